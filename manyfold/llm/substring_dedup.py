"""Removal of repeated passages through difference-cover anchors.

Let D be a difference cover modulo p: for any two positions some shift below p brings both onto D. Hashes of runs of
``window - p + 1`` words are taken only at word positions that are in D modulo p; two equal windows then share an
aligned pair of such anchors. Documents are dealt into blocks by a hash of their id:

1. every block sends each of its distinct anchors once to a bucket of the hash space (an anchor that repeats within
   the block is known to repeat without that), so a passage that a third of all documents hold adds one entry per
   block and not one per document;
2. anchors that repeat extend: the whole windows around them, by 128-bit hashes, again each distinct window once per
   block with its first place, meet in buckets that find the first place of all;
3. every block removes the words of its windows that also start earlier.

The three steps read the same exchange of the texts by block. Numbers travel as compressed columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import keyed, pack, partitions, text_chunks, unpack, unpack_all, window_hashes, word_hashes, word_spans

#: Perfect difference sets: modulus -> residues; every difference occurs.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9)}
_MESSAGE = pa.schema([("bucket", pa.int32()), ("src", pa.int32()), ("payload", pa.binary())])
_REPLY = pa.schema([("block", pa.int32()), ("payload", pa.binary())])
_SUB = 40  # bits of a word position; above them, the row's number among rows of the same id


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least 4 words."""
    period = max((p for p in COVERS if window - p + 1 >= 4), default=1)
    return period, COVERS.get(period, (0,))


class _Block:
    """The texts of a block in order of (id, text), with words and hashes of a run of texts at a time."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, sort_keys=[("_id", "ascending"), ("_text", "ascending")])
        self.table = table.take(order)
        self.ids = self.table.column("_id").to_numpy()
        n = np.arange(len(self.ids))
        first = np.concatenate(([True], self.ids[1:] != self.ids[:-1])) if len(n) else np.zeros(0, bool)
        self.sub = (n - np.maximum.accumulate(np.where(first, n, 0))) << _SUB

    def runs(self):
        """(first row, bytes, offsets, word starts, word ends, first word of each text, text of each word)."""
        for row, data, offsets in text_chunks(self.table.column("_text")):
            start, end, first = word_spans(data, offsets)
            yield row, data, offsets, start, end, first, np.repeat(np.arange(len(first) - 1), np.diff(first))

    def rows_of(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids) + (places >> _SUB)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the 64-bit hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _messages(block: int, buckets: int, keys: list[np.ndarray], ids: np.ndarray, places: np.ndarray, others_only: bool) -> pa.Table:
    """The first place of each distinct key to the key's bucket; places that repeat within the block back to the block.

    keys: sorted, equal ones in order of place. others_only: of those that repeat, not the first.
    """
    out: list[tuple[int, bytes]] = []
    if len(ids):
        same = np.ones(len(ids) - 1, bool)
        for k in keys:
            same &= k[1:] == k[:-1]
        later = np.concatenate(([False], same))
        first = np.flatnonzero(~later)
        cuts = np.searchsorted(_bucket(keys[0][first], buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            part = first[cuts[b] : cuts[b + 1]]
            out.append((int(b), pack(*(k[part] for k in keys), ids[part], places[part])))
        local = later if others_only else later | np.concatenate((same, [False]))
        if local.any():
            out.append((buckets + block, pack(ids[local], places[local])))
    return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())], schema=_MESSAGE)


def _replies(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], schema=_REPLY)


def repeated_windows(docs: DataFrame, window: int, id_col: str, text_col: str):
    """(source by block, replies): replies hold the places of windows that also start earlier."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    blocks = 4 * buckets  # several to a partition, which evens partitions out; a block is in memory at a time
    period, residues = cover_of(window)
    length = window - period + 1
    in_cover = np.zeros(period, bool)
    in_cover[list(residues)] = True
    source = keyed(docs, id_col, text_col).select(F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("block"), "_id", "_text")

    def anchors(table: pa.Table) -> pa.Table:
        block = _Block(table)
        found: list[tuple[np.ndarray, ...]] = []
        for row, data, _, start, end, first, text in block.runs():
            hashes = window_hashes(word_hashes(data, start, end), length)
            word = np.arange(len(hashes))
            text = text[: len(hashes)]
            place = word - first[text]
            words = first[text + 1] - first[text]
            at = np.flatnonzero(in_cover[place % period] & (place + length <= words) & (words >= window))
            rows = row + text[at]
            found.append((hashes[at] >> np.uint64(16) << np.uint64(16), block.ids[rows], block.sub[rows] + place[at]))
        keys, ids, places = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        return _messages(int(table.column("block")[0].as_py()), buckets, [keys[order] >> np.uint64(16) << np.uint64(16)], ids[order], places[order], False)

    def meet_anchors(table: pa.Table) -> pa.Table:
        bucket, sources, payloads = table.column("bucket")[0].as_py(), table.column("src").to_pylist(), table.column("payload").to_pylist()
        if bucket >= buckets:
            return _replies(list(zip(sources, payloads, strict=True)))
        parts = [unpack(p, np.uint64, np.int64, np.int64) for p in payloads]
        hashes = np.sort(np.concatenate([p[0] for p in parts]))
        again = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
        out = []
        for src, (h, ids, places) in zip(sources, parts, strict=True):
            hit = np.isin(h, again, assume_unique=True)
            if hit.any():
                out.append((src, pack(ids[hit], places[hit])))
        return _replies(out)

    def windows(key, texts: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(texts) or not len(hits):
            return _MESSAGE.empty_table()
        block = _Block(texts)
        ids, places = unpack_all(hits.column("payload").to_pylist(), np.int64, np.int64)
        rows = block.rows_of(ids, places)
        order = np.argsort(rows, kind="stable")
        rows, places = rows[order], (places & ((1 << _SUB) - 1))[order]
        found: list[tuple[np.ndarray, ...]] = []
        for row, data, _, start, end, first, text in block.runs():
            n = len(first) - 1
            mine = slice(*np.searchsorted(rows, (row, row + n)))
            if mine.start == mine.stop:
                continue
            of, place = rows[mine] - row, places[mine]
            low = first[of] + np.maximum(place - (window - length), 0)
            high = np.minimum(first[of] + place, first[of + 1] - window)  # the last start
            near = np.zeros(len(start) + 1, np.int32)
            np.add.at(near, low, 1)
            np.add.at(near, high + 1, -1)
            at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            # two hashes of the window, each from word hashes of its own
            one = window_hashes(word_hashes(data, start, end), window)
            two = window_hashes(word_hashes(data, start, end, seed=7), window, 0x2545F4914F6CDD1D)
            texts_of = row + text[at]
            found.append((one[at], two[at], block.ids[texts_of], block.sub[texts_of] + at - first[text[at]]))
        if not found:
            return _MESSAGE.empty_table()
        one, two, ids, places = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((two, one))
        return _messages(key[0].as_py(), buckets, [one[order], two[order]], ids[order], places[order], True)

    def meet_windows(table: pa.Table) -> pa.Table:
        bucket, sources, payloads = table.column("bucket")[0].as_py(), table.column("src").to_pylist(), table.column("payload").to_pylist()
        if bucket >= buckets:
            return _replies(list(zip(sources, payloads, strict=True)))
        parts = [unpack(p, np.uint64, np.uint64, np.int64, np.int64) for p in payloads]
        src = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        one, two, ids, places = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((places, ids, two, one))
        one, two = one[order], two[order]
        later = order[1:][(one[1:] == one[:-1]) & (two[1:] == two[:-1])]
        later = later[np.argsort(src[later], kind="stable")]
        cuts = np.searchsorted(src[later], np.arange(len(parts) + 1))
        return _replies([(sources[k], pack(ids[x], places[x])) for k in range(len(parts)) if len(x := later[cuts[k] : cuts[k + 1]])])

    message, reply = "bucket int, src int, payload binary", "block int, payload binary"
    repeated = source.groupBy("block").applyInArrow(anchors, message).groupBy("bucket").applyInArrow(meet_anchors, reply)
    later = source.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(windows, message).groupBy("bucket").applyInArrow(meet_windows, reply)
    return source, later


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, n_words, n_removed, kept_text.

    Words are [^ \\t-\\r]+. A word goes if a window of ``window`` words that covers it equals one that starts earlier:
    in a document of a smaller id, or earlier in the same one (overlapping or not). Windows are judged on the input.
    Kept words are joined by one space. Rows that share an id count as different documents in order of their texts. A
    document without words, null or shorter than a window loses nothing.
    """
    source, later = repeated_windows(docs, window, id_col, text_col)

    def remove(_, texts: pa.Table, hits: pa.Table) -> pa.Table:
        block = _Block(texts)
        ids, places = unpack_all(hits.column("payload").to_pylist(), np.int64, np.int64)
        rows = block.rows_of(ids, places)
        order = np.argsort(rows, kind="stable")
        rows, places = rows[order], (places & ((1 << _SUB) - 1))[order]
        words, gone, kept = [], [], []
        for row, data, offsets, start, end, first, text in block.runs():
            n = len(first) - 1
            mine = slice(*np.searchsorted(rows, (row, row + n)))
            cover = np.zeros(len(start) + 1, np.int32)
            at = first[rows[mine] - row] + places[mine]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            lost = np.cumsum(cover[:-1]) > 0
            stay = np.flatnonzero(~lost)
            bytes_in = np.zeros(len(data) + 1, np.int8)
            bytes_in[start[stay]] = 1
            bytes_in[end[stay]] -= 1
            keep = np.cumsum(bytes_in[:-1], dtype=np.int8) > 0
            joint = end[stay[:-1][text[stay[1:]] == text[stay[:-1]]]]  # after each kept word but a text's last
            data = data.copy()
            data[joint] = 32
            keep[joint] = True
            cuts = np.concatenate(([0], np.cumsum(keep)))[offsets]
            counts = np.concatenate(([0], np.cumsum(lost)))[first]
            words.append(np.diff(first))
            gone.append(np.diff(counts))
            kept.append(pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data[keep])]))
        if not words:
            return pa.table([block.table.column("_id"), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])
        return pa.table([block.table.column("_id"), np.concatenate(words), np.concatenate(gone), pa.chunked_array(kept)], names=["_id", "n_words", "n_removed", "kept_text"])

    return source.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(remove, "_id long, n_words long, n_removed long, kept_text string")


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM s),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE r > 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
o AS (SELECT p.doc_id, count(*) AS n_words, count(g.p) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY p.p) FILTER (g.p IS NULL), '') AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""

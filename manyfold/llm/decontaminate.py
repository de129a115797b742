"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Words are the symbols. A window within k edits of an item of L words keeps at least L - 1 - 2k of the item's word
pairs; places with fewer benchmark pairs than that can't match and aren't embedded (nothing is lost by this). At every
other place a window starts, sized by a class of item lengths. The CGK embedding walks the window, staying at or
leaving each symbol by a random bit that depends on step and symbol, so windows at a small edit distance agree at most
steps. Each of several repetitions samples a few steps; windows and items that agree there are candidates, whose edit
distance is then computed exactly. Items of more than PIECE words are searched by pieces: one piece at least has no more
than its own share of the edits, so recall doesn't fall with an item's length. The whole item is verified. Items of one word are
found by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import NOT_ALNUM, keyed, mix, text_chunks, window_hashes, word_hashes, word_spans, written

REPETITIONS = 24
SAMPLED = 3
#: Share of an item's words that may be edited.
EDITS = 0.2
#: Words of a piece of an item, at most; longer items are searched by pieces of nearly equal length.
PIECE = 30
#: Items, and bytes of their texts (but for a single item that is longer), embedded and sent to the executors at a time.
ITEMS = 4096
BYTES = 4 << 20
#: Blocks of items that one pass over the documents holds, at most.
BLOCKS = 16
_PAIR_BITS = 20
#: Scripts written without spaces, in which every character counts as a word, and their marks, which separate.
_UNSPACED = r"([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}])"
_MARKS = r"[\x{3000}-\x{303F}\x{30FB}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]"


def words_of(column) -> list[np.ndarray]:
    """Hashes of the words of each text: lower-cased runs of letters, digits and non-ASCII characters, and the single
    characters of scripts without spaces."""
    out = []
    for _, _, first, hashes in _runs(column):
        out.extend(hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True))
    return out


def _runs(column):
    for row, data, offsets in text_chunks(_spaced(pc.utf8_lower(column))):
        start, end, first = word_spans(data, offsets, NOT_ALNUM)
        yield row, len(first) - 1, first, word_hashes(data, start, end)


def _spaced(column):
    lead = (np.uint8(0xE0), np.uint8(0xE1))  # first bytes of the scripts' characters in UTF-8; from 0xE3 on all others
    if any((data >= 0xE3).any() or np.isin(data, lead).any() for _, data, _ in text_chunks(column)):
        column = pc.replace_substring_regex(pc.replace_substring_regex(column, _MARKS, " "), _UNSPACED, r" \1 ")
    return column


def edits_allowed(length: int, share: float = EDITS) -> int:
    return int(share * length)


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, repetition: int) -> np.ndarray:
    """CGK walks from all starts, side by side: the symbol read at each step (0 from the end on)."""
    at = starts.copy()
    out = np.zeros((steps, len(starts)), np.uint64)
    padded = np.append(words, np.uint64(0))
    for j in range(steps):
        symbol = np.where(at < ends, padded[np.minimum(at, len(words))], np.uint64(0))
        out[j] = symbol
        at += (mix(symbol + np.uint64((repetition << 20) + j + 1)) & np.uint64(1)).astype(np.int64)
    return out


def nearest(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the stretch of words that is nearest to the item."""
    steps = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for k, symbol in enumerate(item.tolist(), 1):
        other = np.minimum(row[1:] + 1, row[:-1] + (words != np.uint64(symbol)))
        row = np.minimum.accumulate(np.concatenate(([k], other)) - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


class Benchmark:
    """The items of one block, their word pairs, their pieces and the keys of the pieces' embeddings."""

    def __init__(self, ids: list[int | None], texts: list[str | None], share: float = EDITS):
        words = list(zip(ids, words_of(pa.array([t or "" for t in texts], pa.string())), strict=True))
        single = sorted((int(w[0]), k) for k, (_, w) in enumerate(words) if len(w) == 1)
        self.single, self.single_ids = np.array([h for h, _ in single], np.uint64), [words[k][0] for _, k in single]
        items = [(i, w) for i, w in words if len(w) >= 2]
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.edits = [edits_allowed(len(w), share) for w in self.words]
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        for w in self.words:
            self.pairs[window_hashes(w, 2) >> np.uint64(64 - _PAIR_BITS)] = True
        self.pieces: list[tuple[int, int, np.ndarray]] = []  # item, first word in it, words
        for k, w in enumerate(self.words):
            cuts = [len(w) * c // -(-len(w) // PIECE) for c in range(-(-len(w) // PIECE) + 1)]
            self.pieces.extend((k, a, w[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.classes: list[dict] = []
        lengths = sorted({len(w) for _, _, w in self.pieces})
        while lengths:
            low = lengths[0]
            inside = [n for n in lengths if n <= low * 1.15]
            lengths = lengths[len(inside) :]
            self.classes.append(self._length_class(low, inside[-1], share))

    def _length_class(self, low: int, high: int, share: float) -> dict:
        members = [k for k, (_, _, w) in enumerate(self.pieces) if low <= len(w) <= high]
        steps = 2 * low
        rng = np.random.default_rng(low)
        samples = [np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False)) for _ in range(REPETITIONS)]
        flat = np.concatenate([self.pieces[k][2] for k in members])
        ends = np.cumsum([len(self.pieces[k][2]) for k in members])
        starts = ends - [len(self.pieces[k][2]) for k in members]
        keys = []
        for r, sample in enumerate(samples):
            key = self._key(embed(flat, starts, ends, int(sample[-1]) + 1, r)[sample])
            order = np.argsort(key, kind="stable")
            keys.append((key[order], np.array(members)[order]))
        need = min(max(1, n - 1 - 2 * edits_allowed(n, share)) for n in range(low, high + 1))
        return {"low": low, "high": high, "window": high + edits_allowed(high, share), "need": need, "samples": samples, "keys": keys}

    @staticmethod
    def _key(symbols: np.ndarray) -> np.ndarray:
        key = np.zeros(symbols.shape[1], np.uint64)
        for row in symbols:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        return key

    def _candidates(self, words, starts, end_of, dense, text, near) -> None:
        mine = [np.flatnonzero(d[starts]) for d in dense]
        steps = max(int(s[-1]) + 1 for c, own in zip(self.classes, mine, strict=True) if len(own) for s in c["samples"])
        for r in range(REPETITIONS):
            walk = embed(words, starts, end_of[starts], steps, r)
            for c, own in zip(self.classes, mine, strict=True):
                if not len(own):
                    continue
                keys, members = c["keys"][r]
                key = self._key(walk[c["samples"][r]][:, own])
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for k in np.flatnonzero(hi > lo).tolist():
                    start = int(starts[own[k]])
                    for m in members[lo[k] : hi[k]].tolist():
                        item, offset, _ = self.pieces[m]
                        near.setdefault((int(text[start]), item), []).append(start - offset)

    def _single_words(self, row: int, first: np.ndarray, words: np.ndarray, text: np.ndarray) -> list[tuple]:
        """The first place of each item of one word in each text that has it."""
        lo, hi = np.searchsorted(self.single, words, "left"), np.searchsorted(self.single, words, "right")
        found: dict[tuple[int, int], int] = {}
        for at in np.flatnonzero(hi > lo).tolist():
            for k in range(int(lo[at]), int(hi[at])):
                found.setdefault((int(text[at]), k), at - int(first[text[at]]))
        return [(row + t, self.single_ids[k], 0, place, 1) for (t, k), place in found.items()]

    def find(self, column) -> list[tuple[int, int | None, int, int, int]]:
        """(row, item id, edits, first word, words) of the texts' nearest stretch to each item they hold."""
        out = []
        for row, n, first, words in _runs(column):
            if not len(words):
                continue
            text = np.repeat(np.arange(n), np.diff(first))
            if len(self.single):
                out.extend(self._single_words(row, first, words, text))
            if not self.ids:
                continue
            end_of = first[1:][text]
            flag = np.zeros(len(words), bool)
            flag[:-1] = self.pairs[window_hashes(words, 2) >> np.uint64(64 - _PAIR_BITS)] & (text[1:] == text[:-1])
            total = np.concatenate(([0], np.cumsum(flag)))
            places = np.arange(len(words))
            near: dict[tuple[int, int], list[int]] = {}
            dense = []
            for c in self.classes:
                stop = np.minimum(places + c["window"] - 1, end_of)
                dense.append(total[np.maximum(stop, places)] - total[:-1] >= c["need"])
            every = np.flatnonzero(np.logical_or.reduce(dense))
            for k in range(0, len(every), 8192):  # walks are shared by all classes
                self._candidates(words, every[k : k + 8192], end_of, dense, text, near)
            for (t, m), starts in near.items():
                item, edits = self.words[m], self.edits[m]
                best = None
                starts = sorted(set(starts))
                region = [starts[0], starts[0]]
                for s in [*starts[1:], None]:
                    if s is not None and s <= region[1] + len(item):
                        region[1] = s
                        continue
                    low, high = max(int(first[t]), region[0] - len(item)), min(int(first[t + 1]), region[1] + 2 * len(item))
                    distance, end = nearest(item, words[low:high])
                    if distance <= edits and (best is None or distance < best[0]):
                        back, length = nearest(item[::-1], words[low : low + end][::-1][: len(item) + edits])
                        best = (distance, low + end - length - int(first[t]), length)
                    region = [s, s]
                if best:
                    out.append((row + t, self.ids[m], *best))
        return out


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = ITEMS, share: float = EDITS) -> Iterator[Benchmark]:
    """The items in blocks of a bounded number and length, in the order of ids (null first); the driver reads and holds
    one block at a time. Items without a word are left out."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    held = 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy(F.asc_nulls_first("i"), "t").toLocalIterator():
        more = len((r.t or "").encode())
        if ids and (len(ids) == size or held + more > BYTES):
            yield Benchmark(ids, texts, share)
            ids, texts, held = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        held += more
    if ids:
        yield Benchmark(ids, texts, share)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = EDITS) -> DataFrame:
    """(_id, item_id, edits, first_word, n_words): a row for each document and benchmark item that it holds.

    A document holds an item if some stretch of its words is within floor(share * words of the item) edits of it;
    edits and place are those of the nearest stretch found. Items without a word are never reported, items of one word
    wherever it is, items without an id with a null; of items with equal texts each is. The recall of the candidate
    search is set by REPETITIONS, SAMPLED and PIECE, and what is found is verified exactly. The documents are read once
    per block of items; no shuffle. Null texts are empty; an empty table on either side gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    parts = []
    spark = docs.sparkSession
    for block in blocks_of(benchmark, share=share):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sent.value.find(batch.column(1))
                take = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([take, *rest], names=["_id", "item_id", "edits", "first_word", "n_words"])

        parts.append(rows.mapInArrow(search, "_id long, item_id long, edits long, first_word long, n_words long"))
    if not parts:
        return spark.createDataFrame([], "_id long, item_id long, edits long, first_word long, n_words long")
    return reduce(DataFrame.unionByName, parts)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: float = EDITS) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, as find_leaks() has it (items without an id or of one word
    too); columns unchanged, no shuffle or join. Null texts are empty and stay, repeated rows go or stay together; an
    empty table stays empty. A pass over docs holds BLOCKS blocks of items; with more, what is left is written between.
    """
    out = docs
    for k, block in enumerate(blocks_of(benchmark, share=share)):
        if k and k % BLOCKS == 0:
            out = written(out, "clean")
        clean = _cleanness(docs.sparkSession.sparkContext.broadcast(block))
        out = out.filter(clean(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return out


def _cleanness(sent):
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        keep = np.ones(len(text), bool)
        keep[[f[0] for f in sent.value.find(text)]] = False
        return pa.array(keep)

    return clean

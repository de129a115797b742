"""Exact deduplication by two-pass Bloom filtering; DataFrame functions only.

Pass one makes the filter. Every row sets two bits of one 64-bit word, both chosen by the hash of its text. A partition
sums its rows up by word before anything moves: for each of a few groups of rows, the bits that were set (``bit_or``)
and the number of rows. So a task sends at most one record for each word of the filter, however often a text repeats in
it, and no row. Meeting words give the second array, the bits that were set again: a bit set in two groups, and the
bits of a group in which fewer bits than two for each row came out.

Pass two tests every row where it is: a row whose two bits weren't both set again has no equal and passes straight
through; only the others ("possibly repeated") are grouped by their SHA-256. Texts never shuffle. False positives of the
filter cost a little shuffle and change nothing. A filter of more words than are broadcast at once is split by word
into ranges; rows' hashes are written by range and each range is tested against its own part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import NULL_ID, given_id, ids_side, keyed, written


BITS_PER_ROW = 32
#: Words of the filter in one range, which are broadcast together, at most (16 bytes each, 32 MB).
BROADCAST_WORDS = 2_000_000
#: Groups and rows with their hashes (some 120 bytes each) that are broadcast, at most.
BROADCAST_ROWS = 300_000
_GROUPS = 4


class _Filter:
    """Pass one: the bits of a Bloom filter that were set more than once, as a table (_range, _word, _again)."""

    def __init__(self, rows: DataFrame, bits_per_row: int, broadcast_words: int):
        self.n_words = 1 << max(4, (bits_per_row * max(1, rows.count()) // 64).bit_length())
        self.ranges = -(-self.n_words // broadcast_words)
        group = F.pmod(F.xxhash64("_id"), F.lit(_GROUPS))
        bits = rows.select(*self.place(), group.alias("_group"))
        sums = [a for k in range(_GROUPS) for a in (F.bit_or(F.when(F.col("_group") == k, F.col("_mask"))).alias(f"_o{k}"), F.count_if(F.col("_group") == k).alias(f"_n{k}"))]
        words = bits.groupBy("_range", "_word").agg(*sums)
        once = again = F.lit(0).cast("long")
        for k in range(_GROUPS):
            mine = F.coalesce(f"_o{k}", F.lit(0).cast("long"))
            twice = F.when(F.bit_count(mine) < 2 * F.col(f"_n{k}"), mine).otherwise(F.lit(0).cast("long"))
            again = again.bitwiseOR(once.bitwiseAND(mine)).bitwiseOR(twice)
            once = once.bitwiseOR(mine)
        self.words = written(words.select("_range", "_word", again.alias("_again")).filter("_again != 0"), "bloom-words")

    def place(self) -> list[Column]:
        """_range, _word and _mask of a row with _text; the mask's two bits differ."""
        h = F.xxhash64("_text")
        word = h.bitwiseAND(F.lit(self.n_words - 1))
        one = F.shiftrightunsigned(h, 58)
        two = (one + 1 + F.pmod(F.shiftrightunsigned(h, 40), F.lit(63))) % 64
        bit = [F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) for b in (one, two)]
        return [F.pmod(word, F.lit(self.ranges)).cast("int").alias("_range"), word.alias("_word"), bit[0].bitwiseOR(bit[1]).alias("_mask")]

    def tested(self, rows: DataFrame, of: int | None = None) -> DataFrame:
        """Pass two: rows with _word and _mask get _maybe, whether both bits were set more than once; words of one range."""
        words = self.words if of is None else self.words.filter(F.col("_range") == of)
        words = words.select(F.col("_word").alias("_w"), "_again")
        keep = [c for c in rows.columns if c not in ("_range", "_word", "_mask")]
        found = rows.join(F.broadcast(words), F.col("_word") == F.col("_w"), "left")
        return found.select(*keep, F.coalesce(F.col("_again").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)).alias("_maybe"))

    def marked(self, rows: DataFrame) -> DataFrame:
        """(_id, _sha, _maybe) of every row, written."""
        hashed = rows.select("_id", F.unhex(F.sha2("_text", 256)).alias("_sha"), *self.place())
        if self.ranges == 1:
            return written(self.tested(hashed), "bloom-marked")
        hashed = written(hashed, "row-hashes", partition="_range")
        parts = [written(self.tested(hashed.filter(F.col("_range") == r), r), "bloom-marked") for r in range(self.ranges)]  # one range's words at a time
        return reduce(DataFrame.unionByName, parts)


def _verdict(rows: DataFrame, seen: _Filter) -> DataFrame:
    """(_id, _sha, _keep, _n) of each row: who stays of its text, and how many have it."""
    marked = seen.marked(rows)
    maybe = marked.filter("_maybe").select("_id", "_sha")
    groups = maybe.groupBy(F.col("_sha").alias("_g")).agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Few groups are broadcast, so that the rows of a common text stay spread; many are joined by a skew-aware shuffle.
    groups = ids_side(written(groups, "equal-texts"), BROADCAST_ROWS)
    grouped = maybe.join(groups, F.col("_sha") == F.col("_g"), "left").select(
        "_id", "_sha", F.coalesce("_keep", "_id").alias("_keep"), F.coalesce("_n", F.lit(1).cast("long")).alias("_n")
    )
    single = marked.filter("not _maybe").select("_id", "_sha", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"))
    return single.unionByName(grouped)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per input row: _id, keep_id, group_size, kept, text_sha256.

    Equal texts (null is empty) form a group; its row with the largest id stays. Rows that share both text and
    largest id (the same row given twice) count in group_size and are all marked kept, as no id tells them apart.
    The filter is tested in ranges of at most broadcast_words words.
    """
    rows = keyed(docs, id_col, text_col)
    return _verdict(rows, _Filter(rows, bits_per_row, broadcast_words)).select(
        "_id",
        given_id("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id") == F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """docs without the rows whose text a row with a larger id has, columns unchanged; a row given twice stays twice.

    Null ids count as the smallest id, null texts as empty; an empty table stays empty. Rows that the filter clears
    stay where they are; only possibly repeated ones meet the list of (id, text hash) that go, which is broadcast up to
    BROADCAST_ROWS. With a filter of several ranges, all rows meet that list.
    """
    rows = keyed(docs, id_col, text_col)
    seen = _Filter(rows, bits_per_row, broadcast_words)
    gone = _verdict(rows, seen).filter("_id != _keep").select(F.col("_id").alias("_gone"), F.col("_sha").alias("_gone_sha")).distinct()
    gone = ids_side(written(gone, "copies"), BROADCAST_ROWS)
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
    )
    kept = []
    if seen.ranges == 1:
        marked = seen.tested(whole.select("*", *seen.place()))
        kept.append(marked.filter("not _maybe").select("_row.*"))
        whole = marked.filter("_maybe")
    sha = F.unhex(F.sha2("_text", 256))
    kept.append(whole.join(gone, (F.col("_id") == F.col("_gone")) & (sha == F.col("_gone_sha")), "left_anti").select("_row.*"))
    return kept[0].unionAll(kept[1]) if len(kept) > 1 else kept[0]


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

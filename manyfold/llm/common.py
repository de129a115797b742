"""Helpers that the training-data operators share: ids, written tables, vectorised words.

Conventions that hold for every operator here:

* a null ``doc_id`` counts as the smallest possible id and is given back as null;
* a null text is an empty text;
* only the id and text columns are read, under names of the operator's own, so further
  columns of the input may have any name;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text) without nulls.

    Whole texts make wide rows: unless the session says otherwise, Arrow batches are set to 2,048 rows of them.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, "2048")
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )


def given_id(column: str | Column) -> Column:
    """The id as it was given: null for the stand-in."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != F.lit(NULL_ID), c)


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, everything else as it is; lower() alone is right for pure ASCII."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, _ASCII_UPPER, _ASCII_UPPER.lower())
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder (driver and executors are one process there); on a
    cluster that is an error, as every executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="manyfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders written by this process, in order.
_tables: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/manyfold/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    return len(_tables)


def remove_written(spark: SparkSession, since: int, until: int) -> None:
    """Removes the tables number since to until - 1 of this process; only for those that no unread result needs."""
    hadoop = spark._jsc.hadoopConfiguration()
    for path in _tables[since:until]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


#: Rows of ids (some 40 bytes each once hashed) that are broadcast, at most.
BROADCAST_IDS = 1_000_000


def ids_side(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids as the side of a join with texts: broadcast if it is counted to be small, so that the
    texts stay in place; otherwise left to a shuffled join."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def partitions(spark: SparkSession) -> int:
    """Buckets and blocks follow the session's shuffle partitions, which are set from the size of the data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- vectorised words --------------------------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19
_ROWS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=8)
def _byte_values(fold_case: bool, seed: int) -> np.ndarray:
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    if fold_case:
        values[65:91] = values[97:123]
    return values


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(_CHUNK + 1, n)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                p[filled : filled + step] = p[:step] * np.uint64(pow(b, filled, 1 << 64))
                filled += step
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_chunks(column: pa.Array, limit: int = _CHUNK):
    """(first row, bytes, offsets) of runs of whole texts, of about limit bytes and a bounded number; a longer text is
    a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n, first + _ROWS)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: ASCII bytes that are neither letters nor digits: the separators of plain words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^ \\t-\\r]+ and, for each text, the number of its first word (n + 1 entries)."""
    inside = np.concatenate(([False], ~separators[data], [False]))
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


_WORD_BASE = 0xD1342543DE82EF95


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False, seed: int = 20260101) -> np.ndarray:
    """64-bit hashes of the words, by sums of byte values times powers; words are in order and don't overlap.

    Sums are taken over pieces of a bounded length, so that tables and sums don't grow with the longest text.
    """
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    values = _byte_values(fold_case, seed)
    power, inverse = powers(_WORD_BASE, _CHUNK + 1)
    for at in range(0, len(data), _CHUNK):
        size = min(_CHUNK, len(data) - at)
        a, b = np.searchsorted(end, at, "right"), np.searchsorted(start, at + size, "left")
        if a >= b:
            continue
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[at : at + size]] * power[:size], out=sums[1:])
        first, last = np.maximum(start[a:b] - at, 0), np.minimum(end[a:b] - at, size)
        part = (sums[last] - sums[first]) * inverse[first]
        if start[a] < at:  # a word that began in an earlier piece
            part[:1] *= np.uint64(pow(_WORD_BASE, int(at - start[a]), 1 << 64))
        out[a:b] += part
    return mix(out + (end - start).astype(np.uint64) * _MULT)


def window_hashes(words: np.ndarray, size: int, base: int = 0xF1357AEA2E62A9C5) -> np.ndarray:
    """Hashes of all runs of size words (len(words) - size + 1 of them), in pieces of a bounded number of words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    room = max(_CHUNK, 2 * size)
    power, inverse = powers(base, room + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, room - size + 1):
        part = words[at : at + room]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * power[: len(part)], out=sums[1:])
        out[at : at + len(part) - size + 1] = (sums[size:] - sums[:-size]) * inverse[: len(part) - size + 1]
    return mix(out)


# --- columns of numbers as one binary value -----------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Equally long arrays as one compressed value, byte planes apart (high bytes repeat and shrink)."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns]
    raw = b"".join(planes)
    return n.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(value: bytes, *types) -> list[np.ndarray]:
    n = int.from_bytes(value[:8], "little")
    sizes = [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(value[8:], decompressed_size=n * sum(sizes), codec="zstd"), np.uint8)
    out, at = [], 0
    for t, size in zip(types, sizes, strict=True):
        plane = raw[at : at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).view(t).reshape(n))
        at += n * size
    return out


def unpack_all(values, *types) -> list[np.ndarray]:
    parts = [unpack(v, *types) for v in values]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(types)]

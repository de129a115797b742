"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A record's virtual slot is a hash of its id and text modulo a fixed number of slots and never changes. Bytes and rows
are summed per slot (at most ``slots`` rows, the only thing the driver sees). The map says which shard holds which slot;
version 1 deals slots round robin and every edit (evening out, growing, shrinking) is a further version that moves as
few slots as it can, so that a reader of an older version still finds its records. Versions are stored in a folder, one
below the other; a later call loads the last one and edits it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyfold.llm.common import NULL_ID, keyed, new_path, written

SLOTS = 4096
#: Shards count as even once the fullest and the emptiest differ by at most this share of the mean.
SLACK = 0.002


class SlotMap:
    """versions[k] is the list slot -> shard of version first + k; version numbers start at 1."""

    def __init__(self, slots: int, shards: int, start: list[int] | None = None, first: int = 1):
        self.versions: list[list[int]] = [start or [s % shards for s in range(slots)]]
        self.shards, self.first = shards, first

    @property
    def version(self) -> int:
        return self.first + len(self.versions) - 1

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def rebalance(self, weight: list[int], shards: int | None = None) -> int:
        """A new version with near equal weights on the shards; gives the number of slots moved.

        Slots of shards beyond the new number move first. Then the fullest shard hands the emptiest one the slot
        that comes nearest to half their difference, for as long as that narrows the difference and the shards aren't
        even. Without anything to move and with as many shards as before there is no new version.
        """
        before = self.shards
        old, self.shards = self.current, shards or self.shards
        held: list[list[int]] = [[] for _ in range(self.shards)]
        homeless = []
        for slot, shard in enumerate(old):
            (held[shard] if shard < self.shards else homeless).append(slot)
        load = [sum(weight[s] for s in slots) for slots in held]
        heap = [(load[k], k) for k in range(self.shards)]
        heapq.heapify(heap)
        for slot in sorted(homeless, key=lambda s: (-weight[s], s)):
            _, k = heapq.heappop(heap)
            held[k].append(slot)
            load[k] += weight[slot]
            heapq.heappush(heap, (load[k], k))
        for _ in range(4 * len(old)):
            top = max(range(self.shards), key=lambda k: (load[k], -k))
            low = min(range(self.shards), key=lambda k: (load[k], k))
            gap = load[top] - load[low]
            if gap <= SLACK * sum(load) / self.shards:
                break
            fit = [s for s in held[top] if 0 < weight[s] < gap]
            if not fit:
                break
            slot = min(fit, key=lambda s: (abs(weight[s] - gap / 2), s))
            held[top].remove(slot)
            held[low].append(slot)
            load[top] -= weight[slot]
            load[low] += weight[slot]
        new = list(old)
        for k, slots in enumerate(held):
            for s in slots:
                new[s] = k
        moved = sum(a != b for a, b in zip(old, new, strict=True))
        if moved or before != self.shards:
            self.versions.append(new)
        return moved

    def frame(self, spark: SparkSession) -> DataFrame:
        """The versions as a table (slots x versions rows)."""
        rows = [(v, self.shards, s, k) for v, m in enumerate(self.versions, self.first) for s, k in enumerate(m)]
        return spark.createDataFrame(rows, _STORED)

    def store(self, spark: SparkSession, path: str) -> None:
        """Writes the versions that the folder lacks, each as a table of its own; a version is never overwritten."""
        have = _stored_versions(spark, path)
        for v in range(self.first, self.version + 1):
            if v not in have:
                self.frame(spark).filter(F.col("version") == v).coalesce(1).write.parquet(f"{path}/v{v}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The last version in the folder, or a given one; None of an empty folder."""
        have = _stored_versions(spark, path)
        if not have:
            return None
        version = version or max(have)
        rows = spark.read.schema(_STORED).parquet(f"{path}/v{version}").orderBy("virtual_slot").collect()
        return cls(len(rows), rows[0].shards, [r.shard for r in rows], version)


_STORED = "version int, shards int, virtual_slot int, shard int"


def _stored_versions(spark: SparkSession, path: str) -> set[int]:
    """Versions that were written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return set()
    folders = [f.getPath() for f in files.listStatus(at)]
    return {int(f.getName()[1:]) for f in folders if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))}


def _virtual_slot(row_id, text, slots: int):
    """Rows without an id, or with a common one, are spread by their texts."""
    return F.pmod(F.xxhash64(row_id, text), F.lit(slots)).cast("int")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """(rows, map). Rows: _id, size, text_crc32, virtual_slot, shard, slot; one per input row.

    size is the text's UTF-8 bytes plus 1 (null: 1). slot is the row's place in its shard, without gaps from 0, in
    order of virtual slot and id; equal rows take any order. The sizes of the shards come near each other as far as
    single slots allow; rows alike in id and text share a slot. map_path: the folder of the map's versions; the last one
    there is loaded, edited and stored as the next (without a path: a new folder under the shared one). A stored map
    keeps its number of slots. Null ids count as the smallest id, null texts as empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = map_path or new_path(spark, "slot-map")
    slot_map = SlotMap.load(spark, path) or SlotMap(slots, shards)
    slots = len(slot_map.current)
    rows = keyed(docs, id_col, text_col)
    sized = written(
        rows.select(
            "_id",
            (F.octet_length("_text") + 1).cast("long").alias("size"),
            F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"),
            _virtual_slot("_id", "_text", slots).alias("virtual_slot"),
        ),
        "sized",
    )
    weight, count = [0] * slots, [0] * slots
    for r in sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        weight[r[0]], count[r[0]] = r.b, r.n
    slot_map.rebalance(weight, shards)
    slot_map.store(spark, path)
    first, filled = [], [0] * shards
    for s, k in enumerate(slot_map.current):
        first.append((s, k, filled[k]))
        filled[k] += count[s]
    schema = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("_first", T.LongType())])
    places = F.broadcast(spark.createDataFrame(first, schema))  # one row per slot, a fixed number
    order = "row_number() OVER (PARTITION BY virtual_slot ORDER BY _id, text_crc32, size)"
    dealt = sized.withColumn("_rank", F.expr(order)).join(places, "virtual_slot")
    return dealt.select("_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("_first") + F.col("_rank") - 1).alias("slot")), slot_map


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, into: str = "shard") -> DataFrame:
    """docs with a further last column: the shard by the balanced map, as shard() gives it.

    The column is named into, with as many underscores in front as it takes to differ from all others. Nulls, repeated
    rows and empty tables are as in shard(); no row is lost or multiplied, and texts don't move.
    """
    _, slot_map = shard(docs, shards, slots, id_col, text_col, map_path)
    while into.lower() in {c.lower() for c in docs.columns}:
        into = "_" + into
    spark = docs.sparkSession
    mapping = F.broadcast(spark.createDataFrame(list(enumerate(slot_map.current)), "_of int, _to int"))  # one row per slot
    row_id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _virtual_slot(row_id, F.coalesce(F.col(f"`{text_col}`"), F.lit("")), len(slot_map.current)).alias("_slot"))
    return whole.join(mapping, F.col("_slot") == F.col("_of")).select("_row.*", F.col("_to").alias(into))

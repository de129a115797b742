"""Line deduplication over levelled sorted runs of line hashes; DataFrame functions only.

The store holds, per level, sorted runs: Parquet tables bucketed and sorted by key, one file to a bucket, so that a join
on the key reads them in order without another exchange or sort. A batch's keys (bucketed alike) are merge-anti-joined
with the runs: keys that no run has go to a new run of first sightings, the others to a new run of repeats. When a level
has ``fanout`` runs of a kind they are merged into one run of the next level. A manifest, written anew after every batch,
lists the runs; a later session opens the store by its folder and adds its own batches. As first sightings are disjoint,
the keys that many documents hold are found from the repeats (few) and the first sightings that were frequent within
their own batch.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyfold.llm.common import SPACES, ascii_lower, ids_side, keyed, new_path, partitions, written

_KEY = ["h1", "h2"]
_RUN = "h1 BIGINT, h2 BIGINT, n_docs BIGINT, last_id BIGINT"
_MANIFEST = "kind string, level int, run string, buckets int"
#: Documents with the positions of their dropped lines that are broadcast, at most.
BROADCAST_DOCS = 300_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(min_chars: int) -> Column:
    """Of _text, an array with a struct (h1, h2) for each line, null for lines with shorter keys."""
    keys = F.transform(F.split("_text", "\n", -1), line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))


class LineRuns:
    """Runs of (h1, h2, n_docs, last_id), sorted by key; two 64-bit hashes stand for a line's key.

    path: the store's folder (a new one under the shared folder where none is given); what a folder holds already is
    opened, with its number of buckets. One writer at a time: a manifest is never overwritten, so of two writers that
    add the same version one fails. Reading runs in order needs the session setting
    spark.sql.legacy.bucketedTableScan.outputOrdering, which is set here.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, path: str | None = None):
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark, self.fanout = spark, fanout
        self.path = path or new_path(spark, "line-runs")
        self.levels: dict[str, list[list[str]]] = {"first": [[]], "again": [[]]}
        self.tables: dict[str, str] = {}
        self.buckets, self.version = partitions(spark), 0
        if path:
            self._open()

    def _open(self) -> None:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        at = jvm.Path(f"{self.path}/manifest")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return
        whole = [f.getPath() for f in files.listStatus(at) if files.exists(jvm.Path(f.getPath(), "_SUCCESS"))]
        self.version = max((int(p.getName()[1:]) for p in whole), default=0)
        if not self.version:
            return
        for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v{self.version}").orderBy("level", "run").collect():
            self.buckets = r.buckets
            self._level(r.kind, r.level).append(r.run)

    def _level(self, kind: str, level: int) -> list[str]:
        levels = self.levels[kind]
        while len(levels) <= level:
            levels.append([])
        return levels[level]

    def _save(self) -> None:
        rows = [(kind, k, run, self.buckets) for kind, levels in self.levels.items() for k, runs in enumerate(levels) for run in runs]
        self.version += 1
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/v{self.version}")

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed and sorted table of this session."""
        if name not in self.tables:
            table = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({_RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = table
        return self.spark.table(self.tables[name])

    def runs(self, kind: str) -> list[DataFrame]:
        return [self.run(name) for level in self.levels[kind] for name in level]

    def _write(self, rows: DataFrame, name: str) -> str:
        """rows as a run: one sorted file to a bucket. A killed job leaves a folder that no manifest lists."""
        name, table = f"{name}-{uuid.uuid4().hex}", f"line_run_{uuid.uuid4().hex}"
        sorted_rows = rows.select(*_KEY, "n_docs", "last_id").repartition(self.buckets, *_KEY).sortWithinPartitions(*_KEY)
        sorted_rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name] = table
        return name

    def novel(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch, bucketed as the runs are, whose keys no run has: a chain of merge joins in place."""
        for run in self.runs("first"):
            batch = batch.join(run.select(*_KEY).hint("merge"), _KEY, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch of distinct keys (h1, h2, n_docs, last_id); gives back the keys that are new to the store."""
        batch = self.run(self._write(batch, "batch"))
        first = bool(self.runs("first"))
        novel = self._write(self.novel(batch), "first")
        if first:
            repeat = batch.join(self.run(novel).select(*_KEY).hint("merge"), _KEY, "left_anti")
            self._put("again", 0, self._write(repeat, "again"))
        self._put("first", 0, novel)
        self._save()
        return self.run(novel)

    def _put(self, kind: str, level: int, name: str) -> None:
        runs = self._level(kind, level)
        runs.append(name)
        if len(runs) >= self.fanout:
            merged = self._merge(reduce(DataFrame.unionByName, [self.run(r) for r in runs]))
            runs.clear()
            self._put(kind, level + 1, self._write(merged, kind))

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))

    def held_by(self, min_docs: int) -> DataFrame:
        """Keys held by at least min_docs documents: (h1, h2, n_docs, last_id)."""
        first, again = self.runs("first"), self.runs("again")
        parts = [run.filter(F.col("n_docs") >= min_docs) for run in first]
        if again:
            repeats = self.run(self._write(self._merge(reduce(DataFrame.unionByName, again)), "repeats"))
            parts += [repeats, *(run.filter(F.col("n_docs") < min_docs).join(repeats.select(*_KEY).hint("merge"), _KEY, "left_semi") for run in first)]
        return self._merge(reduce(DataFrame.unionByName, parts)).filter(F.col("n_docs") >= min_docs)


def line_batch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """The distinct keys of some documents as a batch for a store: (h1, h2, n_docs, last_id). Rows that share an id are one
    document; a document that comes in two batches counts twice."""
    return _keys(keyed(docs, id_col, text_col), min_chars).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("_id").alias("last_id"))


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """(_id, h1, h2): each document's distinct keys, once."""

    def exploded(part: DataFrame) -> DataFrame:
        keys = part.select("_id", F.explode(F.array_distinct(line_hashes(min_chars))).alias("k")).filter("k is not null")
        return keys.select("_id", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))

    repeated = written(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id"), "repeated-ids")
    if not repeated.take(1):
        return exploded(rows)
    repeated = ids_side(repeated)  # only rows that share an id must be told apart
    return exploded(rows.join(repeated, "_id", "left_anti")).unionByName(exploded(rows.join(repeated, "_id", "left_semi")).distinct())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, store: LineRuns | None = None) -> DataFrame:
    """One row per input row: _id, n_lines, n_dropped, kept_text.

    A line's key (stripped, A-Z lower-cased) of at least min_chars code points that at least min_docs documents hold
    loses its lines in all of them but the one with the largest id. Rows that share an id are one document. A null
    or empty text is one empty line. Batches are parts of the corpus by a hash of the id, fed to the store in turn. A
    store that is given may hold the batches of earlier documents, which then count too. A null id counts as the
    smallest; an empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    held = written(
        _keys(rows, min_chars)
        .withColumn("batch", F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int"))
        .groupBy("batch", *_KEY)
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("_id").alias("last_id")),
        "line-keys",
    )
    store = store or LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        store.add(held.filter(F.col("batch") == b).drop("batch"))
    common = ids_side(written(store.held_by(min_docs).select(*_KEY, "last_id"), "line-common"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))  # tells apart different texts under one id
    lines = rows.select("_id", "_hash", F.posexplode(line_hashes(min_chars)).alias("pos", "k")).filter("k is not null")
    dropped = (
        lines.select("_id", "_hash", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        .join(common, _KEY)
        .filter("_id != last_id")
        .groupBy(F.col("_id").alias("_of"), F.col("_hash").alias("_of_hash"))
        .agg(F.collect_set("pos").alias("_gone"))
    )
    dropped = written(dropped, "dropped-lines")
    if (dropped.agg(F.sum(F.size("_gone"))).first()[0] or 0) <= 10 * BROADCAST_DOCS:
        dropped = ids_side(dropped, BROADCAST_DOCS)  # the texts stay in place
    none = F.expr("cast(array() as array<int>)")
    return (
        rows.join(dropped, (F.col("_id") == F.col("_of")) & (F.col("_hash") == F.col("_of_hash")), "left")
        .select("_id", F.split("_text", "\n", -1).alias("_lines"), F.coalesce("_gone", none).alias("_gone"))
        .select(
            "_id",
            F.size("_lines").cast("long").alias("n_lines"),
            F.size("_gone").cast("long").alias("n_dropped"),
            F.when(F.size("_gone") == 0, F.array_join("_lines", "\n"))
            .otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda p: F.col("_lines")[p]), "\n"))
            .alias("kept_text"),
        )
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, c.key IS NOT NULL AND doc_id <> last_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics. Every partition of the training rows sums its
part of the normal equations, per fold; the sums meet by fold and the driver solves systems of a fixed size. Scores
that the other fold's weights give are summed in bins, and pooling adjacent violators over the bins calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import keyed, written
from manyfold.llm.statistics import NAMES, document_statistics

FEATURES = 256
#: Labelled rows that the fit uses at most: those with the smallest hashes of their ids.
MAX_LABELLED = 60_000
RIDGE = 1e-2
#: Partitions of the labelled sample, at most.
PARTS = 64
_BINS = 1000


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    seed: int

    def raw(self, statistics: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return fourier(statistics, self.mean, self.scale, self.seed) @ (self.weights if weights is None else weights)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics), self.knots, self.values), 0, 1)


def fourier(statistics: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int) -> np.ndarray:
    """cos(w x + b) for fixed random w and b, and a constant; extreme statistics are clipped at 8 deviations."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / np.sqrt(len(NAMES)), (len(NAMES), FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((statistics - mean) / scale, -8, 8)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones(len(x))])


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to the given ones, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in blocks])


def labelled_sample(labels: DataFrame, label_col: str, usable, id_col: str, limit: int) -> DataFrame:
    """(_lid, _label): at most limit labelled ids, one label each (the larger if they differ), for which usable holds."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(usable(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("_lid")).agg(F.max(F.col(label_col)).cast("int").alias("_label"))
    return rows.orderBy(F.xxhash64("_lid"), "_lid").limit(limit)


def fold_is_not(fold: int, folds: int):
    """Whether crc32 of the decimal id, modulo folds, isn't fold."""
    return lambda column: (F.crc32(column.cast("long").cast("string").cast("binary")) % folds) != fold


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.asarray(batch.column(0).flatten()).reshape(-1, len(NAMES))
    return x, np.asarray(batch.column(1)).astype(float), np.asarray(batch.column(2))


def fit_quality(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED, seed: int = 11) -> QualityModel | None:
    """None if no labelled row is usable."""
    sample = F.broadcast(labelled_sample(labels, "quality", usable, id_col, limit))  # at most limit rows of 12 bytes
    rows = keyed(docs, id_col, text_col)
    chosen = rows.join(sample, rows._id == sample._lid).select("_text", "_label", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(2)).cast("int").alias("_fold"))

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = document_statistics(batch.column(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], names=["x", "label", "fold"])

    # at most limit rows of some 200 bytes, so at most PARTS partial sums of half a megabyte meet in a task
    table = written(chosen.mapInArrow(statistics, "x array<double>, label int, fold int"), "quality-rows").coalesce(PARTS)
    sums = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.avg(F.col("x")[k]) for k in range(len(NAMES)))).alias("mean"),
        F.array(*(F.stddev_pop(F.col("x")[k]) for k in range(len(NAMES)))).alias("scale"),
    ).first()
    if not sums.n:
        return None
    mean = np.array(sums.mean)
    scale = np.array(sums.scale)
    scale[scale < 1e-9] = 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES + 1, FEATURES + 2))
        rows = 0
        for batch in batches:
            x, y, fold = _rows(batch)
            rows += len(x)
            z = fourier(x, mean, scale, seed)
            for f in (0, 1):
                total[f] += z[fold == f].T @ np.column_stack([z, y])[fold == f]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["fold", "part"])

    def meet(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py()) for p in rows.column("part"))
        return pa.table({"fold": rows.column("fold").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    parts = {r.fold: np.frombuffer(r.part).reshape(FEATURES + 1, FEATURES + 2) for r in table.mapInArrow(equations, "fold int, part binary").groupBy("fold").applyInArrow(meet, "fold int, part binary").collect()}

    def solve(m: np.ndarray) -> np.ndarray:
        return np.linalg.solve(m[:, :-1] + RIDGE * np.eye(len(m)), m[:, -1])

    whole, others = solve(parts[0] + parts[1]), {f: solve(parts[1 - f]) for f in (0, 1)}

    def held_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold = _rows(batch)
            z = fourier(x, mean, scale, seed)
            raw = np.where(fold == 0, z @ others[0], z @ others[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(raw * _BINS), -_BINS, 2 * _BINS).astype(np.int32)), pa.array(y)], names=["bin", "label"])

    bins = table.mapInArrow(held_scores, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("sum"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    centre = (np.array([r.bin for r in bins]) + 0.5) / _BINS
    n = np.array([r.n for r in bins], float)
    # one virtual row of each label keeps the ends off 0 and 1
    rate = pooled(np.array([r["sum"] for r in bins]) / n, n)
    level = sum(r["sum"] for r in bins) / n.sum()
    runs = {v: n[rate == v].sum() for v in np.unique(rate)}
    rate = np.array([(v * runs[v] + level) / (runs[v] + 1) for v in rate])
    # a slight slope keeps the order within a level
    values = 0.98 * np.maximum.accumulate(rate) + 0.02 * np.clip((centre + 0.5) / 2, 0, 1)
    return QualityModel(mean, scale, whole, centre, values, seed)


def quality_scores(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, score (0 to 1).

    Labels are learnt from rows for which usable(id) holds only; texts are the only input of a score. A null text is
    scored as an empty one. Without any usable label every score is 0.5.
    """
    model = fit_quality(docs, labels, usable, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5) if model is None else model.score(document_statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(scores, 9))], names=["_id", "score"])

    return keyed(docs, id_col, text_col).mapInArrow(score, "_id long, score double")

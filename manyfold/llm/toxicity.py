"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters are presence tests: words and word beginnings that toxic training documents hold far more often than others do
(the lexicon), and patterns over document statistics. The label model knows no labels: it treats the true label as
hidden and estimates, by expectation-maximisation, how often each voter fires on either side (its accuracy) and, from
the posterior-weighted second moments, how voters correlate within a side; correlated voters share their weight. A
logistic classifier is then trained on the posteriors and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import NOT_ALNUM, keyed, text_chunks, word_hashes, word_spans, written
from manyfold.llm.quality import labelled_sample
from manyfold.llm.statistics import NAMES, document_statistics

#: Labelled rows that the fit uses at most, and voters of the lexicon at most; they bound what the driver holds.
MAX_LABELLED = 60_000
MAX_VOTERS = 256
#: Toxic documents of the sample that hold a feature, at least, whatever the sample's size.
SUPPORT = 3
BEGINNINGS = (4, 5, 6, 7, 8)
#: A voter wants its feature so many times in a text.
TIMES = (1, 2, 4)
#: Chance, per candidate, of a voter that only looks like one.
SIGNIFICANCE = 2e-4
_PATTERNS = ("share_shout", "share_upper", "share_symbol", "share_digit", "repeats_next", "upper_words")


def features(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: (first row, number of texts, text of each occurrence of a feature, its hash).

    Features are plain words, A-Z lower-cased, and their first 4 to 8 bytes where they are longer.
    """
    for row, data, offsets in text_chunks(column):
        start, end, first = word_spans(data, offsets, NOT_ALNUM)
        n = len(first) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        texts, values = [text], [word_hashes(data, start, end, fold_case=True)]
        for size in BEGINNINGS:
            longer = np.flatnonzero(end - start > size)
            texts.append(text[longer])
            values.append(word_hashes(data, start[longer], start[longer] + size, fold_case=True) ^ np.uint64(size))
        yield row, n, np.concatenate(texts), np.concatenate(values)


def _counts(texts: np.ndarray, values: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """n x wanted: how often a text has a feature; wanted is sorted."""
    if not len(wanted):
        return np.zeros((n, 0), np.int64)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    hit = wanted[at] == values
    return np.bincount(texts[hit] * len(wanted) + at[hit], minlength=n * len(wanted)).reshape(n, len(wanted))


@dataclass
class ToxicityModel:
    """Voter k of the lexicon fires where feature[k] occurs at least least[k] times; features is sorted."""

    features: np.ndarray
    feature: np.ndarray
    least: np.ndarray
    limits: np.ndarray
    weights: np.ndarray

    def lexicon_votes(self, column) -> np.ndarray:
        found = [_counts(texts, values, self.features, n)[:, self.feature] >= self.least for _, n, texts, values in features(column)]
        return np.concatenate(found) if found else np.zeros((0, len(self.feature)), bool)

    def votes(self, column) -> np.ndarray:
        """Rows of the lexicon's and the patterns' votes."""
        patterns = document_statistics(column)[:, [NAMES.index(p) for p in _PATTERNS]] > self.limits
        return np.column_stack([self.lexicon_votes(column), patterns])

    def score(self, column) -> np.ndarray:
        return logistic(inputs(self.votes(column), len(self.feature)) @ self.weights)

    def only(self, keep: np.ndarray) -> None:
        """Leaves the voters with these numbers."""
        used = np.unique(self.feature[keep])
        self.features, self.least, self.feature = self.features[used], self.least[keep], np.searchsorted(used, self.feature[keep])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(votes: np.ndarray, lexicon: int) -> np.ndarray:
    """Votes, whether any word of the lexicon is there, how many are (up to 4, in quarters), and a constant."""
    many = votes[:, :lexicon].sum(1)
    return np.column_stack([votes, many > 0, np.minimum(many, 4) / 4, np.ones(len(votes))]).astype(float)


def label_model(votes: np.ndarray, lexicon: int, prior: float, rounds: int = 30) -> np.ndarray:
    """Posterior probability of the hidden label for each row of 0/1 votes: lexicon ones first, then patterns.

    A voter that doesn't fire abstains, which tells nothing; that no lexicon voter fires at all is a voter of its own,
    against. Lexicon voters are taken to be better than chance (they fire at least three times as often on their side);
    a pattern's evidence is for either side, less two standard errors of it, or none. Two passes of expectation-maximisation, starting from
    "some lexicon vote", with the share of toxic rows given (prior): the first takes voters as independent given the
    label. From its posteriors come the correlations within each side; a voter then counts 1 / (1 + sum of its positive
    correlations with the others), averaged over the sides, in the second pass.
    """
    x = np.column_stack([votes, votes[:, :lexicon].sum(1) == 0]).astype(float)
    m = x.shape[1]
    share = np.ones(m)
    pi = np.clip(prior, 1e-4, 1 - 1e-4)
    odds = np.log(pi / (1 - pi))
    start = np.where(x[:, -1] == 0, 0.95, 0.02)
    base = x.mean(0)
    for _ in range(2):
        posterior = start
        for _ in range(rounds):
            weight = posterior.sum(), (1 - posterior).sum()
            fire = [np.clip((x.T @ p + 2 * base) / (w + 2), 1e-6, 1 - 1e-6) for p, w in zip((posterior, 1 - posterior), weight, strict=True)]
            evidence = np.log(fire[0] / fire[1])
            evidence[:lexicon] = np.maximum(evidence[:lexicon], np.log(3))
            evidence[-1] = min(evidence[-1], -np.log(3))
            error = np.sqrt(sum((1 - f) / (f * w + 1) for f, w in zip(fire, weight, strict=True)))[lexicon:-1]
            evidence[lexicon:-1] = np.sign(evidence[lexicon:-1]) * np.maximum(np.abs(evidence[lexicon:-1]) - 2 * error, 0)
            new = logistic(odds + x @ (share * evidence))
            done = np.abs(new - posterior).max(initial=0) < 1e-6
            posterior = new
            if done:
                break
        related = np.zeros((m, m))
        for p in (posterior, 1 - posterior):
            w = max(p.sum(), 1e-9)
            mean = x.T @ p / w
            cov = (x * p[:, None]).T @ x / w - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            related += np.where(w > 20, np.clip(cov / np.outer(sd, sd), 0, 1), 0) / 2
        np.fill_diagonal(related, 0)
        related[related < 0.1] = 0
        share = 1 / (1 + related.sum(1))
    return posterior


def train_logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights for soft targets, by Newton steps; the constant is the last column and isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = logistic(x @ w)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink), x.T @ (target - p) - shrink * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _surprise(toxic: np.ndarray, clean: np.ndarray, toxic_docs: int, clean_docs: int) -> np.ndarray:
    """The log of the likelihood ratio (a G statistic, halved) of the rates on both sides; 0 unless the toxic rate is ten times the other."""
    a, b = toxic / max(toxic_docs, 1), clean / max(clean_docs, 1)
    both = (toxic + clean) / max(toxic_docs + clean_docs, 1)
    gain = lambda k, n, p: k * np.log(np.clip(p, 1e-12, 1)) + (n - k) * np.log(np.clip(1 - p, 1e-12, 1))
    g = gain(toxic, toxic_docs, a) + gain(clean, clean_docs, b) - gain(toxic, toxic_docs, both) - gain(clean, clean_docs, both)
    return np.where(a > 10 * b, g, 0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> ToxicityModel | None:
    """None if no labelled row is usable. The texts of the sample stay on the executors; the driver gets counts and votes."""
    sample = F.broadcast(labelled_sample(labels, "toxic", usable, id_col, limit))  # at most limit rows of 12 bytes
    rows = keyed(docs, id_col, text_col)
    chosen = written(rows.join(sample, rows._id == sample._lid).select("_text", "_label"), "toxicity-rows")
    sides = {r._label: r["count"] for r in chosen.groupBy("_label").count().collect()}
    toxic_docs, clean_docs = sides.get(1, 0), sides.get(0, 0)
    if not toxic_docs + clean_docs:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1)) == 1
            for row, _, texts, values in features(batch.column(0)):
                found, which = np.unique(values, return_inverse=True)
                pairs, times = np.unique(texts * len(found) + which, return_counts=True)
                text, which = pairs // max(len(found), 1), pairs % max(len(found), 1)
                toxic = label[row + text]
                sums = [np.bincount(which[side & (times >= t)], minlength=len(found)) for side in (~toxic, toxic) for t in TIMES]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in sums)], names=["feature", *counts])

    counts = [f"{side}{t}" for side in ("clean", "toxic") for t in TIMES]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, toxic = np.array([np.asarray(batch.column(c)) for c in counts], float).reshape(2, len(TIMES), -1)
            surprise = _surprise(toxic, clean, toxic_docs, clean_docs)
            best = surprise.argmax(0)  # of each feature, its most telling number
            at = np.arange(batch.num_rows)
            impure = clean[best, at] / np.maximum(toxic[best, at], 1)
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(np.array(TIMES)[best]), pa.array(surprise[best, at]), pa.array(impure)], names=["feature", "least", "surprise", "impure"])

    # Every feature is counted on both sides where the texts are; only those that tell something come to the driver.
    counted = chosen.mapInArrow(count, "feature long, " + ", ".join(f"{c} long" for c in counts)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in counts)).filter(F.col(f"toxic{TIMES[0]}") >= SUPPORT)
    telling = counted.mapInArrow(weigh, "feature long, least long, surprise double, impure double").filter(F.col("surprise") > float(-np.log(SIGNIFICANCE)))
    best = telling.orderBy(F.desc("surprise"), "feature").limit(MAX_VOTERS).collect()
    best.sort(key=lambda r: r.feature % (1 << 64))
    surprise, purity = np.array([r.surprise for r in best]), np.array([r.impure for r in best])
    model = ToxicityModel(np.array([r.feature for r in best], np.int64).view(np.uint64), np.arange(len(best)), np.array([r.least for r in best], int), np.zeros(len(_PATTERNS)), np.zeros(0))

    # A pattern votes where its statistic is in the top tenth of the sample.
    at = [NAMES.index(p) for p in _PATTERNS]

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = document_statistics(batch.column(0))[:, at]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(len(at))], names=[f"p{k}" for k in range(len(at))])

    quantiles = chosen.mapInArrow(patterns, ", ".join(f"p{k} double" for k in range(len(at)))).agg(*(F.percentile_approx(f"p{k}", 0.9, 1000) for k in range(len(at)))).first()
    model.limits = np.maximum(np.array(quantiles, float), 1e-6)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.packbits(model.votes(batch.column(0)), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), batch.column(1)], names=["votes", "label"])

    # Distinct rows of votes with their numbers: at most limit rows of some 33 bytes
    kinds = chosen.mapInArrow(vote, "votes binary, label int").groupBy("votes", "label").count().orderBy("votes", "label").collect()
    width = len(model.feature) + len(_PATTERNS)
    number = [r["count"] for r in kinds]
    votes = np.repeat(np.array([np.unpackbits(np.frombuffer(r.votes, np.uint8))[:width] for r in kinds]).reshape(-1, width), number, axis=0)
    keep = distinct_voters(votes[:, : len(model.feature)], np.repeat([r.label == 1 for r in kinds], number), np.lexsort((-surprise, purity)))
    votes = np.column_stack([votes[:, keep], votes[:, len(model.feature) :]])
    model.only(keep)
    prior = toxic_docs / (toxic_docs + clean_docs)
    posterior = label_model(votes, len(keep), prior) if len(keep) else np.full(len(votes), prior)
    model.weights = train_logistic(inputs(votes, len(keep)), posterior)
    return model


def distinct_voters(votes: np.ndarray, toxic: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The voters, taken in the given order (purest first), that are pure or, where none before fires, mostly right."""
    seen = np.zeros(len(votes), bool)
    keep = []
    for k in order.tolist():
        fires = votes[:, k].astype(bool)
        fresh = fires & ~seen
        if not (fires & ~toxic).any() or (fresh & toxic).sum() >= max(3, fresh.sum() / 2):
            keep.append(k)
            seen |= fires
    return np.array(sorted(keep), int)


def toxicity_scores(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, score (0 to 1).

    Labels are used only of rows for which usable(id) holds, to choose the lexicon and the prior; the classifier learns
    the label model's posteriors. A null text is scored as an empty one. Without any usable label every score is 0.
    """
    model = fit_toxicity(docs, labels, usable, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows) if model is None else model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(scores, 9))], names=["_id", "score"])

    return keyed(docs, id_col, text_col).mapInArrow(score, "_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, usable, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; columns unchanged, one pass, no join."""
    model = fit_toxicity(docs, labels, usable, id_col, text_col)
    if model is None:
        return docs

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text))

    return docs.filter(score(F.coalesce(F.col(text_col), F.lit(""))) < threshold)

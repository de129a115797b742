"""Quality and toxicity: parts against brute force, held-out accuracy on small tables."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from manyfold.llm.quality import RIDGE, fit_quality, fold_is_not, fourier, labelled_sample, pooled, quality_scores
from manyfold.llm.statistics import NAMES, document_statistics
from manyfold.llm.toxicity import distinct_voters, drop_toxic, fit_toxicity, label_model, toxicity_scores, train_logistic

from .helpers import awkward, docs, empty


def test_pooled_is_the_best_rising_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v, w = rng.integers(0, 5, 5).astype(float), rng.integers(1, 4, 5).astype(float)
        got = pooled(v, w)
        assert (np.diff(got) >= -1e-12).all()
        grid = [c for c in itertools.product(np.linspace(0, 4, 13), repeat=5) if all(a <= b for a, b in itertools.pairwise(c))]
        assert (w * (got - v) ** 2).sum() <= min((w * (np.array(c) - v) ** 2).sum() for c in grid) + 1e-9


def test_statistics():
    x = document_statistics(pa.array(["", "the the cat sat", "A|B | C!", "line one\nline one\nline two", "é"]))
    at = NAMES.index
    assert x.shape == (5, len(NAMES)) and not x[0].any()
    assert x[1, at("repeats_next")] == 0.25 and x[1, at("distinct_words")] == 3 / 2
    assert x[2, at("share_bar")] == 2 / 8 and x[3, at("distinct_lines")] == 2 / 3
    assert np.isfinite(x).all()


def folds(n, folds_, out):
    return {i for i in range(n) if zlib.crc32(str(i).encode()) % folds_ != out}


def test_sample_is_bounded_and_leaves_out_the_fold(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, None), (8, 1)], "doc_id long, quality int")
    ids = {r._lid for r in labelled_sample(labels, "quality", fold_is_not(1, 3), "doc_id", 1000).collect()}
    assert ids == folds(200, 3, 1)
    assert labelled_sample(labels, "quality", fold_is_not(1, 3), "doc_id", 10).count() == 10


def made(seed, n=240):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rude = ["grobblet", "snarkface", "grobbling"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(["", "s", "."]) for _ in range(rng.randrange(15, 60))]
        bad, toxic = rng.random() < 0.4, rng.random() < 0.4
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(rude))
        if bad:
            text = [w + "$$$" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = made(1)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r._id: r.score for r in quality_scores(docs(spark, rows), frame, fold_is_not(1, 3)).collect()}
    held = set(range(len(rows))) - folds(len(rows), 3, 1)
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, q, _ in labels if i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    wrong = spark.createDataFrame([(i, 1 - q if i in held else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r._id: r.score for r in quality_scores(docs(spark, rows), wrong, fold_is_not(1, 3)).collect()}
    assert again == pytest.approx(got, abs=1e-6)  # held-out labels tell nothing


def test_quality_model_is_the_direct_solution(spark):
    """Means, ridge weights and calibration against one numpy solve over all labelled rows."""
    rows, labels = made(5)
    frame = docs(spark, rows).repartition(7)
    model = fit_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fold_is_not(1, 3))
    usable = [k for k in range(len(rows)) if zlib.crc32(str(rows[k][0]).encode()) % 3 != 1]
    x = document_statistics(pa.array([rows[k][1] for k in usable]))
    y = np.array([labels[k][1] for k in usable], float)
    scale = x.std(0)
    scale[scale < 1e-9] = 1
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, scale)
    z = fourier(x, x.mean(0), scale, model.seed)
    gram = z.T @ z + RIDGE * np.eye(z.shape[1])
    assert np.allclose(gram @ model.weights, z.T @ y, atol=1e-6)
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(gram, z.T @ y), atol=1e-6)
    assert (np.diff(model.values) >= 0).all()


def test_toxicity_held_out(spark):
    rows, labels = made(2)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r._id: r.score for r in toxicity_scores(docs(spark, rows), frame, fold_is_not(2, 4)).collect()}
    held = set(range(len(rows))) - folds(len(rows), 4, 2)
    assert np.mean([(got[i] >= 0.3) == bool(t) for i, _, t in labels if i in held]) > 0.95
    kept = {r.doc_id for r in drop_toxic(docs(spark, rows), frame, fold_is_not(2, 4)).collect()}
    assert kept == {i for i, s in got.items() if s < 0.3}


def test_rare_voters_count_beside_many_common_words(spark):
    common = " ".join(f"{k:04x}" for k in range(9000))  # in every text, so of more support than the insult
    rows = [(i, common + (" grobblet" if i < 20 else "")) for i in range(120)]
    frame = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    model = fit_toxicity(docs(spark, rows), frame, lambda c: c.isNotNull())
    assert model.lexicon_votes(pa.array(["a grobblet here", common])).any(1).tolist() == [True, False]


def test_scores_awkward(spark):
    d = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (6, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for table in (labels, none):
        assert quality_scores(d, table, fold_is_not(1, 3)).count() == d.count()
        assert toxicity_scores(d, table, fold_is_not(2, 4)).count() == d.count()
        assert drop_toxic(d, table, fold_is_not(2, 4)).columns == d.columns
    assert {r.score for r in quality_scores(d, none, fold_is_not(1, 3)).collect()} == {0.5}
    assert {r.score for r in toxicity_scores(d, none, fold_is_not(2, 4)).collect()} == {0.0}
    assert quality_scores(empty(spark), labels, fold_is_not(1, 3)).count() == 0
    assert toxicity_scores(empty(spark), labels, fold_is_not(2, 4)).count() == 0


def test_label_model_finds_the_hidden_label():
    rng = np.random.default_rng(3)
    truth = rng.random(3000) < 0.2
    rates = [(0.6, 0.02), (0.5, 0.01), (0.3, 0.01), (0.4, 0.03)]
    votes = np.column_stack([rng.random(3000) < np.where(truth, a, b) for a, b in rates])
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])  # copies of a voter add nothing
    p = label_model(votes, votes.shape[1], 0.2)
    some = votes.any(1)
    assert p[truth & some].mean() > 0.7 and p[~truth].mean() < 0.15 and p[~some].max(initial=0) < 0.3
    w = train_logistic(np.column_stack([votes, np.ones(3000)]).astype(float), p)
    assert (w[:-1] > 0).all()


def test_patterns_enter_the_label_model():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.2
    lexicon = np.column_stack([rng.random(4000) < np.where(truth, a, b) for a, b in [(0.5, 0.01), (0.4, 0.01), (0.4, 0.02)]])
    telling = rng.random(4000) < np.where(truth, 0.6, 0.05)
    idle = rng.random((4000, 5)) < 0.1
    alone = label_model(lexicon, 3, 0.2)
    p = label_model(np.column_stack([lexicon, telling]), 3, 0.2)
    assert p[truth & telling].mean() > alone[truth & telling].mean() and p[~truth].mean() < 0.15
    q = label_model(np.column_stack([lexicon, idle]), 3, 0.2)  # patterns that tell nothing change little
    assert np.mean((q >= 0.3) == (alone >= 0.3)) > 0.99


def test_distinct_voters():
    votes = np.array([[1, 1, 0], [1, 1, 0], [1, 1, 1], [0, 1, 1], [0, 1, 0], [0, 0, 1]])
    toxic = np.array([True, True, True, False, False, True])
    assert distinct_voters(votes, toxic, np.array([0, 1, 2])).tolist() == [0]

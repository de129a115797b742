"""The pipeline: order and columns of its stages, its decisions against brute force on a small table."""

import os

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from manyfold.llm.bpe import read_ranks
from manyfold.llm.decontaminate import edits_allowed, nearest, words_of
from manyfold.llm.queries import ORACLES, QUERIES

from .helpers import awkward
from .test_dedup import brute_near

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@here
def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        seen[name] = before, after
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    before, after = seen["exact_dedup"]
    assert set(after) == set({t: i for i, t in sorted(before.items())}.values())
    before, after = seen["near_dedup"]
    assert set(after) == {i for i, (_, _, kept) in brute_near(list(before.items()), 5).items() if kept}
    before, after = seen["decontamination"]
    items = [w for w in words_of(pa.array([r.text or "" for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])) if len(w)]
    leaking = {i for i, t in before.items() if any(nearest(w, words_of(pa.array([t or ""]))[0])[0] <= edits_allowed(len(w)) for w in items)}
    assert set(before) - set(after) <= leaking and len(leaking - (set(before) - set(after))) <= 0.1 * len(leaking)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    ranks = read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == plain.encode_ordinary(after[r.doc_id] or "") for r in last)
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()} == {(r.doc_id, r.ids_sha256) for r in last}
    assert {r.doc_id for r in last} == set(seen["decontamination"][1]) and all(len(r.ids) == r.n_tokens for r in last)


@here
def test_awkward_rows_pass_through(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count() > 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)

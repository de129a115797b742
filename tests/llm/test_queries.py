"""Every registered query of the ten operators over a whole small table: against its SQL, or against a plain version."""

import hashlib
import os
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

from manyfold.llm import queries
from manyfold.llm.bpe import read_ranks

from .test_text import base_spans

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return {i: t or "" for i, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()}


def answer(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SMALL).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SMALL)
    cur = tables.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, cur.fetchall()))


def test_shards(spark, texts):
    got = answer(spark, "op1_virtual_slot_sharding")
    assert {i: (r["size"], r.text_crc32) for i, r in got.items()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    load = [sum(r["size"] for r in got.values() if r.shard == k) for k in range(8)]
    assert max(load) - min(load) <= 0.01 * max(load)
    for k in range(8):
        slots = sorted(r.slot for r in got.values() if r.shard == k)
        assert slots == list(range(len(slots)))


def test_secrets(spark, texts):
    got = answer(spark, "op2_secret_scan")
    assert list(next(iter(got.values())).asDict())[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    for i, t in texts.items():
        want = base_spans(t)
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w[0] == k for w in want) for k in ("assign", "access", "hex"))


def test_tokens(spark, texts):
    got = answer(spark, "op3_prefix_bpe")
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in texts.items():
        ids = plain.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t))


def test_leaks_that_are_there_word_by_word(spark, tables, texts):
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op5_cgk_decontamination"](spark, SMALL).collect()}
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = {i: words(t or "") for i, t in tables.execute("SELECT item_id, text FROM benchmark").fetchall()}
    exact = {(d, i) for d, t in texts.items() for i, w in items.items() if w.strip() and w in words(t)}
    assert exact <= found


@pytest.mark.parametrize("name,fold,folds,cut", [("op6_quality_fourier", 1, 3, 0.5), ("op7_weak_toxicity", 2, 4, 0.3)])
def test_scores(spark, texts, name, fold, folds, cut):
    got = answer(spark, name)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)

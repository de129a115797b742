"""Exact, line, substring and near dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from manyfold.llm import exact_dedup as exact_module
from manyfold.llm import near_dedup as near
from manyfold.llm.components import components
from manyfold.llm.exact_dedup import drop_copies, exact_dedup
from manyfold.llm.line_dedup import LineRuns, line_batch, line_dedup
from manyfold.llm.near_dedup import drop_near_copies, near_dedup
from manyfold.llm.substring_dedup import COVERS, substring_dedup

from .helpers import WORD, awkward, docs, empty

SPACES = " \t\n\x0b\x0c\r"


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("limit", [2_000_000, 100])
def test_exact_against_brute_force(spark, limit):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "A", "a ", "", None, "hot", "hot", "hot", f"own {i}"])) for i in range(300)]
    last, count = {}, Counter()
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", i), i)
        count[t or ""] += 1
    got = {r._id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs(spark, rows), broadcast_words=limit).collect()}
    assert got == {i: (last[t or ""], count[t or ""], last[t or ""] == i, digest(t)) for i, t in rows}
    assert sorted(r.doc_id for r in drop_copies(docs(spark, rows), broadcast_words=limit).collect()) == sorted(set(last.values()))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


@pytest.mark.parametrize("limit", [2_000_000, 100])
def test_exact_only_filter_words_and_possibly_repeated_rows_shuffle(spark, limit, monkeypatch):
    plans = defaultdict(list)
    real = exact_module.written
    monkeypatch.setattr(exact_module, "written", lambda df, name, **how: (plans[name].append(exchanges(df)), real(df, name, **how))[1])
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, "hot") for i in range(150)]
    result = exact_dedup(docs(spark, rows), broadcast_words=limit)
    assert [len(p) for p in plans["bloom-words"]] == [1] and "hashpartitioning(_range" in plans["bloom-words"][0][0]  # words, summed up before
    assert not any(plans["row-hashes"]) and not any(plans["bloom-marked"]) and len(plans["bloom-marked"]) == (1 if limit > 1000 else 3)
    assert not exchanges(result)  # the few groups are broadcast
    seen = exact_module._Filter(exact_module.keyed(docs(spark, rows)), 32, limit)
    marked = {r._id: r._maybe for r in seen.marked(exact_module.keyed(docs(spark, rows))).collect()}
    assert len(marked) == 450 and all(marked[1000 + i] for i in range(150))
    assert sum(marked[i] for i in range(300)) < 60  # the others pass straight through
    assert seen.words.count() <= seen.n_words


def test_exact_awkward(spark):
    d = awkward(spark)
    got = sorted((str(r._id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(d).collect())
    assert len(got) == d.count()
    assert ("2", "2", 3, True) in got and got.count(("2", "2", 3, True)) == 2  # the same row twice
    kept = drop_copies(d)
    assert kept.columns == d.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(set(texts)) == len(texts) - 1  # but for the row given twice
    assert exact_dedup(empty(spark)).count() == 0 and drop_copies(empty(spark)).count() == 0


def brute_lines(rows, least=3, chars=20):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_against_brute_force(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"Common line number {k} of some length" for k in range(6)] + ["short", "", "  ÉCOLE line that is long enough \x0b", "  école line that is long enough", "\r\tÉcole LINE that is long enough"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"a line of its own, number {i}" for _ in range(rng.randrange(1, 9)))) for i in range(60)] + [(70, None), (71, "")]
    got = {r._id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs(spark, rows), batches=batches, fanout=fanout).collect()}
    assert got == brute_lines(rows)


def test_line_runs_levels(spark):
    store = LineRuns(spark, fanout=2)
    sizes = []
    for b in range(5):
        batch = spark.createDataFrame([(k, 0, 1, b) for k in range(b, b + 3)], "h1 long, h2 long, n_docs long, last_id long")
        sizes.append(store.add(batch).count())
    assert sizes == [3, 1, 1, 1, 1]
    assert all(len(level) < 2 for kind in store.levels.values() for level in kind)
    held = {r.h1: (r.n_docs, r.last_id) for r in store.held_by(3).collect()}
    assert held == {2: (3, 2), 3: (3, 3), 4: (3, 4)}
    assert {r.h1 for r in store.held_by(2).collect()} == {1, 2, 3, 4, 5}


def test_line_runs_are_read_in_place(spark):
    store = LineRuns(spark, fanout=3)
    for b in range(2):
        store.add(spark.range(b * 50, b * 50 + 200).selectExpr("id AS h1", "-id AS h2", "1L AS n_docs", "id AS last_id"))
    batch = store.run(store._write(spark.range(300).selectExpr("id AS h1", "-id AS h2", "1L AS n_docs", "id AS last_id"), "batch"))
    novel = store.novel(batch)
    plan = novel._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    assert "Sort [" not in plan  # runs and batch are in order as they are read
    assert {r.h1 for r in novel.collect()} == set(range(250, 300))


def test_line_runs_are_opened_by_a_later_session(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "\n".join(f"Common line number {rng.randrange(12)} of some length" for _ in range(3))) for i in range(40)]
    path = str(tmp_path / "runs")
    for part in (rows[:15], rows[15:30], rows[30:]):  # each batch through a store that is opened anew
        later = spark.newSession()
        LineRuns(later, 2, path).add(line_batch(later.createDataFrame(part, "doc_id long, text string")))
    many = LineRuns(spark, 2, path)
    assert many.version == 3
    one = LineRuns(spark)
    one.add(line_batch(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(many.held_by(3).collect()) == sorted(one.held_by(3).collect()) != []


def test_lines_awkward(spark):
    d = awkward(spark)
    got = line_dedup(d)
    assert got.count() == d.count()
    assert {(r.n_lines, r.n_dropped, r.kept_text) for r in got.filter("_id = 4").collect()} == {(1, 0, "")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup(empty(spark)).count() == 0


def brute_windows(rows, size=20):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    seen, out = set(), {}
    for k, (i, t) in enumerate(rows):
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - size + 1):
            w = tuple(words[s : s + size])
            if w in seen:
                gone.update(range(s, s + size))
            seen.add(w)
        out[k] = (i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("window,letters", [(20, "ab"), (20, "abcdefgh"), (7, "ab"), (10, "abc")])
def test_windows_against_brute_force(spark, window, letters):
    rng = random.Random(window)
    base = [rng.choice(letters) + rng.choice(["", "é", "ü"]) for _ in range(200)]
    rows = []
    for i in range(60):
        a = rng.randrange(200)
        own = [rng.choice(letters) * rng.randrange(1, 4) for _ in range(rng.randrange(30))]
        words = own + base[a : a + rng.randrange(60)] + own[: rng.randrange(20)]
        rows.append((i, rng.choice([" ", "\n", "  ", "\t "]).join(words)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "x " * 100), (104, rows[0][1])]
    got = sorted(((r._id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs(spark, rows), window).collect()), key=str)
    assert got == brute_windows(rows, window)


@pytest.mark.parametrize("period", COVERS)
def test_difference_covers(period):
    d = COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def test_windows_awkward(spark):
    d = awkward(spark)
    got = substring_dedup(d).collect()
    assert len(got) == d.count()
    assert [r.n_removed for r in got if r._id == 7] == [60_000] and [r.kept_text for r in got if r._id == 4] == [""]
    assert substring_dedup(empty(spark)).count() == 0


def shingles(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[s : s + k]) for s in range(max(1, len(words) - k + 1))} if words else set()


def brute_near(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b), key=lambda x: rows[x][0])] = min(find(a), find(b), key=lambda x: rows[x][0])
    return {i: (len(sets[n]), rows[find(n)][0], rows[find(n)][0] == i) for n, (i, _) in enumerate(rows)}


def families(seed, n, most):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    passage = [rng.choice(vocabulary) for _ in range(25)]
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 90]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    return rows


@pytest.mark.parametrize("k,most", [(4, 6), (5, 30)])
def test_near_against_brute_force(spark, k, most):
    rows = families(k, 150, most) + [(2000, None), (2001, ""), (2002, "One two"), (2003, "one TWO"), (2004, "one")]
    got = {r._id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs(spark, rows), shingle=k).collect()}
    assert got == brute_near(rows, k)


def test_near_large_nodes(spark, monkeypatch):
    """Small limits, so that stars, families in blocks, branching and the last level's blocks are used."""
    rows = families(9, 160, 60)
    want = brute_near(rows, 5)
    for leaf, outsiders, levels in ((8, 1024, 4), (8, 0, 3), (4, 6, 2)):
        monkeypatch.setattr(near, "LEAF", leaf)
        monkeypatch.setattr(near, "OUTSIDERS", outsiders)
        monkeypatch.setattr(near, "LEVELS", levels)
        got = {r._id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs(spark, rows)).collect()}
        assert got == want


def test_near_awkward(spark):
    d = awkward(spark)
    got = near_dedup(d).collect()
    assert len(got) == d.count()
    assert {(r.n_shingles, r.component_id) for r in got if r._id == 4} == {(0, 4)}
    assert {r.component_id for r in got if r._id == 7} == {6}
    kept = drop_near_copies(d)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, None, None, 6, 8, 9, 9]))
    assert near_dedup(empty(spark)).count() == 0 and drop_near_copies(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

"""Multi-way joins in every mode against Spark's own answer, and two-way joins against SQL."""


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manyfold.engine import Engine
from manyfold.operators.binary import join
from manyfold.operators.hypercube import CELL, largest_cell, routed
from manyfold.operators.leapfrog import matches, matches_by_block
from manyfold.operators.whole import shape
from manyfold.plans.cost import SampleEstimator
from manyfold.plans.graph import QueryGraph
from manyfold.plans.planner import ByDistinct, Planner
from manyfold.plans.query import MultiJoin
from manyfold.plans.stats import RelationStats, collect_stats

ROWS = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
TWO = {"a": "xz", "b": "xy", "c": "yz", "d": "sz", "da": "zp", "e": "sx", "ea": "pq", "f": "sy", "fa": "qs", "h": "yr", "i": "rw"}
ONE = {"al": "x", "dl": "z", "g": "s", "j": "w"}
TRIANGLE = "SELECT * FROM a, b, c WHERE a.x = b.x AND b.y = c.y AND c.z = a.z"
QUERIES = {
    "triangle": (TRIANGLE, 12, 6),
    "clique": ("SELECT * FROM a, b, c, d, e, f WHERE a.x = b.x AND b.y = c.y AND c.z = a.z AND d.s = e.s AND e.s = f.s AND d.z = c.z AND e.x = a.x AND f.y = b.y", 24, 12),
    "line": ("SELECT * FROM al, b, c, dl WHERE al.x = b.x AND b.y = c.y AND c.z = dl.z", 12, 6),
    "arbitrary": ("SELECT * FROM a, b, c, da, ea, fa, g, h, i, j WHERE a.x = b.x AND b.y = c.y AND c.z = a.z AND a.z = da.z AND da.p = ea.p AND ea.q = fa.q AND fa.s = g.s AND b.y = h.y AND h.r = i.r AND i.w = j.w", 384, 18),
}
PLANS = [("default", {}), ("one-round", {}), ("one-round", {"local": "leapfrog"}), ("mixed", {}), ("mixed", {"bias": 1e-9}), ("core", {"bias": 1e-9, "local": "leapfrog"})]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, Planner(cells=8))
    for name, columns in TWO.items():
        e.register(name, spark.createDataFrame(ROWS, ", ".join(f"{c} int" for c in columns)), analyse=name == "a")
    for name, column in ONE.items():
        e.register(name, spark.createDataFrame([(k,) for k in range(1, 7)], f"{column} int"))
    return e


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("mode,more", PLANS)
def test_fixture_queries(spark, engine, name, mode, more):
    text, n, width = QUERIES[name]
    own = engine.with_mode(mode, **more)
    got = own.sql(text)
    assert bool(own.planner.decisions) == (mode != "default")
    assert (got.count(), len(got.columns)) == (n, width)
    assert rows(got) == rows(spark.sql(text))


@pytest.mark.parametrize("mode,more", PLANS[1:])
@pytest.mark.parametrize(
    "text",
    [
        "SELECT a.x AS one, c.y + b.y AS two, z FROM a JOIN b ON a.x = b.x JOIN c ON b.y = c.y AND c.z < 2 CROSS JOIN dl d2 WHERE d2.z = c.z AND a.x + b.y > c.z".replace(", z FROM", ", c.z FROM"),
        "SELECT p.x, q.z, r.y FROM a p, a q, b r WHERE p.x = q.x AND q.x = r.x AND p.z <> q.z",
        "SELECT a.x, b.y FROM a, b, g WHERE a.x = b.x AND g.s > 4",
        "SELECT a.x FROM a, b, c WHERE a.x = b.x AND b.y = c.y AND (a.z = 1 OR c.z = a.z)",
        "SELECT a.x, al.x AS y FROM a, al, c WHERE a.x = a.z AND a.z = al.x AND c.y = a.x",
        "SELECT count(*) AS n FROM a, b, c WHERE a.x = b.x AND b.y = c.y AND c.z = a.z",
        "SELECT a.x, sum(c.y + b.y) AS s, count(DISTINCT c.z), max(a.z) AS m FROM a, b, c WHERE a.x = b.x AND b.y = c.y AND a.z <= c.z GROUP BY a.x",
        "SELECT t.x, t.n, c.z FROM (SELECT x, count(*) AS n FROM b WHERE y < 3 GROUP BY x) t, a, c WHERE t.x = a.x AND a.z = c.z",
        "SELECT a.x + 1 AS k, count(*) AS n FROM a JOIN b ON a.x = b.x JOIN c ON c.y = b.y GROUP BY a.x + 1",
        "SELECT x, count(*) AS n FROM al, b b2, c WHERE al.x = b2.x AND b2.y = c.y GROUP BY al.x ORDER BY n".replace("SELECT x", "SELECT al.x"),
    ],
)
def test_other_shapes(spark, engine, mode, more, text):
    assert rows(engine.with_mode(mode, **more).sql(text)) == rows(spark.sql(text))


CYCLE = "a, b, c WHERE a.x = b.x AND b.y = c.y AND c.z = a.z"


@pytest.mark.parametrize(
    "text",
    [
        f"SELECT a.x, b.y FROM {CYCLE} ORDER BY a.x DESC, c.z, b.y LIMIT 5",
        f"SELECT DISTINCT a.x FROM {CYCLE}",
        f"SELECT a.x, count(*) AS n FROM {CYCLE} GROUP BY a.x HAVING max(b.y) > 1 AND count(*) > 2",
        f"SELECT x, sum(b.y) AS s FROM (SELECT 1 AS one) o, {CYCLE.replace('c.z = a.z', 'c.z = a.z AND a.x > 0').replace('a.x', 'a.x')} GROUP BY 1 ORDER BY s".replace("SELECT x", "SELECT a.x"),
        f"WITH t AS (SELECT a.x, c.z FROM {CYCLE}) SELECT t.x, d.s FROM t JOIN d ON t.z = d.z",
        f"WITH t(p, q) AS (SELECT a.x, c.z FROM {CYCLE}), u AS (SELECT p, count(*) AS n FROM t GROUP BY p) SELECT t.q, u.n, g.s FROM t, u, g WHERE t.p = u.p AND u.p = g.s",
        f"SELECT q.x, al.x AS y FROM (SELECT a.x FROM {CYCLE}) q LEFT JOIN al ON q.x = al.x + 1",
        f"SELECT a.x FROM {CYCLE} UNION ALL SELECT al.x FROM al UNION SELECT b.y FROM {CYCLE}",
        f"SELECT * FROM {CYCLE} AND a.x IN (SELECT x FROM al WHERE al.x > 1) AND EXISTS (SELECT 1 FROM g WHERE g.s = a.x)",
        f"SELECT a.*, row_number() OVER (PARTITION BY a.x ORDER BY b.y, c.z) AS r FROM {CYCLE}",
        f"SELECT a.x, z.s FROM a JOIN b ON a.x = b.x JOIN c ON b.y = c.y LEFT JOIN (SELECT s, z AS k FROM d) z ON z.k = a.x WHERE c.z = a.z",
        f"SELECT y, count(*) AS n FROM {CYCLE.replace('a.x = b.x', 'a.x <=> b.x')} GROUP BY ALL".replace("SELECT y", "SELECT b.y"),
        "SELECT a.x, s FROM a, b, g WHERE a.x + 1 = b.x AND b.y * 2 = s",
        f"SELECT `a`.`x` AS `odd name`, CASE WHEN b.y > 1 THEN 'p' ELSE 'q' END AS k FROM {CYCLE} SORT BY k".replace(" SORT BY k", ""),
        f"SELECT (SELECT max(x) FROM al) AS top, count(*) FROM {CYCLE}",
        f"SELECT x FROM al EXCEPT SELECT a.x FROM {CYCLE} AND a.x < 3",
    ],
)
def test_joins_anywhere_in_sql(spark, engine, text):
    own = engine.with_mode("mixed", bias=1e-9)
    got = own.sql(text)
    assert own.planner.decisions
    assert got.columns == spark.sql(text).columns and rows(got) == rows(spark.sql(text))


def test_sql_that_is_sparks_own(spark, engine):
    mixed = engine.with_mode("mixed")
    for text in (
        "SELECT /*+ BROADCAST(a) */ a.x FROM a, b, c WHERE a.x = b.x AND b.y = c.y",
        "WITH r AS (SELECT rand() AS v) SELECT a.x FROM a, b, c, r, r s WHERE a.x = b.x AND b.y = c.y AND r.v = s.v AND r.v < 0",
        "SELECT a.x FROM a JOIN b USING (x) JOIN c USING (y)","SELECT a.x, count(*) OVER () AS n FROM a, b, c WHERE a.x = b.x AND b.y = c.y", "SELECT a.x FROM a LEFT JOIN b ON a.x = b.x", "SELECT x, count(*) AS n FROM a GROUP BY x ORDER BY x", "SELECT a.x FROM a, b, c WHERE a.x IN (SELECT x FROM al) AND a.x = b.x AND b.y = c.y"):
        assert rows(mixed.sql(text)) == rows(spark.sql(text))


def test_nulls_duplicates_types(spark):
    a = spark.createDataFrame([(1, "p"), (1, "p"), (None, "q"), (2, None), (3, "r")], "k int, s string")
    b = spark.createDataFrame([(1, 10), (None, 20), (2, 30), (2, 30), (9, None)], "k long, v int")
    c = spark.createDataFrame([("p", 10), ("p", 10), (None, 30), ("r", 30), ("zz", None)], "s string, v short")
    for name, df in {"na": a, "nb": b, "nc": c}.items():
        df.createOrReplaceTempView(name)
    want = rows(spark.sql("SELECT na.k AS a, na.s AS b, nb.v AS c FROM na, nb, nc WHERE na.k = nb.k AND na.s = nc.s AND nb.v = nc.v"))
    assert len(want) == 4
    for mode, more in PLANS:
        e = Engine(spark, Planner(mode=mode, cells=6, **more))
        got = e.join({"na": a, "nb": b, "nc": c}, ["na.k = nb.k AND na.s = nc.s", "nb.v = nc.v"], [("na.k", "a"), ("na.s", "b"), ("nb.v", "c")])
        assert rows(got) == want, mode


def test_keys_that_differ_in_bytes(spark):
    nan = float("nan")
    a = spark.createDataFrame([(0.0, "A"), (-0.0, "b"), (nan, "C"), (1.5, None)], "d double, s string").selectExpr("d", "s COLLATE UTF8_LCASE AS s")
    b = spark.createDataFrame([(-0.0, 1), (0.0, 2), (nan, 3), (2.5, 4)], "f float, k int")
    c = spark.createDataFrame([("a", 1), ("B", 2), ("c", 3), ("x", 1)], "s string, k int").selectExpr("s COLLATE UTF8_LCASE AS s", "k")
    frames = {"a": a, "b": b, "c": c}
    for predicates in (["a.d = b.f", "b.k = c.k"], ["a.d = b.f", "b.k = c.k", "a.s = c.s"]):
        got = {}
        for mode, more in PLANS:
            got[mode, str(more)] = rows(Engine(spark, Planner(mode=mode, cells=6, **more)).join(frames, predicates, [("a.d + 0.0", "d"), ("b.k", "k"), ("upper(a.s)", "s")]))
        assert len({str(g) for g in got.values()}) == 1 and len(got["default", "{}"]) == (7 if len(predicates) == 2 else 3)


def test_null_safe_and_expression_keys_are_variables(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q"), (0, "r"), (2, None)], "k int, s string")
    b = spark.createDataFrame([(1, 10), (None, 20), (0, 30), (7, None)], "k long, v int")
    c = spark.createDataFrame([("P", 11), ("Q", None), ("R", 31), (None, 21)], "t string, w int")
    for name, df in {"sa": a, "sb": b, "sc": c}.items():
        df.createOrReplaceTempView(name)
    predicates = ["sa.k <=> sb.k", "upper(sa.s) = sc.t", "sb.v + 1 <=> sc.w"]
    want = rows(spark.sql(f"SELECT sa.*, sb.v, sc.w FROM sa, sb, sc WHERE {' AND '.join(predicates)}"))
    assert len(want) == 2
    query = MultiJoin.build({"sa": a, "sb": b, "sc": c}, predicates)
    assert len(query.equalities) == 5 and not query.residual
    for mode, more in PLANS:
        e = Engine(spark, Planner(mode=mode, cells=6, **more))
        assert rows(e.join({"sa": a, "sb": b, "sc": c}, predicates, [("sa.k", "k"), ("sa.s", "s"), ("sb.v", "v"), ("sc.w", "w")])) == want, mode
        whole = e.join({"sa": a, "sb": b, "sc": c}, predicates)
        assert whole.columns == ["sa_k", "sa_s", "sb_k", "sb_v", "sc_t", "sc_w"]


def test_strategies_and_settings(spark, engine):
    settings = {"mode": "one-round", "local": "leapfrog", "cells": "8", "shares": "linear-program", "variables": "distinct", "rounds": "breadth-first", "sizes": "sample"}
    for k, v in settings.items():
        spark.conf.set(f"manyfold.{k}", v)
    try:
        own = Engine(spark)
    finally:
        for k in settings:
            spark.conf.unset(f"manyfold.{k}")
    own.tables = engine.tables
    kinds = [type(s).__name__ for s in (own.planner.one_round, own.planner.variables, own.planner.multi_round, own.planner.estimator)]
    assert kinds == ["LinearProgram", "ByDistinct", "BreadthFirst", "SampleEstimator"]
    assert rows(own.sql(TRIANGLE)) == rows(spark.sql(TRIANGLE)) and "shares (2, 2, 2)" in own.planner.decisions[0]
    small = engine.with_mode("one-round", local="leapfrog", leapfrog_rows=1)
    assert rows(small.sql(TRIANGLE)) == rows(spark.sql(TRIANGLE)) and any("too large for leapfrog" in d for d in small.planner.decisions)


def test_statistics_once_for_equal_inputs(spark):
    edges = spark.range(600).selectExpr("id % 30 AS p", "id % 41 AS q").distinct()
    planner = Planner(mode="mixed", cells=4, bias=0.5)
    query = MultiJoin.build({"x": edges, "y": edges.select("*"), "z": edges}, ["x.q = y.p", "y.q = z.p", "z.q = x.p"])
    seen = planner._statistics(query, query.graph(), None)
    assert seen["x"] is seen["z"] and len({id(s) for s in seen.values()}) <= 2 and planner.kept
    planner.release()
    assert not planner.kept


def test_unlike_key_types_stay_correct(spark):
    a, b, c = (spark.createDataFrame(r, s) for r, s in (([(1, "1"), (2, "x")], "i int, s string"), ([(1.0,), (2.5,)], "d double"), ([("1",), ("01",)], "t string")))
    q = MultiJoin.build({"a": a, "b": b, "c": c}, ["a.i = b.d", "a.i = c.t"])
    assert q.equalities == [] and len(q.residual) == 2
    for mode in ("default", "one-round", "mixed"):
        assert rows(Planner(mode=mode, cells=4).plan(q)) == rows(a.alias("a").join(b.alias("b"), F.expr("a.i = b.d")).join(c.alias("c"), F.expr("a.i = c.t")).selectExpr("a.i a_i", "a.s a_s", "b.d b_d", "c.t c_t"))


def test_classification_keeps_every_conjunct(spark, engine):
    frames = {n: engine.tables.frame(n) for n in "abc"}
    q = MultiJoin.build(frames, ["a.x = b.x AND a.z > 1 AND a.x + b.y = c.y AND a.z < c.z", "b.y = c.y"])
    assert q.equalities == [(("a", "x"), ("b", "x")), (("b", "y"), ("c", "y"))]
    assert list(q.local) == ["a"] and len(q.residual) == 2
    with pytest.raises(ValueError):
        MultiJoin.build(frames, ["x = 1"])
    with pytest.raises(ValueError):
        MultiJoin.build(frames, ["nosuch = 1"])


def test_every_row_of_the_answer_is_in_one_cell(spark, engine):
    frames = {n: engine.tables.frame(n) for n in "abc"}
    q = MultiJoin.build(frames, ["a.x = b.x", "b.y = c.y", "c.z = a.z"])
    g = q.graph()
    for name in "abc":
        sent = routed(q, g, name, (2, 2, 2))
        assert sent.count() == 12
        assert sent.select(CELL).distinct().count() <= 8
        assert {r[0] for r in sent.select(CELL).collect()} <= set(range(8))


def test_pruned_columns_and_no_extra_exchange(spark, engine):
    frames = {n: engine.tables.frame(n) for n in "abc"}
    df = Planner(mode="one-round", cells=8).plan(MultiJoin.build(frames, ["a.x = b.x", "b.y = c.y", "c.z = a.z"], [("a.x", "x")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3 and plan.count("shufflepartitionidpassthrough") == 3


def brute(keys, sizes, order):
    names = list(keys)
    out = []
    for combo in np.ndindex(*(sizes[r] for r in names)):
        ok = all(len({int(keys[r][v][i]) for r, i in zip(names, combo, strict=True) if v in keys[r]}) == 1 for v in order)
        if ok:
            out.append(combo)
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_leapfrog_matches_against_brute_force(data):
    shape = data.draw(st.sampled_from([{"a": (0, 1), "b": (1, 2), "c": (2, 0)}, {"a": (0,), "b": (0, 1), "c": (1,), "d": ()}, {"a": (0, 1), "b": (0, 1)}]))
    sizes = {r: data.draw(st.integers(0, 5)) for r in shape}
    keys = {r: {v: np.array(data.draw(st.lists(st.integers(0, 2), min_size=sizes[r], max_size=sizes[r])), np.int64) for v in vs} for r, vs in shape.items()}
    order = sorted({v for vs in shape.values() for v in vs})
    got = matches(keys, sizes, order)
    assert sorted(zip(*(got[r].tolist() for r in shape), strict=True)) == brute(keys, sizes, order)


@pytest.mark.parametrize("how,sql", [("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN"), ("semi", "LEFT SEMI JOIN"), ("anti", "LEFT ANTI JOIN")])
@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle_hash", "merge"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_two_way(spark, how, sql, strategy, null_safe):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, v string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k int, w string")
    left.createOrReplaceTempView("tl")
    right.createOrReplaceTempView("tr")
    want = spark.sql(f"SELECT * FROM tl {sql} tr ON tl.k {'<=>' if null_safe else '='} tr.k")
    if strategy == "broadcast" and how == "full":
        with pytest.raises(ValueError):
            join(left, right, [("k", "k")], how, strategy)
        return
    assert rows(join(left, right, [("k", "k")], how, strategy, null_safe=null_safe)) == rows(want)


def test_two_way_without_keys_and_existence(spark):
    left, right = spark.range(4).toDF("a"), spark.range(3).toDF("b")
    assert join(left, right, how="cross", strategy="cartesian").count() == 12
    assert join(left, right, how="left", strategy="nested_loop", condition=F.expr("a < b")).count() == 5
    assert [r["exists"] for r in join(left, right, [("a", "b")], "existence").orderBy("a").collect()] == [True, True, True, False]
    for bad in ({"how": "full", "strategy": "broadcast"}, {"how": "left", "strategy": "broadcast", "build": "left"}, {"how": "odd"}, {"strategy": "odd"}, {"how": "left", "strategy": "cartesian"}):
        with pytest.raises(ValueError):
            join(left, right, **bad)
    odd = join(left, right, [("a", "b")], "existence", condition="a > 0")
    plan = odd._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in plan and sorted(odd.collect()) == [(0, False), (1, True), (2, True), (3, False)]
    assert sorted(join(left, right, [("a", "b")], "existence", condition=F.col("l.a") > 0).collect()) == sorted(odd.collect())
    big = join(left, right, [("a", "b")], strategy="broadcast", broadcast_limit=0)
    assert big.count() == 3


def test_statistics(spark):
    df = spark.range(2000).selectExpr("id", "id % 10 AS k", "CASE WHEN id % 4 = 0 THEN NULL ELSE 'xy' END AS s", "array(id) AS l")
    s = collect_stats(df, 0.5)
    assert s.rows == 2000 and s.nulls["s"] == 500 and s.nulls["id"] == 0
    assert s.distinct["k"] == 10 and abs(s.distinct["id"] - 2000) < 400 and "l" not in s.distinct
    assert s.size_bytes > 2000 * 16 + 1500 * 2
    assert 800 < s.sample.count() < 1200
    empty = collect_stats(df.limit(0))
    assert (empty.rows, empty.size_bytes) == (0, 0)


def test_sampled_estimate(spark):
    a, b = spark.range(4000).selectExpr("id AS x"), spark.range(8000).selectExpr("id % 4000 AS x")
    q = MultiJoin.build({"a": a, "b": b}, ["a.x = b.x"])
    stats = {"a": collect_stats(a, 0.5), "b": collect_stats(b, 0.5)}
    assert 5000 < SampleEstimator().join_rows(q, q.graph(), stats, ["a", "b"]) < 12000


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_leapfrog_in_blocks_is_the_same(data):
    shape = {"a": (0, 1), "b": (1, 2), "c": (2, 0), "d": (1,)}
    sizes = {r: data.draw(st.integers(0, 6)) for r in shape}
    keys = {r: {v: np.array(data.draw(st.lists(st.integers(0, 2), min_size=sizes[r], max_size=sizes[r])), np.int64) for v in vs} for r, vs in shape.items()}
    blocks = list(matches_by_block(keys, sizes, [2, 0, 1], block=data.draw(st.integers(1, 5))))
    assert sorted(x for b in blocks for x in zip(*(b[r].tolist() for r in shape), strict=True)) == brute(keys, sizes, [0, 1, 2])


def test_leapfrog_holds_a_block_of_bindings_at_once():
    n = 300  # every value of one variable with every one of the other: 90,000 bindings before the last variable decides
    keys = {"a": {0: np.arange(n)}, "b": {1: np.arange(n)}, "c": {0: np.arange(n), 1: np.arange(n)[::-1].copy()}}
    blocks = list(matches_by_block(keys, {r: n for r in keys}, [0, 1], block=50))
    assert sum(len(b["a"]) for b in blocks) == n and max(len(b["a"]) for b in blocks) <= 50


def test_variables_by_distinct_values_keep_bindings_few():
    """In the four-cycle, customers and suppliers of a nation are tied together by orders and their lines only."""
    names = {"l": ("o", "s"), "o": ("o", "c"), "c": ("c", "n"), "s": ("n", "s")}
    distinct = {"o": 9_000_000, "c": 900_000, "n": 25, "s": 60_000}
    rows = {"l": 36_000_000, "o": 9_000_000, "c": 900_000, "s": 60_000}
    graph = QueryGraph.build(names, [(("l", "o"), ("o", "o")), (("o", "c"), ("c", "c")), (("c", "n"), ("s", "n")), (("s", "s"), ("l", "s"))])
    order = ByDistinct().order(graph, {r: RelationStats(rows[r], 0, {c: distinct[c] for c in names[r]}, {}) for r in names})
    assert [graph.classes[v][0][1] for v in order] == ["n", "s", "o", "c"]


def test_cells_are_counted_before_leapfrog(spark):
    """One value of a key holds nearly all rows, so one cell does, whatever the shares are."""
    a, b, c = spark.range(4000).selectExpr("if(id < 3900, 0, id) AS x", "id AS k"), spark.range(50).selectExpr("id AS x", "id AS y"), spark.range(50).selectExpr("id AS y")
    query = MultiJoin.build({"a": a, "b": b, "c": c}, ["a.x = b.x", "b.y = c.y"])
    for shares in ((8, 1), (2, 4)):
        cells = {}
        for r in query.relations:
            for cell, n in routed(query, query.graph(), r, shares).groupBy(CELL).count().collect():
                cells[cell] = cells.get(cell, 0) + n
        assert largest_cell(query, shares, 10**9) == max(cells.values()) > 3900
    for most, large in ((3900, True), (4200, False)):
        planner = Planner(mode="one-round", local="leapfrog", cells=8, leapfrog_rows=most)
        assert planner.plan(query).count() == 3900 + 0
        assert any("too large for leapfrog" in d for d in planner.decisions) == large


@pytest.mark.parametrize("mode,more", [("one-round", {}), ("mixed", {}), ("core", {"bias": 1e-9}), ("one-round", {"local": "leapfrog", "leapfrog_rows": 0})])
def test_rows_are_sieved_before_a_relation_that_closes_a_cycle(spark, mode, more):
    """Keys of unlike widths, 0.0 and -0.0, duplicates and nulls: the filter loses no row, and it is in the plan."""
    values = [None, *range(40)]
    a = spark.createDataFrame([(x, (x or 0) * 7 % 40) for x in values] * 2, "x int, y bigint")
    b = spark.createDataFrame([(y, -0.0 if y % 2 else 1.0 + y % 3) for y in range(0, 40, 3)] + [(None, 0.0)], "y int, z double")
    c = spark.createDataFrame([(z, x) for x in range(0, 40, 9) for z in (0.0, 1.0, None)], "z double, x bigint")
    engine = Engine(spark, Planner(mode=mode, cells=4, sieve_least=1, **more))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in (("sa", a), ("sb", b), ("sc", c)):
            engine.register(name, df)
        text = "SELECT sa.x, sb.y, sc.z FROM sa, sb, sc WHERE sa.x = sc.x AND sa.y = sb.y AND sb.z = sc.z"
        got = engine.sql(text)
        assert "might_contain" in got._jdf.queryExecution().optimizedPlan().toString()
        assert rows(got) == rows(spark.sql(text)) and got.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_of_sparks_joins_take_fewer_cells_where_that_saves_copies(spark):
    frame = lambda a, b: spark.range(40).selectExpr(f"id AS {a}", f"id AS {b}")
    query = MultiJoin.build({"a": frame("x", "y"), "b": frame("y", "z"), "c": frame("z", "x")}, ["a.x = c.x", "a.y = b.y", "b.z = c.z"])
    graph, stats = query.graph(), {r: RelationStats(3_000_000, 0, {}, {}) for r in "abc"}
    assert np.prod(Planner(cells=64)._shares(query, graph, stats, "leapfrog")) == 64
    assert np.prod(Planner(cells=64)._shares(query, graph, stats, "joins")) == 8  # two for each of four cores
    assert np.prod(Planner(cells=64, cell_rows=1_000_000)._shares(query, graph, stats, "joins")) > 8  # else cells grow too large


def test_cells_too_large_for_leapfrog_are_dealt_anew_for_sparks_joins(spark):
    engine = Engine(spark, Planner(mode="one-round", cells=64, local="leapfrog", leapfrog_rows=0))
    frames = {r: spark.range(60).selectExpr(f"id AS {a}", f"id AS {b}") for r, a, b in (("a", "x", "y"), ("b", "y", "z"), ("c", "z", "x"))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = engine.join(frames, ["a.x = c.x", "a.y = b.y", "b.z = c.z"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and ", 8" in plan and ", 64" not in plan
        assert got.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_relation_with_few_keys_is_not_dealt_where_the_others_can_be_broadcast(spark):
    engine = Engine(spark, Planner(mode="one-round", cells=8, local="leapfrog", leapfrog_rows=10))
    large = spark.range(3000).selectExpr("id", "id % 3 AS k", "repeat('x', 10000) AS wide")
    small = spark.range(6).selectExpr("id % 3 AS k", "id % 3 % 2 AS m")
    last = spark.range(2).selectExpr("id AS m", "concat('n', id) AS name")
    got = engine.join({"l": large, "s": small, "n": last}, ["l.k = s.k", "s.m = n.m"], [("l.id", "id"), ("n.name", "name")])
    assert "RepartitionByExpression" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 6000


def edges(spark, wide=False):
    """A derived relation with duplicates, nulls, negative keys and, if wide, keys beyond four bytes."""
    pairs = [(None if k % 97 == 0 else k * 7 % 23 - 5, None if k % 89 == 0 else k * 11 % 19 - 3) for k in range(260)]
    far = 1 << 40 if wide else 0
    df = spark.createDataFrame([(p and p + far, q and q + far) for p, q in pairs], "p long, q long")
    return df.groupBy("p", "q").count().select("p", "q", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).select("p", "q")


CLIQUE = ["ab.p = ac.p", "ab.p = ad.p", "ab.q = bc.p", "ab.q = bd.p", "ac.q = bc.q", "ac.q = cd.p", "ad.q = bd.q", "ad.q = cd.q"]
CLIQUE_OUT = [("ab.p", "a"), ("ab.q", "b"), ("ac.q", "c"), ("ad.q", "d")]


def clique_by_whole(spark, mode, wide=False, **more):
    """The clique over whole relations equals Spark's chain, in a plan without an exchange; returns what was decided."""
    e = edges(spark, wide)
    relations = dict.fromkeys(("ab", "ac", "ad", "bc", "bd", "cd"), e)
    want = rows(Engine(spark, Planner(whole_rows=0)).join(relations, CLIQUE, CLIQUE_OUT))
    planner = Planner(mode=mode, cells=8, whole_least=1, **more)
    got = Engine(spark, planner).join(relations, CLIQUE, CLIQUE_OUT)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == want and len(want) > 100
    planner.release()
    return planner.decisions


@pytest.mark.parametrize("wide", [False, True])
def test_a_round_over_keys_alone_goes_by_whole_relations(spark, wide):
    assert any(d.startswith("whole relations") and "(1 distinct)" in d for d in clique_by_whole(spark, "one-round", wide))


def test_whole_relations_of_one_variable_and_of_unlike_widths(spark):
    """Also a relation that holds one variable twice, and parallel relations."""
    e = edges(spark)
    few = spark.createDataFrame([(k,) for k in [*range(-5, 20, 2), 3, None]], "k short")
    ints = e.select(F.col("p").cast("int").alias("p"), F.col("q").cast("int").alias("q"))
    relations = {"ab": e, "bc": ints, "ca": e, "again": ints, "a": few, "loop": e}
    text = ["ab.q = bc.p", "bc.q = ca.p", "ca.q = ab.p", "again.p = ab.p", "again.q = ab.q", "a.k = ab.p", "loop.p = bc.q", "loop.q = bc.q"]
    out = [("ab.p", "a"), ("bc.p", "b"), ("ca.p", "c"), ("a.k", "k")]
    want = Engine(spark, Planner(whole_rows=0)).join(relations, text, out)
    planner = Planner(mode="one-round", cells=8, whole_least=0)
    planner._whole = lambda part, graph, stats: shape(part, graph, planner.variables.order(graph, stats))
    got = Engine(spark, planner).join(relations, text, out)
    assert any(d.startswith("whole relations") for d in planner.decisions)
    assert got.schema == want.schema and rows(got) == rows(want) and want.count() > 0
    planner.release()


def test_cells_too_large_for_leapfrog_go_by_whole_relations(spark):
    assert any(d.startswith("whole relations") for d in clique_by_whole(spark, "one-round", local="leapfrog", leapfrog_rows=0))


def test_default_goes_by_whole_relations_where_all_are_derived(spark):
    assert any(d.startswith("whole relations") for d in clique_by_whole(spark, "default"))
    e = edges(spark)
    plain = spark.createDataFrame([(k % 23 - 5, k % 19 - 3) for k in range(200)], "p long, q long")
    planner = Planner(whole_least=1)
    Engine(spark, planner).join({"ab": e, "bc": e, "ac": plain}, ["ab.q = bc.p", "ab.p = ac.p", "ac.q = bc.q"], [("ab.p", "a"), ("bc.q", "c")])
    assert planner.decisions == ["multi-round: all"] and not planner.kept


def test_a_core_goes_by_whole_relations(spark):
    assert any(d.startswith("whole relations") for d in clique_by_whole(spark, "core", bias=1e-6))

"""The driver contract: names, schemas, and a few registered queries against their SQL in DuckDB."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from manyfold.queries import JOINS, ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"  # for plans only
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_registered():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(queries)


@here
def test_entry(spark):
    assert contract.entry(spark).count() >= 0


@here
@pytest.mark.parametrize("name", [*(n for n in ORACLES if n.startswith("cycle4_") and not n.endswith("_one_round")), "triangle_leapfrog", "residual_one_round", "composite_mixed", "null_safe_keys_one_round", "expression_keys_mixed", "float_keys_leapfrog", "join_existence", "join_full", "join_null_safe", "key_counts", "column_statistics", "sampled_join_estimate"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    got = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == want


@here
def test_statistics_of_every_table(spark):
    assert "events" in {r.relation for r in QUERIES["column_statistics"](spark, SMALL).collect()}


def joins_of_nations_alone(df):
    """Joins of customers and suppliers by their nation with no other condition: each customer meets every supplier there."""
    lines = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x and "c_nationkey" in x and "s_nationkey" in x]
    assert lines
    return [x for x in lines if "custkey" not in x and "suppkey" not in x]


@here
@pytest.mark.parametrize("name", ["cycle4_derived", "cycle_tails", "cycle4_having", "cycle4_order_limit", "cycle4_sql", "cycle4_exists", "cycle4_distinct", "cycle4_mixed", "cycle4_union", "cycle4_window", "cycle4_with", "left_deep_hints", "cycle_tails_one_round"])
def test_chains_close_cycles_instead_of_multiplying_rows(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not joins_of_nations_alone(QUERIES[name](spark, LARGER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@here
def test_cells_too_large_for_leapfrog_close_cycles_too(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not joins_of_nations_alone(JOINS["cycle_tails"].run("one-round", local="leapfrog", leapfrog_rows=1)(spark, LARGER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@here
def test_few_values_of_a_key_fill_few_cells(spark):
    """Lines have seven quantities: whatever the cells, one holds far more than the average, and leapfrog leaves it to joins."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        df = JOINS["float_keys"].run("one-round", local="leapfrog", leapfrog_rows=600)(spark, SMALL)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert "FlatMapGroupsInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("mode,more", [("default", {}), ("mixed", {"bias": 1e6})])
def test_small_relations_that_multiply_are_dealt_to_all_cores(spark, tmp_path, mode, more):
    """Two relations beyond a broadcast that would share one shuffle partition: the first is dealt out evenly, each in more parts than cores."""
    spark.range(400).selectExpr("id AS c_custkey", "cast(id % 3 AS int) AS c_nationkey", "cast(id % 2 AS string) AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60).selectExpr("id AS s_suppkey", "cast(id % 3 AS int) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        df = JOINS["self_join"].run(mode, **more)(spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        parts = [int(x) for x in re.findall(r"Repartition (\d+), true", plan)]
        assert parts and min(parts) > spark.sparkContext.defaultParallelism, plan
        want = sorted((x, y, s) for x in range(400) for y in range(x + 1, 400) if x % 6 == y % 6 for s in range(x % 3, 60, 3))
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def customers_and_suppliers(spark, folder, customers, suppliers):
    spark.range(customers).selectExpr("id AS c_custkey", "cast(id % 3 AS int) AS c_nationkey", "cast(id % 2 AS string) AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(suppliers).selectExpr("id AS s_suppkey", "cast(id % 3 AS int) AS s_nationkey").write.parquet(f"{folder}/supplier.parquet")


def sorted_joins(df):
    """Sorts of the rows of a join."""
    found = []

    def walk(node):
        below = [node.children().apply(k) for k in range(node.children().size())]
        joins = any(walk(c) for c in below)
        if node.nodeName() == "Sort" and joins:
            found.append(node.toString())
        return joins or "Join" in node.nodeName()

    walk(df._jdf.queryExecution().executedPlan().initialPlan())
    return found


def test_a_round_does_not_sort_rows_that_multiply(spark, tmp_path):
    """Customers meet all suppliers of their nation first: 150,000,000 rows, which spilled as they were sorted to meet customers again."""
    customers_and_suppliers(spark, tmp_path, 30_000, 15_000)
    df = JOINS["self_join"].run("one-round")(spark, str(tmp_path))
    assert "ShuffledHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert not sorted_joins(df)


def test_rounds_hash_only_what_has_room(spark, tmp_path, monkeypatch):
    customers_and_suppliers(spark, tmp_path, 400, 60)
    want = sorted((x, y, s) for x in range(400) for y in range(x + 1, 400) if x % 6 == y % 6 for s in range(x % 3, 60, 3))
    for limit, hashed in ((64 << 20, True), (1_000, False)):
        monkeypatch.setattr("manyfold.plans.planner.BROADCAST_LIMIT", limit)
        df = JOINS["self_join"].run("one-round", hash_least=1)(spark, str(tmp_path))
        assert ("ShuffledHashJoin" in df._jdf.queryExecution().executedPlan().toString()) == hashed
        assert sorted(map(tuple, df.collect())) == want


@pytest.mark.parametrize("mode", ["mixed", "core"])
def test_small_relations_that_multiply_are_no_round(spark, tmp_path, mode):
    """Cells by three nations would leave cores idle; dealt out evenly, with the others broadcast, nothing more is sent."""
    customers_and_suppliers(spark, tmp_path, 400, 60)
    want = sorted((x, y, s) for x in range(400) for y in range(x + 1, 400) if x % 6 == y % 6 for s in range(x % 3, 60, 3))
    customers_and_suppliers(spark, tmp_path / "larger", 10_000, 200)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        for folder, more in ((tmp_path / "larger", {}), (tmp_path, {"whole_least": 1})):
            df = JOINS["self_join"].run(mode, **more)(spark, str(folder))
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            parts = [int(x) for x in re.findall(r"Repartition (\d+), true", plan)]
            assert parts and min(parts) > spark.sparkContext.defaultParallelism and "__cell" not in plan, plan
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

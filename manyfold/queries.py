"""The registered relational queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyfold.engine import Engine
from manyfold.operators.binary import join
from manyfold.plans.cost import SampleEstimator, cheapest_order
from manyfold.plans.planner import BreadthFirst, ByDistinct, LinearProgram, Planner, left_deep
from manyfold.plans.query import MultiJoin
from manyfold.plans.stats import RSD, collect_stats

_BUYS = "SELECT DISTINCT o_custkey AS b_custkey, l_suppkey AS b_suppkey FROM orders, lineitem WHERE o_orderkey = l_orderkey"
_EDGES = "SELECT DISTINCT x.l_partkey AS p, y.l_partkey AS q FROM lineitem x, lineitem y WHERE x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey"
_NULLED = "SELECT nullif(n_nationkey, 7) AS key, n_nationkey AS home FROM nation"
# keys that are equal without having equal bytes: 0.0 and -0.0
_QUANTITIES = "SELECT l_orderkey, l_linenumber, cast(l_linenumber - 2 AS double) AS quantity FROM lineitem"
_SIZES = "SELECT n_nationkey AS kind, -0.5 * cast(n_regionkey - n_regionkey % 2 AS double) AS size FROM nation"
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class JoinQuery:
    """relations: alias -> table or subquery (in parentheses in SQL); predicates joined by AND; output: name -> expression."""

    relations: dict[str, str]
    predicates: tuple[str, ...]
    output: dict[str, str]
    given_sql: str | None = None

    def sql(self) -> str:
        if self.given_sql:
            return self.given_sql
        source = ", ".join(f"{'(' + t + ')' if ' ' in t else t} {a}" for a, t in self.relations.items())
        columns = ", ".join(f"{e} AS {n}" for n, e in self.output.items())
        return f"SELECT {columns} FROM {source} WHERE {' AND '.join(self.predicates)}"

    def run(self, mode: str, **planner) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            cells = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
            engine = Engine(spark, Planner(mode=mode, cells=cells, **planner))
            relations = {a: _source(spark, sf_dir, t) for a, t in self.relations.items()}
            return engine.join(relations, self.predicates, [(e, n) for n, e in self.output.items()])

        return query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A table, or one of the two derived relations as DataFrames."""
    if text == _BUYS:
        orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
        pairs = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        return pairs.select(F.col("o_custkey").alias("b_custkey"), F.col("l_suppkey").alias("b_suppkey")).distinct()
    if text == _EDGES:
        lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        x, y = lines.alias("x"), lines.alias("y")
        near = x.join(y, (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & (F.col("x.l_partkey") < F.col("y.l_partkey")))
        pairs = near.select(F.col("x.l_partkey").alias("p"), F.col("y.l_partkey").alias("q"))
        return pairs.repartition("p").distinct()  # pairs from one vertex stay together, so that they need not be sent again
    if text == _NULLED:
        return _table(spark, sf_dir, "nation").select(F.expr("nullif(n_nationkey, 7)").alias("key"), F.col("n_nationkey").alias("home"))
    if text == _QUANTITIES:
        return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(l_linenumber - 2 AS double)").alias("quantity"))
    if text == _SIZES:  # a double product with -0.5 makes -0.0 of 0
        return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kind"), F.expr("-0.5D * cast(n_regionkey - n_regionkey % 2 AS double)").alias("size"))
    return _table(spark, sf_dir, text)


_CYCLE = ("l.l_orderkey = o.o_orderkey", "o.o_custkey = c.c_custkey", "c.c_nationkey = s.s_nationkey", "s.s_suppkey = l.l_suppkey")
_CYCLE_OUT = {"orderkey": "o.o_orderkey", "linenumber": "l.l_linenumber", "custkey": "c.c_custkey", "suppkey": "s.s_suppkey", "nationkey": "s.s_nationkey", "price": "l.l_extendedprice"}
_CYCLE_IN = {"l": "lineitem", "o": "orders", "c": "customer", "s": "supplier"}

JOINS: dict[str, JoinQuery] = {
    "cycle4": JoinQuery(_CYCLE_IN, _CYCLE, _CYCLE_OUT),
    "chain": JoinQuery(
        {"r": "region", "n": "nation", "c": "customer", "o": "orders"},
        ("r.r_regionkey = n.n_regionkey", "n.n_nationkey = c.c_nationkey", "c.c_custkey = o.o_custkey"),
        {"region": "r.r_name", "nation": "n.n_name", "custkey": "c.c_custkey", "orderkey": "o.o_orderkey", "total": "o.o_totalprice"},
    ),
    "star": JoinQuery(
        {"l": "lineitem", "o": "orders", "p": "part", "s": "supplier"},
        ("l.l_orderkey = o.o_orderkey", "l.l_partkey = p.p_partkey", "l.l_suppkey = s.s_suppkey", "o.o_orderstatus = 'F'"),
        {"orderkey": "o.o_orderkey", "linenumber": "l.l_linenumber", "brand": "p.p_brand", "supplier": "s.s_name", "quantity": "l.l_quantity"},
    ),
    "triangle": JoinQuery(
        {"c": "customer", "s": "supplier", "b": _BUYS},
        ("c.c_nationkey = s.s_nationkey", "b.b_custkey = c.c_custkey", "b.b_suppkey = s.s_suppkey"),
        {"custkey": "c.c_custkey", "suppkey": "s.s_suppkey", "nationkey": "c.c_nationkey"},
    ),
    "clique4": JoinQuery(
        {"ab": _EDGES, "ac": _EDGES, "ad": _EDGES, "bc": _EDGES, "bd": _EDGES, "cd": _EDGES},
        ("ab.p = ac.p", "ab.p = ad.p", "ab.q = bc.p", "ab.q = bd.p", "ac.q = bc.q", "ac.q = cd.p", "ad.q = bd.q", "ad.q = cd.q"),
        {"a": "ab.p", "b": "ab.q", "c": "ac.q", "d": "ad.q"},
        # the same join in two steps, triangles first
        f"WITH e AS MATERIALIZED ({_EDGES}), t AS MATERIALIZED (SELECT ab.p AS a, ab.q AS b, ac.q AS c FROM e ab, e ac, e bc WHERE ab.p = ac.p AND ab.q = bc.p AND ac.q = bc.q) "
        "SELECT t.a, t.b, t.c, ad.q AS d FROM t, e ad, e bd, e cd WHERE ad.p = t.a AND bd.p = t.b AND cd.p = t.c AND ad.q = bd.q AND ad.q = cd.q",
    ),
    "cycle_tails": JoinQuery(
        {**_CYCLE_IN, "n": "nation", "r": "region", "p": "part"},
        (*_CYCLE, "s.s_nationkey = n.n_nationkey", "n.n_regionkey = r.r_regionkey", "l.l_partkey = p.p_partkey"),
        {**_CYCLE_OUT, "nation": "n.n_name", "region": "r.r_name", "brand": "p.p_brand"},
    ),
    "residual": JoinQuery(
        _CYCLE_IN,
        (*_CYCLE, "c.c_acctbal > s.s_acctbal", "l.l_quantity < 25", "l.l_quantity * l.l_extendedprice > o.o_totalprice + s.s_acctbal"),
        _CYCLE_OUT,
    ),
    "composite": JoinQuery(
        {"x": "lineitem", "y": "lineitem", "p": "part"},
        ("x.l_orderkey = y.l_orderkey", "x.l_suppkey = y.l_suppkey", "x.l_partkey = p.p_partkey", "x.l_linenumber < y.l_linenumber"),
        {"orderkey": "x.l_orderkey", "first_line": "x.l_linenumber", "second_line": "y.l_linenumber", "brand": "p.p_brand"},
    ),
    "self_join": JoinQuery(
        {"x": "customer", "y": "customer", "s": "supplier"},
        ("x.c_nationkey = y.c_nationkey", "x.c_nationkey = s.s_nationkey", "x.c_mktsegment = y.c_mktsegment", "x.c_custkey < y.c_custkey"),
        {"x_custkey": "x.c_custkey", "y_custkey": "y.c_custkey", "suppkey": "s.s_suppkey"},
    ),
    "empty_side": JoinQuery(
        _CYCLE_IN,
        (*_CYCLE, "o.o_orderstatus = 'none'"),
        _CYCLE_OUT,
    ),
    "mixed_widths": JoinQuery(
        {"l": "lineitem", "n": "nation", "s": "supplier"},
        ("l.l_suppkey = s.s_suppkey", "s.s_nationkey = n.n_nationkey", "l.l_linenumber = n.n_regionkey"),
        {"orderkey": "l.l_orderkey", "linenumber": "l.l_linenumber", "nation": "n.n_name"},
    ),
    "three_relation_predicate": JoinQuery(
        {"c": "customer", "o": "orders", "n": "nation"},
        ("c.c_custkey = o.o_custkey", "c.c_nationkey = n.n_nationkey", "c.c_acctbal + n.n_regionkey > o.o_totalprice / 10"),
        {"custkey": "c.c_custkey", "orderkey": "o.o_orderkey", "nation": "n.n_name"},
    ),
    "null_safe_keys": JoinQuery(
        {"c": "customer", "n": _NULLED, "s": "supplier"},
        ("nullif(c.c_nationkey, 3) IS NOT DISTINCT FROM n.key", "n.home = s.s_nationkey"),
        {"custkey": "c.c_custkey", "key": "n.key", "suppkey": "s.s_suppkey"},
    ),
    "expression_keys": JoinQuery(
        {"c": "customer", "n": "nation", "r": "region"},
        ("c.c_nationkey + 1 = n.n_nationkey", "n.n_regionkey = 4 - r.r_regionkey"),
        {"custkey": "c.c_custkey", "nation": "n.n_name", "region": "r.r_name"},
    ),
    "float_keys": JoinQuery(
        {"l": _QUANTITIES, "p": _SIZES, "n": "nation"},
        ("l.quantity = p.size", "p.kind = n.n_nationkey"),
        {"orderkey": "l.l_orderkey", "linenumber": "l.l_linenumber", "size": "p.size + 0.0", "nation": "n.n_name"},
    ),
    "disconnected": JoinQuery(
        {"r": "region", "n": "nation", "m": "nation"},
        ("r.r_regionkey = n.n_regionkey",),
        {"region": "r.r_name", "nation": "n.n_name", "other": "m.n_name"},
    ),
}


def _pair(left: str, right: str, left_columns: dict[str, str], right_columns: dict[str, str], **how):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        l, r = (_table(spark, sf_dir, t).select(*(F.expr(e).alias(n) for n, e in c.items())) for t, c in ((left, left_columns), (right, right_columns)))  # noqa: E741
        return join(l, r, **how)

    return query


_CUST = {"custkey": "c_custkey", "balance": "c_acctbal"}
_ORD = {"o_custkey": "o_custkey", "orderkey": "o_orderkey"}
_C = "(SELECT c_custkey AS custkey, c_acctbal AS balance FROM customer)"
_O = "(SELECT o_custkey, o_orderkey AS orderkey FROM orders WHERE o_totalprice > 150000)"
_BIG = {"o_custkey": "CASE WHEN o_totalprice > 150000 THEN o_custkey END", "orderkey": "o_orderkey"}
_O_BIG = "(SELECT CASE WHEN o_totalprice > 150000 THEN o_custkey END AS o_custkey, o_orderkey AS orderkey FROM orders)"
_ON = [("custkey", "o_custkey")]
_HALF = {"custkey": "CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END", "balance": "c_acctbal"}
_NAT = {"key": "CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey END", "nation": "n_name"}
_HALF_SQL = "(SELECT CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS custkey, c_acctbal AS balance FROM customer)"
_NAT_SQL = "(SELECT CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey END AS key, n_name AS nation FROM nation)"

PAIRS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "join_left": (_pair("customer", "orders", _CUST, _BIG, on=_ON, how="left"), f"SELECT * FROM {_C} c LEFT JOIN {_O_BIG} o ON c.custkey = o.o_custkey"),
    "join_right": (_pair("customer", "orders", _CUST, _BIG, on=_ON, how="right"), f"SELECT * FROM {_C} c RIGHT JOIN {_O_BIG} o ON c.custkey = o.o_custkey"),
    "join_full": (_pair("customer", "orders", _CUST, _BIG, on=_ON, how="full"), f"SELECT * FROM {_C} c FULL JOIN {_O_BIG} o ON c.custkey = o.o_custkey"),
    "join_semi": (_pair("customer", "orders", _CUST, _BIG, on=_ON, how="semi"), f"SELECT * FROM {_C} c WHERE EXISTS (SELECT 1 FROM {_O_BIG} o WHERE c.custkey = o.o_custkey)"),
    "join_anti": (_pair("customer", "orders", _CUST, _BIG, on=_ON, how="anti"), f"SELECT * FROM {_C} c WHERE NOT EXISTS (SELECT 1 FROM {_O_BIG} o WHERE c.custkey = o.o_custkey)"),
    "join_existence": (_pair("customer", "orders", _CUST, _BIG, on=_ON, how="existence"), f"SELECT *, EXISTS (SELECT 1 FROM {_O_BIG} o WHERE c.custkey = o.o_custkey) AS \"exists\" FROM {_C} c"),
    "join_null_safe": (_pair("customer", "nation", _HALF, _NAT, on=[("custkey", "key")], null_safe=True), f"SELECT * FROM {_HALF_SQL} c JOIN {_NAT_SQL} n ON c.custkey IS NOT DISTINCT FROM n.key"),
    "join_null_keys": (_pair("customer", "nation", _HALF, _NAT, on=[("custkey", "key")]), f"SELECT * FROM {_HALF_SQL} c JOIN {_NAT_SQL} n ON c.custkey = n.key"),
    "join_broadcast": (_pair("customer", "nation", _HALF, _NAT, on=[("custkey", "key")], strategy="broadcast"), f"SELECT * FROM {_HALF_SQL} c JOIN {_NAT_SQL} n ON c.custkey = n.key"),
    "join_shuffle_hash": (_pair("customer", "orders", _CUST, _ORD, on=_ON, strategy="shuffle_hash"), f"SELECT * FROM {_C} c JOIN (SELECT o_custkey, o_orderkey AS orderkey FROM orders) o ON c.custkey = o.o_custkey"),
    "join_merge": (_pair("customer", "orders", _CUST, _ORD, on=_ON, strategy="merge"), f"SELECT * FROM {_C} c JOIN (SELECT o_custkey, o_orderkey AS orderkey FROM orders) o ON c.custkey = o.o_custkey"),
    "join_nested_loop": (
        _pair("customer", "supplier", _CUST, {"s_suppkey": "s_suppkey", "s_balance": "s_acctbal"}, how="left", strategy="nested_loop", condition="balance > 9900 AND s_balance > balance"),
        f"SELECT * FROM {_C} c LEFT JOIN (SELECT s_suppkey, s_acctbal AS s_balance FROM supplier) s ON balance > 9900 AND s_balance > balance",
    ),
    "join_cartesian": (
        _pair("nation", "region", {"nation": "n_name"}, {"region": "r_name"}, how="cross", strategy="cartesian"),
        "SELECT n_name AS nation, r_name AS region FROM nation, region",
    ),
}


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of rows, nulls and distinct keys, for the tables that queries join."""
    parts = []
    for name, key in (("customer", "c_nationkey"), ("orders", "o_custkey"), ("lineitem", "l_suppkey")):
        df = _table(spark, sf_dir, name)
        parts.append(df.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_nulls")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planner knows of each column of each table: rows, nulls, and whether the approximate number of distinct
    values is within four standard deviations of the exact one."""
    rows = []
    for name in _TABLES:
        df = _table(spark, sf_dir, name)
        s = collect_stats(df)
        exact = df.agg(*(F.count_distinct(c).alias(c) for c in s.distinct)).first()
        rows.extend((name, c, s.rows, s.nulls[c], abs(d - exact[c]) <= 4 * RSD * exact[c]) for c, d in s.distinct.items())
    return spark.createDataFrame(rows, "relation string, column string, n_rows long, n_nulls long, distinct_is_near boolean")


def _sampled_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the chain, and whether the sample estimator's figure is within a quarter of them."""
    q = JOINS["chain"]
    query = MultiJoin.build({a: _source(spark, sf_dir, t) for a, t in q.relations.items()}, q.predicates)
    stats = {a: collect_stats(df, 0.5) for a, df in query.relations.items()}
    estimate = SampleEstimator().join_rows(query, query.graph(), stats, list(query.relations))
    rows = left_deep(query).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.lit("chain").alias("query"), "n_rows", (F.abs(F.lit(float(estimate)) - F.col("n_rows")) <= F.col("n_rows") / 4).alias("estimate_is_near"))


_CYCLE_SQL = f"{', '.join(f'{t} {a}' for a, t in _CYCLE_IN.items())} WHERE {' AND '.join(_CYCLE)}"
#: The four-cycle below other clauses of SQL.
TEXTS = {
    "cycle4_sql": JOINS["cycle4"].sql(),
    "cycle4_order_limit": f"SELECT o.o_orderkey AS orderkey, l.l_linenumber AS linenumber, c.c_custkey AS custkey FROM {_CYCLE_SQL} ORDER BY orderkey DESC, linenumber LIMIT 100",
    "cycle4_distinct": f"SELECT DISTINCT c.c_nationkey AS nationkey, l.l_linenumber AS linenumber FROM {_CYCLE_SQL}",
    "cycle4_having": f"SELECT c.c_custkey AS custkey, count(*) AS n, max(l.l_linenumber) AS last_line FROM {_CYCLE_SQL} GROUP BY c.c_custkey HAVING count(DISTINCT s.s_suppkey) > 1",
    "cycle4_with": f"WITH t AS (SELECT s.s_suppkey AS suppkey, c.c_nationkey AS nationkey, o.o_orderkey AS orderkey FROM {_CYCLE_SQL}), u AS (SELECT suppkey, count(*) AS n FROM t GROUP BY suppkey) SELECT t.orderkey, t.suppkey, u.n, n_name AS nation FROM t JOIN u ON t.suppkey = u.suppkey JOIN nation ON n_nationkey = t.nationkey",
    "cycle4_derived": f"SELECT q.custkey, n.n_name AS nation, q.n FROM (SELECT c.c_custkey AS custkey, c.c_nationkey AS nationkey, count(*) AS n FROM {_CYCLE_SQL} GROUP BY c.c_custkey, c.c_nationkey) q LEFT JOIN nation n ON n.n_nationkey = q.nationkey AND q.n > 1",
    "cycle4_union": f"SELECT c.c_custkey AS k, 'cycle' AS side FROM {_CYCLE_SQL} UNION SELECT s_suppkey AS k, 'supplier' AS side FROM supplier",
    "cycle4_exists": f"SELECT o.o_orderkey AS orderkey, l.l_linenumber AS linenumber FROM {_CYCLE_SQL} AND EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey > 1)",
    "cycle4_window": f"SELECT o.o_orderkey AS orderkey, l.l_linenumber AS linenumber, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderkey, l.l_linenumber) AS place FROM {_CYCLE_SQL}",
}


def _text(text: str, **planner) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, Planner(cells=max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), **planner))
        for t in ("lineitem", "orders", "customer", "supplier", "nation"):
            engine.register(t, _table(spark, sf_dir, t))
        return engine.sql(text)

    return query


def _left_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycle with tails as a chain that starts from a tail, with join hints."""
    q = JOINS["cycle_tails"]
    query = MultiJoin.build({a: _source(spark, sf_dir, t) for a, t in q.relations.items()}, q.predicates, [(e, n) for n, e in q.output.items()])
    start = BreadthFirst().order(query, query.graph(), {})[0]
    order = cheapest_order(query, query.graph(), Planner()._statistics(query, query.graph(), None), start)
    return left_deep(query, order=order, hints={"n": "broadcast", "r": "broadcast"})


def _build() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries, oracles = {}, {}
    for name, q in JOINS.items():
        forms = {name: q.run("default"), f"{name}_one_round": q.run("one-round"), f"{name}_mixed": q.run("mixed")}
        if name in ("cycle4", "triangle", "clique4", "cycle_tails"):
            forms[f"{name}_core"] = q.run("core", bias=1e-6)
            forms[f"{name}_leapfrog"] = q.run("one-round", local="leapfrog")
        for form, run in forms.items():
            queries[form], oracles[form] = run, q.sql()
    for name, (run, sql) in PAIRS.items():
        queries[name], oracles[name] = run, sql
    for name, text in TEXTS.items():
        queries[name], oracles[name] = _text(text, mode="mixed"), text
        queries[f"{name}_one_round"], oracles[f"{name}_one_round"] = _text(text, mode="one-round"), text
    strategies = {
        "cycle4_lp_shares": {"mode": "one-round", "one_round": LinearProgram()},
        "cycle4_distinct_variables": {"mode": "one-round", "local": "leapfrog", "variables": ByDistinct()},
        "cycle4_sample_sizes": {"mode": "core", "bias": 0.5, "estimator": SampleEstimator()},
        "cycle4_breadth_first": {"mode": "mixed", "bias": 0.5, "multi_round": BreadthFirst()},
    }
    for name, planner in strategies.items():
        queries[name], oracles[name] = JOINS["cycle4"].run(**planner), JOINS["cycle4"].sql()
    queries["float_keys_leapfrog"], oracles["float_keys_leapfrog"] = JOINS["float_keys"].run("one-round", local="leapfrog"), JOINS["float_keys"].sql()
    queries["left_deep_hints"], oracles["left_deep_hints"] = _left_deep, JOINS["cycle_tails"].sql()
    queries["key_counts"] = _counts
    oracles["key_counts"] = " UNION ALL ".join(
        f"SELECT '{t}' AS relation, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys, count(*) - count({k}) AS n_nulls FROM {t}"
        for t, k in (("customer", "c_nationkey"), ("orders", "o_custkey"), ("lineitem", "l_suppkey"))
    )
    queries["column_statistics"] = _statistics
    oracles["column_statistics"] = " UNION ALL ".join(
        f"SELECT '{t}' AS relation, k AS \"column\", (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM {t}) - n AS n_nulls, true AS distinct_is_near FROM (SELECT count(COLUMNS(*)) FROM {t}) UNPIVOT INCLUDE NULLS (n FOR k IN (*))" for t in _TABLES
    )
    queries["sampled_join_estimate"] = _sampled_estimate
    oracles["sampled_join_estimate"] = f"SELECT 'chain' AS query, count(*) AS n_rows, true AS estimate_is_near FROM ({JOINS['chain'].sql()})"
    return queries, oracles


QUERIES, ORACLES = _build()

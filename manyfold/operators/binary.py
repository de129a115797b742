"""Two-way joins with a chosen strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sides that may be built (broadcast or hashed) for each type of join.
BUILD_SIDES = {
    "inner": ("right", "left"),
    "cross": ("right", "left"),
    "left": ("right",),
    "right": ("left",),
    "full": (),
    "semi": ("right",),
    "anti": ("right",),
    "existence": ("right",),
}
_HINTS = {"broadcast": "broadcast", "shuffle_hash": "shuffle_hash", "merge": "merge", "nested_loop": "broadcast", "cartesian": "shuffle_replicate_nl"}
#: A side is broadcast on request only if Spark's estimate of it is at most this.
BROADCAST_LIMIT = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcastable(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether Spark's estimate lets a request to broadcast df stand."""
    return estimated_bytes(df) <= limit


def join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]] = (),
    how: str = "inner",
    strategy: str = "auto",
    build: str | None = None,
    null_safe: bool = False,
    condition: Column | str | None = None,
    exists_as: str = "exists",
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """on: pairs of column names, left and right; condition: a further predicate over both sides, as a
    column or as SQL text.

    how: inner, left, right, full, semi, anti, cross or existence (left rows with a boolean). strategy: auto, broadcast,
    shuffle_hash, merge, nested_loop or cartesian. null_safe: null keys match each other. A broadcast of a side that
    is estimated beyond the limit is left to Spark's choice; building a side that the join's type forbids is an error.
    """
    if how not in BUILD_SIDES:
        raise ValueError(f"unknown join type {how}")
    if strategy not in ("auto", *_HINTS):
        raise ValueError(f"unknown strategy {strategy}")
    needs_build = strategy in ("broadcast", "nested_loop", "shuffle_hash")
    side = build or next(iter(BUILD_SIDES[how]), None)
    if needs_build and strategy != "shuffle_hash" and side not in BUILD_SIDES[how]:
        raise ValueError(f"a {how} join can't build its {side or 'either'} side")
    if strategy in ("nested_loop", "cartesian") and on:
        raise ValueError(f"{strategy} is for joins without keys; use condition")
    if strategy == "cartesian" and how not in ("inner", "cross"):
        raise ValueError("a cartesian product is an inner join")
    # columns by position, so that names may occur on both sides
    names_left, names_right = left.columns, right.columns
    left = left.toDF(*names_left).alias("l")
    right = right.toDF(*names_right).alias("r")
    hint = _HINTS.get(strategy)
    if hint == "broadcast":
        if not broadcastable(right if side == "right" else left, broadcast_limit):
            hint = None
    if hint:
        left, right = (left, right.hint(hint)) if side != "left" else (left.hint(hint), right)
    keys = [F.col(f"l.`{a}`").eqNullSafe(F.col(f"r.`{b}`")) if null_safe else F.col(f"l.`{a}`") == F.col(f"r.`{b}`") for a, b in on]
    every = keys + ([F.expr(condition) if isinstance(condition, str) else condition] if condition is not None else [])
    if how == "existence":
        return _existence(left, right, on, null_safe, condition, exists_as)
    if not every:
        return left.crossJoin(right) if how in ("inner", "cross") else left.join(right, F.lit(True), _spark_type(how))
    whole = every[0]
    for c in every[1:]:
        whole = whole & c
    return left.join(right, whole, _spark_type(how))


def _spark_type(how: str) -> str:
    return {"semi": "left_semi", "anti": "left_anti", "cross": "inner", "full": "full_outer"}.get(how, how)


def _existence(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], null_safe: bool, condition: Column | str | None, name: str) -> DataFrame:
    """left with a column that tells whether a match exists: Spark's existence join, by an EXISTS in the select list, which
    reads each side once. A condition given as a Column can't be put there; it costs a semi and an anti join."""
    if condition is None or isinstance(condition, str):
        equal = "<=>" if null_safe else "="
        where = [f"l.`{a}` {equal} r.`{b}`" for a, b in on] + ([f"({condition})"] if condition else [])
        text = f"SELECT l.*, EXISTS (SELECT 1 FROM {{r}} r WHERE {' AND '.join(where) or 'true'}) AS `{name}` FROM {{l}} l"
        return left.sparkSession.sql(text, l=left, r=right)
    for a, b in on:
        equal = F.col(f"l.`{a}`").eqNullSafe(F.col(f"r.`{b}`")) if null_safe else F.col(f"l.`{a}`") == F.col(f"r.`{b}`")
        condition = condition & equal
    matched = left.join(right, condition, "left_semi").withColumn(name, F.lit(True))
    return matched.unionByName(left.join(right, condition, "left_anti").withColumn(name, F.lit(False)))

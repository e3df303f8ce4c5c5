"""Joins and subquery predicates. Catalyst picks the physical join; nothing is broadcast by hint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import InvalidQuery
from .predicates import Predicate, keeps

KINDS = {"inner", "left", "right", "full", "cross"}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def on(left: str, op: str, right: str) -> Column:
    """A condition between qualified columns, such as on("o.o_custkey", "=", "c.c_custkey")."""
    if op not in COMPARE:
        raise InvalidQuery(f"no such comparison: {op}")
    return COMPARE[op](F.col(left), F.col(right))


def join(left: DataFrame, right: DataFrame, condition: Column | None = None, kind: str = "left", alias: str | None = None) -> DataFrame:
    if kind not in KINDS:
        raise InvalidQuery(f"no such join: {kind}")
    right = right.alias(alias) if alias else right
    if kind == "cross":
        return left.crossJoin(right)
    if condition is None:
        raise InvalidQuery(f"a {kind} join needs a condition")
    return left.join(right, condition, kind)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns renamed to prefix_column, so a join result has no clashing names."""
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in df.columns])


def where_in(df: DataFrame, column: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """column IN (subquery)."""
    return df.join(sub.select(F.col(sub_column).alias("_in")), F.col(column) == F.col("_in"), "left_semi")


def where_not_in(df: DataFrame, column: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """column NOT IN (subquery), null-aware: any NULL in the subquery, or a NULL column against a non-empty one, keeps nothing.

    As an anti join on the key with the two NULL cases decided by one scalar subquery, so it stays an equi join.
    """
    keys = sub.select(F.col(sub_column).alias("_in"))
    counts = keys.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("_in").alias("known")).alias("c")).scalar()
    kept = df.join(keys, F.col(column) == F.col("_in"), "left_anti")
    return kept.where((counts["n"] == counts["known"]) & (F.col(column).isNotNull() | (counts["n"] == 0)))


def where_exists(df: DataFrame, sub: DataFrame, condition: Column | None = None) -> DataFrame:
    """EXISTS (subquery), correlated by the condition; without one, all rows or none."""
    return df.join(sub, condition if condition is not None else F.lit(True), "left_semi") if condition is not None else df.join(sub.limit(1), F.lit(True), "left_semi")


def where_not_exists(df: DataFrame, sub: DataFrame, condition: Column | None = None) -> DataFrame:
    return df.join(sub, condition, "left_anti") if condition is not None else df.join(sub.limit(1), F.lit(True), "left_anti")


def with_scalar(df: DataFrame, name: str, sub: DataFrame) -> DataFrame:
    """Adds the single value of a one-row, one-column subquery; NULL if it has no row."""
    return df.withColumn(name, sub.scalar())


def equals_scalar(df: DataFrame, column: str, sub: DataFrame) -> DataFrame:
    return df.where(F.col(column) == sub.scalar())


def subquery(df: DataFrame, columns: list[str], where: Predicate | None = None) -> DataFrame:
    return df.where(keeps(where)).select(*columns)

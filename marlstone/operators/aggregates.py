"""Aggregates, grouping and having."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import InvalidQuery
from .predicates import Predicate, keeps


@dataclass(frozen=True)
class Agg:
    """fn over a field, or over rows where there is none. exact: sum decimals of that scale and return a double, so the order of addition
    can't show. only: count rows that pass."""

    fn: str
    field: str | None = None
    alias: str | None = None
    distinct: bool = False
    exact: int | None = None
    only: Predicate | None = None

    @property
    def name(self) -> str:
        return self.alias or (f"{self.fn}_{self.field}" if self.field else self.fn)

    def column(self) -> Column:
        fn = self.fn.lower()
        if fn not in ("count", "sum", "avg", "min", "max"):
            raise InvalidQuery(f"no such aggregate: {self.fn}")
        if self.field is None:
            if fn != "count":
                raise InvalidQuery(f"{fn} needs a field")
            return F.count(F.when(keeps(self.only), 1)) if self.only else F.count(F.lit(1))
        x = F.col(self.field)
        if self.only is not None:
            x = F.when(keeps(self.only), x)
        if self.exact is not None and fn in ("sum", "avg"):
            total = F.sum(x.cast(f"decimal(18,{self.exact})")).cast("double")
            return total if fn == "sum" else total / F.count(x)
        if self.distinct:
            return F.count_distinct(x) if fn == "count" else F.sum_distinct(x) if fn == "sum" else getattr(F, fn)(x)
        return getattr(F, fn)(x)


def count(field: str | None = None, alias: str | None = None, distinct: bool = False, only: Predicate | None = None) -> Agg:
    return Agg("count", field, alias, distinct, None, only)


def total(field: str, alias: str | None = None, exact: int | None = None) -> Agg:
    return Agg("sum", field, alias, exact=exact)


def avg(field: str, alias: str | None = None, exact: int | None = None) -> Agg:
    return Agg("avg", field, alias, exact=exact)


def least(field: str, alias: str | None = None) -> Agg:
    return Agg("min", field, alias)


def largest(field: str, alias: str | None = None) -> Agg:
    return Agg("max", field, alias)


def aggregate(df: DataFrame, aggs: list[Agg], where: Predicate | None = None) -> DataFrame:
    """One row over all that pass."""
    return df.where(keeps(where)).agg(*[a.column().alias(a.name) for a in aggs])


def group_by(df: DataFrame, keys: list[str], aggs: list[Agg], where: Predicate | None = None, having: Predicate | None = None, keys_last: bool = False) -> DataFrame:
    """Groups by keys (at least one); having sees keys and aggregate names. keys_last puts aggregates before keys."""
    if not keys:
        raise InvalidQuery("group_by needs a key")
    out = df.where(keeps(where)).groupBy(*keys).agg(*[a.column().alias(a.name) for a in aggs])
    if having is not None:
        out = out.where(keeps(having))
    named, plain = [a.name for a in aggs], [k.rpartition(".")[2] for k in keys]
    return out.select(*(named + plain if keys_last else plain + named))


def scalar_or_zero(df: DataFrame, agg: Agg, where: Predicate | None = None) -> DataFrame:
    """One double; zero where there are no rows."""
    return df.where(keeps(where)).agg(F.coalesce(agg.column(), F.lit(0)).cast("double").alias(agg.name))

"""The fluent query builder: an immutable plan that lowers to DataFrame calls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import InvalidQuery, NotFound
from ..plans.schema import Catalog
from . import aggregates, joins, relations, windows
from .predicates import Cond, Predicate, Raw, all_of, field, keeps


@dataclass(frozen=True)
class Join:
    table: str | DataFrame
    condition: Column | None
    kind: str
    alias: str | None


@dataclass(frozen=True)
class Query:
    """Query("orders").where(...).order_by(...).take(n).to_df(catalog). Every method returns a new query."""

    model: str
    alias: str | None = None
    columns: tuple[str | Column, ...] = ()
    filters: tuple[Predicate, ...] = ()
    joined: tuple[Join, ...] = ()
    keys: tuple[str, ...] = ()
    aggs: tuple[aggregates.Agg, ...] = ()
    having_: Predicate | None = None
    window_fns: tuple[windows.WindowFn, ...] = ()
    distinct_on_: tuple[str, ...] = ()
    unique: bool = False
    order: tuple[tuple[str, str] | str, ...] = ()
    limit: int | None = None
    offset: int = 0
    includes: tuple[relations.Include, ...] = ()
    steps: tuple[Callable[[DataFrame, Catalog], DataFrame], ...] = ()
    beyond: tuple[tuple[str, object], ...] = ()

    def select(self, *columns: str | Column) -> Query:
        return replace(self, columns=columns)

    def where(self, *predicates: Predicate, **equal) -> Query:
        return replace(self, filters=(*self.filters, *predicates, *(field(k).equals(v) for k, v in equal.items())))

    def join(self, table: str | DataFrame, condition: Column | None = None, kind: str = "left", alias: str | None = None) -> Query:
        return replace(self, joined=(*self.joined, Join(table, condition, kind, alias)))

    def where_in(self, column: str, sub: Query, sub_column: str) -> Query:
        return self._step(lambda df, c: joins.where_in(df, column, sub.to_df(c), sub_column))

    def where_not_in(self, column: str, sub: Query, sub_column: str) -> Query:
        return self._step(lambda df, c: joins.where_not_in(df, column, sub.to_df(c), sub_column))

    def where_exists(self, sub: Query, condition: Column | None = None) -> Query:
        return self._step(lambda df, c: joins.where_exists(df, sub.to_df(c), condition))

    def where_not_exists(self, sub: Query, condition: Column | None = None) -> Query:
        return self._step(lambda df, c: joins.where_not_exists(df, sub.to_df(c), condition))

    def some(self, relation: str, where: Predicate | None = None) -> Query:
        return self._step(lambda df, c: relations.some(c, df, self.model, relation, where))

    def every(self, relation: str, where: Predicate) -> Query:
        return self._step(lambda df, c: relations.every(c, df, self.model, relation, where))

    def none(self, relation: str, where: Predicate | None = None) -> Query:
        return self._step(lambda df, c: relations.none(c, df, self.model, relation, where))

    def group_by(self, *keys: str) -> Query:
        return replace(self, keys=keys)

    def aggregate(self, *aggs: aggregates.Agg) -> Query:
        return replace(self, aggs=aggs)

    def having(self, predicate: Predicate) -> Query:
        return replace(self, having_=predicate)

    def window(self, *fns: windows.WindowFn) -> Query:
        return replace(self, window_fns=(*self.window_fns, *fns))

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def distinct_on(self, *keys: str) -> Query:
        """One row per key: the first in the query's order, ties by the model's key."""
        return replace(self, distinct_on_=keys)

    def order_by(self, *keys: tuple[str, str] | str) -> Query:
        return replace(self, order=(*self.order, *keys))

    def take(self, n: int) -> Query:
        if n < 0:
            raise InvalidQuery("take can't be negative")
        return replace(self, limit=n)

    def skip(self, n: int) -> Query:
        if n < 0:
            raise InvalidQuery("skip can't be negative")
        return replace(self, offset=n)

    def cursor(self, name: str, value) -> Query:
        """Rows beyond the value in the direction that the query orders the field; exclusive.

        Rows that tie with the value are skipped: a page ordered by a field that isn't unique is continued by after.
        """
        way = next((k[1] for k in self.order if not isinstance(k, str) and k[0] == name), "asc")
        return self.where(Cond(name, "lt" if way.lower() == "desc" else "gt", value))

    def after(self, **row) -> Query:
        """Rows beyond a given one: the values, NULL included, of all fields that the query orders by and of the model's key.

        The key ends the order, so no row that ties with the given one is skipped or comes twice.
        """
        return replace(self, beyond=tuple(row.items()))

    def _continued(self, catalog: Catalog) -> Query:
        """The query with what after says as a condition, and the key at the end of its order."""
        ways = [(k, "asc") if isinstance(k, str) else k for k in self.order]
        ways += [(k, "asc") for k in catalog.key(self.model) if k not in {w[0] for w in ways}]
        values = dict(self.beyond)
        if missing := [k for k, _ in ways if k not in values]:
            raise InvalidQuery(f"after needs {', '.join(missing)}")
        cases, same = [], F.lit(True)
        for name, way in ways:
            col, value = F.col(name), values[name]
            if way.lower() == "desc":  # NULLs come first
                further = col.isNotNull() if value is None else col < F.lit(value)
            else:
                further = F.lit(False) if value is None else col.isNull() | (col > F.lit(value))
            cases.append(same & further)
            same = same & col.eqNullSafe(F.lit(value))
        return replace(self.where(Raw(reduce(or_, cases))), order=tuple(ways), beyond=())

    def include(self, relation: str, where: Predicate | None = None, order: tuple = (), take: int | None = None, select: tuple[str, ...] = (), include: tuple = ()) -> Query:
        return replace(self, includes=(*self.includes, relations.Include(relation, where, order, take, select, include)))

    def _step(self, f: Callable[[DataFrame, Catalog], DataFrame]) -> Query:
        return replace(self, steps=(*self.steps, f))

    def to_df(self, catalog: Catalog) -> DataFrame:
        if self.beyond:
            return self._continued(catalog).to_df(catalog)
        df = catalog.table(self.model)
        if self.alias:
            df = df.alias(self.alias)
        for j in self.joined:
            df = joins.join(df, catalog.table(j.table) if isinstance(j.table, str) else j.table, j.condition, j.kind, j.alias)
        if self.filters:
            df = df.where(keeps(all_of(*self.filters)))
        for step in self.steps:
            df = step(df, catalog)
        if self.keys:
            df = aggregates.group_by(df, list(self.keys), list(self.aggs), having=self.having_)
        elif self.aggs:
            df = aggregates.aggregate(df, list(self.aggs))
            df = df.where(keeps(self.having_)) if self.having_ is not None else df
        elif self.having_ is not None:
            raise InvalidQuery("having without groups or aggregates")
        if self.window_fns:
            df = windows.with_windows(df, *self.window_fns)
        if self.distinct_on_:
            ties = [k for k in catalog.key(self.model) if k in df.columns]
            w = Window.partitionBy(*self.distinct_on_).orderBy(*windows.ordering([*self.order, *ties]))
            df = df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")
        if self.unique:
            df = (df.select(*self.columns) if self.columns else df).distinct()
        paged = self.limit is not None or self.offset
        order = windows.ordering(list(self.order))
        if order and (paged or not self.includes):
            df = df.orderBy(*order)
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        # parents are paged before children are attached; a page that its order decides is small, and children are cut to it
        fixed = self.limit is not None and {*catalog.key(self.model)} <= {k if isinstance(k, str) else k[0] for k in self.order}
        page = df if fixed and self.includes else None
        for i in self.includes:
            df = relations.include(catalog, df, self.model, i, page)
        if order and self.includes:  # the joins of the children lose the order
            df = df.orderBy(*order)
        if self.columns and not self.unique:
            df = df.select(*self.columns, *[i.relation for i in self.includes])
        return df

    # actions

    def find_many(self, catalog: Catalog) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.to_df(catalog).collect()]

    def find_first(self, catalog: Catalog) -> dict | None:
        return next(iter(self.take(1).find_many(catalog)), None)

    def find_unique(self, catalog: Catalog) -> dict | None:
        """The only row; raises if there is another."""
        rows = self.take(2).find_many(catalog)
        if len(rows) > 1:
            raise InvalidQuery(f"more than one {self.model} matches")
        return rows[0] if rows else None

    def find_first_or_raise(self, catalog: Catalog) -> dict:
        row = self.find_first(catalog)
        if row is None:
            raise NotFound(f"no {self.model} matches")
        return row

    def find_unique_or_raise(self, catalog: Catalog) -> dict:
        row = self.find_unique(catalog)
        if row is None:
            raise NotFound(f"no {self.model} matches")
        return row

    def count(self, catalog: Catalog) -> int:
        return self.to_df(catalog).count()

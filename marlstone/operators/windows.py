"""Window functions with explicit partitions, null order and frames, frame exclusion included."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import InvalidQuery

UNBOUNDED_PRECEDING, CURRENT_ROW, UNBOUNDED_FOLLOWING = Window.unboundedPreceding, 0, Window.unboundedFollowing


def preceding(n: int) -> int:
    return -n


def following(n: int) -> int:
    return n


def ordering(keys: list[tuple[str, str] | str]) -> list[Column]:
    """ASC puts NULLs last and DESC first."""
    out = []
    for k in keys:
        name, way = (k, "asc") if isinstance(k, str) else k
        if way.lower() not in ("asc", "desc"):
            raise InvalidQuery(f"no such direction: {way}")
        out.append(F.col(name).asc_nulls_last() if way.lower() == "asc" else F.col(name).desc_nulls_first())
    return out


@dataclass(frozen=True)
class Over:
    partition: tuple[str, ...] = ()
    order: tuple[tuple[str, str] | str, ...] = ()
    frame: tuple[str, int, int] | None = None
    exclude: str = "no others"

    def partition_by(self, *fields: str) -> Over:
        return replace(self, partition=fields)

    def order_by(self, *keys: tuple[str, str] | str) -> Over:
        return replace(self, order=keys)

    def rows(self, start: int, end: int = CURRENT_ROW) -> Over:
        return replace(self, frame=("rows", start, end))

    def range(self, start: int, end: int = CURRENT_ROW) -> Over:
        return replace(self, frame=("range", start, end))

    def excluding(self, what: str) -> Over:
        if what not in ("current row", "group", "ties", "no others"):
            raise InvalidQuery(f"no such exclusion: {what}")
        return replace(self, exclude=what)

    def bounds(self) -> tuple[str, int, int]:
        """The frame; without one, all peers and rows before them, or the whole partition if it has no order."""
        return self.frame or (("range", UNBOUNDED_PRECEDING, CURRENT_ROW) if self.order else ("rows", UNBOUNDED_PRECEDING, UNBOUNDED_FOLLOWING))

    def spec(self):
        w = Window.partitionBy(*self.partition)
        if self.order:
            w = w.orderBy(*ordering(list(self.order)))
        if self.frame:
            kind, a, b = self.frame
            w = w.rowsBetween(a, b) if kind == "rows" else w.rangeBetween(a, b)
        return w


@dataclass(frozen=True)
class WindowFn:
    fn: str
    field: str | None
    alias: str
    over: Over
    offset: int = 1
    default: object = None

    def column(self, types: dict[str, T.DataType] | None = None) -> Column:
        """The function over its window. With an exclusion other than a row frame's current row, the rows need _rank and _row,
        which with_windows gives them."""
        w = self.over.spec()
        x = F.col(self.field) if self.field else F.lit(1)
        if self.fn in ("row_number", "rank", "dense_rank"):
            return getattr(F, self.fn)().over(w).cast("bigint")
        if self.fn in ("lag", "lead"):
            return getattr(F, self.fn)(x, self.offset, self.default).over(w)
        if self.fn in ("first_value", "last_value"):
            return getattr(F, self.fn)(x).over(w)
        if self.fn not in ("sum", "avg", "count", "min", "max"):
            raise InvalidQuery(f"no such window function: {self.fn}")
        if self.over.exclude == "no others":
            return getattr(F, self.fn)(x).over(w)
        return self._combined(self._parts(x, types or {}))

    def needs_ranks(self) -> bool:
        return self.over.exclude != "no others" and not (self.over.exclude == "current row" and self.over.bounds()[0] == "rows")

    def _parts(self, x: Column, types: dict[str, T.DataType]) -> list[Part]:
        """The frame without what is excluded, as disjoint parts.

        Rows before and after the current one's peers lie in a range of ranks where the frame is open to that side, and in a
        window of at most as many rows as the frame says where it isn't; so only that many rows are ever held.
        """
        kind, a, b = self.over.bounds()
        what = self.over.exclude
        beside = lambda lo, hi: _span(x, self.over.rows(lo, hi).spec())
        ranks = Window.partitionBy(*self.over.partition).orderBy("_rank")
        if kind == "rows" and what == "current row":
            return [beside(a, min(b, -1))] * (a < 0) + [beside(max(a, 1), b)] * (b > 0)
        if kind == "rows" and (a > 0 or b < 0):
            return [self._held(x, a, b)]
        parts = []
        if kind == "rows":
            if a < 0:
                parts.append(_span(x, ranks.rangeBetween(UNBOUNDED_PRECEDING, -1)) if a == UNBOUNDED_PRECEDING else self._held(x, a, -1))
            if b > 0:
                parts.append(_span(x, ranks.rangeBetween(1, UNBOUNDED_FOLLOWING)) if b == UNBOUNDED_FOLLOWING else self._held(x, 1, b))
        else:
            whole = all(isinstance(types.get(k if isinstance(k, str) else k[0]), T.IntegralType) for k in self.over.order) and len(self.over.order) == 1
            free = (UNBOUNDED_PRECEDING, CURRENT_ROW, UNBOUNDED_FOLLOWING)
            if not (a in free and b in free) and not whole or a > 0 or b < 0:
                return [self._held(x, a, b)]
            if a < 0:
                parts.append(_span(x, ranks.rangeBetween(a, -1) if a == UNBOUNDED_PRECEDING else self.over.range(a, -1).spec()))
            if b > 0:
                parts.append(_span(x, ranks.rangeBetween(1, b) if b == UNBOUNDED_FOLLOWING else self.over.range(1, b).spec()))
        if what == "ties":
            parts.append(lambda fn: F.when(x.isNotNull(), 1).otherwise(0).cast("bigint") if fn == "count" else x)
        elif what == "current row":
            peers = Window.partitionBy(*self.over.partition, "_rank").orderBy("_row")
            parts += [_span(x, peers.rowsBetween(UNBOUNDED_PRECEDING, -1)), _span(x, peers.rowsBetween(1, UNBOUNDED_FOLLOWING))]
        return parts

    def _held(self, x: Column, a: int, b: int) -> Part:
        """A short frame as an array, without the current row's peers; the current row and its peers stay as far as the exclusion says."""
        over = replace(self.over, frame=(self.over.bounds()[0], a, b))
        rows = F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col("_row").alias("row"), x.alias("v"))).over(over.spec())
        stays = {
            "group": lambda r: r["rank"] != F.col("_rank"),
            "ties": lambda r: (r["rank"] != F.col("_rank")) | (r["row"] == F.col("_row")),
            "current row": lambda r: r["row"] != F.col("_row"),
        }[self.over.exclude]
        known = F.filter(F.transform(F.filter(rows, stays), lambda r: r["v"]), lambda v: v.isNotNull())
        return lambda fn: {
            "count": lambda: F.size(known).cast("bigint"), "min": lambda: F.array_min(known), "max": lambda: F.array_max(known),
            "sum": lambda: F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v.cast("double"))),
        }[fn]()

    def _combined(self, parts: list[Part]) -> Column:
        add = lambda fn: reduce(lambda p, q: p + q, [F.coalesce(p(fn), F.lit(0)) for p in parts])
        if not parts:
            return F.lit(0).cast("bigint") if self.fn == "count" else F.lit(None).cast("double")
        if self.fn == "count":
            return add("count")
        if self.fn in ("min", "max"):
            return parts[0](self.fn) if len(parts) == 1 else (F.least if self.fn == "min" else F.greatest)(*[p(self.fn) for p in parts])
        n = add("count")
        return F.when(n > 0, add("sum") if self.fn == "sum" else add("sum") / n)


#: An aggregate (count, sum, min or max) of part of a frame.
Part = Callable[[str], Column]


def _span(x: Column, spec) -> Part:
    return lambda fn: getattr(F, fn)(x).over(spec)


def over(*partition: str) -> Over:
    return Over(partition)


def window_fn(fn: str, alias: str, w: Over, field: str | None = None, offset: int = 1, default: object = None) -> WindowFn:
    return WindowFn(fn, field, alias, w, offset, default)


def with_windows(df: DataFrame, *fns: WindowFn) -> DataFrame:
    """df with each function's column. A frame exclusion gets ranks of peers first; functions of one partition and order share them."""
    types = {f.name: f.dataType for f in df.schema}
    plain = [f for f in fns if not f.needs_ranks()]
    out = df.withColumns({f.alias: f.column(types) for f in plain}) if plain else df
    groups: dict[tuple, list[WindowFn]] = {}
    for f in fns:
        if f.needs_ranks():
            groups.setdefault((f.over.partition, f.over.order), []).append(f)
    for (partition, order), some in groups.items():
        w = Window.partitionBy(*partition)
        rank = F.dense_rank().over(w.orderBy(*ordering(list(order)))) if order else F.lit(1)
        ranked = out.withColumns({"_row": F.monotonically_increasing_id(), "_rank": rank})
        out = ranked.withColumns({f.alias: f.column(types) for f in some}).drop("_row", "_rank")
    added = [f.alias for f in fns if f.alias not in df.columns]
    kept = [c for c in out.columns if c not in added]
    return out if out.columns == [*kept, *added] else out.select(*[F.col(f"`{c}`") for c in (*kept, *added)])

"""Filter trees and how they become columns.

Comparisons keep three-valued logic: a NULL operand gives NULL, and equality with None never matches (use is_null).
Array, JSON and full-text predicates are never NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import json as J
from ..plans.errors import InvalidQuery

Resolve = Callable[[str], Column]


class Predicate:
    def __and__(self, other: Predicate) -> Group:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Group:
        return any_of(self, other)

    def __invert__(self) -> Group:
        return not_(self)

    def column(self, resolve: Resolve = F.col) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Cond(Predicate):
    field: str
    op: str
    value: Any = None
    path: Any = None
    insensitive: bool = False

    def column(self, resolve: Resolve = F.col) -> Column:
        if self.op not in OPERATORS:
            raise InvalidQuery(f"no such operator: {self.op}")
        return OPERATORS[self.op](resolve(self.field), self)


@dataclass(frozen=True)
class Raw(Predicate):
    """A ready-made column, for conditions between columns or on aggregates."""

    expression: Column

    def column(self, resolve: Resolve = F.col) -> Column:
        return self.expression


@dataclass(frozen=True)
class Group(Predicate):
    kind: str
    parts: tuple[Predicate, ...]

    def column(self, resolve: Resolve = F.col) -> Column:
        cols = [p.column(resolve) for p in self.parts]
        if self.kind == "and":
            return reduce(and_, cols, F.lit(True)) if not cols else reduce(and_, cols)
        if self.kind == "or":
            return reduce(or_, cols) if cols else F.lit(False)
        if self.kind == "nor":
            return ~reduce(or_, cols) if cols else F.lit(True)
        if self.kind == "not_all":
            return ~reduce(and_, cols) if cols else F.lit(False)
        raise InvalidQuery(f"no such connective: {self.kind}")


def all_of(*parts: Predicate) -> Group:
    return Group("and", parts)


def any_of(*parts: Predicate) -> Group:
    return Group("or", parts)


def not_(*parts: Predicate) -> Group:
    """None of the parts holds."""
    return Group("nor", parts)


def not_all(*parts: Predicate) -> Group:
    """Not all of the parts hold together."""
    return Group("not_all", parts)


def like_pattern(value: str) -> str:
    """% and _ of the value stay wildcards; backslashes are ordinary characters."""
    return value.replace("\\", "\\\\")


def _like(col: Column, c: Cond, pattern: str) -> Column:
    return F.lower(col).like(pattern.lower()) if c.insensitive else col.like(pattern)


def _in(col: Column, c: Cond) -> Column:
    values = list(c.value)
    return col.isin(*values) if values else F.lit(False)


def _null(col: Column, c: Cond) -> Column:
    if not isinstance(c.value, bool):
        raise InvalidQuery("is_null takes true or false")
    return col.isNull() if c.value else col.isNotNull()


def _search(col: Column, c: Cond) -> Column:
    """Every word of the value is a whole word of the text; no stemming and no stop words.

    Words of both are runs of letters and digits. A plain substring test goes before the pattern.
    """
    text = F.lower(col)
    words = dict.fromkeys(re.findall(r"[^\W_]+", c.value.lower()))
    found = [F.contains(text, F.lit(w)) for w in words] + [F.regexp_like(text, F.lit(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])")) for w in words]
    return F.coalesce(reduce(and_, found, F.lit(True)), F.lit(False))


def _known(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


OPERATORS: dict[str, Callable[[Column, Cond], Column]] = {
    "equals": lambda x, c: x == F.lit(c.value),
    "not_equals": lambda x, c: x != F.lit(c.value),
    "gt": lambda x, c: x > F.lit(c.value),
    "gte": lambda x, c: x >= F.lit(c.value),
    "lt": lambda x, c: x < F.lit(c.value),
    "lte": lambda x, c: x <= F.lit(c.value),
    "in": _in,
    "not_in": lambda x, c: ~_in(x, c),
    "like": lambda x, c: _like(x, c, c.value),
    "contains": lambda x, c: _like(x, c, f"%{like_pattern(c.value)}%"),
    "starts_with": lambda x, c: _like(x, c, f"{like_pattern(c.value)}%"),
    "ends_with": lambda x, c: _like(x, c, f"%{like_pattern(c.value)}"),
    "is_null": _null,
    "json_path": lambda x, c: J.path_equals(x, c.path, c.value),
    "json_contains": lambda x, c: J.contains(x, c.value),
    "json_array_contains": lambda x, c: J.array_contains(x, c.path, c.value),
    "json_has_key": lambda x, c: J.has_key(x, c.value, c.path or "$"),
    "is_empty": lambda x, c: (F.coalesce(F.size(x), F.lit(0)) == 0) == F.lit(bool(c.value)),
    "has": lambda x, c: _known(F.array_contains(x, F.lit(c.value))),
    "has_every": lambda x, c: _known(F.size(F.array_except(F.array(*map(F.lit, c.value)), x)) == 0) if c.value else F.lit(True),
    "has_some": lambda x, c: _known(F.arrays_overlap(x, F.array(*map(F.lit, c.value)))) if c.value else F.lit(False),
    "search": _search,
}


class FieldRef:
    """Conditions on one field: col("age").gte(18)."""

    def __init__(self, name: str):
        self.name = name

    def _c(self, op: str, value: Any = None, **more) -> Cond:
        return Cond(self.name, op, tuple(value) if isinstance(value, list | set) and op != "json_contains" else value, **more)

    def equals(self, v):
        return self._c("equals", v)

    def not_equals(self, v):
        return self._c("not_equals", v)

    def gt(self, v):
        return self._c("gt", v)

    def gte(self, v):
        return self._c("gte", v)

    def lt(self, v):
        return self._c("lt", v)

    def lte(self, v):
        return self._c("lte", v)

    def is_in(self, values: Iterable):
        return self._c("in", tuple(values))

    def not_in(self, values: Iterable):
        return self._c("not_in", tuple(values))

    def like(self, pattern: str, insensitive: bool = False):
        return self._c("like", pattern, insensitive=insensitive)

    def contains(self, v: str, insensitive: bool = False):
        return self._c("contains", v, insensitive=insensitive)

    def starts_with(self, v: str, insensitive: bool = False):
        return self._c("starts_with", v, insensitive=insensitive)

    def ends_with(self, v: str, insensitive: bool = False):
        return self._c("ends_with", v, insensitive=insensitive)

    def is_null(self, yes: bool = True):
        return self._c("is_null", yes)

    def is_not_null(self):
        return self._c("is_null", False)

    def json_path(self, path, v):
        return self._c("json_path", v, path=path)

    def json_contains(self, v):
        return self._c("json_contains", v)

    def json_array_contains(self, path, v):
        return self._c("json_array_contains", v, path=path)

    def json_has_key(self, key: str, path=None):
        return self._c("json_has_key", key, path=path)

    def is_empty(self, yes: bool = True):
        return self._c("is_empty", yes)

    def has(self, v):
        return self._c("has", v)

    def has_every(self, values: Iterable):
        return self._c("has_every", tuple(values))

    def has_some(self, values: Iterable):
        return self._c("has_some", tuple(values))

    def search(self, words: str):
        return self._c("search", words)


def field(name: str) -> FieldRef:
    return FieldRef(name)


def keeps(predicate: Predicate | None, resolve: Resolve = F.col) -> Column:
    """Whether a row passes, never NULL; no predicate passes all."""
    return F.lit(True) if predicate is None else F.coalesce(predicate.column(resolve), F.lit(False))

"""Common table expressions, plain, with column lists, and recursive."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..plans.errors import InvalidQuery
from ..plans.runtime import with_tables


@dataclass(frozen=True)
class With:
    """With().add("t", "SELECT ...").query("SELECT ... FROM t", spark, lo=1). Values go in by name, never by position in the text."""

    parts: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    recursive: bool = False

    def add(self, name: str, sql: str, columns: tuple[str, ...] = ()) -> With:
        if not name.isidentifier() or not all(c.isidentifier() for c in columns):
            raise InvalidQuery(f"not a name: {name} {columns}")
        return replace(self, parts=(*self.parts, (name, columns, sql)))

    def add_recursive(self, name: str, base: str, step: str, columns: tuple[str, ...]) -> With:
        """base UNION ALL step; the step should bound its own depth."""
        return replace(self.add(name, f"{base} UNION ALL {step}", columns), recursive=True)

    def text(self, body: str) -> str:
        parts = ", ".join(f"{n}{'(' + ', '.join(c) + ')' if c else ''} AS ({q})" for n, c, q in self.parts)
        return f"WITH {'RECURSIVE ' if self.recursive else ''}{parts} {body}" if parts else body

    def query(self, body: str, spark: SparkSession, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
        return with_tables(spark, self.text(body), tables, args or None)

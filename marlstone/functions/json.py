"""JSON predicates on text columns, evaluated in the JVM over variants."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import InvalidQuery


def _step(key: str) -> str:
    """One key of a path. Which quotes a path may hold differs between JSON functions, so a key with one goes after a dot."""
    if "'" not in key and "?" not in key:
        return f"['{key}']"
    if any(c in key for c in ".["):
        raise InvalidQuery(f"a JSON path can't hold the key {key!r}")
    return f".{key}"


def path_of(path: str | list[str | int]) -> str:
    """'$.a[0]' as it is; a list of keys and indexes as a path."""
    if isinstance(path, str):
        return path if path.startswith("$") else f"$.{path}"
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else _step(p) for p in path)


def text_of(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def path_equals(col: Column, path: str | list, value) -> Column:
    """The value at the path, as text, equals; a missing path gives NULL."""
    return F.get_json_object(col, path_of(path)) == F.lit(text_of(value))


def _contains(v: Column, value) -> Column:
    if isinstance(value, dict):
        parts = [_contains(F.try_variant_get(v, path_of([k]), "variant"), x) for k, x in value.items()]
        return reduce(and_, parts, F.schema_of_variant(v).startswith("OBJECT"))
    if isinstance(value, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        among = lambda x: F.exists(items, lambda e: F.coalesce(_contains(e, x), F.lit(False)))
        return reduce(and_, map(among, value), items.isNotNull())
    if value is None:
        return F.schema_of_variant(v) == "VOID"
    text = F.to_json(v)
    if isinstance(value, bool):
        return text == json.dumps(value)
    if isinstance(value, int | float):
        return ~text.startswith('"') & (text.try_cast("double") == float(value))
    return F.schema_of_variant(v).eqNullSafe("STRING") & (F.try_variant_get(v, "$", "string") == value)


def contains(col: Column, value) -> Column:
    """Containment: objects by key, arrays by element in any order, scalars by equality; never NULL."""
    v = F.try_parse_json(col)
    inside = _contains(v, value)
    if not isinstance(value, dict | list):  # an array also contains a scalar element
        inside = F.coalesce(inside, F.lit(False)) | F.coalesce(_contains(v, [value]), F.lit(False))
    return F.coalesce(inside, F.lit(False))


def array_contains(col: Column, path: str | list, value) -> Column:
    return F.coalesce(_contains(F.try_variant_get(F.try_parse_json(col), path_of(path), "variant"), [value]), F.lit(False))


def has_key(col: Column, key: str, path: str | list = "$") -> Column:
    """Whether the object at the path has the key, whatever its value, JSON null included."""
    at = path_of(path)
    keys = F.json_object_keys(col if at == "$" else F.get_json_object(col, at))
    return F.coalesce(F.array_contains(keys, key), F.lit(False))

"""Values that a schema gives to columns by itself: defaults of new rows, and update times.

Generated ids differ between evaluations of a plan; read them back from the table that was written.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import InvalidQuery
from ..plans.schema import Field, Schema

_CALL = re.compile(r"(\w+)\((.*)\)", re.S)


def _cuid(prefix: str, n: int) -> Column:
    """A letter and n base-36 characters: milliseconds, then random ones."""
    at = F.lpad(F.lower(F.conv(F.unix_millis(F.current_timestamp()).cast("string"), 10, 36)), 8, "0")
    rest = F.rpad(F.lower(F.conv(F.substring(F.sha2(F.expr("uuid()"), 256), 1, 15), 16, 36)), 11, "0")
    more = F.rpad(F.lower(F.conv(F.substring(F.sha2(F.expr("uuid()"), 256), 1, 15), 16, 36)), 11, "0")
    return F.substring(F.concat(F.lit(prefix), at, rest, more), 1, n + 1)


def _value(schema: Schema, f: Field) -> Column | None:
    """The column of a default; None where ids are to be numbered, which next_ids does."""
    text = f.default
    if f.is_list:
        items = [x.strip() for x in text.strip()[1:-1].split(",") if x.strip()]
        return F.array(*[_plain(schema, f, x).cast(schema.scalar(f)) for x in items])
    m = _CALL.fullmatch(text)
    if not m:
        return _plain(schema, f, text).cast(schema.scalar(f))
    name, argument = m[1], m[2].strip().strip('"')
    if name == "now":
        return F.current_timestamp().cast(schema.scalar(f))
    if name == "uuid":
        return F.expr("uuid()")
    if name in ("cuid", "cuid2"):
        return _cuid("c", 24 if name == "cuid" else 23)
    if name == "dbgenerated":
        return F.expr(argument).cast(schema.scalar(f)) if argument else None
    if name == "env":
        return F.lit(os.environ.get(argument)).cast(schema.scalar(f))
    if name in ("autoincrement", "sequence"):
        return None
    raise InvalidQuery(f"{f.name}: no such default function: {name}")


def _plain(schema: Schema, f: Field, text: str) -> Column:
    if text.startswith('"'):
        return F.lit(text[1:-1].replace('\\"', '"'))
    if text in ("true", "false"):
        return F.lit(text == "true")
    return F.lit(int(text) if re.fullmatch(r"[+-]?\d{1,18}", text) else text)


def creation_defaults(schema: Schema, model: str) -> dict[str, Column]:
    """Columns that a new row of the model gets where it doesn't say otherwise; create_many takes them. @updatedAt columns are among them."""
    out = {}
    for f in schema.models[model].fields:
        if f.default is not None and (value := _value(schema, f)) is not None:
            out[f.column_name] = value
    return update_stamps(schema, model) | out


def update_stamps(schema: Schema, model: str) -> dict[str, Column]:
    """The @updatedAt columns of the model, each the time of the query; update takes them."""
    return {f.column_name: F.current_timestamp().cast(schema.scalar(f)) for f in schema.models[model].fields if f.updated_at}


def numbered_columns(schema: Schema, model: str) -> list[str]:
    """Columns whose default is autoincrement(); next_ids fills them."""
    return [f.column_name for f in schema.models[model].fields if f.default is not None and f.default.startswith(("autoincrement(", "sequence("))]

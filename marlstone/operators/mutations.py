"""Changes to tables as functions from one version to the next. Nothing is written until the caller writes a version.

Each returns a Change: the new table, and the rows that are new in it or gone from it. Updates and deletes without a
condition are refused. A change through a junction table concerns two tables; the second one's Change is in also.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import ForeignKeyViolation, InvalidQuery, UniqueViolation
from ..plans.schema import Catalog, Relation
from .predicates import Predicate, field, keeps


@dataclass(frozen=True)
class Change:
    """of: the table's name in the catalog, where the change was made through one."""

    table: DataFrame
    affected: DataFrame
    of: str | None = None
    also: tuple[Change, ...] = ()

    def count(self) -> int:
        return self.affected.count()

    def tables(self) -> dict[str, DataFrame]:
        """The new version of every table that changes, by name."""
        if self.of is None:
            raise InvalidQuery("the change doesn't know its table's name")
        out = {self.of: self.table}
        for c in self.also:
            out |= c.tables()
        return out

    def apply(self, catalog: Catalog) -> Catalog:
        for name, df in self.tables().items():
            catalog = catalog.with_table(name, df)
        return catalog


def _as_column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _shaped(base: DataFrame, new: DataFrame, defaults: dict | None = None) -> DataFrame:
    """new with base's columns and types; missing columns take their default or NULL."""
    extra = [c for c in new.columns if c not in base.columns]
    if extra:
        raise InvalidQuery(f"no such columns: {extra}")
    value = lambda f: F.col(f.name) if f.name in new.columns else _as_column((defaults or {}).get(f.name))
    return new.select(*[value(f).cast(f.dataType).alias(f.name) for f in base.schema])


def _check_unique(rows: DataFrame, keys: list[str], base: DataFrame | None = None) -> None:
    """Raises if a key without NULLs is there twice, in rows or in rows and base."""
    known = rows.select(*keys).dropna()
    if not known.groupBy(*keys).count().where("count > 1").isEmpty():
        raise UniqueViolation(f"a value of {keys} is given more than once")
    if base is not None and not known.join(base.select(*keys), keys, "left_semi").isEmpty():
        raise UniqueViolation(f"a value of {keys} is already there")


def create_many(base: DataFrame, rows: list[dict] | DataFrame, defaults: dict | None = None, unique: tuple[str, ...] | list[str] = ()) -> Change:
    """rows of one set of columns; autoincrement can be given as a default through next_ids.

    unique names columns whose values must be new; they are looked up at once, before anything is written.
    """
    if not isinstance(rows, DataFrame):
        if not rows or not rows[0]:
            raise InvalidQuery("nothing to create")
        if any(r.keys() != rows[0].keys() for r in rows):
            raise InvalidQuery("all rows need the same columns")
        kinds = [base.schema[c] for c in rows[0]]
        rows = base.sparkSession.createDataFrame([tuple(r[k.name] for k in kinds) for r in rows], ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds))
    new = _shaped(base, rows, defaults)
    if unique:
        _check_unique(new, list(unique), base)
    return Change(base.unionByName(new), new)


def create(base: DataFrame, row: dict, defaults: dict | None = None, unique: tuple[str, ...] | list[str] = ()) -> Change:
    return create_many(base, [row], defaults, unique)


def next_ids(base: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """new with key = largest key of base + 1, 2, ... in the order given; new is small, as what one call inserts."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()
    return new.withColumn(key, (top + F.row_number().over(Window.orderBy(*order))).cast(base.schema[key].dataType))


def update(base: DataFrame, where: Predicate | None, data: dict, stamps: dict | None = None) -> Change:
    """stamps: columns that every update sets, such as update_stamps gives; data goes before them."""
    if where is None:
        raise InvalidQuery("an update needs a condition")
    if not data:
        raise InvalidQuery("nothing to update")
    data = {**(stamps or {}), **data}
    unknown = [c for c in data if c not in base.columns]
    if unknown:
        raise InvalidQuery(f"no such columns: {unknown}")
    hit = keeps(where)
    new = {c: _as_column(v).cast(base.schema[c].dataType) for c, v in data.items()}
    table = base.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns])
    return Change(table, base.where(hit).select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns]))


def delete(base: DataFrame, where: Predicate | None) -> Change:
    if where is None:
        raise InvalidQuery("a delete needs a condition")
    hit = keeps(where)
    return Change(base.where(~hit), base.where(hit))


def upsert(base: DataFrame, rows: DataFrame, keys: list[str], update_columns: list[str] | None = None, update_data: dict | None = None) -> Change:
    """Inserts rows whose keys are new; for the others sets update_columns (all but the keys by default) from the row, or update_data.

    A key that rows hold twice is a UniqueViolation, found by a count of rows' keys at once. A NULL key matches nothing.
    """
    if not keys:
        raise InvalidQuery("an upsert needs keys")
    _check_unique(rows, keys)
    cols = [c for c in base.columns if c not in keys] if update_columns is None else update_columns
    new = _shaped(base, rows).select(*[F.col(c).alias(f"_new_{c}") for c in base.columns]).withColumn("_given", F.lit(True))
    old = base.withColumn("_had", F.lit(True))
    both = old.join(new, [old[k] == new[f"_new_{k}"] for k in keys], "full")
    fresh, hit = F.col("_had").isNull(), F.col("_had").isNotNull() & F.col("_given").isNotNull()
    changed = {c: _as_column(v).cast(base.schema[c].dataType) for c, v in update_data.items()} if update_data is not None else {c: F.col(f"_new_{c}") for c in cols}
    out = both.select(
        *[F.when(fresh, F.col(f"_new_{c}")).when(hit, changed[c] if c in changed else F.col(c)).otherwise(F.col(c)).alias(c) for c in base.columns],
        F.coalesce("_given", F.lit(False)).alias("_touched"),
    )
    return Change(out.drop("_touched"), out.where("_touched").drop("_touched"))


# nested writes: changes to the rows related to the parent with the given key
#
# A relation that the child's table holds the key of changes the child's table. Through a junction the links are rows of the
# junction table: connecting and disconnecting change only those, creating and upserting add the child's row and its link,
# deleting takes the child's row and all links to it. A relation whose key the parent holds can't be written from the
# parent's side here, as that changes the parent: update the parent instead.


def _link(catalog: Catalog, model: str, relation: str) -> tuple[Relation, DataFrame]:
    r = catalog.relation(model, relation)
    if r.refers:
        raise InvalidQuery(f"{model}.{relation}: the key is {model}'s own; update {model}")
    return r, catalog.table(r.to_model)


def _pairs(catalog: Catalog, r: Relation, parent) -> DataFrame:
    """The junction's child keys of the parent, as _child."""
    name, to_parent, to_child = r.junction
    return catalog.table(name).where(F.col(to_parent) == F.lit(parent)).select(F.col(to_child).alias("_child"))


def _mine(catalog: Catalog, r: Relation, kids: DataFrame, parent, where: Predicate | None) -> Column:
    """Whether a row of kids is related to the parent and passes where; never NULL."""
    if r.junction is None:
        own = F.coalesce(F.col(r.to_key) == F.lit(parent), F.lit(False))
        return own & keeps(where)
    return F.coalesce(F.col("_linked"), F.lit(False)) & keeps(where)


def _marked(catalog: Catalog, r: Relation, kids: DataFrame, parent) -> DataFrame:
    """kids, through a junction with _linked: whether the parent has a link to the row."""
    if r.junction is None:
        return kids
    mine = _pairs(catalog, r, parent).distinct().withColumn("_linked", F.lit(True))
    return kids.join(mine, kids[r.to_key] == mine["_child"], "left").drop("_child")


def _linked_to(catalog: Catalog, r: Relation, parent, children: DataFrame) -> Change:
    """The junction with a pair for each value of children's only column; known pairs are left alone."""
    name, to_parent, to_child = r.junction
    pairs = catalog.table(name)
    new = children.toDF(to_child).distinct().select(F.lit(parent).cast(pairs.schema[to_parent].dataType).alias(to_parent), F.col(to_child).cast(pairs.schema[to_child].dataType))
    return replace(create_many(pairs, new.join(pairs.select(to_parent, to_child), [to_parent, to_child], "left_anti")), of=name)


def nested_create(catalog: Catalog, model: str, relation: str, parent, rows: list[dict]) -> Change:
    """New related rows; through a junction their links too, so rows must hold the child's key."""
    r, kids = _link(catalog, model, relation)
    if r.junction is None:
        return replace(create_many(kids, [{**row, r.to_key: parent} for row in rows]), of=r.to_model)
    if any(row.get(r.to_key) is None for row in rows):
        raise InvalidQuery(f"{relation}: new rows need {r.to_key} to be linked")
    change = create_many(kids, rows)
    return replace(change, of=r.to_model, also=(_linked_to(catalog, r, parent, change.affected.select(r.to_key)),))


def link(catalog: Catalog, model: str, relation: str, parent, ids: list) -> Change:
    """Junction rows between the parent and the ids, each pair once."""
    r, _ = _link(catalog, model, relation)
    if r.junction is None:
        raise InvalidQuery(f"{relation} has no junction")
    name, _, to_child = r.junction
    kind = catalog.table(name).schema[to_child].dataType.simpleString()
    return _linked_to(catalog, r, parent, catalog.spark.createDataFrame([(i,) for i in ids], f"`{to_child}` {kind}"))


def unlink(catalog: Catalog, model: str, relation: str, parent, ids: list | None = None) -> Change:
    r, _ = _link(catalog, model, relation)
    if r.junction is None:
        raise InvalidQuery(f"{relation} has no junction")
    name, to_parent, to_child = r.junction
    where = field(to_parent).equals(parent)
    return replace(delete(catalog.table(name), where if ids is None else where & field(to_child).is_in(ids)), of=name)


def nested_update(catalog: Catalog, model: str, relation: str, parent, where: Predicate | None, data: dict) -> Change:
    r, kids = _link(catalog, model, relation)
    unknown = [c for c in data if c not in kids.columns]
    if unknown or not data:
        raise InvalidQuery(f"no such columns: {unknown}" if unknown else "nothing to update")
    marked, hit = _marked(catalog, r, kids, parent), _mine(catalog, r, kids, parent, where)
    new = {c: _as_column(v).cast(kids.schema[c].dataType) for c, v in data.items()}
    table = marked.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in kids.columns])
    return Change(table, marked.where(hit).select(*[new[c].alias(c) if c in new else F.col(c) for c in kids.columns]), r.to_model)


def nested_delete(catalog: Catalog, model: str, relation: str, parent, where: Predicate | None = None) -> Change:
    """The parent's related rows that pass go, and with them, through a junction, every link to them."""
    r, kids = _link(catalog, model, relation)
    marked, hit = _marked(catalog, r, kids, parent), _mine(catalog, r, kids, parent, where)
    change = Change(marked.where(~hit).select(*kids.columns), marked.where(hit).select(*kids.columns), r.to_model)
    if r.junction is None:
        return change
    name, _, to_child = r.junction
    pairs, gone = catalog.table(name), change.affected.select(F.col(r.to_key).alias("_gone"))
    of_gone = pairs[to_child] == gone["_gone"]
    return replace(change, also=(Change(pairs.join(gone, of_gone, "left_anti"), pairs.join(gone, of_gone, "left_semi"), name),))


def connect(catalog: Catalog, model: str, relation: str, parent, where: Predicate) -> Change:
    """Relates the rows that pass to the parent. Through a junction the Change is the junction's."""
    r, kids = _link(catalog, model, relation)
    if r.junction is None:
        return replace(update(kids, where, {r.to_key: parent}), of=r.to_model)
    return _linked_to(catalog, r, parent, kids.where(keeps(where)).select(r.to_key))


def disconnect(catalog: Catalog, model: str, relation: str, parent, where: Predicate | None = None) -> Change:
    """Parts the parent from its related rows that pass. Through a junction the Change is the junction's."""
    r, kids = _link(catalog, model, relation)
    if r.junction is None:
        own = field(r.to_key).equals(parent)
        return replace(update(kids, own & where if where is not None else own, {r.to_key: None}), of=r.to_model)
    if where is None:
        return unlink(catalog, model, relation, parent)
    name, to_parent, to_child = r.junction
    pairs, chosen = catalog.table(name), kids.where(keeps(where)).select(F.col(r.to_key).alias("_chosen"))
    cut = (F.col(to_parent) == F.lit(parent)) & (F.col(to_child) == F.col("_chosen"))
    return Change(pairs.join(chosen, cut, "left_anti"), pairs.join(chosen, cut, "left_semi"), name)


def set_related(catalog: Catalog, model: str, relation: str, parent, where: Predicate) -> Change:
    """Disconnects all, then connects those that match. Through a junction the Change is the junction's: links that stay stay as they are."""
    r, kids = _link(catalog, model, relation)
    if r.junction is not None:
        name, to_parent, to_child = r.junction
        pairs, chosen = catalog.table(name), kids.where(keeps(where)).select(F.col(r.to_key).alias("_chosen"))
        other = ~F.coalesce(F.col(to_parent) == F.lit(parent), F.lit(False))
        kept = pairs.where(other).unionByName(pairs.where(~other).join(chosen, F.col(to_child) == F.col("_chosen"), "left_semi"))
        gone = pairs.where(~other).join(chosen, F.col(to_child) == F.col("_chosen"), "left_anti")
        added = _linked_to(catalog, r, parent, chosen)
        return Change(kept.unionByName(added.affected), gone.unionByName(added.affected), name)
    mine, chosen = keeps(field(r.to_key).equals(parent)), keeps(where)
    key = F.col(r.to_key)
    new = F.when(chosen, F.lit(parent)).when(mine, F.lit(None)).otherwise(key).cast(kids.schema[r.to_key].dataType)
    cols = [new.alias(c) if c == r.to_key else F.col(c) for c in kids.columns]
    return Change(kids.select(*cols), kids.where(mine | chosen).select(*cols), r.to_model)


def _nested_upsert(catalog: Catalog, r: Relation, kids: DataFrame, parent, rows: list[dict], keys: list[str], update_columns: list[str] | None) -> Change:
    if r.junction is None:
        given = create_many(kids.limit(0), [{**x, r.to_key: parent} for x in rows]).affected
        return replace(upsert(kids, given, keys, update_columns), of=r.to_model)
    if any(row.get(r.to_key) is None for row in rows):
        raise InvalidQuery(f"rows need {r.to_key} to be linked")
    given = create_many(kids.limit(0), rows).affected
    kept = update_columns if update_columns is not None else [c for c in rows[0] if c not in keys]
    return replace(upsert(kids, given, keys, kept), of=r.to_model, also=(_linked_to(catalog, r, parent, given.select(r.to_key)),))


def nested_upsert(catalog: Catalog, model: str, relation: str, parent, rows: list[dict], keys: list[str]) -> Change:
    r, kids = _link(catalog, model, relation)
    return _nested_upsert(catalog, r, kids, parent, rows, keys, None)


def connect_or_create(catalog: Catalog, model: str, relation: str, parent, row: dict, keys: list[str]) -> Change:
    """Connects the row with these keys; creates it where there is none."""
    r, kids = _link(catalog, model, relation)
    return _nested_upsert(catalog, r, kids, parent, [row], keys, [r.to_key] if r.junction is None else [])


# Operations that write_nested takes, by name: f(catalog, model, relation, parent, argument).
NESTED: dict[str, Callable[..., Change]] = {
    "create": lambda c, m, r, p, x: nested_create(c, m, r, p, x if isinstance(x, list) else [x]),
    "connect": lambda c, m, r, p, x: connect(c, m, r, p, x),
    "connect_or_create": lambda c, m, r, p, x: connect_or_create(c, m, r, p, *x),
    "disconnect": lambda c, m, r, p, x: disconnect(c, m, r, p, None if x is True else x),
    "set": lambda c, m, r, p, x: set_related(c, m, r, p, x),
    "update": lambda c, m, r, p, x: nested_update(c, m, r, p, *x),
    "upsert": lambda c, m, r, p, x: nested_upsert(c, m, r, p, *x),
    "delete": lambda c, m, r, p, x: nested_delete(c, m, r, p, None if x is True else x),
}


def write_nested(catalog: Catalog, model: str, parent, nested: dict[str, dict]) -> Catalog:
    """The catalog after all nested operations on the rows of one parent, in the order given: {relation: {operation: argument}}.

    Arguments: create a row or rows; connect and set a predicate; disconnect and delete a predicate or True for all;
    update (predicate or None, data); upsert (rows, keys); connect_or_create (row, keys).
    """
    for relation, ops in nested.items():
        for op, argument in ops.items():
            if op not in NESTED:
                raise InvalidQuery(f"no such nested operation: {op}")
            catalog = NESTED[op](catalog, model, relation, parent, argument).apply(catalog)
    return catalog


def _only_key(catalog: Catalog, model: str) -> str:
    key = catalog.key(model)
    if len(key) != 1:
        raise InvalidQuery(f"{model} needs a key of one column")
    return key[0]


def create_with(catalog: Catalog, model: str, row: dict, nested: dict[str, dict], defaults: dict | None = None) -> Catalog:
    """The catalog after one new row, which holds its key, and nested operations on its related rows."""
    key = _only_key(catalog, model)
    if row.get(key) is None:
        raise InvalidQuery(f"a row with nested operations needs its {key}")
    change = replace(create(catalog.table(model), row, defaults, unique=[key]), of=model)
    return write_nested(change.apply(catalog), model, row[key], nested)


def update_with(catalog: Catalog, model: str, parent, data: dict, nested: dict[str, dict], stamps: dict | None = None) -> Catalog:
    """The catalog after an update of the row with this key, if data isn't empty, and nested operations on its related rows."""
    if data:
        catalog = replace(update(catalog.table(model), field(_only_key(catalog, model)).equals(parent), data, stamps), of=model).apply(catalog)
    return write_nested(catalog, model, parent, nested)


# referential actions


def _references(catalog: Catalog, model: str) -> list[tuple[str, Relation]]:
    """Relations by which rows of any table, the model's own included, refer to the model."""
    return [(name, r) for (_, name), r in catalog.relations.items() if r.to_model == model and r.refers]


def _is_cyclic(catalog: Catalog, model: str) -> bool:
    """Whether rows of the model can refer to the model's own, directly or through others."""
    seen, todo = set(), [model]
    while todo:
        for _, r in _references(catalog, todo.pop()):
            if r.from_model == model:
                return True
            if r.from_model not in seen:
                seen.add(r.from_model)
                todo.append(r.from_model)
    return False


def _matches(kids: DataFrame, gone: DataFrame, r: Relation, kind: str) -> DataFrame:
    return kids.join(gone, kids[r.from_key] == gone["_gone"], kind)


def _reassigned(kids: DataFrame, pairs: DataFrame, key: str, value: Column) -> DataFrame:
    """kids with the key set to value where it is in pairs' _gone."""
    joined = kids.join(pairs, kids[key] == pairs["_gone"], "left")
    new = F.when(F.col("_gone").isNotNull(), value).otherwise(F.col(key)).cast(kids.schema[key].dataType)
    return joined.select(*[new.alias(c) if c == key else F.col(c) for c in kids.columns])


def _checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, where the session names a shared folder for that."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df


def referential_delete(catalog: Catalog, model: str, where: Predicate) -> dict[str, DataFrame]:
    """Deletes and applies each relation's on_delete through all levels: the new tables by name.

    Cascade deletes the rows that refer, and what refers to those; SetNull and SetDefault reassign their key; Restrict
    raises as soon as a row refers, NoAction if one still does at the end. Tables that refer to themselves, directly or
    in a circle, are followed until no row goes any more, with the lineage cut at each level where spark.checkpoint.dir is set.
    """
    change = delete(catalog.table(model), where)
    out = {model: change.table}
    todo: list[tuple[str, DataFrame]] = [(model, change.affected)]
    open_ends: list[tuple[str, Relation, DataFrame]] = []
    while todo:
        at, rows = todo.pop(0)
        if _is_cyclic(catalog, at):
            rows = _checkpointed(rows)
            if rows.isEmpty():
                continue
        for name, r in _references(catalog, at):
            kids = out.get(r.from_model, catalog.table(r.from_model))
            gone = rows.select(F.col(r.to_key).alias("_gone")).distinct()
            if r.on_delete == "Cascade":
                out[r.from_model] = _matches(kids, gone, r, "left_anti")
                todo.append((r.from_model, _matches(kids, gone, r, "left_semi")))
            elif r.on_delete in ("SetNull", "SetDefault"):
                out[r.from_model] = _reassigned(kids, gone, r.from_key, F.lit(r.default if r.on_delete == "SetDefault" else None))
            elif r.on_delete == "Restrict":
                if not _matches(kids, gone, r, "left_semi").isEmpty():
                    raise ForeignKeyViolation(f"{r.from_model}.{name} still refers to {at}")
            elif r.on_delete == "NoAction":
                open_ends.append((f"{r.from_model}.{name} still refers to {at}", r, gone))
            else:
                raise InvalidQuery(f"no such action: {r.on_delete}")
    for text, r, gone in open_ends:
        if not _matches(out.get(r.from_model, catalog.table(r.from_model)), gone, r, "left_semi").isEmpty():
            raise ForeignKeyViolation(text)
    return out


def referential_update(catalog: Catalog, model: str, where: Predicate, data: dict) -> dict[str, DataFrame]:
    """Updates and applies each relation's on_update to the rows that refer to a key column in data: the new tables by name.

    Cascade carries the new key on, through further tables that refer to the reassigned column; SetNull, SetDefault,
    Restrict and NoAction as in referential_delete. A table that refers to itself is reassigned once.
    """
    base = catalog.table(model)
    out = {model: update(base, where, data).table}
    todo = [(model, c, base.where(keeps(where)).select(F.col(c).alias("_gone"), _as_column(v).cast(base.schema[c].dataType).alias("_new"))) for c, v in data.items()]
    seen = set()
    while todo:
        at, column, pairs = todo.pop(0)
        if (at, column) in seen:
            continue
        seen.add((at, column))
        pairs = pairs.where(~F.col("_gone").eqNullSafe(F.col("_new"))).distinct()
        for name, r in _references(catalog, at):
            if r.to_key != column:
                continue
            kids = out.get(r.from_model, catalog.table(r.from_model))
            if r.on_update == "Cascade":
                out[r.from_model] = _reassigned(kids, pairs, r.from_key, F.col("_new"))
                todo.append((r.from_model, r.from_key, pairs))
            elif r.on_update in ("SetNull", "SetDefault"):
                out[r.from_model] = _reassigned(kids, pairs, r.from_key, F.lit(r.default if r.on_update == "SetDefault" else None))
            elif not _matches(kids, pairs.select("_gone"), r, "left_semi").isEmpty():
                raise ForeignKeyViolation(f"{r.from_model}.{name} still refers to {at}")
    return out

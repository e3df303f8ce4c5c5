"""Loading related rows, and filters on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import Catalog, Relation
from . import windows
from .predicates import Predicate, keeps


@dataclass(frozen=True)
class Include:
    relation: str
    where: Predicate | None = None
    order: tuple = ()
    take: int | None = None
    select: tuple[str, ...] = ()
    include: tuple[Include, ...] = ()


def children(catalog: Catalog, r: Relation, where: Predicate | None = None) -> DataFrame:
    """Rows of the related model with the parent's key as _parent."""
    df = catalog.table(r.to_model).where(keeps(where))
    if r.junction is None:
        return df.withColumn("_parent", F.col(r.to_key))
    table, to_parent, to_child = r.junction
    pairs = catalog.table(table).select(F.col(to_parent).alias("_parent"), F.col(to_child).alias("_child")).distinct()
    return df.join(pairs, F.col(r.to_key) == F.col("_child")).drop("_child")


def include(catalog: Catalog, df: DataFrame, model: str, i: Include, page: DataFrame | None = None) -> DataFrame:
    """Adds the relation as a column: an array of structs, sorted, empty if there are none; or a struct or NULL for a single one.

    Children are filtered, ranked and collected before the join, so the parent's rows are never multiplied. page: rows of
    which the parents are all, by which the children are cut down first. A parent's children lie in one row, so a
    parent with very many of them should be given take.
    """
    r = catalog.relation(model, i.relation)
    kids = children(catalog, r, i.where)
    if page is not None:
        kids = kids.join(page.select(F.col(r.from_key).alias("_wanted")).distinct(), F.col("_parent") == F.col("_wanted"), "left_semi")
    for deeper in i.include:
        kids = include(catalog, kids, r.to_model, deeper)
    order = windows.ordering([*i.order, *catalog.key(r.to_model)])
    single = not r.many and r.junction is None
    if i.take is not None or single:
        n = 1 if single else i.take
        kids = kids.withColumn("_n", F.row_number().over(Window.partitionBy("_parent").orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    nested = [d.relation for d in i.include]
    shown = [c for c in kids.columns if c != "_parent" and (not i.select or c in i.select or c in nested)]
    row = F.struct(*[F.col(c) for c in shown])
    if single:
        one = kids.select(F.col("_parent").alias("_of"), row.alias("_row"))
        return df.join(one, F.col(r.from_key) == F.col("_of"), "left").withColumn(i.relation, F.col("_row")).drop("_of", "_row")
    place = _place(kids, [*i.order, *catalog.key(r.to_model)], i.take)
    ranked = kids.select("_parent", place.alias("_n"), row.alias("_row"))
    collected = F.collect_list(F.struct("_n", "_row"))
    plain = not any(x in ranked.schema["_row"].dataType.simpleString() for x in ("map<", "variant"))  # what has an order
    sorted_rows = F.sort_array(collected) if plain else F.array_sort(collected, lambda a, b: F.when(a["_n"] < b["_n"], -1).when(a["_n"] > b["_n"], 1).otherwise(0))
    lists = ranked.groupBy(F.col("_parent").alias("_of")).agg(F.transform(sorted_rows, lambda x: x["_row"]).alias("_rows"))
    joined = df.join(lists, F.col(r.from_key) == F.col("_of"), "left")
    return joined.withColumn(i.relation, F.coalesce("_rows", F.array().cast(lists.schema["_rows"].dataType))).drop("_of", "_rows")


def _place(kids: DataFrame, keys: list, take: int | None) -> Column:
    """What a parent's children are sorted by: the keys themselves where all ascend, NULLs last; else a rank."""
    names = [k if isinstance(k, str) else k[0] for k in keys]
    rising = all(isinstance(k, str) or k[1].lower() == "asc" for k in keys)
    if rising and take is None and all(n in kids.columns for n in names):
        return F.struct(*[c for k, n in enumerate(names) for c in (F.col(n).isNull().alias(f"null{k}"), F.col(n).alias(f"key{k}"))])
    return F.row_number().over(Window.partitionBy("_parent").orderBy(*windows.ordering(keys)))


def flat(catalog: Catalog, df: DataFrame, model: str, relation: str, select: tuple[str, ...] = ()) -> DataFrame:
    """One row per pair, the related columns prefixed with the relation's name; parents without any stay."""
    r = catalog.relation(model, relation)
    kids = children(catalog, r)
    cols = [c for c in kids.columns if c != "_parent" and (not select or c in select)]
    named = kids.select("_parent", *[F.col(c).alias(f"{relation}_{c}") for c in cols])
    return df.join(named, F.col(r.from_key) == F.col("_parent"), "left").drop("_parent")


def some(catalog: Catalog, df: DataFrame, model: str, relation: str, where: Predicate | None = None) -> DataFrame:
    r = catalog.relation(model, relation)
    return df.join(children(catalog, r, where).select("_parent"), F.col(r.from_key) == F.col("_parent"), "left_semi")


def none(catalog: Catalog, df: DataFrame, model: str, relation: str, where: Predicate | None = None) -> DataFrame:
    r = catalog.relation(model, relation)
    return df.join(children(catalog, r, where).select("_parent"), F.col(r.from_key) == F.col("_parent"), "left_anti")


def every(catalog: Catalog, df: DataFrame, model: str, relation: str, where: Predicate) -> DataFrame:
    """No related row fails; one for which the condition is NULL fails. Parents without related rows pass."""
    r = catalog.relation(model, relation)
    failing = children(catalog, r).where(~keeps(where)).select("_parent")
    return df.join(failing, F.col(r.from_key) == F.col("_parent"), "left_anti")

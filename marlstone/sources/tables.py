"""Reading tables, and giving rows back."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.schema import Catalog, Relation

FORMATS = ("parquet", "orc", "json", "csv")

# Keys and foreign keys of the test tables.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"),
}
FOREIGN = {
    ("nation", "n_regionkey"): ("region", "r_regionkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey"), ("supplier", "s_nationkey"): ("nation", "n_nationkey"),
    ("orders", "o_custkey"): ("customer", "c_custkey"), ("lineitem", "l_orderkey"): ("orders", "o_orderkey"), ("labels", "doc_id"): ("documents", "doc_id"),
}


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A file source; text formats should be given their schema, so nothing is read twice."""
    if format not in FORMATS:
        raise ValueError(f"no such format: {format}")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **options) -> DataFrame:
    """A database table through its JDBC driver, which must be on the class path; partitioned by ranges of a column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def load_fixture(spark: SparkSession, rows: list[dict] | list[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def to_maps(df: DataFrame) -> list[dict]:
    """All rows as dictionaries, NULLs kept; for results that fit the driver."""
    return [r.asDict(recursive=True) for r in df.collect()]


def to_objects(df: DataFrame, cls: type) -> list[Any]:
    """All rows as dataclass instances, by column name whatever the case; fields without a column keep their default."""
    if not is_dataclass(cls):
        raise TypeError(f"{cls.__name__} is no dataclass")
    columns = {c.lower(): c for c in df.columns}
    pairs = [(f.name, columns[f.name.lower()]) for f in fields(cls) if f.name.lower() in columns]
    return [cls(**{name: row[c] for name, c in pairs}) for row in df.select(*[c for _, c in pairs]).collect()]


def sf_catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """The test tables with their relations; each parent's side is named after the child table and the other way round."""
    from ..plans.schema import infer_relations

    tables = {n: read_table(spark, f"{sf_dir}/{n}.parquet") for n in names or KEYS}
    foreign = {k: v for k, v in FOREIGN.items() if k[0] in tables and v[0] in tables}
    relations = infer_relations({n: t.schema for n, t in tables.items()}, foreign, {("labels", "doc_id")})
    if {"part", "supplier", "lineitem"} <= tables.keys():
        relations["part", "suppliers"] = Relation("suppliers", "part", "p_partkey", "supplier", "s_suppkey", True, ("lineitem", "l_partkey", "l_suppkey"))
    return Catalog(spark, tables, relations, KEYS)

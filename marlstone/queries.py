"""The registered queries: each an engine call over the test tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import joins as N
from .operators import mutations as M
from .operators import relations as R
from .operators import windows as W
from .operators.aggregates import avg, count, group_by, largest, least, scalar_or_zero, total
from .operators.cte import With
from .operators.predicates import Raw, all_of, any_of, field, keeps, not_, not_all
from .operators.query import Query
from .plans.errors import InvalidQuery
from .plans.runtime import raw_query
from .plans.schema import Catalog, Relation
from .plans.transactions import Transaction
from .sources.tables import load_fixture, sf_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *tables: str):
    """Registers f(catalog, spark) under the name; the catalog holds the given tables."""

    def register(f: Callable[[Catalog, SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(sf_catalog(spark, sf_dir, *tables), spark)
        if sql:
            ORACLES[name] = sql
        return f

    return register


def plain(name: str, sql: str, q: Callable[[], Query], *tables: str) -> None:
    """A query that is one builder expression; built when it runs, for columns need a session. The tables default to its model."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        built = q()
        return built.to_df(sf_catalog(spark, sf_dir, *(tables or (built.model,))))

    QUERIES[name], ORACLES[name] = run, sql


def decimal_sum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


# sources

query("scan_table", "SELECT * FROM orders", "orders")(lambda c, s: c.table("orders"))


def _introspect(c: Catalog, s: SparkSession) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString()) for t, schema in c.introspect().items() if t in c.tables for f in schema]
    return load_fixture(s, rows, "table_name string, column_name string, column_type string")


query(
    "introspect_tables",
    "SELECT * FROM (VALUES ('nation','n_nationkey','int'),('nation','n_name','string'),('nation','n_regionkey','int'),('region','r_regionkey','int'),('region','r_name','string')) t(table_name, column_name, column_type)",
    "region", "nation",
)(_introspect)

# filters

plain("filter_compare", "SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' AND l_discount > 0.03 AND l_tax <= 0.06 AND l_linestatus <> 'X'",
      lambda: Query("lineitem").where(field("l_quantity").gte(10.0), field("l_quantity").lt(20.0), field("l_returnflag").equals("R"), field("l_discount").gt(0.03), field("l_tax").lte(0.06), field("l_linestatus").not_equals("X")))
plain("filter_equals_null", "SELECT * FROM orders WHERE o_orderstatus = NULL", lambda: Query("orders").where(field("o_orderstatus").equals(None)))
plain("filter_in", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')", lambda: Query("orders").where(field("o_orderstatus").is_in(["F", "P"])))
plain("filter_in_empty", "SELECT * FROM orders WHERE FALSE", lambda: Query("orders").where(field("o_orderstatus").is_in([])))
plain("filter_not_in", "SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')", lambda: Query("orders").where(field("o_orderpriority").not_in(["1-URGENT", "5-LOW"])))
plain("filter_not_in_empty", "SELECT * FROM nation", lambda: Query("nation").where(field("n_name").not_in([])))
plain("filter_like_wildcard", "SELECT * FROM part WHERE p_name LIKE '%a_e%'", lambda: Query("part").where(field("p_name").contains("a_e")))
plain("filter_like", "SELECT * FROM part WHERE p_type LIKE '%A%E%'", lambda: Query("part").where(field("p_type").like("%A%E%")))
plain("filter_starts_ends", "SELECT * FROM part WHERE p_name LIKE 'b%' OR p_name LIKE '%n'", lambda: Query("part").where(field("p_name").starts_with("b") | field("p_name").ends_with("n")))
plain("filter_insensitive", "SELECT * FROM part WHERE lower(p_name) LIKE lower('%BLUE%')", lambda: Query("part").where(field("p_name").contains("BLUE", insensitive=True)))
plain("filter_and_or_nested", "SELECT * FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderstatus = 'O' AND o_totalprice < 20000)",
      lambda: Query("orders").where(any_of(all_of(field("o_orderstatus").equals("F"), field("o_totalprice").gt(300000.0)), all_of(field("o_orderstatus").equals("O"), field("o_totalprice").lt(20000.0)))))
plain("filter_nor", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F') AND NOT (o_totalprice > 200000)", lambda: Query("orders").where(not_(field("o_orderstatus").equals("F"), field("o_totalprice").gt(200000.0))))
plain("filter_not_all", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 200000)", lambda: Query("orders").where(not_all(field("o_orderstatus").equals("F"), field("o_totalprice").gt(200000.0))))
plain("filter_between_columns", "SELECT * FROM lineitem WHERE l_discount > l_tax", lambda: Query("lineitem").where(Raw(F.col("l_discount") > F.col("l_tax"))))


@query("filter_null", "SELECT o.o_orderkey, o.o_orderstatus FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL", "orders", "lineitem")
def _(c, s):
    return Query("orders").join("lineitem", F.col("o_orderkey") == F.col("l_orderkey")).where(field("l_orderkey").is_null()).select("o_orderkey", "o_orderstatus").to_df(c)


plain("filter_not_null", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
      lambda: Query("documents", alias="d").join("labels", N.on("d.doc_id", "=", "l.doc_id"), alias="l").where(field("l.quality").is_not_null()).select("d.doc_id", "l.quality"), "documents", "labels")

# JSON, arrays, text

plain("json_path", "SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '69'", lambda: Query("events").where(field("props").json_path("$.k", 69)).select("event_id", "props"))
plain("json_has_key", "SELECT event_id, props FROM events WHERE list_contains(json_keys(props), 'k')", lambda: Query("events").where(field("props").json_has_key("k")).select("event_id", "props"))
plain("json_has_no_key", "SELECT event_id, props FROM events WHERE NOT list_contains(json_keys(props), 'z')", lambda: Query("events").where(not_(field("props").json_has_key("z"))).select("event_id", "props"))
plain("json_not_contains", "SELECT event_id, props FROM events WHERE NOT json_contains(props, '{\"k\": 42}')", lambda: Query("events").where(not_(field("props").json_contains({"k": 42}))).select("event_id", "props"))
plain("json_contains", "SELECT event_id, props FROM events WHERE json_contains(props, '{\"k\": 42}')", lambda: Query("events").where(field("props").json_contains({"k": 42})).select("event_id", "props"))


@query("json_array_contains", "SELECT event_id FROM events WHERE list_contains([CAST(json_extract_string(props, '$.k') AS INT), event_id % 10], 5)", "events")
def _(c, s):
    made = c.table("events").withColumn("doc", F.format_string('{"tags": [%s, %s]}', F.get_json_object("props", "$.k"), (F.col("event_id") % 10).cast("string")))
    return made.where(keeps(field("doc").json_array_contains("$.tags", 5))).select("event_id")


_ARRAYS = "(SELECT c_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderpriority IS NOT NULL) AS tags FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 GROUP BY c_custkey)"


def _arrays(c: Catalog) -> DataFrame:
    big = c.table("orders").where(keeps(field("o_totalprice").gt(250000.0)))
    return c.table("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.collect_set("o_orderpriority").alias("tags"))


for _name, _pred, _sql in (
    ("array_is_empty", field("tags").is_empty(), "coalesce(len(tags), 0) = 0"),
    ("array_not_empty", field("tags").is_empty(False), "coalesce(len(tags), 0) > 0"),
    ("array_has", field("tags").has("1-URGENT"), "coalesce(list_contains(tags, '1-URGENT'), false)"),
    ("array_has_every", field("tags").has_every(["1-URGENT", "5-LOW"]), "coalesce(list_has_all(tags, ['1-URGENT', '5-LOW']), false)"),
    ("array_has_some", field("tags").has_some(["1-URGENT", "2-HIGH"]), "coalesce(list_has_any(tags, ['1-URGENT', '2-HIGH']), false)"),
):
    query(_name, f"SELECT c_custkey, coalesce(len(tags), 0) AS n FROM {_ARRAYS} WHERE {_sql}", "customer", "orders")(
        lambda c, s, p=_pred: _arrays(c).where(keeps(p)).select("c_custkey", F.size("tags").cast("bigint").alias("n"))
    )

plain("fulltext_search", r"SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['the', 'was'])", lambda: Query("documents").where(field("text").search("The was")).select("doc_id"))
plain("fulltext_hyphen", r"SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['the', 'was'])", lambda: Query("documents").where(field("text").search("The-was")).select("doc_id"))

# projection and distinct

plain("select_columns", "SELECT c_name, c_acctbal, c_custkey FROM customer", lambda: Query("customer").select("c_name", "c_acctbal", "c_custkey"))
plain("select_computed", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net FROM lineitem", lambda: Query("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("net")))
plain("distinct_values", "SELECT DISTINCT c_mktsegment FROM customer", lambda: Query("customer").select("c_mktsegment").distinct())
plain("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
      lambda: Query("orders").distinct_on("o_custkey").order_by("o_custkey", ("o_totalprice", "desc"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice"))
plain("count_distinct", "SELECT count(DISTINCT o_custkey) AS customers FROM orders", lambda: Query("orders").aggregate(count("o_custkey", "customers", distinct=True)))
plain("case_count", "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, count(*) AS n FROM orders GROUP BY o_orderpriority",
      lambda: Query("orders").group_by("o_orderpriority").aggregate(count(alias="done", only=field("o_orderstatus").equals("F")), count(alias="n")))


@query("scalar_subquery", "SELECT r_name, (SELECT count(*) FROM nation) AS nations FROM region", "region", "nation")
def _(c, s):
    return N.with_scalar(c.table("region"), "nations", c.table("nation").agg(F.count(F.lit(1)).alias("n"))).select("r_name", "nations")


@query("scalar_equals", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)", "orders")
def _(c, s):
    return N.equals_scalar(c.table("orders"), "o_totalprice", c.table("orders").agg(F.max("o_totalprice"))).select("o_orderkey", "o_totalprice")


# joins

_CO = "customer c {} JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000"
for _kind in ("inner", "left", "right", "full"):
    query(f"join_{_kind}", f"SELECT c.c_custkey, o.o_orderkey FROM {_CO.format(_kind.upper())}", "customer", "orders")(
        lambda c, s, k=_kind: Query("customer", alias="c").join("orders", N.on("c.c_custkey", "=", "o.o_custkey") & (F.col("o.o_totalprice") > 400000), k, "o").select("c.c_custkey", "o.o_orderkey").to_df(c)
    )
query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")(lambda c, s: Query("region").join("nation", kind="cross").select("r_name", "n_name").to_df(c))
query("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "supplier")(
    lambda c, s: Query("supplier", alias="a").join("supplier", N.on("a.s_nationkey", "=", "b.s_nationkey") & N.on("a.s_acctbal", "<", "b.s_acctbal"), "inner", "b").select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b")).to_df(c)
)
query("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")(
    lambda c, s: Query("nation", alias="a").join("nation", N.on("a.n_regionkey", "=", "b.n_regionkey") & N.on("a.n_nationkey", "<", "b.n_nationkey"), "inner", "b").select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b")).to_df(c)
)


@query(
    "join_four",
    "SELECT c_name, o_orderkey, l_linenumber, n_name, l_extendedprice FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' AND o_totalprice > 350000",
    "customer", "nation", "orders", "lineitem",
)
def _(c, s):
    q = Query("customer").join("nation", N.on("c_nationkey", "=", "n_nationkey"), "inner").join("orders", N.on("c_custkey", "=", "o_custkey"), "inner").join("lineitem", N.on("o_orderkey", "=", "l_orderkey"), "inner")
    return q.where(field("l_returnflag").equals("A"), field("o_totalprice").gt(350000.0)).select("c_name", "o_orderkey", "l_linenumber", "n_name", "l_extendedprice").to_df(c)


_BIG = Query("orders").where(field("o_totalprice").gt(400000.0))
query("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "customer", "orders")(lambda c, s: Query("customer").where_in("c_custkey", _BIG, "o_custkey").select("c_custkey").to_df(c))
query("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "customer", "orders")(lambda c, s: Query("customer").where_not_in("c_custkey", _BIG, "o_custkey").select("c_custkey").to_df(c))


@query("not_in_subquery_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders WHERE o_totalprice > 1000)", "customer", "orders")
def _(c, s):
    sub = c.table("orders").where(keeps(field("o_totalprice").gt(1000.0))).select(F.nullif(F.col("o_custkey"), F.lit(1)).alias("k"))
    return N.where_not_in(c.table("customer"), "c_custkey", sub, "k").select("c_custkey")


def _own() -> Column:
    return F.col("c_custkey") == F.col("o_custkey")


query("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", "customer", "orders")(lambda c, s: Query("customer").where_exists(_BIG, _own()).select("c_custkey").to_df(c))
query("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", "customer", "orders")(lambda c, s: Query("customer").where_not_exists(_BIG, _own()).select("c_custkey").to_df(c))
query("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 0)", "region", "nation")(lambda c, s: Query("region").where_exists(Query("nation").where(n_regionkey=0)).select("r_name").to_df(c))

# relations

query("relation_some", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "customer", "orders")(lambda c, s: Query("customer").some("orders", field("o_orderstatus").equals("P")).select("c_custkey").to_df(c))
query("relation_every", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 20000))", "customer", "orders")(lambda c, s: Query("customer").every("orders", field("o_totalprice").gt(20000.0)).select("c_custkey").to_df(c))
query("relation_none", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "customer", "orders")(lambda c, s: Query("customer").none("orders", field("o_orderstatus").equals("P")).select("c_custkey").to_df(c))


def _listed(column: str, key: str):
    return F.array_join(F.transform(column, lambda x: x[key].cast("string")), ",").alias(column)


query("include_ordered", "SELECT c_custkey, c_acctbal, (SELECT coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey), '') FROM (SELECT * FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)) AS orders FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40", "customer", "orders")(
    lambda c, s: Query("customer").include("orders", order=(("o_totalprice", "desc"),), take=2).order_by(("c_acctbal", "desc"), "c_custkey").take(40).to_df(c).select("c_custkey", "c_acctbal", _listed("orders", "o_orderkey"))
)
query("include_one_to_many", "SELECT n_name, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name", "nation", "supplier")(
    lambda c, s: Query("nation").include("supplier").to_df(c).select("n_name", _listed("supplier", "s_suppkey"))
)
query("include_many_to_one", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "orders", "customer")(lambda c, s: Query("orders").include("customer").to_df(c).select("o_orderkey", "customer.c_name"))
query("include_one_to_one", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "documents", "labels")(lambda c, s: Query("documents").include("labels").to_df(c).select("doc_id", "labels.quality"))
query("include_many_to_many", "SELECT p_partkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS suppliers FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) ON p_partkey = l_partkey GROUP BY p_partkey", "part", "supplier", "lineitem")(
    lambda c, s: Query("part").include("suppliers").to_df(c).select("p_partkey", _listed("suppliers", "s_suppkey"))
)
query("include_nested", "SELECT r_name, coalesce(string_agg(n_name || ':' || n, ',' ORDER BY n_nationkey), '') AS nations FROM region LEFT JOIN (SELECT n_nationkey, n_name, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name", "region", "nation", "customer")(
    lambda c, s: Query("region").include("nation", include=(R.Include("customer"),)).to_df(c).select("r_name", F.array_join(F.transform("nation", lambda x: F.concat_ws(":", x["n_name"], F.size(x["customer"]).cast("string"))), ",").alias("nations"))
)
query("include_filtered_top", "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey), '') AS orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3) ON c_custkey = o_custkey GROUP BY c_custkey", "customer", "orders")(
    lambda c, s: Query("customer").include("orders", field("o_orderstatus").equals("F"), (("o_totalprice", "desc"),), 3).to_df(c).select("c_custkey", _listed("orders", "o_orderkey"))
)
query("include_paged_parents", "SELECT c_custkey, count(o_orderkey) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "customer", "orders")(
    lambda c, s: Query("customer").order_by(("c_acctbal", "desc"), "c_custkey").take(10).include("orders").to_df(c).select("c_custkey", F.size("orders").cast("bigint").alias("n"))
)
query("include_flat", "SELECT n_name, s_suppkey AS supplier_s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey", "nation", "supplier")(lambda c, s: R.flat(c, c.table("nation"), "nation", "supplier", ("s_suppkey",)).select("n_name", "supplier_s_suppkey"))

# aggregates

plain("agg_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'", lambda: Query("orders").where(o_orderstatus="O").aggregate(count(alias="n")))
plain("agg_count_column", "SELECT count(l.quality) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", lambda: Query("documents", alias="d").join("labels", N.on("d.doc_id", "=", "l.doc_id"), alias="l").aggregate(count("l.quality", "n")), "documents", "labels")
plain("agg_sum", f"SELECT {decimal_sum('o_totalprice')} AS revenue, CAST(sum(p) AS BIGINT) AS keys FROM (SELECT *, o_orderkey AS p FROM orders)", lambda: Query("orders").aggregate(total("o_totalprice", "revenue", exact=2), total("o_orderkey", "keys")))
plain("agg_avg", "SELECT avg(p_size) AS mean FROM part", lambda: Query("part").aggregate(avg("p_size", "mean")))
plain("agg_min_max", "SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_name) AS first_name FROM part", lambda: Query("part").aggregate(least("p_retailprice", "lo"), largest("p_retailprice", "hi"), least("p_name", "first_name")))
query("agg_empty_zero", "SELECT coalesce(CAST(sum(o_totalprice) AS DOUBLE), 0) AS total FROM orders WHERE o_orderstatus = 'none'", "orders")(lambda c, s: scalar_or_zero(c.table("orders"), total("o_totalprice", "total"), field("o_orderstatus").equals("none")))
plain("agg_empty_null", "SELECT sum(o_totalprice) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'none'", lambda: Query("orders").where(o_orderstatus="none").aggregate(total("o_totalprice", "total"), count(alias="n")))
query("agg_keys_last", "SELECT count(*) AS n, max(o_totalprice) AS hi, o_orderstatus FROM orders GROUP BY o_orderstatus", "orders")(lambda c, s: group_by(c.table("orders"), ["o_orderstatus"], [count(alias="n"), largest("o_totalprice", "hi")], keys_last=True))
plain("group_by", f"SELECT c_mktsegment, count(*) AS count, {decimal_sum('c_acctbal')} AS sum_c_acctbal FROM customer GROUP BY c_mktsegment", lambda: Query("customer").group_by("c_mktsegment").aggregate(count(), total("c_acctbal", exact=2)))
plain("group_by_multi", "SELECT n_name, o_orderpriority, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY n_name, o_orderpriority",
      lambda: Query("customer").join("nation", N.on("c_nationkey", "=", "n_nationkey"), "inner").join("orders", N.on("c_custkey", "=", "o_custkey"), "inner").group_by("n_name", "o_orderpriority").aggregate(count(alias="n")), "customer", "nation", "orders")
plain("group_by_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", lambda: Query("orders").group_by("o_custkey").aggregate(count(alias="n")).having(field("n").gt(15)))
plain("group_by_having_avg", f"SELECT c_nationkey, round({decimal_sum('c_acctbal')} / count(c_acctbal), 6) AS mean FROM customer GROUP BY c_nationkey HAVING {decimal_sum('c_acctbal')} / count(c_acctbal) > 4600",
      lambda: Query("customer").group_by("c_nationkey").aggregate(avg("c_acctbal", "m", exact=2)).having(field("m").gt(4600.0)).select("c_nationkey", F.round("m", 6).alias("mean")))

def _flagship() -> Query:
    return (
        Query("orders").join("customer", N.on("o_custkey", "=", "c_custkey"), "inner")
        .where(field("o_orderstatus").is_in(["F", "O"]), Raw(F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp_ntz")))
        .group_by("c_mktsegment").aggregate(count(alias="n"), total("o_totalprice", "revenue", exact=2)).having(field("n").gt(10)).order_by(("revenue", "desc"), "c_mktsegment")
    )


plain("group_by_join", f"SELECT c_mktsegment, count(*) AS n, {decimal_sum('o_totalprice')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1993-01-01' GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC", _flagship, "orders", "customer")
plain("group_by_seven", f"SELECT l_returnflag, l_linestatus, {decimal_sum('l_quantity')} AS qty, {decimal_sum('l_extendedprice')} AS price, min(l_discount) AS lo, max(l_discount) AS hi, count(*) AS n, count(CASE WHEN l_tax > 0.04 THEN 1 END) AS taxed FROM lineitem GROUP BY ALL",
      lambda: Query("lineitem").group_by("l_returnflag", "l_linestatus").aggregate(total("l_quantity", "qty", 2), total("l_extendedprice", "price", 2), least("l_discount", "lo"), largest("l_discount", "hi"), count(alias="n"), count(alias="taxed", only=field("l_tax").gt(0.04))))

# windows

_BY = W.over("o_custkey").order_by("o_orderdate", "o_orderkey")
_OV = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {})"


def windowed(name: str, sql: str, *fns: W.WindowFn) -> None:
    plain(name, f"SELECT o_orderkey, {sql} FROM orders", lambda: Query("orders").window(*fns).select("o_orderkey", *[f.alias for f in fns]))


windowed("win_row_number", f"row_number() {_OV.format('')} AS n", W.window_fn("row_number", "n", _BY))
_RANKED = W.over("o_custkey").order_by("o_orderpriority")
windowed("win_rank", "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d", W.window_fn("rank", "r", _RANKED), W.window_fn("dense_rank", "d", _RANKED))
_ROLL = _BY.rows(W.preceding(2))
_ROWS = _OV.format("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW")
_AGGS = f"SELECT o_orderkey, CAST(sum(o_orderkey) {_ROWS} AS BIGINT) AS s, round(avg(o_orderkey) {_ROWS}, 6) AS a, count(o_orderkey) {_ROWS} AS n, min(o_totalprice) {_ROWS} AS lo, max(o_totalprice) {_ROWS} AS hi FROM orders"
query("win_aggregates", _AGGS, "orders")(lambda c, s: Query("orders").window(*[W.window_fn(f, a, _ROLL, x) for f, a, x in (("sum", "s", "o_orderkey"), ("avg", "m", "o_orderkey"), ("count", "n", "o_orderkey"), ("min", "lo", "o_totalprice"), ("max", "hi", "o_totalprice"))]).select("o_orderkey", "s", F.round("m", 6).alias("a"), "n", "lo", "hi").to_df(c))
windowed("win_count_rows", "count(*) OVER (PARTITION BY o_custkey) AS n", W.window_fn("count", "n", W.over("o_custkey")))
windowed("win_lag_lead", f"lag(o_orderkey, 2, 0) {_OV.format('')} AS before, lead(o_orderkey, 2, 0) {_OV.format('')} AS after", W.window_fn("lag", "before", _BY, "o_orderkey", 2, 0), W.window_fn("lead", "after", _BY, "o_orderkey", 2, 0))
_FULL = _BY.rows(W.UNBOUNDED_PRECEDING, W.UNBOUNDED_FOLLOWING)
windowed("win_first_last", f"first_value(o_orderkey) {_OV.format('')} AS a, last_value(o_orderkey) {_OV.format('ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')} AS z", W.window_fn("first_value", "a", _BY, "o_orderkey"), W.window_fn("last_value", "z", _FULL, "o_orderkey"))
_RANGE = W.over("c_nationkey").order_by("c_custkey").range(W.preceding(100), W.following(50))
plain("win_range_frame", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 100 PRECEDING AND 50 FOLLOWING) AS n FROM customer", lambda: Query("customer").window(W.window_fn("count", "n", _RANGE)).select("c_custkey", "n"))
_AROUND = _BY.rows(W.preceding(1), W.following(1)).excluding("current row")
_EX = _OV.format("ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW")
windowed("win_exclude_current", f"CAST(sum(o_orderkey) {_EX} AS BIGINT) AS s, count(o_orderkey) {_EX} AS n, max(o_totalprice) {_EX} AS hi", W.window_fn("sum", "s", _AROUND, "o_orderkey"), W.window_fn("count", "n", _AROUND, "o_orderkey"), W.window_fn("max", "hi", _AROUND, "o_totalprice"))
for _what in ("group", "ties"):
    _ord = W.over("n_regionkey").order_by("first").rows(W.UNBOUNDED_PRECEDING, W.UNBOUNDED_FOLLOWING).excluding(_what)
    query(f"win_exclude_{_what}", f"SELECT n_nationkey, count(n_nationkey) OVER w AS n, max(n_nationkey) OVER w AS hi FROM (SELECT *, n_nationkey % 2 AS first FROM nation) WINDOW w AS (PARTITION BY n_regionkey ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {_what.upper()})", "nation")(
        lambda c, s, w=_ord: W.with_windows(c.table("nation").withColumn("first", F.col("n_nationkey") % 2), W.window_fn("count", "n", w, "n_nationkey"), W.window_fn("max", "hi", w, "n_nationkey")).select("n_nationkey", "n", "hi")
    )
_PEERS = W.over("o_custkey").order_by("o_orderstatus")
for _what, _frame in (("group", (W.UNBOUNDED_PRECEDING, 0)), ("ties", (W.UNBOUNDED_PRECEDING, W.UNBOUNDED_FOLLOWING)), ("current row", (0, W.UNBOUNDED_FOLLOWING))):
    _named = f"win_exclude_range_{_what.replace(' ', '_')}"
    _sql = f"OVER (PARTITION BY o_custkey ORDER BY o_orderstatus RANGE BETWEEN {'UNBOUNDED PRECEDING' if _frame[0] else 'CURRENT ROW'} AND {'UNBOUNDED FOLLOWING' if _frame[1] else 'CURRENT ROW'} EXCLUDE {_what.upper()})"
    windowed(_named, f"CAST(sum(o_orderkey) {_sql} AS BIGINT) AS s, count(o_orderkey) {_sql} AS n, min(o_totalprice) {_sql} AS lo", *[W.window_fn(f, a, _PEERS.range(*_frame).excluding(_what), x) for f, a, x in (("sum", "s", "o_orderkey"), ("count", "n", "o_orderkey"), ("min", "lo", "o_totalprice"))])
plain("win_join_where_top", "SELECT c_name, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
      lambda: Query("customer").join("orders", N.on("c_custkey", "=", "o_custkey"), "inner").where(o_orderstatus="F").window(W.window_fn("row_number", "n", W.over("c_custkey").order_by(("o_totalprice", "desc"), "o_orderkey"))).order_by(("o_totalprice", "desc"), "o_orderkey").take(50).select("c_name", "o_orderkey", "n"), "customer", "orders")

# order and paging


plain("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40", lambda: Query("orders").order_by("o_totalprice", "o_orderkey").skip(40).take(20).select("o_orderkey", "o_totalprice"))
plain("order_nulls", "SELECT d.doc_id, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY l.quality DESC NULLS FIRST, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
      lambda: Query("documents", alias="d").join("labels", N.on("d.doc_id", "=", "l.doc_id"), alias="l").window(W.window_fn("row_number", "place", W.over("d.source").order_by(("l.quality", "desc"), "d.doc_id"))).select("d.doc_id", "l.quality", "place"), "documents", "labels")
plain("top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", lambda: Query("customer").order_by(("c_acctbal", "desc"), "c_custkey").take(10).select("c_custkey", "c_acctbal"))
plain("limit_zero", "SELECT * FROM nation LIMIT 0", lambda: Query("nation").take(0))
plain("cursor_page_asc", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25", lambda: Query("orders").order_by(("o_orderkey", "asc")).cursor("o_orderkey", 500).take(25).select("o_orderkey"))
plain("cursor_page_desc", "SELECT o_orderkey FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 25", lambda: Query("orders").order_by(("o_orderkey", "desc")).cursor("o_orderkey", 500).take(25).select("o_orderkey"))
plain("cursor_page_ties", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND o_orderkey > 500) ORDER BY o_orderstatus, o_orderkey LIMIT 25",
      lambda: Query("orders").order_by("o_orderstatus").after(o_orderstatus="F", o_orderkey=500).take(25).select("o_orderkey", "o_orderstatus"))
plain("cursor_page_ties_desc", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 12 OR (c_nationkey = 12 AND c_custkey > 40) ORDER BY c_nationkey DESC, c_custkey LIMIT 25",
      lambda: Query("customer").order_by(("c_nationkey", "desc")).after(c_nationkey=12, c_custkey=40).take(25).select("c_custkey", "c_nationkey"))
plain("find_first", "SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1", lambda: Query("orders").where(o_orderstatus="P").order_by("o_orderkey").take(1))
plain("find_unique", "SELECT * FROM customer WHERE c_custkey = 77", lambda: Query("customer").where(c_custkey=77).take(1))

# common table expressions and raw SQL

_REVENUE = f"SELECT n_name, {decimal_sum('o_totalprice')} AS revenue FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY n_name"
_CTE_TABLES = ("nation", "customer", "orders")
query("cte", f"WITH r AS ({_REVENUE}) SELECT * FROM r WHERE revenue > (SELECT avg(revenue) FROM r)", *_CTE_TABLES)(lambda c, s: With().add("r", _REVENUE).query("SELECT * FROM r WHERE revenue > (SELECT avg(revenue) FROM r)", s, c.tables))
query("cte_columns", f"WITH r(name, amount) AS ({_REVENUE}) SELECT name, amount FROM r WHERE amount > 1000000", *_CTE_TABLES)(lambda c, s: With().add("r", _REVENUE, ("name", "amount")).query("SELECT name, amount FROM r WHERE amount > :least", s, c.tables, least=1000000))
query("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 20) SELECT n, f FROM t", "region")(
    lambda c, s: With().add_recursive("t", "SELECT 1, CAST(1 AS BIGINT)", "SELECT n + 1, f * (n + 1) FROM t WHERE n < :most", ("n", "f")).query("SELECT n, f FROM t", s, most=20)
)
query("raw_sql_params", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'", "orders")(lambda c, s: raw_query(s, "SELECT o_orderkey FROM orders WHERE o_totalprice > $2 AND o_orderstatus = $1", "F", 300000, tables=c.tables))
query("raw_sql_named", "SELECT n_name FROM nation WHERE n_regionkey = 2", "nation")(lambda c, s: raw_query(s, "SELECT n_name FROM nation WHERE n_regionkey = :r", tables=c.tables, r=2))

# mutations, as the next version of a table

query("create", "SELECT * FROM region UNION ALL SELECT 9, 'ATLANTIS'", "region")(lambda c, s: M.create(c.table("region"), {"r_regionkey": 9, "r_name": "ATLANTIS"}).table)
query("create_many", "SELECT * FROM nation UNION ALL SELECT * FROM (VALUES (90, 'A', 1), (91, 'B', NULL)) t", "nation")(
    lambda c, s: M.create_many(c.table("nation"), [{"n_nationkey": 90, "n_name": "A", "n_regionkey": 1}, {"n_nationkey": 91, "n_name": "B", "n_regionkey": None}]).table
)
query("create_autoincrement", "SELECT * FROM region UNION ALL SELECT CAST((SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY v) AS INT), v FROM (VALUES ('X'), ('Y')) t(v)", "region")(
    lambda c, s: M.create_many(c.table("region"), M.next_ids(c.table("region"), load_fixture(s, [("X",), ("Y",)], "r_name string"), "r_regionkey", ["r_name"])).table
)
query("update_many", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders", "orders")(
    lambda c, s: M.update(c.table("orders"), field("o_orderstatus").equals("P"), {"o_orderstatus": "O"}).table.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
)
query("update_affected", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'", "orders")(lambda c, s: M.update(c.table("orders"), field("o_orderstatus").equals("P"), {"o_orderstatus": "O"}).affected.agg(F.count(F.lit(1)).alias("n")))
query("delete_many", "SELECT * FROM customer WHERE NOT (c_acctbal < 0)", "customer")(lambda c, s: M.delete(c.table("customer"), field("c_acctbal").lt(0.0)).table)


def _rows(s: SparkSession) -> DataFrame:
    return load_fixture(s, [(1, "ONE", 4), (77, "NEW", 2)], "n_nationkey int, n_name string, n_regionkey int")


query("upsert", "SELECT * FROM nation WHERE n_nationkey <> 1 UNION ALL SELECT * FROM (VALUES (1, 'ONE', 4), (77, 'NEW', 2)) t", "nation")(lambda c, s: M.upsert(c.table("nation"), _rows(s), ["n_nationkey"]).table)
query("upsert_data", "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'KNOWN' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 77, 'NEW', 2", "nation")(lambda c, s: M.upsert(c.table("nation"), _rows(s), ["n_nationkey"], update_data={"n_name": "KNOWN"}).table)
_SET = "SELECT n_nationkey, n_name, {} AS n_regionkey FROM nation"
query("nested_create", "SELECT * FROM nation UNION ALL SELECT 50, 'K', 3", "region", "nation")(lambda c, s: M.nested_create(c, "region", "nation", 3, [{"n_nationkey": 50, "n_name": "K"}]).table)
query("nested_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 3 AND n_nationkey > 10 THEN 'Z' ELSE n_name END AS n_name, n_regionkey FROM nation", "region", "nation")(lambda c, s: M.nested_update(c, "region", "nation", 3, field("n_nationkey").gt(10), {"n_name": "Z"}).table)
query("nested_delete", "SELECT * FROM nation WHERE NOT (n_regionkey = 3)", "region", "nation")(lambda c, s: M.nested_delete(c, "region", "nation", 3).table)
query("connect", _SET.format("CASE WHEN n_nationkey IN (1, 2) THEN 4 ELSE n_regionkey END"), "region", "nation")(lambda c, s: M.connect(c, "region", "nation", 4, field("n_nationkey").is_in([1, 2])).table)
query("disconnect", _SET.format("CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END"), "region", "nation")(lambda c, s: M.disconnect(c, "region", "nation", 1).table)
query("set_relation", _SET.format("CASE WHEN n_nationkey IN (0, 5) THEN 1 WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END"), "region", "nation")(lambda c, s: M.set_related(c, "region", "nation", 1, field("n_nationkey").is_in([0, 5])).table)
query("nested_upsert", "SELECT * FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT * FROM (VALUES (5, 'FIVE', 2), (60, 'SIXTY', 2)) t", "region", "nation")(
    lambda c, s: M.nested_upsert(c, "region", "nation", 2, [{"n_nationkey": 5, "n_name": "FIVE"}, {"n_nationkey": 60, "n_name": "SIXTY"}], ["n_nationkey"]).table
)
query("connect_or_create", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 5 THEN 2 ELSE n_regionkey END AS n_regionkey FROM nation", "region", "nation")(lambda c, s: M.connect_or_create(c, "region", "nation", 2, {"n_nationkey": 5, "n_name": "ignored"}, ["n_nationkey"]).table)
query("delete_set_null", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 0 THEN n_regionkey END AS n_regionkey FROM nation", "region", "nation")(lambda c, s: _with_action(c, "SetNull")["nation"])
query("delete_cascade", "SELECT * FROM nation WHERE n_regionkey <> 0", "region", "nation")(lambda c, s: _with_action(c, "Cascade")["nation"])

_PS = "SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem"
_M2M = ("part", "supplier", "lineitem", "nation")


def _m2m(c: Catalog) -> Catalog:
    """part and supplier linked by part_supplier, the distinct pairs of lineitem."""
    pairs = c.table("lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    r = Relation("suppliers", "part", "p_partkey", "supplier", "s_suppkey", True, ("part_supplier", "p", "s"))
    return Catalog(c.spark, {**c.tables, "part_supplier": pairs}, {**c.relations, ("part", "suppliers"): r}, c.keys)


query("connect_m2m", f"SELECT * FROM ({_PS}) UNION SELECT 7, s_suppkey FROM supplier WHERE s_suppkey IN (1, 2)", *_M2M)(lambda c, s: M.connect(_m2m(c), "part", "suppliers", 7, field("s_suppkey").is_in([1, 2])).table)
query("disconnect_m2m", f"SELECT * FROM ({_PS}) WHERE NOT (p = 1 AND s > 5)", *_M2M)(lambda c, s: M.disconnect(_m2m(c), "part", "suppliers", 1, field("s_suppkey").gt(5)).table)
query("set_m2m", f"SELECT * FROM ({_PS}) WHERE p <> 1 UNION SELECT 1, s_suppkey FROM supplier WHERE s_suppkey IN (2, 3)", *_M2M)(lambda c, s: M.set_related(_m2m(c), "part", "suppliers", 1, field("s_suppkey").is_in([2, 3])).table)
query("nested_delete_m2m", f"SELECT * FROM ({_PS}) WHERE s NOT IN (SELECT s FROM ({_PS}) WHERE p = 1)", *_M2M)(lambda c, s: M.nested_delete(_m2m(c), "part", "suppliers", 1).apply(_m2m(c)).table("part_supplier"))
query("nested_delete_m2m_rows", f"SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM ({_PS}) WHERE p = 1)", *_M2M)(lambda c, s: M.nested_delete(_m2m(c), "part", "suppliers", 1).table)
query("nested_update_m2m", f"SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT s FROM ({_PS}) WHERE p = 1) THEN 'of part 1' ELSE s_name END AS s_name FROM supplier", *_M2M)(
    lambda c, s: M.nested_update(_m2m(c), "part", "suppliers", 1, None, {"s_name": "of part 1"}).table.select("s_suppkey", "s_name")
)
query("nested_create_m2m", f"SELECT s_suppkey, s_name, p FROM (SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT 900001, 'NEW') JOIN (SELECT * FROM ({_PS}) UNION ALL SELECT 1, 900001) ON s = s_suppkey WHERE p = 1", *_M2M)(
    lambda c, s: R.flat(M.nested_create(_m2m(c), "part", "suppliers", 1, [{"s_suppkey": 900001, "s_name": "NEW"}]).apply(_m2m(c)), c.table("part").where("p_partkey = 1"), "part", "suppliers", ("s_suppkey", "s_name")).select(F.col("suppliers_s_suppkey").alias("s_suppkey"), F.col("suppliers_s_name").alias("s_name"), F.col("p_partkey").alias("p"))
)
query("create_with_nested", "SELECT * FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT n_nationkey, n_name, 9 FROM nation WHERE n_nationkey IN (3, 4) UNION ALL SELECT 95, 'NEW', 9", "region", "nation")(
    lambda c, s: M.create_with(c, "region", {"r_regionkey": 9, "r_name": "ATLANTIS"}, {"nation": {"create": {"n_nationkey": 95, "n_name": "NEW"}, "connect": field("n_nationkey").is_in([3, 4])}}).table("nation")
)
query("update_with_nested", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'Z' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 2 AND n_nationkey > 10)", "region", "nation")(
    lambda c, s: M.update_with(c, "region", 2, {"r_name": "SECOND"}, {"nation": {"delete": field("n_nationkey").gt(10), "update": (None, {"n_name": "Z"})}}).table("nation")
)
_DEEP = ("region", "nation", "customer", "orders")
_GONE = "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0"
query("delete_cascade_deep", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN ({_GONE})", *_DEEP)(lambda c, s: _with_action(c, "Cascade")["orders"].select("o_orderkey", "o_custkey"))
query("delete_cascade_then_null", f"SELECT o_orderkey, CASE WHEN o_custkey NOT IN ({_GONE}) THEN o_custkey END AS o_custkey FROM orders", *_DEEP)(
    lambda c, s: _with_action(c, "Cascade", orders="SetNull")["orders"].select("o_orderkey", "o_custkey")
)
query("update_cascade", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 0 THEN 40 ELSE n_regionkey END AS n_regionkey FROM nation", "region", "nation")(lambda c, s: M.referential_update(c, "region", field("r_regionkey").equals(0), {"r_regionkey": 40})["nation"])


@query("delete_self_relation", "WITH RECURSIVE gone AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 1 UNION SELECT n_nationkey FROM nation JOIN gone ON n_nationkey // 2 = k AND n_nationkey > 1) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT k FROM gone)", "nation")
def _delete_self(c: Catalog, s: SparkSession) -> DataFrame:
    """Nations in a tree by halved keys; the first goes with all below it."""
    tree = c.table("nation").withColumn("above", F.when(F.col("n_nationkey") > 1, F.floor(F.col("n_nationkey") / 2).cast("int")))
    up = Relation("above", "nation", "above", "nation", "n_nationkey", False, None, "Cascade")
    linked = Catalog(c.spark, {"nation": tree}, {("nation", "above"): up}, c.keys)
    return M.referential_delete(linked, "nation", field("n_nationkey").equals(1))["nation"].select("n_nationkey", "n_name")


def _in_transaction(c: Catalog, fail: bool) -> DataFrame:
    """Both tables after a block that changes both, and raises at the end or doesn't."""
    t = Transaction(c)
    try:
        with t.nested():
            t.apply(M.update(t.table("region"), field("r_regionkey").equals(1), {"r_name": "ONE"}), "region")
            t.apply(M.update(t.table("nation"), field("n_regionkey").equals(1), {"n_name": "of ONE"}), "nation")
            if fail:
                raise InvalidQuery("undone")
    except InvalidQuery:
        pass
    return t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


query("transaction_commit", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'of ONE' ELSE n_name END AS n_name, CASE WHEN r_regionkey = 1 THEN 'ONE' ELSE r_name END AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "region", "nation")(lambda c, s: _in_transaction(c, False))
query("transaction_rollback", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "region", "nation")(lambda c, s: _in_transaction(c, True))


def _with_action(c: Catalog, action: str, **other: str) -> dict[str, DataFrame]:
    from dataclasses import replace

    linked = Catalog(c.spark, c.tables, {k: replace(r, on_delete=other.get(r.from_model, action)) for k, r in c.relations.items()}, c.keys)
    return M.referential_delete(linked, "region", field("r_regionkey").equals(0))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_by_join"](spark, sf_dir)

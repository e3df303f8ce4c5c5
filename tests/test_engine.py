"""The builder and its operators on the small company tables."""

import time
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators import joins as N
from marlstone.operators import mutations as M
from marlstone.operators import windows as W
from marlstone.operators.aggregates import avg, count, largest, scalar_or_zero, total
from marlstone.operators.cte import With
from marlstone.operators.defaults import creation_defaults, numbered_columns, update_stamps
from marlstone.operators.predicates import field
from marlstone.operators.query import Query
from marlstone.plans import runtime as X
from marlstone.plans.errors import ForeignKeyViolation, InvalidQuery, NotFound, TimedOut, TransactionConflict, UniqueViolation, classify
from marlstone.plans.schema import Catalog, Relation, diff_models, diff_schemas, infer_relations, parse_schema
from marlstone.plans.transactions import Store, run_transaction, transaction
from marlstone.sources.tables import load_fixture, read_table, to_maps, to_objects


@pytest.fixture(scope="module")
def company(spark):
    t = {
        "departments": load_fixture(spark, [(1, "Engineering", Decimal("1000000.50")), (2, "Marketing", Decimal("500000.75")), (3, "Sales", Decimal("750000.25")), (4, "Empty", None)], "id int, name string, budget decimal(12,2)"),
        "employees": load_fixture(spark, [(1, "John Doe", 80000.0, 1), (2, "Jane Smith", 75000.0, 1), (3, "Bob Johnson", 60000.0, 2), (4, "Alice Brown", 70000.0, 2), (5, "Charlie Wilson", 90000.0, 3)], "id int, name string, salary double, department_id int"),
        "projects": load_fixture(spark, [(1, "Alpha", 1), (2, "Beta", 1), (3, "Gamma", 2)], "id int, name string, department_id int"),
        "employee_projects": load_fixture(spark, [(1, 1, "Lead"), (2, 1, "Developer"), (3, 2, "Manager"), (4, 2, "Designer"), (5, 3, "Consultant"), (1, 3, "Advisor")], "employee_id int, project_id int, role string"),
    }
    r = infer_relations({k: v.schema for k, v in t.items()}, {("employees", "department_id"): ("departments", "id"), ("projects", "department_id"): ("departments", "id")})
    r["employees", "projects"] = Relation("projects", "employees", "id", "projects", "id", True, ("employee_projects", "employee_id", "project_id"))
    return Catalog(spark, t, r, {k: ("id",) for k in ("departments", "employees", "projects")})


def test_find(company):
    q = Query("employees").where(field("salary").gte(70000.0)).order_by(("salary", "desc"))
    assert [r["id"] for r in q.find_many(company)] == [5, 1, 2, 4]
    assert q.find_first(company)["name"] == "Charlie Wilson"
    assert Query("employees").where(id=99).find_first(company) is None
    with pytest.raises(NotFound):
        Query("employees").where(id=99).find_unique_or_raise(company)
    assert [r["id"] for r in q.skip(1).take(2).find_many(company)] == [1, 2]
    assert q.count(company) == 4
    with pytest.raises(InvalidQuery):
        q.take(-1)


def test_include(company):
    rows = Query("departments").include("employees", order=(("salary", "desc"),)).order_by("id").find_many(company)
    assert [[e["id"] for e in r["employees"]] for r in rows] == [[1, 2], [4, 3], [5], []]
    one = Query("employees").include("departments").order_by("id").find_many(company)
    assert [r["departments"]["name"] for r in one][:3] == ["Engineering", "Engineering", "Marketing"]
    many = Query("employees").include("projects").order_by("id").find_many(company)
    assert [[p["name"] for p in r["projects"]] for r in many] == [["Alpha", "Gamma"], ["Alpha"], ["Beta"], ["Beta"], ["Gamma"]]


def test_paging_parents_keeps_their_children(company):
    rows = Query("departments").order_by("id").take(1).include("employees").find_many(company)
    assert len(rows) == 1 and len(rows[0]["employees"]) == 2


def test_relation_filters(company):
    names = lambda q: sorted(r["name"] for r in q.find_many(company))
    assert names(Query("departments").some("employees", field("salary").gt(75000.0))) == ["Engineering", "Sales"]
    assert names(Query("departments").every("employees", field("salary").gte(70000.0))) == ["Empty", "Engineering", "Sales"]
    assert names(Query("departments").none("employees")) == ["Empty"]


def test_max_salary_and_averages(company):
    assert Query("employees").aggregate(largest("salary", "top")).find_many(company) == [{"top": 90000.0}]
    got = Query("employees").group_by("department_id").aggregate(avg("salary", "mean"), count(alias="n")).having(field("mean").gt(70000.0)).find_many(company)
    assert sorted((r["department_id"], r["mean"], r["n"]) for r in got) == [(1, 77500.0, 2), (3, 90000.0, 1)]
    assert scalar_or_zero(company.table("employees"), total("salary", "s"), field("id").equals(-1)).first().s == 0.0


def test_not_in_is_null_aware(spark, company):
    e = company.table("employees")
    sub = load_fixture(spark, [(1,), (None,)], "k int")
    assert N.where_not_in(e, "id", sub, "k").count() == 0
    assert N.where_not_in(e, "id", sub.where("k is not null"), "k").count() == 4
    assert N.where_not_in(e, "id", sub.limit(0), "k").count() == 5


def test_frame_exclusion(spark):
    df = load_fixture(spark, [(1, 1, 10), (2, 1, 20), (3, 2, 30), (4, 2, None)], "id int, k int, v int")
    w = W.over().order_by("k").rows(W.UNBOUNDED_PRECEDING, W.UNBOUNDED_FOLLOWING)
    got = {what: [r.s for r in W.with_windows(df, W.window_fn("sum", "s", w.excluding(what), "v")).orderBy("id").collect()] for what in ("group", "ties")}
    assert got == {"group": [30.0, 30.0, 30.0, 30.0], "ties": [40.0, 50.0, 60.0, 30.0]}
    alone = W.over("id").order_by("k").rows(-1, 1).excluding("current row")
    assert [r.s for r in W.with_windows(df, W.window_fn("sum", "s", alone, "v")).collect()] == [None] * 4


def test_mutations(company):
    e = company.table("employees")
    assert M.update(e, field("department_id").equals(2), {"salary": F.col("salary") + 1}).count() == 2
    with pytest.raises(InvalidQuery):
        M.update(e, None, {"salary": 1.0})
    with pytest.raises(InvalidQuery):
        M.delete(e, None)
    assert M.delete(e, field("salary").gt(75000.0)).table.count() == 3
    up = M.upsert(e, load_fixture(e.sparkSession, [(1, "New Name"), (9, "Nine")], "id int, name string"), ["id"], ["name"])
    assert up.table.count() == 6 and up.count() == 2
    assert {(r.id, r.name, r.salary) for r in up.affected.collect()} == {(1, "New Name", 80000.0), (9, "Nine", None)}
    assert M.link(company, "employees", "projects", 1, [1, 2]).count() == 1
    assert M.unlink(company, "employees", "projects", 1).table.count() == 4
    with pytest.raises(ForeignKeyViolation):
        M.referential_delete(company, "departments", field("id").equals(1))


def test_raw_and_cte(spark, company):
    got = X.raw_query(spark, "SELECT id FROM employees WHERE salary > $2 AND department_id = $1", 1, 76000, tables=company.tables)
    assert [r.id for r in got.collect()] == [1]
    assert With().add("a", "SELECT 1 AS x").query("SELECT x FROM a", spark).first().x == 1
    with pytest.raises(InvalidQuery):
        With().add("a; drop", "SELECT 1")


def test_runtime(spark, company):
    seen, log = [], []
    run = X.Runtime(spark).use(X.timing(log)).on("before", "query", lambda e: seen.append(e.action))
    e = company.table("employees")
    assert len(run.batch([e, e.limit(1)], parallel=2)) == 2 and seen == ["query"] * 2 and len(log) == 2
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("connection refused")
        return "ok"

    assert X.Runtime(spark).use(X.retrying(first=0.01)).run("query", flaky) == "ok"
    cache = X.ResultCache()
    for _ in range(2):
        cache.get(e.where("id > 1"), ("employees",)).count()
    assert (cache.hits, cache.misses) == (1, 1)
    cache.invalidate("employees")
    assert not cache.held
    assert classify(NotFound("x")) == "P2025"
    slow = spark.range(0, 4 * 10**9, 1, 4).selectExpr("sum(id % 7)")
    with pytest.raises(TimedOut):
        run.collect(slow, 1.0)


def test_schema_language(spark):
    s = parse_schema("""
      enum Role { USER ADMIN }
      model User { id Int @id @default(autoincrement())
        email String @unique
        role Role @default(USER)
        tags String[]
        balance Decimal? @db.Decimal(12, 2)
        posts Post[]
        @@map("users") }
      model Post {
        id Int @id
        title String @map("post_title")
        authorId Int @map("author_id")
        author User @relation(fields: [authorId], references: [id], onDelete: Cascade)
      }""")  # fmt: skip
    assert s.struct("User").simpleString() == "struct<id:int,email:string,role:string,tags:array<string>,balance:decimal(12,2)>"
    assert s.relations["User", "posts"].many and s.relations["Post", "author"].on_delete == "Cascade"
    assert s.relations["Post", "author"].from_key == "author_id" and s.models["User"].table_name == "users"
    with pytest.raises(InvalidQuery):
        parse_schema("model A { id Int @id\n x Nope }")
    changes = diff_schemas({"a": s.struct("User")}, {"a": s.struct("Post"), "b": s.struct("Post")})
    assert ("create_table", "b") in {(c.kind, c.table) for c in changes} and any(c.kind == "drop_column" and c.column == "email" for c in changes)


@dataclass
class Person:
    ID: int
    name: str
    nick: str = "-"


def test_sinks_and_sources(spark, company, tmp_path):
    e = company.table("employees")
    assert to_objects(e.where("id = 1"), Person) == [Person(1, "John Doe")]
    assert to_maps(e.where("id = 1"))[0]["salary"] == 80000.0
    for kind in ("parquet", "orc", "json", "csv"):
        e.write.format(kind).save(str(tmp_path / kind))
        assert read_table(spark, str(tmp_path / kind), kind, schema=e.schema).count() == 5


# many-to-many, referential actions, transactions


@pytest.fixture()
def assigned(spark):
    tables = {
        "employees": load_fixture(spark, [(1, "a"), (2, "b"), (3, None)], "id int, name string"), "projects": load_fixture(spark, [(1, "p", 5), (2, "q", None), (7, "r", 9)], "id int, title string, cost int"),
        "assignments": load_fixture(spark, [(1, 1), (1, 2), (2, 2), (3, None)], "employee_id int, project_id int"),
    }
    r = Relation("projects", "employees", "id", "projects", "id", True, ("assignments", "employee_id", "project_id"))
    return Catalog(spark, tables, {("employees", "projects"): r}, {"employees": ("id",), "projects": ("id",)})


def test_many_to_many_writes_leave_other_rows_alone(assigned):
    c = assigned
    connected = M.connect(c, "employees", "projects", 2, field("id").is_in([2, 7]))
    assert connected.of == "assignments" and {(r.employee_id, r.project_id) for r in connected.affected.collect()} == {(2, 7)}
    assert {(r.employee_id, r.project_id) for r in connected.table.collect()} == {(1, 1), (1, 2), (2, 2), (2, 7), (3, None)}
    cut = M.disconnect(c, "employees", "projects", 1, field("cost").equals(5))
    assert {(r.employee_id, r.project_id) for r in cut.table.collect()} == {(1, 2), (2, 2), (3, None)}
    chosen = M.set_related(c, "employees", "projects", 1, field("id").is_in([2, 7]))
    assert {(r.employee_id, r.project_id) for r in chosen.table.collect()} == {(1, 2), (1, 7), (2, 2), (3, None)}
    gone = M.nested_delete(c, "employees", "projects", 1, field("title").equals("q")).apply(c)
    assert {r.id for r in gone.table("projects").collect()} == {1, 7}
    assert {(r.employee_id, r.project_id) for r in gone.table("assignments").collect()} == {(1, 1), (3, None)}
    new = M.nested_create(c, "employees", "projects", 3, [{"id": 8, "title": "s"}]).apply(c)
    assert (3, 8) in {(r.employee_id, r.project_id) for r in new.table("assignments").collect()} and new.table("projects").count() == 4
    with pytest.raises(InvalidQuery):
        M.nested_create(c, "employees", "projects", 3, [{"title": "s"}])
    up = M.nested_upsert(c, "employees", "projects", 2, [{"id": 1, "title": "P"}, {"id": 9, "title": "n"}], ["id"]).apply(c)
    assert {(r.id, r.title, r.cost) for r in up.table("projects").collect()} == {(1, "P", 5), (2, "q", None), (7, "r", 9), (9, "n", None)}
    assert {(2, 1), (2, 9)} <= {(r.employee_id, r.project_id) for r in up.table("assignments").collect()}
    known = M.connect_or_create(c, "employees", "projects", 2, {"id": 1, "title": "ignored"}, ["id"]).apply(c)
    assert {r.title for r in known.table("projects").collect()} == {"p", "q", "r"}
    changed = M.nested_update(c, "employees", "projects", 1, field("cost").is_null(), {"cost": 1}).table
    assert {(r.id, r.cost) for r in changed.collect()} == {(1, 5), (2, 1), (7, 9)}


def test_one_call_with_nested_writes(assigned):
    c = M.create_with(assigned, "employees", {"id": 4, "name": "d"}, {"projects": {"connect": field("id").equals(1), "create": [{"id": 9, "title": "z"}]}})
    assert {(r.employee_id, r.project_id) for r in c.table("assignments").where("employee_id = 4").collect()} == {(4, 1), (4, 9)}
    c = M.update_with(assigned, "employees", 1, {"name": "A"}, {"projects": {"disconnect": True}})
    assert c.table("employees").where("id = 1").first().name == "A" and c.table("assignments").where("employee_id = 1").isEmpty()
    with pytest.raises(UniqueViolation):
        M.create_with(assigned, "employees", {"id": 1, "name": "twice"}, {})


def test_upsert_refuses_a_repeated_key(spark, company):
    twice = load_fixture(spark, [(1, "x"), (1, "y")], "id int, name string")
    with pytest.raises(UniqueViolation):
        M.upsert(company.table("employees"), twice, ["id"], ["name"])
    nulls = load_fixture(spark, [(None, "x"), (None, "y")], "id int, name string")
    assert M.upsert(company.table("employees"), nulls, ["id"], ["name"]).table.count() == 7


def chain(spark, **actions):
    tables = {"a": load_fixture(spark, [(1,), (2,)], "id int"), "b": load_fixture(spark, [(1, 1), (2, 2), (3, None)], "id int, a_id int"), "c": load_fixture(spark, [(1, 1), (2, 2), (3, 3)], "id int, b_id int"), "t": load_fixture(spark, [(1, None), (2, 1), (3, 2), (4, 4), (5, 9)], "id int, up int")}
    relations = {
        ("b", "a"): Relation("a", "b", "a_id", "a", "id", on_delete=actions.get("b", "Cascade"), on_update=actions.get("update", "Cascade"), default=2), ("a", "bs"): Relation("bs", "a", "id", "b", "a_id", True),
        ("c", "b"): Relation("b", "c", "b_id", "b", "id", on_delete=actions.get("c", "Cascade")), ("t", "up"): Relation("up", "t", "up", "t", "id", on_delete=actions.get("t", "Cascade")),
    }
    return Catalog(spark, tables, relations)


def ids_of(df):
    return sorted(r.id for r in df.collect())


def test_referential_actions_reach_all_levels(spark):
    out = M.referential_delete(chain(spark), "a", field("id").equals(1))
    assert (ids_of(out["a"]), ids_of(out["b"]), ids_of(out["c"])) == ([2], [2, 3], [2, 3])
    out = M.referential_delete(chain(spark, c="SetNull"), "a", field("id").equals(1))
    assert {(r.id, r.b_id) for r in out["c"].collect()} == {(1, None), (2, 2), (3, 3)}
    out = M.referential_delete(chain(spark, b="SetDefault"), "a", field("id").equals(1))
    assert {(r.id, r.a_id) for r in out["b"].collect()} == {(1, 2), (2, 2), (3, None)}
    for action in ("Restrict", "NoAction"):
        with pytest.raises(ForeignKeyViolation):
            M.referential_delete(chain(spark, c=action), "a", field("id").equals(1))
    assert ids_of(M.referential_delete(chain(spark), "t", field("id").equals(1))["t"]) == [4, 5]
    assert ids_of(M.referential_delete(chain(spark), "t", field("id").equals(4))["t"]) == [1, 2, 3, 5]
    assert {(r.id, r.up) for r in M.referential_delete(chain(spark, t="SetNull"), "t", field("id").equals(1))["t"].collect()} == {(2, None), (3, 2), (4, 4), (5, 9)}


def test_key_updates_are_carried_on(spark):
    out = M.referential_update(chain(spark), "a", field("id").equals(1), {"id": 10})
    assert {(r.id, r.a_id) for r in out["b"].collect()} == {(1, 10), (2, 2), (3, None)}
    with pytest.raises(ForeignKeyViolation):
        M.referential_update(chain(spark, update="Restrict"), "a", field("id").equals(1), {"id": 10})


def test_store_commits_all_tables_or_none(spark, company, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"), company.relations, company.keys)
    assert store.version() == 0
    with transaction(store) as t:
        t.apply({n: company.table(n) for n in ("employees", "departments")})
    assert store.version() == 1 and store.catalog().table("employees").count() == 5
    with pytest.raises(ZeroDivisionError), transaction(store) as t:
        t.apply(M.delete(t.table("employees"), field("id").equals(1)), "employees")
        1 / 0  # noqa: B018
    assert store.version() == 1 and store.catalog().table("employees").count() == 5

    def both(t):
        t.apply(M.delete(t.table("employees"), field("id").equals(1)), "employees")
        point = t.savepoint()
        t.apply(M.delete(t.table("departments"), field("id").gt(0)), "departments")
        t.back_to(point)
        t.apply(M.update(t.table("departments"), field("id").equals(1), {"name": "One"}), "departments")
        return t.table("employees").count()

    assert run_transaction(store, both) == 4
    now = store.catalog()
    assert store.version() == 2 and now.table("employees").count() == 4 and now.table("departments").where("name = 'One'").count() == 1
    assert store.catalog(1).table("employees").count() == 5
    with pytest.raises(TransactionConflict):
        store.commit({"employees": company.table("employees")}, 1)
    tries = []

    def raced(t):
        tries.append(1)
        if len(tries) == 1:
            store.commit({"departments": company.table("departments")}, store.version())
        t.apply(M.delete(t.table("employees"), field("id").equals(2)), "employees")

    run_transaction(store, raced, first=0.001)
    assert len(tries) == 2 and store.version() == 4 and store.catalog().table("employees").count() == 3
    with pytest.raises(InvalidQuery), transaction(store, read_only=True) as t:
        t.apply({})


# order, paging, windows, text


def test_ordered_includes_keep_their_order(spark, company):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Query("departments").select("name").include("employees").order_by(("id", "desc")).find_many(company)
        names = [r.name for r in company.table("departments").orderBy("id").collect()]
        assert [r["name"] for r in rows] == names[::-1]
        assert [e["id"] for r in rows for e in r["employees"]] == [e["id"] for r in rows for e in sorted(r["employees"], key=lambda e: e["id"])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paging_by_a_field_with_ties_and_nulls_loses_nothing(spark):
    rows = [(k, [None, 1, 2][k % 3]) for k in range(20)]
    c = Catalog(spark, {"t": load_fixture(spark, rows, "id int, v int")}, keys={"t": ("id",)})
    for way in ("asc", "desc"):
        seen, last = [], None
        while True:
            q = Query("t").order_by(("v", way), "id").take(3)
            page = (q.after(**last) if last else q).find_many(c)
            if not page:
                break
            seen += page
            last = page[-1]
        assert len(seen) == 20 and seen == Query("t").order_by(("v", way), "id").find_many(c)
    with pytest.raises(InvalidQuery):
        Query("t").order_by("v").after(v=1).to_df(c)


def test_find_unique_wants_one_row(company):
    assert Query("employees").where(id=1).find_unique(company)["id"] == 1
    assert Query("employees").where(id=99).find_unique(company) is None
    with pytest.raises(InvalidQuery):
        Query("employees").find_unique(company)


@pytest.mark.parametrize("kind,a,b", [("rows", None, None), ("rows", None, 0), ("rows", None, 1), ("rows", -2, None), ("rows", -2, 1), ("range", None, 0), ("range", 0, None), ("range", -1, 2), ("range", None, None)])
def test_frame_exclusion_agrees_with_brute_force(spark, kind, a, b):
    rows = [(i, i % 2, [1, 1, 2, 3, 3, 3, 5, 8][i % 8], None if i % 5 == 0 else i * 1.5) for i in range(24)]
    df = load_fixture(spark, rows, "id int, p int, k int, v double")
    lo, hi = (W.UNBOUNDED_PRECEDING if a is None else a), (W.UNBOUNDED_FOLLOWING if b is None else b)
    base = W.over("p").order_by("k", "id") if kind == "rows" and (a, b) != (None, None) else W.over("p").order_by("k")
    w = base.rows(lo, hi) if kind == "rows" else base.range(lo, hi)
    unique = base.order == ("k", "id")
    for what in ("current row", "group", "ties"):
        fns = [W.window_fn(f, f, w.excluding(what), "v") for f in ("count", "sum", "min", "max")]
        got = {r.id: (r["count"], r["sum"], r["min"], r["max"]) for r in W.with_windows(df, *fns).collect()}
        for i, p, k, _ in rows:
            mine = sorted((r for r in rows if r[1] == p), key=lambda r: (r[2], r[0]))
            at = next(n for n, r in enumerate(mine) if r[0] == i)
            if kind == "rows":
                frame = [r for n, r in enumerate(mine) if (a is None or n >= at + a) and (b is None or n <= at + b)]
            else:
                frame = [r for r in mine if (a is None or r[2] >= k + a) and (b is None or r[2] <= k + b)]
            peer = lambda r: r[0] == i if unique else r[2] == k  # noqa: B023, E731
            keep = {"current row": lambda r: r[0] != i, "group": lambda r: not peer(r), "ties": lambda r: not peer(r) or r[0] == i}[what]  # noqa: B023
            v = [r[3] for r in frame if keep(r) and r[3] is not None]
            assert got[i] == (len(v), pytest.approx(sum(v)) if v else None, min(v, default=None), max(v, default=None)), (what, i)


def test_search_splits_both_sides_alike(spark):
    c = Catalog(spark, {"t": load_fixture(spark, [(1, "a foo-bar b"), (2, "foobar"), (3, None), (4, "FOO_bar, été")], "id int, s string")})
    ids = lambda q: ids_of(Query("t").where(field("s").search(q)).to_df(c))
    assert ids("foo-bar") == [1, 4] and ids("Bar FOO") == [1, 4] and ids("foobar") == [2] and ids("ÉTÉ") == [4] and ids("fo") == []


def test_raw_queries_leave_quoted_text_alone(spark):
    t = load_fixture(spark, [(1, "$2 'x'")], "id int, s string")
    got = X.raw_query(spark, "SELECT id, '$9 it''s' AS q, \"$8\" AS d /* $7 */ FROM t WHERE id = $1 -- $6\n", 1, tables={"t": t}).first()
    assert got.id == 1 and got.d == "$8"
    one, two = X.raw_query(spark, "SELECT id FROM t", tables={"t": t}), X.raw_query(spark, "WITH u AS (SELECT id + 1 AS id FROM t) SELECT id FROM u", tables={"t": t.selectExpr("id + 10 AS id")})
    assert (one.first().id, two.first().id) == (1, 12) and not [v for v in spark.catalog.listTables() if v.name.startswith("_marlstone")]
    with pytest.raises(InvalidQuery):
        X.raw_query(spark, "SELECT $1 + $2", 1)


def test_json_keys_with_quotes(spark):
    c = Catalog(spark, {"t": load_fixture(spark, [(1, '{"a\'b": {"c": 5}}'), (2, '{"a": 1}')], "id int, j string")})
    assert ids_of(Query("t").where(field("j").json_path(["a'b", "c"], 5)).to_df(c)) == [1]
    assert ids_of(Query("t").where(field("j").json_contains({"a'b": {"c": 5}})).to_df(c)) == [1]
    with pytest.raises(InvalidQuery):
        Query("t").where(field("j").json_path(["a'.b"], 5)).to_df(c)


def test_a_failing_batch_ends_the_others(spark):
    bad = spark.range(1).selectExpr("raise_error('broken')")
    slow = spark.range(0, 4 * 10**10, 1, 2).selectExpr("sum(id % 7)")
    began = time.time()
    with pytest.raises(Exception, match="broken"):
        X.Runtime(spark).batch([bad, slow], parallel=2)
    assert time.time() - began < 60


# schema


RICH = """
  enum Role { USER ADMIN }
  model User {
    id Int @id @default(autoincrement())
    code String @default(uuid())
    short String @default(cuid())
    role Role @default(ADMIN)
    score Float @default(1.5)
    made DateTime @default(now())
    seen DateTime @updatedAt
    tags String[] @default(["a", "b"])
    raw Int @default(dbgenerated("1 + 1"))
    written Post[] @relation("writes")
    checked Post[] @relation("checks")
    groups Group[]
  }
  model Post { id Int @id
    by Int
    on Int? @default(3)
    author User @relation("writes", fields: [by], references: [id], onDelete: Cascade)
    editor User? @relation("checks", fields: [on], references: [id], onDelete: SetDefault)
    @@index([by]) }
  model Group { id Int @id
    users User[] }"""


def test_defaults_and_update_times(spark):
    s = parse_schema(RICH)
    base = spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in s.struct("User")]))
    given = M.next_ids(base, load_fixture(spark, [("a",), ("b",)], "code string"), "id", ["code"]).drop("code")
    row = M.create_many(base, given, creation_defaults(s, "User")).affected.orderBy("id").collect()
    assert [r.id for r in row] == [1, 2] and row[0].code != row[1].code and len(row[0].code) == 36 and len(row[0].short) == 25 and row[0].short.startswith("c")
    assert (row[0].role, row[0].score, row[0].tags, row[0].raw) == ("ADMIN", 1.5, ["a", "b"], 2) and row[0].made and row[0].seen
    assert numbered_columns(s, "User") == ["id"]
    old = M.create(base, {"id": 1, "seen": datetime(2000, 1, 1)}).table
    assert M.update(old, field("id").equals(1), {"role": "USER"}, update_stamps(s, "User")).affected.first().seen.year > 2000


def test_named_and_implicit_relations():
    s = parse_schema(RICH)
    assert s.relations["User", "written"].to_key == "by" and s.relations["User", "checked"].to_key == "on"
    assert s.relations["Post", "editor"].default == 3 and s.relations["Post", "author"].on_delete == "Cascade"
    assert s.relations["User", "groups"].junction == ("_GroupToUser", "B", "A") and s.relations["Group", "users"].junction == ("_GroupToUser", "A", "B")


@pytest.mark.parametrize("text,said", [
    ("model A { id Int @id\n x Int @default(\"a\") }", "no default of Int"), ("model A { id Int @id\n x Int @default(uuid()) }", "no default of Int"), ("model A { x Int }", "no key"), ("model A { id Int? @id }", "optional"),
    ("model A { id Int @id\n b String @db.SmallInt }", "native type"), ("model A { id Int @id\n @@index([nope]) }", "no field nope"), ("model A { id Int @id\n d String @updatedAt }", "DateTime"),
    ("enum E { X }\n model A { id Int @id\n e E @default(Y) }", "no value of E"), ("model A { id Int @id\n bs B[] }\n model B { id Int @id\n x String\n a A @relation(fields: [x], references: [id]) }", "differ in type"),
    ("model A { id Int @id\n n Int\n bs B[] }\n model B { id Int @id\n x Int\n a A @relation(fields: [x], references: [n]) }", "not unique"), ("model A { id Int @id\n b B }\n model B { id Int @id }", "opposite"),
    ("model A { id Int @id\n bs B[] }\n model B { id Int @id\n x Int\n a A @relation(fields: [x], references: [id], onDelete: SetNull) }", "SetNull"),
    ("model A { id Int\n no Int\n bs B[]\n @@id([id, no]) }\n model B { id Int @id\n x Int\n y Int\n a A @relation(fields: [x, y], references: [id, no]) }", "over 2 columns"),
    ("model A { id Int @id }\n model A { id Int @id }", "twice"), ("model A { id Int @id\n @@map(\"t\") }\n model B { id Int @id\n @@map(\"t\") }", "mapped to t"),
])
def test_validation_refuses(text, said):
    with pytest.raises(InvalidQuery, match=said):
        parse_schema(text)


def test_schema_differences_come_in_order():
    new = RICH.replace("@@index([by]) }", "@@index([on]) }").replace("score Float @default(1.5)", "score Float @default(2.5)").replace("ADMIN }", "ADMIN ROOT }").replace("onDelete: Cascade", "onDelete: Restrict").replace("model Group { id Int @id", "model Tag { id Int @id }\n  model Group { id Int @id\n    name String @unique")
    found = diff_models(parse_schema(RICH), parse_schema(new))
    kinds = [c.kind for c in found]
    assert {"drop_foreign_key", "create_foreign_key", "drop_index", "create_index", "alter_default", "alter_enum", "create_table", "add_column"} <= set(kinds)
    assert kinds.index("drop_foreign_key") < kinds.index("create_table") < kinds.index("add_column") < kinds.index("create_index") < kinds.index("create_foreign_key")
    assert diff_models(parse_schema(RICH), parse_schema(RICH)) == []


def test_two_keys_to_one_table_keep_both_relations(spark, company):
    schemas = {"a": T.StructType([T.StructField("id", T.IntegerType())]), "b": T.StructType([T.StructField(c, T.IntegerType()) for c in ("id", "x", "y")])}
    got = infer_relations(schemas, {("b", "x"): ("a", "id"), ("b", "y"): ("a", "id")})
    assert {k for k in got} == {("b", "a_by_x"), ("a", "b_of_x"), ("b", "a_by_y"), ("a", "b_of_y")}
    s = company.introspect_models()
    assert s.models["employees"].keys == company.keys.get("employees", ()) and any(f.type == "Int" for f in s.models["employees"].fields)

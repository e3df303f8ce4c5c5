"""Filter trees against a small evaluator with three-valued logic, and the predicates' edge cases."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from marlstone.operators.predicates import Cond, Group, all_of, any_of, field, keeps, not_, not_all
from marlstone.plans.errors import InvalidQuery

ROWS = [(i, s, n) for i, (s, n) in enumerate([("a", 1), ("b", None), (None, 3), ("ab", 2), (None, None), ("B", 5)])]


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame(ROWS, "id int, s string, n int").cache()


def holds(p, row):
    """True, False or None."""
    if isinstance(p, Group):
        parts = [holds(x, row) for x in p.parts]
        both = False if False in parts else None if None in parts else True
        either = True if True in parts else None if None in parts else False
        flip = lambda x: None if x is None else not x
        return {"and": both, "or": either, "nor": flip(either), "not_all": flip(both)}[p.kind]
    x = row[p.field]
    if p.op == "is_null":
        return (x is None) == p.value
    if p.op in ("in", "not_in") and not p.value:
        return p.op == "not_in"
    if x is None or p.value is None:
        return None
    return {"equals": lambda: x == p.value, "not_equals": lambda: x != p.value, "gt": lambda: x > p.value, "lte": lambda: x <= p.value, "in": lambda: x in p.value, "not_in": lambda: x not in p.value}[p.op]()


leaf = st.one_of(
    st.builds(Cond, st.just("n"), st.sampled_from(["equals", "not_equals", "gt", "lte"]), st.one_of(st.none(), st.integers(0, 6))),
    st.builds(Cond, st.just("n"), st.sampled_from(["in", "not_in"]), st.lists(st.integers(0, 6), max_size=3).map(tuple)),
    st.builds(Cond, st.sampled_from(["s", "n"]), st.just("is_null"), st.booleans()),
    st.builds(Cond, st.just("s"), st.sampled_from(["equals", "not_equals"]), st.sampled_from(["a", "b", "B"])),
)
trees = st.recursive(leaf, lambda c: st.builds(lambda k, ps: Group(k, tuple(ps)), st.sampled_from(["and", "or", "nor", "not_all"]), st.lists(c, min_size=1, max_size=3)), max_leaves=8)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(trees, min_size=4, max_size=4))
def test_trees_agree_with_three_valued_logic(demo, batch):
    got = demo.select("id", *[p.column().alias(f"p{i}") for i, p in enumerate(batch)]).collect()
    for row in got:
        record = dict(zip(("id", "s", "n"), ROWS[row["id"]], strict=True))
        assert [row[f"p{i}"] for i in range(len(batch))] == [holds(p, record) for p in batch]


def ids(df, p):
    return sorted(r.id for r in df.where(keeps(p)).collect())


def test_wildcards_and_backslashes(spark):
    df = spark.createDataFrame([(0, "a%b"), (1, "axb"), (2, "a\\b"), (3, "end\\"), (4, None)], "id int, s string")
    assert ids(df, field("s").contains("a_b")) == [0, 1, 2]
    assert ids(df, field("s").ends_with("\\")) == [3]
    assert ids(df, field("s").contains("a\\b")) == [2]
    assert ids(df, field("s").starts_with("A", insensitive=True)) == [0, 1, 2]


def test_not_forms_differ(demo):
    a, b = field("s").equals("a"), field("n").equals(2)
    assert ids(demo, not_(a, b)) == [5]
    assert ids(demo, not_all(a, b)) == [0, 1, 2, 3, 5]
    assert ids(demo, ~a) == [1, 3, 5]


def test_empty_groups_and_lists(demo):
    assert ids(demo, all_of()) == list(range(6))
    assert ids(demo, any_of()) == []
    assert ids(demo, field("n").is_in([])) == []
    assert ids(demo, field("n").not_in([])) == list(range(6))


def test_arrays(spark):
    df = spark.createDataFrame([(0, ["x", "y"]), (1, []), (2, None), (3, ["x", None])], "id int, t array<string>")
    assert ids(df, field("t").is_empty()) == [1, 2]
    assert ids(df, field("t").is_empty(False)) == [0, 3]
    assert ids(df, field("t").has("y")) == [0]
    assert ids(df, not_(field("t").has("y"))) == [1, 2, 3]
    assert ids(df, field("t").has_every(["x", "y"])) == [0]
    assert ids(df, field("t").has_every([])) == [0, 1, 2, 3]
    assert ids(df, field("t").has_some(["y", "z"])) == [0]
    assert ids(df, not_(field("t").has_some(["z"]))) == [0, 1, 2, 3]


def test_json(spark):
    df = spark.createDataFrame([(0, '{"a": {"b": [1, 2, {"c": "x"}]}, "n": null}'), (1, '{"a": "1"}'), (2, None), (3, "[1, 2]"), (4, "broken")], "id int, d string")
    assert ids(df, field("d").json_path("$.a", "1")) == [1]
    assert ids(df, field("d").json_contains({"a": {"b": [{"c": "x"}, 1]}})) == [0]
    assert ids(df, field("d").json_contains({"a": 1})) == []
    assert ids(df, field("d").json_contains({"n": None})) == [0]
    assert ids(df, field("d").json_contains([2])) == [3]
    assert ids(df, field("d").json_contains(2)) == [3]
    assert ids(df, field("d").json_array_contains("$.a.b", 2)) == [0]
    assert ids(df, field("d").json_has_key("n")) == [0]
    assert ids(df, field("d").json_has_key("b", "$.a")) == [0]


def test_search_and_errors(spark, demo):
    df = spark.createDataFrame([(0, "Red fox, blue Moon."), (1, "redfox"), (2, None)], "id int, s string")
    assert ids(df, field("s").search("moon RED")) == [0]
    with pytest.raises(InvalidQuery):
        Cond("s", "nope").column()
    with pytest.raises(InvalidQuery):
        Cond("s", "is_null", "yes").column(F.col)

"""Role repair against every possible repair, cut conversations against whole ones, and edge cases."""

import itertools
import random

import duckdb
import pytest

from marlstone.llm import chat

TURNS = chat.Turns()
R = chat.repair_tables(TURNS)
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(codes):
    """The least (cost, roles) over all assignments of roles to turns; None for a step is no way at all."""
    best = None
    for qs in itertools.product(range(1, 4), repeat=len(codes)):
        steps = list(zip((0, *qs), qs, codes))
        if all(R.step[p][q] for p, q, _ in steps):
            found = (sum(R.cost(p, q, c) for p, q, c in steps) + R.ends[qs[-1]][0], qs)
            best = min(best or found, found)
    return best


def legal(roles):
    follow = dict(TURNS.follow)
    return all(b in follow[a] for a, b in zip(["", *roles], roles)) and roles[-1] in TURNS.accept


def test_every_short_sequence_is_repaired_at_the_least_cost():
    w = chat.Writer(R, chat.Template())
    for n in range(1, 6):
        for codes in itertools.product(range(4), repeat=n):
            cost, qs = brute(codes)
            got = w.part(bytes(codes), [None] * n, 0, R.end_costs, True)
            assert got["cost"] == cost and R.path(bytes(codes), 0, R.end_costs) == qs
            assert legal(got["roles"].split())


def test_another_automaton():
    """System messages anywhere and tool calls; ends with either side."""
    turns = chat.Turns(roles=("system", "user", "assistant", "tool"), follow=(("", ("system", "user")), ("system", ("user", "assistant")), ("user", ("assistant", "system")), ("assistant", ("user", "tool")), ("tool", ("assistant",))), accept=("assistant", "user"))
    r = chat.Repair(turns)
    assert r.path(bytes([2, 4, 3]), 0, r.end_costs) == (2, 4, 3) and r.step[2][4] == (3, (3,))
    with pytest.raises(ValueError):
        chat.Repair(chat.Turns(follow=(("", ("user",)),)))


def test_summaries_say_where_paths_lead():
    rng = random.Random(5)
    for _ in range(200):
        codes = bytes(rng.randrange(4) for _ in range(rng.randint(2, 30)))
        cut = rng.randint(1, len(codes) - 1)
        whole = R.path(codes, 0, R.end_costs)
        costs, ranks = R.summary(codes[cut:])
        after = tuple(min(costs[p * 4 + q] + R.end_costs[q] for q in range(4)) for p in range(4))
        costs, ranks = R.summary(codes[:cut])
        state = min((costs[q] + after[q], ranks[q], q) for q in range(4))[2]
        assert state == whole[cut - 1]
        assert R.path(codes[:cut], 0, after) + R.path(codes[cut:], state, R.end_costs) == whole


def test_a_conversation_across_partitions_is_repaired_as_a_whole(spark):
    rng = random.Random(8)
    rows = [(7 if i % 3 else 100 + i % 50, i // 4 if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", None, "assistant"]), rng.choice(["a", "b <|end|> x", "", None, f"text {i}"])) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert all(r.n_parts == 1 and legal(r.roles.split()) for r in whole.values()) and len(whole) == len({r[0] for r in rows})
    parts = chat.format_chats(df, whole_bytes=0).collect()
    assert max(r.n_parts for r in parts) > 3
    for conv, w in whole.items():
        mine = sorted((r for r in parts if r.conv_id == conv), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(mine[0].n_parts))
        assert "".join(r.rendered for r in mine) == w.rendered and " ".join(r.roles for r in mine if r.roles) == w.roles
        for k in ("n_turns", "n_kept", "n_merged", "n_relabelled", "n_inserted", "cost"):
            assert sum(r[k] for r in mine) == w[k]


def test_edges(spark):
    rows = [(1, 0, " Human ", "hi", 1), (1, 1, "GPT", None, 2), (2, None, None, "x", 3), (2, 0, "user", "", 4), (None, 0, "user", "q", 5), (None, 0, "user", "q", 5), (None, 1, "assistant", "long " * 60_000, 6), (3, 0, "system", "<|end|>", 7)]
    df = spark.createDataFrame(rows, SCHEMA + ", rendered int")
    by = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert by[1].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\n<|end|>\n" and by[1].cost == 0
    assert by[2].roles == "system user assistant" and (by[2].n_merged, by[2].n_relabelled, by[2].n_inserted) == (0, 1, 1)
    assert by[None].n_merged == 1 and by[None].rendered.startswith("<|user|>\nq\n\nq<|end|>\n<|assistant|>\nlong ")
    assert by[3].rendered == "<|system|>\n< |end|><|end|>\n<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0
    renamed = chat.format_chats(df.selectExpr("string(conv_id) c", "turn t", "role r", "text x"), conv_col="c", turn_col="t", role_col="r", text_col="x").collect()
    assert {r.conv_id: r.rendered for r in renamed} == {None if k is None else str(k): r.rendered for k, r in by.items()}


def test_matches_sql_on_damaged_conversations(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Bot", "tool", None]), rng.choice(["", None, "it's <|user|>", f"é {c}.{t}"])) for c in range(300) for t in range(rng.randint(1, 12))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op1_chat_formatting(spark, str(tmp_path))
    want = duckdb.sql(chat.ORACLES["op1_chat_formatting"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)

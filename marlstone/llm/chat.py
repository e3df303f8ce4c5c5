"""Chat formatting: minimum-cost role repair over a legal-turn automaton, and rendering of the repaired sequence.

The automaton says which role may follow which. Each turn takes a legal role: its own at no cost, another by a relabel; it may be merged
into the message before it, or empty messages may be inserted before it. Dynamic programming finds the cheapest choice for
the whole conversation: costs to go backwards, choices forwards. A conversation of any length may be cut into fragments, as a
fragment is summed up by its least cost from each role before it to each role at its end (and by which of two equal ways comes first).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, session, shuffle_width, table

#: Rows in a batch of results.
OUT_ROWS = 1000
#: More than any conversation's cost.
NEVER = 1 << 60
#: A conversation of up to so many bytes is rendered in one piece; each turn counts as TURN_BYTES besides its text.
WHOLE_BYTES = 1 << 26
TURN_BYTES = 64

# Role names in use elsewhere and what they are called here.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Costs:
    """What each repair costs; a role that isn't known says little, so replacing it is cheaper."""

    merge: int = 1
    insert: int = 3
    relabel: int = 4
    unknown: int = 2


@dataclass(frozen=True)
class Template:
    """How messages are written. `mark` in a text is taken apart, so that no text can pass for a message border."""

    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    joint: str = "\n\n"
    mark: str = "<|"
    instead: str = "< |"


@dataclass(frozen=True)
class Turns:
    """A legal-turn automaton: follow[role] are the roles that may come next, "" stands for the start; any other role is unknown."""

    roles: tuple[str, ...] = ("system", "user", "assistant")
    follow: tuple[tuple[str, tuple[str, ...]], ...] = (("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    accept: tuple[str, ...] = ("assistant",)
    costs: Costs = field(default_factory=Costs)


class Repair:
    """The program over an automaton's states. State 0 is the start and state i the i-th role; code i is the i-th role and 0 an unknown one.

    step[p][q]: (cost before any relabel, roles inserted or None for a merge), None if q can't follow p at all;
    ends[p]: (cost, roles inserted at the end); moves[code][p]: the roles a turn may take after p, with their costs."""

    def __init__(self, turns: Turns):
        self.turns, self.names = turns, ("", *turns.roles)
        n, c = len(self.names), turns.costs
        follow = {self.names.index(p): sorted(self.names.index(q) for q in qs) for p, qs in turns.follow}
        between = [self._between(follow, p) for p in range(n)]
        self.step: list[list] = [[None] * n for _ in range(n)]
        for p in range(n):
            for q in range(1, n):
                ways = [(c.merge, 0, None)] if p == q else []
                if q in between[p]:
                    ways.append((c.insert * len(between[p][q]), 1, between[p][q]))
                if ways:
                    cost, _, how = min(ways, key=lambda w: w[:2])
                    self.step[p][q] = (cost, how)
        final = [self.names.index(r) for r in turns.accept]
        self.ends = []
        for p in range(n):
            ways = [(0, ())] if p in final else [(c.insert * (len(between[p][q]) + 1), (*between[p][q], q)) for q in final if q in between[p]]
            if not ways:
                raise ValueError(f"no legal end can be reached from {self.names[p] or 'the start'}")
            self.ends.append(min(ways))
        self.moves = [[[(q, self.cost(p, q, code)) for q in range(1, n) if self.step[p][q]] for p in range(n)] for code in range(n)]
        self.end_costs = tuple(e[0] for e in self.ends)
        self.short_path = lru_cache(1 << 16)(self.path)

    @staticmethod
    def _between(follow: dict[int, list[int]], p: int) -> dict[int, tuple[int, ...]]:
        """For each state that can come after p, the fewest states to insert before it (of equally few the smallest)."""
        out: dict[int, tuple[int, ...]] = {}
        edge = [(q, ()) for q in follow.get(p, [])]
        while edge:
            for q, way in edge:
                out.setdefault(q, way)
            edge = [(x, (*way, q)) for q, way in edge if out[q] == way for x in follow.get(q, []) if x not in out]
        return out

    def cost(self, p: int, q: int, code: int) -> int:
        c = self.turns.costs
        return self.step[p][q][0] + (0 if code == q else c.relabel if code else c.unknown)

    def path(self, codes: bytes, entry: int, after: tuple[int, ...]) -> tuple[int, ...]:
        """The role each turn takes, given the state before and what going on costs from each state after them: the least cost, and
        of equally cheap paths the smallest from the first turn on."""
        togo = [after]
        for code in reversed(codes):
            g = togo[-1]
            togo.append([min(cost + g[q] for q, cost in moves) for moves in self.moves[code]])
        out, p = [], entry
        for k, code in enumerate(codes):
            g = togo[len(codes) - 1 - k]
            p = min((cost + g[q], q) for q, cost in self.moves[code][p])[1]
            out.append(p)
        return tuple(out)

    def summary(self, codes: bytes) -> tuple[list[int], list[int]]:
        """A fragment's least cost from each state to each (state by state; NEVER if there is no way), and of the paths that have it,
        from the same state to different ones, the order that `path` prefers them in."""
        n, costs, ranks = len(self.names), [], []
        for p in range(n):
            cost, rank = [NEVER] * n, [n] * n
            cost[p] = rank[p] = 0
            for code in codes:
                best = [(NEVER, n, q) for q in range(n)]
                for x in range(n):
                    if cost[x] < NEVER:
                        for q, c in self.moves[code][x]:
                            best[q] = min(best[q], (cost[x] + c, rank[x], q))
                cost, rank = [b[0] for b in best], [n] * n
                for k, (_, _, q) in enumerate(sorted((b for b in best if b[0] < NEVER), key=lambda b: b[1:])):
                    rank[q] = k
            costs += cost
            ranks += rank
        return costs, ranks


@lru_cache(8)
def repair_tables(turns: Turns) -> Repair:
    return Repair(turns)


class Writer:
    """Renders turns whose roles are known. A message is closed by what follows it, so each turn's piece needs only what came before."""

    def __init__(self, tables: Repair, template: Template):
        self.r, t = tables, template
        self.t, self.opening = t, [t.opening.format(role=name) for name in tables.names]

    def empty(self, inserted: tuple[int, ...]) -> str:
        return "".join(self.opening[q] + self.t.closing for q in inserted)

    def part(self, codes: bytes, texts: list[str | None], entry: int, after: tuple[int, ...], last: bool) -> dict:
        r, t, p, pieces, roles = self.r, self.t, entry, [], []
        n = {"kept": 0, "merged": 0, "relabelled": 0, "inserted": 0, "cost": 0}
        for code, q, text in zip(codes, (r.short_path if len(codes) <= 64 else r.path)(codes, entry, after), texts, strict=True):
            inserted = r.step[p][q][1]
            n["cost"] += r.cost(p, q, code)
            n["relabelled"] += code != q
            if inserted is None:
                n["merged"] += 1
                pieces.append(t.joint)
            else:
                n["kept"] += code == q
                n["inserted"] += len(inserted)
                roles += [*inserted, q]
                pieces.append((t.closing if p else "") + self.empty(inserted) + self.opening[q])
            pieces.append((text or "").replace(t.mark, t.instead))
            p = q
        if last:
            cost, inserted = r.ends[p]
            n["cost"] += cost
            n["inserted"] += len(inserted)
            roles += inserted
            pieces.append(t.closing + self.empty(inserted))
        return {**n, "roles": " ".join(r.names[q] for q in roles), "rendered": "".join(pieces)}


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list], bool]]:
    """Column lists of consecutive rows with equal keys, batch by batch: (key, columns, whether the key goes on from the run before)."""
    before = None
    for batch in batches:
        cols = batch.to_pydict()
        marks = list(zip(*[cols[k] for k in keys], strict=True))
        at = 0
        for key, run in groupby(marks):
            n = sum(1 for _ in run)
            yield key, {k: v[at : at + n] for k, v in cols.items()}, key == before
            before, at = key, at + n


def _edges(turns: Turns, conv_type: pa.DataType):
    """For a sorted partition: a summary of its first and of its last conversation, which other partitions may share."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables, part = repair_tables(turns), TaskContext.get().partitionId()
        first, now = None, None
        for (conv,), cols, goes_on in _runs(batches, ["conv_id"]):
            if not goes_on:
                first = first or now
                now = (conv, [cols[k][0] for k in ("turn", "code", "text_hash", "row_id")], bytearray(), [0])
            now[2].extend(cols["code"])
            now[3][0] += sum(cols["size"])
        for conv, key, codes, size in [x for x in (first, now) if x]:
            costs, ranks = tables.summary(bytes(codes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([conv], conv_type), pa.array(size, pa.int64()), *[pa.array([x], pa.int64()) for x in key], pa.array([costs], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.int64()))],
                ["part", "conv_id", "size", "turn", "code", "text_hash", "row_id", "costs", "ranks"],
            )

    return look


def _rank(turn: int | None, code: int, text_hash: int, row_id: int) -> tuple:
    """Where a row stands in its conversation, as the sort of the partitions has it: null turns first."""
    return (turn is not None, turn or 0, code, text_hash, row_id)


def _cuts(rows: list, tables: Repair, whole_bytes: int) -> dict:
    """For each large conversation that lies in several partitions: ranks at which its later fragments begin, and each fragment's state before and costs to go after."""
    rows, width, out = sorted(rows, key=lambda r: r.part), len(tables.names), {}
    for conv, same in groupby(rows, key=lambda r: r.conv_id):
        parts = list(same)
        if len(parts) > 1 and sum(r.size for r in parts) > whole_bytes:
            after = [tables.end_costs]
            for r in reversed(parts[1:]):
                togo = [min(r.costs[p * width + q] + after[-1][q] for q in range(width)) for p in range(width)]
                after.append(tuple(min(g - min(togo), NEVER) for g in togo))
            after.reverse()
            entry = [0]
            for r, g in zip(parts[:-1], after, strict=False):
                row = slice(entry[-1] * width, (entry[-1] + 1) * width)
                entry.append(min((c + g[q], rank, q) for q, (c, rank) in enumerate(zip(r.costs[row], r.ranks[row], strict=True)))[2])
            out[conv] = ([_rank(r.turn, r.code, r.text_hash, r.row_id) for r in parts[1:]], entry, after)
    return out


def format_chats(df: DataFrame, turns: Turns = Turns(), template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", whole_bytes: int = WHOLE_BYTES) -> DataFrame:  # noqa: B008
    """Repairs the roles of each conversation at the least cost and renders it: conv_id, part, n_parts, n_turns, n_kept, n_merged,
    n_relabelled, n_inserted, cost, roles (of the messages that begin in the part) and rendered.

    A conversation of up to whole_bytes has one row. A larger one that lies across the partitions of a sort by (conversation, turn), of
    which there are spark.sql.shuffle.partitions, has a row for each piece, and the renderings put together by part are the whole: so
    one that holds a third of all rows is neither cut short nor gathered. The pieces follow the partitions, the repair doesn't.

    Roles are taken without blanks around them and in any case, after ALIASES. Of equally cheap repairs the one with the smallest roles,
    turn by turn and in the automaton's order, is taken. Null or other roles are unknown. A null text is empty; its turn stays. Turns
    with equal numbers are ordered by role (unknown first) and then by the first 60 bits of the text's MD5; null turn numbers come
    first; repeated rows are turns of their own. Rows without conv_id form one conversation. An empty table gives no rows. A very
    long text is one turn in one task. Other columns aren't carried, as turns are merged; theirs may have any names."""
    spark, tables = session(df), repair_tables(turns)
    name = F.lower(F.trim(F.col(role_col).cast("string")))
    code = F.lit(0)
    for i, role in reversed(list(enumerate(turns.roles, 1))):
        code = F.when(name.isin(role, *[a for a, r in ALIASES.items() if r == role and a not in turns.roles]), F.lit(i)).otherwise(code)
    text = F.col(text_col).cast("string")
    scratch = Scratch(spark, "chat")
    rows = scratch.write(
        df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(code, F.lit(0)).cast("int").alias("code"), F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long").alias("text_hash"), F.monotonically_increasing_id().alias("row_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + TURN_BYTES).cast("long").alias("size"), text.alias("text")),
        "turns",
    )
    order = ["conv_id", "turn", "code", "text_hash", "row_id"]
    conv_sql = rows.schema["conv_id"].dataType.simpleString()
    conv_type = rows.limit(0).select("conv_id").toArrow().schema.field(0).type
    light = rows.select(*order, "size").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    # At most two rows a partition reach the driver, whatever the input.
    edges = light.mapInArrow(_edges(turns, conv_type), f"part long, conv_id {conv_sql}, size long, turn long, code long, text_hash long, row_id long, costs array<long>, ranks array<long>")
    cuts = _cuts(edges.collect(), tables, whole_bytes)

    @F.arrow_udf("int")
    def fragment(conv: pa.Array, turn: pa.Array, code: pa.Array, text_hash: pa.Array, row_id: pa.Array) -> pa.Array:
        out = np.zeros(len(conv), np.int32)
        for i, c in enumerate(conv.to_pylist()):
            if c in cuts:
                out[i] = bisect_right(cuts[c][0], _rank(turn[i].as_py(), code[i].as_py(), text_hash[i].as_py(), row_id[i].as_py()))
        return pa.array(out)

    schema = [("conv_id", conv_type), ("part", pa.int32()), ("n_parts", pa.int32()), *[(f"n_{k}", pa.int64()) for k in ("turns", "kept", "merged", "relabelled", "inserted")], ("cost", pa.int64()), ("roles", pa.string()), ("rendered", pa.string())]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, out, now = Writer(repair_tables(turns), template), [], None
        whole = writer.r.end_costs

        def done(key: tuple, codes: bytearray, texts: list) -> dict:
            conv, part = key
            ranks, entry, after = cuts.get(conv, ((), (0,), (whole,)))
            got = writer.part(bytes(codes), texts, entry[part], after[part], part == len(ranks))
            return {"conv_id": conv, "part": part, "n_parts": len(ranks) + 1, "n_turns": len(texts), **{(k if k in ("cost", "roles", "rendered") else f"n_{k}"): v for k, v in got.items()}}

        size = 0
        for key, cols, goes_on in _runs(batches, ["conv_id", "fragment"]):
            if not goes_on:
                if now:
                    out.append(done(*now))
                    size += len(out[-1]["rendered"])
                if len(out) >= OUT_ROWS or size >= 1 << 24:
                    yield pa.RecordBatch.from_pylist(out, pa.schema(schema))
                    out, size = [], 0
                now = (key, bytearray(), [])
            now[1].extend(cols["code"])
            now[2].extend(cols["text"])
        if now:
            out.append(done(*now))
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema(schema))

    placed = rows.withColumn("fragment", fragment(*order) if cuts else F.lit(0))
    dealt = placed.repartition("conv_id", "fragment").sortWithinPartitions("conv_id", "fragment", *order[1:])
    counts = ", ".join(f"n_{k} long" for k in ("turns", "kept", "merged", "relabelled", "inserted"))
    return dealt.select("conv_id", "fragment", "code", "text").mapInArrow(render, f"conv_id {conv_sql}, part int, n_parts int, {counts}, cost long, roles string, rendered string")


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def _sql(turns: Turns, t: Template) -> str:
    """The query as SQL: a recursive walk carries each role's least cost and path; ties between turn numbers go by role and the text's MD5."""
    r = repair_tables(turns)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    empty = lambda how: "".join(t.opening.format(role=r.names[q]) + t.closing for q in how)
    begin = lambda p, q, how: (t.closing if p else "") + empty(how) + t.opening.format(role=r.names[q])
    steps, n = [], range(len(r.names))
    for p, q in [(p, q) for p in n for q in n if r.step[p][q]]:
        cost, how = r.step[p][q]
        steps.append(f"({p},{q},{cost},{len(how or ())},{how is None},{quote(' '.join(r.names[x] for x in (*(how or ()), q)) if how is not None else '')},{quote(t.joint if how is None else begin(p, q, how))})")
    ends = [f"({p},{c},{len(how)},{quote(' '.join(r.names[x] for x in how))},{quote(t.closing + empty(how))})" for p, (c, how) in enumerate(r.ends)]
    names = " ".join(f"WHEN lower(trim(role)) IN ({', '.join(quote(x) for x in (role, *[a for a, b in ALIASES.items() if b == role]))}) THEN {i}" for i, role in enumerate(turns.roles, 1))
    relabel = lambda code, q: f"CASE WHEN {code} = {q} THEN 0 WHEN {code} = 0 THEN {turns.costs.unknown} ELSE {turns.costs.relabel} END"
    return f"""
WITH RECURSIVE step(p, q, base, n_new, merged, names, opening) AS (VALUES {", ".join(steps)}),
fin(p, cost, n_new, names, tail) AS (VALUES {", ".join(ends)}),
coded AS (SELECT conv_id, turn, CASE {names} ELSE 0 END AS code, coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id, code, replace(coded.text, {quote(t.mark)}, {quote(t.instead)}) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code, CAST('0x' || substr(md5(coded.text), 1, 15) AS BIGINT)) AS k FROM coded),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS path FROM t
  UNION ALL
  SELECT conv_id, k, q, best.cost, best.path FROM (
    SELECT dp.conv_id, t.k, s.q, min(struct_pack(cost := CAST(dp.cost + s.base + {relabel("t.code", "s.q")} AS BIGINT), path := dp.path || s.q)) AS best
    FROM dp JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.k = dp.k + 1 JOIN step s ON s.p = dp.state GROUP BY ALL)
),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
best AS (
  SELECT dp.conv_id, min(struct_pack(cost := dp.cost + fin.cost, path := dp.path)) AS b FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.k JOIN fin ON fin.p = dp.state GROUP BY dp.conv_id
),
laid AS (SELECT t.*, b.cost, CAST(b.path[k] AS INT) AS q, CASE WHEN k = 1 THEN 0 ELSE CAST(b.path[k - 1] AS INT) END AS p, CAST(b.path[length(b.path)] AS INT) AS l FROM t JOIN best ON best.conv_id IS NOT DISTINCT FROM t.conv_id)
SELECT conv_id, CAST(0 AS INT) AS part, CAST(1 AS INT) AS n_parts, count(*) AS n_turns, count(*) FILTER (WHERE code = laid.q AND NOT merged) AS n_kept, count(*) FILTER (WHERE merged) AS n_merged,
  count(*) FILTER (WHERE code <> laid.q) AS n_relabelled, CAST(sum(s.n_new) + any_value(fin.n_new) AS BIGINT) AS n_inserted, any_value(laid.cost) AS cost,
  string_agg(s.names, ' ' ORDER BY k) FILTER (WHERE s.names <> '') || CASE WHEN any_value(fin.names) = '' THEN '' ELSE ' ' || any_value(fin.names) END AS roles,
  string_agg(s.opening || text, '' ORDER BY k) || any_value(fin.tail) AS rendered
FROM laid JOIN step s ON s.p = laid.p AND s.q = laid.q JOIN fin ON fin.p = laid.l GROUP BY conv_id
"""


QUERIES = {"op1_chat_formatting": op1_chat_formatting}
ORACLES = {"op1_chat_formatting": _sql(Turns(), Template())}

"""Histogram sort: equal-byte shards from exact counts below candidate boundaries, then one exchange.

Rows are ordered by (hash of the text, id). The driver keeps a set of candidate boundaries (probes). In each
round the executors count the exact bytes and rows between neighbouring probes of a thin table of keys and
sizes; brackets that still hold a wanted splitter, or too many bytes, get further probes. When every splitter
meets the tolerance the rows are exchanged once, by bracket, and numbered within their shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, session, table, utf8_bytes, without

#: Bytes that one task sorts in the end, about, and the most probes wanted for that.
CELL_BYTES, MOST_PROBES = 128 << 20, 1 << 20
#: Equal texts of at most this share of a shard's bytes stay together.
WHOLE_SHARE = 0.1
OWN = ("_hi", "_lo", "_size", "_cell", "shard", "slot", "size")


class Splitters:
    """Probes as numbers (hi - hi_min) * span + (lo - lo_min), with the exact bytes and rows below each."""

    def __init__(self, keys: list[int], below_bytes: list[int], below_rows: list[int], cuts: list[int], lo_min: int, span: int, hi_min: int):
        self.keys, self.below_bytes, self.below_rows, self.cuts = keys, below_bytes, below_rows, cuts
        self.hi = np.array([k // span + hi_min for k in keys], np.int64)
        self.lo = np.array([k % span + lo_min for k in keys], np.int64)


def cells(hi: np.ndarray, lo: np.ndarray, probe_hi: np.ndarray, probe_lo: np.ndarray) -> np.ndarray:
    """For each key the number of probes that are not above it."""
    left, out = np.searchsorted(probe_hi, hi, "left"), np.searchsorted(probe_hi, hi, "right")
    tied = np.flatnonzero(left < out)
    order = tied[np.argsort(hi[tied], kind="stable")]
    for run in np.split(order, np.flatnonzero(np.diff(hi[order])) + 1) if len(order) else ():
        a, b = left[run[0]], out[run[0]]
        out[run] = a + np.searchsorted(probe_lo[a:b], lo[run], "right")
    return out


class Counts:
    """Exact bytes and rows of each cell, and its least and largest hi (0 and -1 in an empty one)."""

    def __init__(self, n: int):
        self.bytes, self.rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.least, self.most = np.zeros(n, np.int64), np.full(n, -1, np.int64)


def _count(thin: DataFrame, probe_hi: np.ndarray, probe_lo: np.ndarray) -> Counts:
    n = len(probe_hi) + 1

    def partial(batches):
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        for b in batches:
            hi = b.column(0).to_numpy()
            c = cells(hi, b.column(1).to_numpy(), probe_hi, probe_lo)
            np.add.at(size, c, b.column(2).to_numpy())
            rows += np.bincount(c, minlength=n)
            np.minimum.at(least, c, hi), np.maximum.at(most, c, hi)
        full = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(x) for x in (full, size[full], rows[full], least[full], most[full])], ["cell", "bytes", "rows", "least", "most"])

    sums = thin.mapInArrow(partial, "cell long, bytes long, rows long, least long, most long").groupBy("cell")
    got = sums.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    out, c = Counts(n), got.column("cell").to_numpy()
    for name in ("bytes", "rows", "least", "most"):
        getattr(out, name)[c] = got.column(name).to_numpy()
    return out


def find_splitters(thin: DataFrame, n_shards: int, tolerance: float, fan: int, whole_share: float = WHOLE_SHARE, cell_bytes: int = CELL_BYTES) -> Splitters | None:
    """thin: _hi long, _lo long, _size long. None for an empty table.

    A boundary that falls among equal texts of at most whole_share of a shard's bytes moves to the nearer end of the group. Probes
    are added until every boundary is settled and no cell holds more than about cell_bytes, or one key; a round splits
    each open bracket fan ways, so brackets close after at most 128 / log2(fan) rounds. At most MOST_PROBES are wanted for
    cells; beyond MOST_PROBES * cell_bytes cells grow instead.
    """
    lim = thin.agg(*[f(c).alias(f"{n}_{c}") for c in ("_hi", "_lo") for n, f in (("min", F.min), ("max", F.max))], F.sum("_size").alias("bytes"), F.count("*").alias("rows")).first()
    if not lim.rows:
        return None
    span = lim.max__lo - lim.min__lo + 1
    end = (lim.max__hi - lim.min__hi + 1) * span
    known = {0: (0, 0), end: (lim.bytes, lim.rows)}
    within = {0: (0, lim.max__hi - lim.min__hi)}  # by where a cell begins: its least and largest hi, from the smallest
    targets = [lim.bytes * k // n_shards for k in range(1, n_shards)]
    shard = lim.bytes / n_shards
    slack, whole = max(1, int(tolerance * shard)), whole_share * shard
    heavy = max(min(4 * shard / fan, cell_bytes), lim.bytes / MOST_PROBES)
    while True:
        keys = sorted(known)
        for a, b in zip(keys[:-1], keys[1:], strict=True):  # a cell of one group tells the group's ends without another count
            least, most = within.get(a, (0, -1))
            if least == most:
                for p, below in ((least * span, known[a]), ((least + 1) * span, known[b])):
                    if a < p < b:
                        known[p] = below
                        within[p] = (least, most) if p == least * span else (0, -1)
                        if p == least * span:
                            within[a] = (0, -1)
        keys = sorted(known)
        below = [known[k][0] for k in keys]
        wanted: dict[int, int] = {}
        for j in range(len(keys) - 1):
            if keys[j + 1] - keys[j] > 1 and below[j + 1] - below[j] > heavy:
                one = within.get(keys[j], (0, -1))
                wanted[j] = max(fan if one[0] == one[1] else 1, 1 + int((below[j + 1] - below[j]) / heavy))
        for t in targets:
            if t and _nearest(t, keys, below, slack, span, whole) is None:
                j = bisect_left(below, t)
                wanted[j - 1] = max(fan, wanted.get(j - 1, 0))
        fresh = set()
        for j, n in wanted.items():
            a, b = keys[j], keys[j + 1]
            least, most = within.get(a, (0, -1))
            a, b = max(a, least * span), min(b, (most + 1) * span)  # where its rows are
            for i in range(n + 2):
                p = a + (b - a) * i // (n + 1)
                if most > least:  # between groups of equal texts
                    p = p // span * span
                if keys[j] < p < keys[j + 1]:
                    fresh.add(p)
        if not fresh:
            break
        probes = sorted(fresh | known.keys() - {0, end})
        hi = np.array([p // span + lim.min__hi for p in probes], np.int64)
        lo = np.array([p % span + lim.min__lo for p in probes], np.int64)
        n = _count(thin, hi, lo)
        known |= {p: (int(s), int(r)) for p, s, r in zip(probes, np.cumsum(n.bytes)[:-1], np.cumsum(n.rows)[:-1], strict=True)}
        within = {p: (least - lim.min__hi, most - lim.min__hi) if rows else (0, -1) for p, least, most, rows in zip([0, *probes], n.least.tolist(), n.most.tolist(), n.rows.tolist(), strict=True)}
    cuts = [_nearest(t, keys, below, slack, span, whole) if t else 0 for t in targets]
    inner = keys[1:-1]
    return Splitters(inner, [known[k][0] for k in inner], [known[k][1] for k in inner], cuts, lim.min__lo, span, lim.min__hi)


def _nearest(target: int, keys: list[int], below: list[int], slack: int, span: int, whole: float) -> int | None:
    """Where the boundary for a target lies, or None while its bracket needs more probes: between groups of equal texts within
    the slack; else at the nearer end of the group around it, if that is to stay whole; else within the slack among the
    group's rows, or at the row that the target falls on."""
    j = bisect_left(below, target)
    closest = lambda some: keys[min(some, key=lambda i: abs(below[i] - target))]
    near = range(bisect_left(below, target - slack), bisect_right(below, target + slack))
    if between := [i for i in near if keys[i] % span == 0]:
        return closest(between)
    a, b = j - 1, j
    while keys[a] % span:
        a -= 1
    while keys[b] % span:
        b += 1
    if keys[b] - keys[a] > span:
        return None
    if below[b] - below[a] <= whole:
        return closest((a, b))
    if len(near):
        return closest(near)
    return closest((j - 1, j)) if keys[j] - keys[j - 1] == 1 else None


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, overhead: int = 8, tolerance: float = 0.001, fan: int = 32, whole_share: float = WHOLE_SHARE, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """All rows of df with size (UTF-8 bytes plus overhead), shard (0 to n_shards-1) and slot (gapless from 0 in a shard).

    Shards have equal bytes to within tolerance (a share of a shard), or one row where a row is larger, or half a group where
    that keeps a group whole: equal texts share a shard if together they hold at most whole_share of a shard's bytes; larger
    groups are cut where a boundary falls among them. Null text counts no bytes; a null id sorts as 0; equal rows are told
    apart arbitrarily but each keeps its own slot. An empty table gives an empty result; a very long text is one row like any
    other. Input columns named like the operator's own (size, shard, slot) are replaced. The driver holds only probes.
    """
    spark = session(df)
    keyed = without(df, *OWN).withColumns({
        "_hi": F.xxhash64(F.col(text_col)), "_lo": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "size": utf8_bytes(F.col(text_col)) + overhead,
    })
    scratch = Scratch(spark, "sharding")
    thin = scratch.write(keyed.select("_hi", "_lo", F.col("size").alias("_size")), "keys")
    found = find_splitters(thin, n_shards, tolerance, fan, whole_share, cell_bytes)
    scratch.keep_only()
    if found is None:
        return keyed.drop("_hi", "_lo").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    probes = np.array(found.below_rows, np.int64)
    where = {k: i for i, k in enumerate(found.keys)}
    inner = np.array([where[c] for c in found.cuts if c in where], np.int64)
    low = sum(c <= 0 for c in found.cuts)  # boundaries at the very start: shards that stay empty
    shard_of = np.searchsorted(inner + 1, np.arange(len(found.keys) + 1), "right") + low
    starts = np.concatenate([[0], probes])
    new = np.ones(len(shard_of), bool)
    new[1:] = shard_of[1:] != shard_of[:-1]
    base = starts - starts[np.flatnonzero(new)][np.cumsum(new) - 1]
    probe_hi, probe_lo = found.hi, found.lo

    @F.pandas_udf("cell int, shard int, base long")
    def place(hi: pd.Series, lo: pd.Series) -> pd.DataFrame:
        c = cells(hi.to_numpy(), lo.to_numpy(), probe_hi, probe_lo)
        return pd.DataFrame({"cell": c.astype(np.int32), "shard": shard_of[c].astype(np.int32), "base": base[c]})

    placed = keyed.withColumn("_cell", place("_hi", "_lo"))
    order = Window.partitionBy("_cell.cell").orderBy("_hi", "_lo")
    return placed.withColumns({"shard": F.col("_cell.shard"), "slot": F.col("_cell.base") + F.row_number().over(order) - 1}).drop("_hi", "_lo", "_cell")


def op2_histogram_sort(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_histogram_sort": op2_histogram_sort}

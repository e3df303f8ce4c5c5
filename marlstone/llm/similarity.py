"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

A document is the set of its distinct word shingles. Equal sets form a class; classes link when their Jaccard similarity
reaches the threshold. Sizes are cut into intervals so that linked sets lie in the same or in neighbouring ones; within
such a range two linked sets differ in at most D shingles. The hash space of shingles is cut into parts:

* light ranges (small sets): D + 2 parts, of which linked sets agree in at least two, so every subset of two parts is a
  signature;
* heavy ranges (large sets): D + 1 parts, of which linked sets agree in at least one, so every single part is a signature,
  whose inverted list is scanned.

A few spare parts make up for empty ones, which are no signatures. Shingles of widespread passages are left out of
the parts, which can only bring two sets closer; sets that have little else are taken whole as well.

The boundary is where the whole costs least by what was counted: the sets of each size, and how often shingles that aren't
widespread meet in unrelated sets. Subsets are more signatures, but their lists bring fewer unrelated sets together, which
pays for many small sets of a poor vocabulary. A list chains its members to the smallest, never to each other; chained sets form clusters, and only within clusters are sets
compared, exactly and in blocks, so a large cluster is spread over many tasks and no pair but the linked ones leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, combine, hash_words, mix, session, shuffle_width, table
from .components import components

#: Sets in a block of a cluster, and shingles in it, about.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 21
#: Bits of the filter that spares documents outside all clusters the second reading; its size is fixed.
FILTER_BITS = 1 << 23
#: What comparing two sets costs a shingle, in units of one signature.
COMPARE = 0.01
#: Cells that shingles are counted in to tell the widespread ones, the sets that a cell needs at least, and the cells of a run, whose
#: counts travel together.
CELLS, WIDESPREAD, RUN = 1 << 22, 64, 1 << 14


def shingle_sets(texts: list[str | None], size: int = 3) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; the whole sequence where it has fewer words."""
    for words in hash_words(texts, BLANKS):
        h, n = words.hashes, len(words.hashes)
        full = combine(*[h[i : n - size + 1 + i] for i in range(size)]) if n >= size else h[:0]
        for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if hi - lo >= size:
                yield np.unique(full[lo : hi - size + 1])
            elif hi > lo:
                yield combine(*[h[k : k + 1] for k in range(lo, hi)])
            else:
                yield h[:0]


def fingerprint(s: np.ndarray) -> int:
    """64 bits that stand for a whole set; two of N sets collide with a chance below N^2 / 2^65."""
    return int(mix(np.array([mix(s + np.uint64(77)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


class Ranges:
    """The intervals of set sizes, the most that linked sets of a range differ by, its scheme and its spare parts.

    With spare parts, linked sets agree in more parts than either has empty ones, so empty parts needn't be signatures.
    """

    def __init__(self, num: int, den: int, histogram: dict[int, int], meet: float = 0.0):
        """histogram: sets by their size; meet: how likely a shingle of one set is in another."""
        self.bounds, largest = [1], max(histogram, default=1)
        while self.bounds[-1] <= largest:
            self.bounds.append(self.bounds[-1] * den // num + 1)
        self.differ, self.light, self.spare = [], [], []
        for i in range(len(self.bounds) - 1):
            top = 2 * (self.bounds[i + 1] - 1)
            d = max(s - 2 * -(-num * s // (num + den)) for s in range(max(2, top - 2 * (num + den)), top + 1))
            self.differ.append(d)
            empty = (d + 1) * exp(-0.8 * self.bounds[i] / (d + 1))
            self.spare.append(ceil(empty + 3 * empty**0.5) + 1 if d else 0)
        self.costs = [self._costs(i, histogram, meet) for i in range(len(self.differ))]
        # the boundary between light and heavy ranges that makes all of them cheapest
        below = [sum(c[0] for c in self.costs[:k]) + sum(c[1] for c in self.costs[k:]) for k in range(len(self.costs) + 1)]
        self.boundary = below.index(min(below))
        self.light = [i < self.boundary for i in range(len(self.differ))]

    def _costs(self, i: int, histogram: dict[int, int], meet: float) -> tuple[float, float]:
        """What a range costs with subsets of two parts, and with single parts: its signatures, made and exchanged at a unit each; and
        the pairs of unrelated sets that its inverted lists bring together, which are compared at COMPARE a shingle. Two sets
        meet in a part if all its shingles are in both."""
        lo, hi = self.bounds[max(0, i - 1)], self.bounds[i + 1]
        some = [(n, c) for n, c in histogram.items() if lo <= n < hi]
        sets, shingles = sum(c for _, c in some), sum(n * c for n, c in some)
        if not sets:
            return 0.0, 0.0
        out = []
        for extra in (1, 0):
            parts = self.differ[i] + 1 + extra + self.spare[i]
            kinds, each = (comb(parts, 2), 2) if extra else (parts, 1)
            strays = sets * (sets - 1) / 2 * kinds * min(1.0, meet) ** max(1.0, each * shingles / sets / parts)
            out.append(sets * kinds + strays * COMPARE * shingles / sets)
        return out[0], out[1]

    def of(self, n: int) -> tuple[int, int]:
        """The two ranges a set of n shingles takes part in: its own interval's, and the next, as the smaller side."""
        i = int(np.searchsorted(self.bounds, n, "right")) - 1
        return i, i + 1

    def signatures(self, s: np.ndarray, cold: np.ndarray) -> np.ndarray:
        """Parts of the shingles that aren't widespread; if too many of those are empty, parts of all shingles too, and then empty ones."""
        out = []
        rare = s[cold]
        for i in self.of(len(s)):
            if i >= len(self.differ):
                continue
            parts = self.differ[i] + 1 + self.light[i] + self.spare[i]
            for kind, some in enumerate((rare, s)):
                one, full = self._parts(some, parts, i << 34 | kind << 32)
                out.append(self._subsets(one, full, self.light[i], False))
                enough = parts - full.sum() <= self.spare[i] + self.light[i]
                if enough or len(some) == len(s):
                    break
            if not enough:
                one, full = self._parts(s, parts, i << 34 | 2 << 32)
                out.append(self._subsets(one, full, self.light[i], True))
        return np.concatenate(out)

    @staticmethod
    def _parts(s: np.ndarray, parts: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s))])
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        return combine(np.arange(parts, dtype=np.uint64) + np.uint64(tag), sums[at[1:]] - sums[at[:-1]]), at[1:] > at[:-1]

    @staticmethod
    def _subsets(one: np.ndarray, full: np.ndarray, two: bool, empty: bool) -> np.ndarray:
        if not two:
            return one[~full] if empty else one[full]
        a, b = np.triu_indices(len(one), 1)
        keep = ~(full[a] | full[b]) if empty else full[a] | full[b]
        return combine(one[a[keep]], one[b[keep]])


def _widespread(docs: DataFrame, text_col: str, size: int, sets: int, shingles: int, scratch: Scratch) -> tuple[np.ndarray, float]:
    """One bit per hash cell: whether its shingles are in far more distinct sets than most; any choice gives the same links. And how
    likely a shingle of one set that isn't widespread is in another set, for the costs.

    Tasks report cells that they met often, packed by runs of RUN cells. Counts are summed and judged on the executors, whatever
    the number of cells that are met often: a row for each run reaches the driver, with RUN / 8 bytes, and CELLS / 8 bytes go out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int32)
        seen: set[int] = set()
        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), size):
                if len(s) and (p := fingerprint(s)) not in seen:
                    seen.add(p)
                    n[(s & np.uint64(CELLS - 1)).astype(np.int64)] += 1
            if len(seen) > 1 << 18:
                seen.clear()
        for run in range(CELLS // RUN):
            mine = n[run * RUN : (run + 1) * RUN]
            if len(often := np.flatnonzero(mine >= 4)):
                yield pa.record_batch([pa.array([run]), pa.array([often.astype(np.int32).tobytes()], pa.binary()), pa.array([mine[often].tobytes()], pa.binary())], ["run", "cells", "counts"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        n = np.zeros(RUN, np.int64)
        for cells, counts in zip(group.column("cells"), group.column("counts"), strict=True):
            n[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(counts.as_buffer(), np.int32)
        n[n < WIDESPREAD] = 0
        return pa.table({"run": [key[0].as_py()], "n": [int(n.sum())], "counts": pa.array([n.tobytes()], pa.binary())})

    counted = docs.select(text_col).mapInArrow(count, "run long, cells binary, counts binary").groupBy("run").applyInArrow(add, "run long, n long, counts binary")
    counted = scratch.write(counted, "cells")
    often = counted.agg(F.sum("n")).first()[0] or 0
    least = WIDESPREAD + 4 * often // CELLS

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = np.frombuffer(blob.as_buffer(), np.int64)
                hot = n >= least
                yield pa.record_batch([pa.array([run]), pa.array([np.packbits(hot).tobytes()], pa.binary()), pa.array([float((n[~hot].astype(np.float64) ** 2).sum())])], ["run", "hot", "squares"])

    out, squares = np.zeros((CELLS // RUN, RUN // 8), np.uint8), 0.0
    for r in counted.select("run", "counts").mapInArrow(judge, "run long, hot binary, squares double").collect():
        out[r.run] = np.frombuffer(r.hot, np.uint8)
        squares += r.squares
    # other cells hold a share of the rest of the shingles each, or what was counted
    rest = max(0, shingles - often)
    met = rest * max(1.0, rest / CELLS) + squares
    return out.ravel(), met / max(1, shingles) / max(1, sets)


def _signatures(docs: DataFrame, text_col: str, size: int, ranges: Ranges, buckets: int, widespread: np.ndarray) -> DataFrame:
    """bucket, blob: pairs (signature, fingerprint), each set once a partition."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, prints, n = [], [], 0
        hot = np.unpackbits(widespread).astype(bool)

        def flush():
            s, f = np.concatenate(sigs), np.repeat(np.array([p for p, _ in prints], np.int64), [k for _, k in prints])
            b = ((s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            pairs = np.stack([s.view(np.int64), f], 1)[order]
            full = np.flatnonzero(np.diff(cut))
            return pa.record_batch([pa.array(full), pa.array([pairs[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), size):
                if len(s) and (p := fingerprint(s)) not in seen:
                    seen.add(p)
                    sigs.append(ranges.signatures(s, ~hot[(s & np.uint64(CELLS - 1)).astype(np.int64)]))
                    prints.append((p, len(sigs[-1])))
                    n += len(sigs[-1])
                    if n > 1 << 20:
                        yield flush()
                        sigs, prints, n = [], [], 0
            if len(seen) > 1 << 18:
                seen.clear()
        if n:
            yield flush()

    return docs.select(text_col).mapInArrow(emit, "bucket long, blob binary")


def _chains(blobs: DataFrame) -> DataFrame:
    """a, b: each list's members chained to the smallest."""

    def chain(key: tuple, group: pa.Table) -> pa.Table:
        pairs = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group.column("blob")]).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        start = np.flatnonzero(np.diff(pairs[:, 0], prepend=~pairs[:1, 0]))
        low = np.repeat(np.minimum.reduceat(pairs[:, 1], start), np.diff([*start, len(pairs)]))
        edges = np.unique(np.stack([low, pairs[:, 1]], 1)[low != pairs[:, 1]], axis=0)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return blobs.groupBy("bucket").applyInArrow(chain, "a long, b long").distinct()


def _filter_words(nodes: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter of node fingerprints as 64-bit words; at most FILTER_BITS / 8 bytes, and their places, reach the driver,
    a row for each batch."""
    bit = F.col("node").bitwiseAND(FILTER_BITS - 1)
    words = nodes.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(node & 63 as int))").alias("bits")).groupBy("w").agg(F.bit_or("bits").alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for k in (0, 1)], ["w", "bits"])

    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.mapInArrow(pack, "w binary, bits binary").collect():
        out[np.frombuffer(r.w, np.int64)] = np.frombuffer(r.bits, np.int64)
    return out


def _sets(docs: DataFrame, text_col: str, size: int, words: np.ndarray) -> DataFrame:
    """node, shingles of documents that pass the filter."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, blobs, n = [], [], 0
            for s in shingle_sets(batch.column(0).to_pylist(), size):
                if not len(s) or (p := fingerprint(s)) in seen:
                    continue
                bit = p & (FILTER_BITS - 1)
                if int(words[bit >> 6]) >> (p & 63) & 1:
                    seen.add(p)
                    nodes.append(p), blobs.append(s.tobytes())
                    n += s.nbytes
                if n > 8 << 20:
                    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])
                    nodes, blobs, n = [], [], 0
            if len(seen) > 1 << 18:
                seen.clear()
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])

    return docs.select(text_col).mapInArrow(emit, "node long, shingles binary")


def overlaps(sets: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Intersection sizes of all pairs, by products of dense slices of the incidence matrix."""
    g = len(sets)
    tokens, row = np.concatenate(sets), np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    new = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
    n = np.diff([*new, len(tokens)])
    column = np.repeat(np.where(n > 1, np.cumsum(n > 1) - 1, -1), n)
    row, column = row[column >= 0], column[column >= 0]
    out = np.zeros((g, g), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        m = np.zeros((g, columns), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    n = np.array([len(s) for s in sets], np.int64)
    inter = overlaps(sets)
    return inter * den >= num * (n[:, None] + n[None, :] - inter)


def _compare(num: int, den: int):
    """From rows (cluster, bi, bj, node, block, copies, shingles) in task order: a, b links of a spanning forest; and a, null, links."""

    def task(nodes, blocks, copies, sets) -> tuple[list, list, list]:
        own: dict[int, int] = {}
        for k, x in enumerate(nodes):
            own.setdefault(x, k)
        keep = list(own.values())
        nodes, blocks, copies = np.array(nodes, np.int64)[keep], np.array(blocks)[keep], np.array(copies, np.int64)[keep]
        ok = _linked([sets[k] for k in keep], num, den)
        ok &= ~np.eye(len(keep), dtype=bool)
        if blocks.min() != blocks.max():  # pairs within a block have a task of their own
            ok &= blocks[:, None] != blocks[None, :]
        links = ok @ copies
        root = np.arange(len(keep))
        a_out, b_out = [], []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(np.triu(ok)), strict=True):
            if (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
                a_out.append(int(nodes[i])), b_out.append(int(nodes[j]))
        some = np.flatnonzero(links)
        return a_out + nodes[some].tolist(), b_out + [None] * len(some), [None] * len(b_out) + links[some].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        out: tuple[list, list, list] = ([], [], [])

        def done():
            if len(held[0]) > 1:
                for to, x in zip(out, task(*held), strict=True):
                    to.extend(x)

        def batch_of():
            b = pa.record_batch([pa.array(x, pa.int64()) for x in out], ["a", "b", "links"])
            for x in out:
                x.clear()
            return b

        for b in batches:
            c, bi, bj, node, block, copies = (b.column(k).to_pylist() for k in range(6))
            for k, blob in enumerate(b.column(6)):
                if (c[k], bi[k], bj[k]) != key:
                    done()
                    key, held = (c[k], bi[k], bj[k]), ([], [], [], [])
                for to, x in zip(held, (node[k], block[k], copies[k], np.frombuffer(blob.as_buffer(), np.uint64).copy()), strict=True):
                    to.append(x)
            yield batch_of()
        done()
        yield batch_of()

    return run


def _measure(size: int):
    """A function of texts: n, the number of shingles, and node, the fingerprint of their set."""

    @F.arrow_udf("n long, node long")
    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            got = [(len(s), fingerprint(s) if len(s) else None) for s in shingle_sets(batch.to_pylist(), size)]
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["n", "node"])

    return measure


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100, block_sets: int = BLOCK_SETS, by_row: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links, itself included) and n_links.

    Two documents link when den * |intersection| >= num * |union|. Words are runs without the six ASCII blanks, A-Z
    lower-cased. A null text, or one without words, has no shingles and no links. Equal texts link. Repeated rows stay
    repeated rows; a null id is never a component's name unless all its ids are null. An empty table gives no rows;
    other columns of the input aren't carried. With by_row, node (the set's fingerprint) and root (its component's node,
    whatever the ids) come too, null where there are no shingles.
    """
    spark = session(docs)
    scratch = Scratch(spark, "similarity")
    measured = docs.select(F.col(id_col), _measure(size)(text_col).alias("m")).select(id_col, "m.n", "m.node")
    thin = scratch.write(measured, "sizes", docs.count(), costly=True)
    classes = thin.where("n > 0").groupBy("node").agg(F.min(id_col).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = scratch.write(classes, "classes", thin.count())
    histogram = {r.n: r["c"] for r in classes.groupBy("n").agg(F.count("*").alias("c")).collect()}
    kinds, total = sum(histogram.values()), sum(n * c for n, c in histogram.items())
    widespread, meet = _widespread(docs, text_col, size, kinds, total, scratch)
    ranges = Ranges(num, den, histogram, meet)
    buckets = max(shuffle_width(spark), total // (1 << 21))
    chains = scratch.write(_chains(_signatures(docs, text_col, size, ranges, buckets, widespread)), "chains", 8 * kinds)
    clusters = scratch.write(components(chains, scratch), "clusters", kinds)
    found = _sets(docs, text_col, size, _filter_words(clusters))
    sizes = clusters.join(classes, "node").groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("sets") / block_sets), F.ceil(F.col("total") / BLOCK_SHINGLES))
    members = clusters.join(sizes, "root").join(classes, "node").select("node", "root", "copies", blocks.cast("int").alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "node", "block", "copies",
    )
    once = found.join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    work = tasks.join(once, "node").select("root", "bi", "bj", "node", "block", "copies", "shingles")
    work = work.repartition(shuffle_width(spark), "root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    links = scratch.write(work.mapInArrow(_compare(num, den), "a long, b long, links long"), "links", 2 * kinds, costly=True)
    edges = links.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = components(edges, scratch)
    degree = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = joined.join(least, "root").join(degree, "node", "left")
    of_class = of_class.select("node", "root", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of_class = scratch.write(of_class, "of-class", kinds)
    scratch.keep_only(thin, of_class)
    return thin.join(of_class, "node", "left").select(
        id_col, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        *(("node", "root") if by_row else ()),
    )


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row of docs for each component: its smallest id, which a null is not, unless all are null.

    With repeated or null ids that takes groups by row, of the same text_col and size: rows are then told apart by their
    sets, rows of one id and one set by a hash, and rows without words all stay. Of groups that aren't by row, one row
    of a repeated id stays, and all rows with a null id.
    """
    unique = groups.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty()
    if "root" in groups.columns and not unique:
        return _keep_rows(docs, groups, id_col, text_col, size)
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(id_col)
    out = docs.join(kept, id_col, "left_semi")
    if unique:
        return out
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns])))).where("_n = 1").drop("_n")
    return out.unionByName(docs.where(F.col(id_col).isNull()))


def _keep_rows(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """keep_one for any ids; rows of one id and one set are aggregated, so that many of them don't meet in one task."""
    own = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "node")
    first = groups.where("root is not null").groupBy("root").agg(F.min(own).alias("f")).select(F.col("f.id").alias("_id"), F.col("f.node").alias("_first"))
    rows = docs.withColumn("_node", _measure(size)(text_col)["node"])
    kept = rows.join(first, rows["_node"].eqNullSafe(first["_first"]) & rows[id_col].eqNullSafe(first["_id"]), "left").where("_node is null or _first is not null")
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    alone = F.when(F.col("_node").isNull(), F.monotonically_increasing_id())
    one = kept.groupBy("_node", id_col, alone.alias("_alone")).agg(F.min_by(row, F.xxhash64(*[f"`{c}`" for c in docs.columns])).alias("_row"))
    return one.select("_row.*")


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


# The query as SQL: all pairs of documents that share a shingle, and the closure of their links.
_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS component_id,
  (SELECT count(*) FROM link WHERE a = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLES = {"op3_ngram_jaccard": _SQL}

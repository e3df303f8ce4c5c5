"""Removal of every byte under a string of 400 bytes that also starts elsewhere, by suffix sorting of shards.

1. Anchors. Every window of 400 bytes has as its anchor the first smallest of the hashes of its substrings of 64 bytes;
   consecutive windows with the same anchor position form a segment. Equal windows have equal anchors, so only segments
   with a repeated anchor matter, and a segment that occurs twice as a whole is repeated throughout.
2. Suffix sorting. Of the rest, distinct segments with the same anchor meet in a shard, whose text is sorted by external
   induced sorting with common-prefix lengths; neighbours that share 400 bytes mark repeated windows.
3. An anchor with very many distinct segments (a passage in a large part of all documents) doesn't fit a shard. The
   windows of its segments are counted by hash instead, each block of segments summing up its own first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, mix, powers, prefix_hash, session, shuffle_width, table, without
from .scoring import cuts, grow, shrink
from .suffixes import repeated_starts

LENGTH, GRAM = 400, 64
#: Bytes of segments in a shard, and distinct segments of one anchor from which its windows are counted by hash.
SHARD_BYTES, MANY = 1 << 19, 600
FILTER_BITS = 1 << 23
#: Texts that a task holds outside Arrow's buffers at a time.
SLICE = 256
_POSITION = np.uint64((1 << 24) - 1)


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i:i+width] for every i."""
    n = len(x)
    blocks = np.full((-(-n // width) + 1) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """text number, anchor, hash of the segment's bytes, first window, windows: one row per segment, texts in runs."""
    i = 0
    while i < len(texts):
        parts, size, first = [], 0, i
        while i < len(texts) and (not parts or size + len(texts[i]) < CHUNK_BYTES):
            parts.append(texts[i])
            size += len(texts[i])
            i += 1
        data = np.frombuffer(b"".join(parts), np.uint8)
        if len(data) < length:
            continue
        at = np.cumsum([0, *map(len, parts)])
        s = prefix_hash(data)
        grams = mix((s[gram:] - s[:-gram]) * powers(len(data))[1][: len(data) - gram + 1])
        width = length - gram + 1
        place = np.arange(len(grams), dtype=np.uint64)
        # a window never sees beyond itself, so substrings that cross into the next text only matter for windows that do too
        wrap = np.uint64(max(1, len(grams) >> 24)) if len(grams) >> 24 else None
        if wrap is None:
            least = smallest((grams & ~_POSITION) | place, width)[: len(data) - length + 1]
            anchor_at = (least & _POSITION).astype(np.int64)
        else:
            anchor_at = _leftmost(grams, width)[: len(data) - length + 1]
        start = np.arange(len(data) - length + 1)
        doc = np.searchsorted(at, start, "right") - 1
        fits = start + length <= at[doc + 1]
        start, doc, anchor_at = start[fits], doc[fits], anchor_at[fits]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (anchor_at[1:] != anchor_at[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(start)))
        lo = start[head]
        hi = lo + n - 1 + length
        whole = mix((s[hi] - s[lo]) * powers(len(data))[1][lo] + n.astype(np.uint64))
        yield first + doc[head], grams[anchor_at[head]].view(np.int64), whole.view(np.int64), lo - at[doc[head]], n


def _leftmost(grams: np.ndarray, width: int) -> np.ndarray:
    """Where the first least coarse hash of each window stands, for texts too long to pack a position beside the hash."""
    out = []
    step = 1 << 22
    for lo in range(0, len(grams), step):
        g = grams[lo : lo + step + width]
        packed = (g & ~_POSITION) | np.arange(len(g), dtype=np.uint64)
        out.append((smallest(packed, width)[:step] & _POSITION).astype(np.int64) + lo)
    return np.concatenate(out)[: len(grams)]


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """text (its hash), anchor, whole, start, n of all segments; of equal texts in a partition, two speak for all."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            names, keep = b.column(0).to_pylist(), []
            for k, x in enumerate(names):
                if seen.get(x, 0) < 2:
                    seen[x] = seen.get(x, 0) + 1
                    keep.append(k)
            if len(seen) > 1 << 18:
                seen.clear()
            for part in (keep[i : i + SLICE] for i in range(0, len(keep), SLICE)):
                own = np.array([names[k] for k in part], np.int64)
                for doc, anchor, whole, start, n in segments(_encoded(b.column(1).take(pa.array(part))), length, gram):
                    yield pa.record_batch([pa.array(own[doc]), pa.array(anchor), pa.array(whole), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["text", "anchor", "whole", "start", "n"])

    return docs.where(F.octet_length("_text") >= length).select("_name", "_text").mapInArrow(emit, "text long, anchor long, whole long, start int, n int")


def _bits(df: DataFrame, column: str) -> np.ndarray:
    """A one-hash filter of a column of hashes; at most FILTER_BITS / 64 numbers reach the driver."""
    bit = F.col(column).bitwiseAND(FILTER_BITS - 1)
    got = df.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got.w.to_numpy(np.int64)] = got.b.to_numpy(np.int64)
    return out


def _maybe(words: np.ndarray):
    @F.arrow_udf("boolean")
    def maybe(column: pa.Array) -> pa.Array:
        x = column.to_numpy(zero_copy_only=False).astype(np.int64)
        bit = x & (FILTER_BITS - 1)
        return pa.array((words[bit >> 6] >> (x & 63)) & 1 == 1)

    return maybe


def _cut_out(docs: DataFrame, wanted: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """wanted (text, anchor, n_rows, many, start, n) with the bytes of each segment; one copy of each text is moved."""
    needs = _maybe(_bits(wanted.select("text").distinct(), "text"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keep = []
            for k, x in enumerate(b.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    keep.append(k)
            if len(seen) > 1 << 18:
                seen.clear()
            yield b.take(pa.array(keep, pa.int64()))

    texts = docs.where(F.octet_length("_text") >= length).where(needs("_name")).select("_name", "_text").mapInArrow(once, "_name long, _text string")
    of_text = wanted.groupBy("text").agg(F.collect_list(F.struct("anchor", "n_rows", "many", "start", "n")).alias("wanted"))
    joined = texts.join(of_text, texts["_name"] == of_text["text"]).select("text", "_text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, SLICE) for x in batches for i in range(0, len(x), SLICE)):
            rows = []
            for name, t, wanted in zip(b.column(0).to_pylist(), _encoded(b.column(1)), b.column(2).to_pylist(), strict=True):
                rows += [(name, w["anchor"], w["n_rows"], w["many"], w["start"], t[w["start"] : w["start"] + w["n"] - 1 + length]) for w in wanted]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            names = ["text", "anchor", "n_rows", "many", "start", "bytes"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)

    return scratch.write(joined.mapInArrow(cut, "text long, anchor long, n_rows long, many boolean, start int, bytes binary"), "segments")


_FOUND = "text long, start int, end int"


def _runs(mark: np.ndarray, length: int) -> np.ndarray:
    """Byte runs under marked window starts: rows of first and end."""
    edge = np.flatnonzero(np.diff(mark, prepend=False, append=False)).reshape(-1, 2)
    return edge + [0, length - 1]


def _found(rows: list[tuple[int, np.ndarray]]) -> pa.Table:
    text = np.concatenate([np.full(len(r), t, np.int64) for t, r in rows]) if rows else np.zeros(0, np.int64)
    runs = np.concatenate([r for _, r in rows]).astype(np.int32) if rows else np.zeros((0, 2), np.int32)
    return pa.table({"text": text, "start": runs[:, 0], "end": runs[:, 1]})


def _sort_shard(length: int):
    def sort(key: tuple, shard: pa.Table) -> pa.Table:
        blobs = [x.as_buffer().to_pybytes() for x in shard.column("bytes")]
        data = np.frombuffer(b"\0".join([*blobs, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
        at = np.cumsum([0, *(len(b) + 1 for b in blobs)])
        data[at[1:] - 1] = 0
        mark = repeated_starts(data, length)
        rows = []
        for k, (text, n, start) in enumerate(zip(*(shard.column(c).to_pylist() for c in ("text", "n_rows", "start")), strict=True)):
            if n == 1 and (mine := mark[at[k] : at[k + 1] - 1]).any():
                rows.append((text, _runs(mine, length) + start))
        return _found(rows)

    return sort


def _windows(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of some segments, and where each segment's begin."""
    out, at = [], [0]
    for b in blobs:
        s = prefix_hash(np.frombuffer(b, np.uint8))
        n = len(b) - length + 1
        out.append(mix((s[length:] - s[:-length]) * powers(len(b))[1][:n]))
        at.append(at[-1] + n)
    return np.concatenate(out), np.array(at)


def _ask(length: int, ranges: int):
    def ask(key: tuple, block: pa.Table) -> pa.Table:
        hashes, at = _windows([x.as_buffer().to_pybytes() for x in block.column("bytes")], length)
        keys, back = np.unique(hashes, return_inverse=True)
        weight = np.repeat(np.minimum(block.column("n_rows").to_numpy(), 2), np.diff(at))
        n = np.minimum(np.bincount(back, weights=weight), 2).astype(np.int64)
        cut = [0, *cuts(keys, 64, ranges), len(keys)]
        rows = [(key[0].as_py(), r, shrink(np.diff(keys[a:b], prepend=np.uint64(0))), shrink(n[a:b])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pa.table({c: pa.array(x, t) for c, t, x in zip(("block", "range", "keys", "counts"), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), zip(*rows, strict=True), strict=True)})

    return ask


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    keys = [np.cumsum(grow(x.as_buffer().to_pybytes())) for x in asked.column("keys")]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([grow(x.as_buffer().to_pybytes()) for x in asked.column("counts")]), minlength=len(distinct))
    mine = np.split((total >= 2)[back], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"block": asked.column("block").cast(pa.int64()), "range": asked.column("range").cast(pa.int32()), "twice": pa.array([np.packbits(m).tobytes() for m in mine], pa.binary()), "n": pa.array([len(m) for m in mine], pa.int64())})


def _take(length: int):
    def take(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block):
            return _found([])
        hashes, at = _windows([x.as_buffer().to_pybytes() for x in block.column("bytes")], length)
        keys, back = np.unique(hashes, return_inverse=True)
        said = sorted(zip(answers.column("range").to_pylist(), answers.column("twice").to_pylist(), answers.column("n").to_pylist(), strict=True))
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for _, t, n in said]).astype(bool)[back]
        rows = []
        for k, (text, n, start) in enumerate(zip(*(block.column(c).to_pylist() for c in ("text", "n_rows", "start")), strict=True)):
            if n == 1 and (mine := twice[at[k] : at[k + 1]]).any():
                rows.append((text, _runs(mine, length) + start))
        return _found(rows)

    return take


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, many: int = MANY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """text (hash), start, end of repeated bytes, not merged; docs has _name (hash of the text) and _text."""
    spark = docs.sparkSession
    anchors = scratch.hold(_anchors(docs, length, gram))
    twice = anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    likely = scratch.hold(anchors.where(_maybe(_bits(twice, "anchor"))("anchor")))
    whole = likely.groupBy("anchor", "whole").agg(F.count("*").alias("n_rows"), F.min(F.struct("text", "start", "n")).alias("one"))
    whole = scratch.hold(whole)
    by_anchor = whole.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = whole.join(by_anchor, "anchor").select("one.text", "anchor", "n_rows", (F.col("kinds") > many).alias("many"), "one.start", "one.n")
    pieces = _cut_out(docs, scratch.hold(wanted), scratch, length)
    full = likely.join(whole.where("n_rows > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi")
    found = full.select("text", "start", (F.col("start") + F.col("n") - 1 + length).cast("int").alias("end"))
    size = pieces.groupBy("many").agg(F.sum(F.octet_length("bytes")).alias("b"), F.count("*").alias("c")).collect()
    size = {r.many: (r.b, r.c) for r in size}
    if False in size:
        shards = max(shuffle_width(spark), -(-size[False][0] // shard_bytes))
        shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
        sorted_ = pieces.where("not many").select(shard, "text", "n_rows", "start", "bytes").groupBy("shard").applyInArrow(_sort_shard(length), _FOUND)
        found = found.unionByName(sorted_)
    if True in size:
        blocks = max(shuffle_width(spark), -(-size[True][0] // (2 * shard_bytes)))
        ranges = max(shuffle_width(spark) // 2, -(-size[True][1] * length // (1 << 20)), 1)
        hot = pieces.where("many").select(F.pmod(F.xxhash64("text", "start", "anchor"), F.lit(blocks)).alias("block"), "text", "n_rows", "start", "bytes")
        asked = hot.groupBy("block").applyInArrow(_ask(length, ranges), "block long, range int, keys binary, counts binary")
        answers = asked.groupBy("range").applyInArrow(_answer, "block long, range int, twice binary, n long")
        found = found.unionByName(hot.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_take(length), _FOUND))
    return found


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, many: int = MANY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_bytes, removed (maximal runs of removed bytes, start and end) and kept (the remaining bytes).

    A byte goes if a string of length bytes over it also starts elsewhere, in the same text or another; matches are
    judged on the input and never cross texts. A null text counts as empty. Texts shorter than length stay whole.
    Equal rows count as different documents. Input columns of the same names are replaced. Texts are told apart by 64-bit hashes.
    """
    spark = session(docs)
    scratch = Scratch(spark, "repeats")
    own = ("n_bytes", "removed", "kept", "_name", "_text", "_spans")
    named = without(docs, *own).withColumns({"_text": F.coalesce(F.col(text_col), F.lit("")), "_name": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    found = repeated_spans(named.select("_name", "_text"), scratch, length, gram, many, shard_bytes)
    spans = found.groupBy("text").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    spans = scratch.write(spans, "spans", named.count(), costly=True)
    scratch.keep_only(spans)
    scratch.release()
    hit = _maybe(_bits(spans, "text"))
    run = "array<struct<start:int,end:int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(f"n_bytes long, removed {run}, kept binary")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        size, removed, kept = [], [], []
        for t, s in zip(texts, spans, strict=True):
            t, runs = (t.as_py() or "").encode("utf-8", "surrogatepass"), []
            for x in s.as_py() or ():
                if runs and x["start"] <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], x["end"])
                else:
                    runs.append(x)
            edges = [0, *(e for r in runs for e in (r["start"], r["end"])), len(t)]
            size.append(len(t)), removed.append(runs), kept.append(b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["n_bytes", "removed", "kept"])

    named = named.withColumn("_hit", hit("_name"))
    clean = named.where("not _hit").withColumn("_spans", F.lit(None).cast(run))
    other = named.where("_hit").join(spans.withColumnRenamed("text", "_spans_of"), F.col("_name") == F.col("_spans_of"), "left").drop("_spans_of")
    out = clean.unionByName(other).withColumn("_cut", cut("_text", "_spans"))
    return out.select(*[f"`{c}`" for c in without(docs, *own).columns], "_cut.*")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """kept_text is null where a removal cut a character in two."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"),
        F.try_validate_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


def _doubled(n: int) -> str:
    """Ranks of the strings of 2 n bytes from those of n, by document and place; 0 stands for what is beyond the end."""
    pairs = f"SELECT doc_id, i, r, coalesce(lead(r, {n}) OVER (PARTITION BY doc_id ORDER BY i), 0) AS q FROM b{n}"
    return f"b{2 * n} AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (ORDER BY r, q) AS r FROM ({pairs}))"


# The query as SQL, by doubling: a string of 400 bytes is one of 256 and another that begins 144 bytes later.
_SQL = f"""
WITH b1 AS MATERIALIZED (SELECT doc_id, i, CAST('0x' || h[i] AS INT) + 1 AS r FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents))),
{", ".join(_doubled(n) for n in (1, 2, 4, 8, 16, 32, 64, 128))},
w AS (SELECT b256.doc_id, b256.i, b256.r AS x, lead(b256.r, 144) OVER (PARTITION BY b256.doc_id ORDER BY b256.i) AS y, max(b256.i) OVER (PARTITION BY b256.doc_id) AS n FROM b256),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x, y) AS c FROM w WHERE i + 399 <= n) WHERE c > 1),
gone AS (SELECT doc_id, i, max(t) OVER (PARTITION BY doc_id ORDER BY i) >= i - 399 AS cut FROM (SELECT b1.doc_id, b1.i, twice.i AS t FROM b1 LEFT JOIN twice USING (doc_id, i))),
flagged AS (SELECT doc_id, i, coalesce(cut, false) AS cut, lag(coalesce(cut, false), 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS before, r FROM gone JOIN b1 USING (doc_id, i)),
out AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE cut AND NOT before) AS n_spans, unhex(coalesce(string_agg(printf('%02X', r - 1), '' ORDER BY i) FILTER (WHERE NOT cut), '')) AS kept FROM flagged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, encode(''))) AS kept_sha256, coalesce(n_bytes - n_removed, 0) AS n_kept, TRY(decode(coalesce(kept, encode('')))) AS kept_text
FROM documents d LEFT JOIN out USING (doc_id)
"""

QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLES = {"op9_suffix_dedup": _SQL}

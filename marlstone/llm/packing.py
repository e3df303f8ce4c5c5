"""Best-fit decreasing packing of token sequences into windows of fixed capacity.

Texts are cut into full windows and one rest. Rests of equal length are interchangeable, so the packing is done on the
histogram of lengths: lengths go from long to short, and a segment tree over remaining capacities finds the tightest
open windows with room; runs of equal windows are filled together. The plan is a short list of runs; each
piece finds its place from its rank among the pieces of its length, which is counted in salted groups.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, session, table

CAPACITY = 2048
END = 1
#: Distinct chunks of text whose ids a worker remembers, at most.
REMEMBERED = 200_000
_CUT = re.compile(r" (?=\S)")
_RUN = re.compile(r" (?!\S)")


class OpenWindows:
    """Counts of windows by remaining capacity under a segment tree, each capacity with its runs of window ids."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # first window, windows, used

    def _add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def push(self, room: int, first: int, n: int, used: int) -> None:
        if room > 0:
            self.runs[room].append((first, n, used))
            self._add(room, n)

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least need that a window has."""
        k = need + self.leaves
        if self.count[k]:
            return need
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None

    def take(self, room: int, most: int) -> tuple[int, int, int]:
        first, n, used = self.runs[room].pop()
        if n > most:
            self.runs[room].append((first + most, n - most, used))
            n = most
        self._add(room, -n)
        return first, n, used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first window, offset) that place all pieces of each length up to the capacity."""
    open_, windows, out = OpenWindows(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = open_.tightest(length)
            if room is None:
                each = capacity // length  # equal pieces fill new windows side by side, which is what best fit does with them
                full, rest = divmod(left, each)
                for i in range(each if full else 0):
                    out.append((length, rank, full, windows, i * length))
                    rank += full
                open_.push(capacity - each * length, windows, full, each * length)
                windows += full
                for i in range(rest):
                    out.append((length, rank, 1, windows, i * length))
                    rank += 1
                if rest:
                    open_.push(capacity - rest * length, windows, 1, rest * length)
                    windows += 1
                left = 0
            else:
                first, n, used = open_.take(room, left)
                out.append((length, rank, n, first, used))
                open_.push(room - length, first, n, used + length)
                rank, left = rank + n, left - n
    return out


def byte_ranks(public) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer as byte strings with their ids."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    added = public.get_added_tokens_decoder()
    return {bytes(byte_of[c] for c in token): i for token, i in public.get_vocab(with_added_tokens=False).items() if i not in added}


#: Letters that every Unicode table of the last decades knows alike; chunks with others are left to the tokenizer.
SETTLED = "\u0370"


def merge_core(public, path: str):
    """A faster encoder over the same vocabulary, or None where the file doesn't prove that it gives the same ids.

    The core joins the neighbours whose union has the least id; the tokenizer applies the first rule of its list that fits.
    That is the same if ids ascend along the list and every token is what its own text is encoded to: a run of bytes is
    encoded by itself as it is within a longer one until a rule crosses its border, so two neighbours whose union
    is a token can only be the pair that the token's rule joins.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or made.get("normalizer") or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    ids = model["vocab"]
    joined = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(joined, joined[1:], strict=False)) or any(len(public.model.tokenize(t)) != 1 for t in ids):
        return None
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(public), special_tokens={})


class Tokenizer:
    """Ids of whole texts by a byte-level vocabulary file.

    Chunks between blanks are encoded once and remembered; the vocabulary's split never joins them. A chunk of settled
    letters that isn't remembered goes through the merge core, which is several times as fast as the full tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer as Public

        self.public = Public.from_file(path)
        self.marks = [t.content for t in self.public.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.remembered = remembered
        self.core = merge_core(self.public, path)

    def _whole(self, text: str) -> bytes:
        return np.array(self.public.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _one(self, chunk: str, blank: str = " ") -> bytes:
        """Ids of a chunk after the blank that goes before it, which a text's first chunk has not."""
        if self.core is None or not chunk.isascii() and max(chunk) >= SETTLED:
            return self._whole(blank + chunk)
        if blank and chunk.isalpha():
            return array("I", self.core._core_bpe.encode_single_piece(b" " + chunk.encode())).tobytes()
        return array("I", self.core.encode_ordinary(blank + chunk)).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        for i, t in enumerate(texts):
            if any(m in t for m in self.marks):
                out[i] = np.frombuffer(self._whole(t), np.uint32)
                continue
            first, *chunks = chunked(t)
            if len(self.known) > self.remembered:
                self.known = {}
            known = self.known
            fresh = [*set(chunks).difference(known)]
            known.update(zip(fresh, map(self._one, fresh), strict=True))
            out[i] = np.frombuffer(b"".join([self._one(first, "") if first else b"", *map(known.__getitem__, chunks)]), np.uint32)
        return out


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for all tasks of a worker."""
    return Tokenizer(path)


def chunked(text: str) -> list[str]:
    """The text cut before each blank that precedes a visible character: places where the byte-level split always cuts.

    The blank that starts every chunk but the first is left out; the first chunk is what stands before all of them.
    """
    return text.split(" ") if not _RUN.search(text) else _CUT.split(text)


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens (and the ids).

    A null or empty text is its end mark alone; a very long one is read whole by one task; equal rows give equal rows each; an
    empty table gives none; other columns aren't carried, whatever their names.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                run, n = [], 0
                while at + len(run) < len(texts) and n < 1 << 20:
                    run.append(texts[at + len(run)] or "")
                    n += len(run[-1])
                who, start, length, crc, total, pieces = [], [], [], [], [], []
                for k, got in enumerate(tok.encode(run)):
                    t = np.append(got, np.uint32(end)).astype("<u4")
                    for s in range(0, len(t), capacity):
                        p = t[s : s + capacity]
                        who.append(at + k), start.append(s), length.append(len(p)), total.append(len(t))
                        crc.append(zlib.crc32(p.tobytes()))
                        if with_ids:
                            pieces.append(p.astype(np.int32))
                at += len(run)
                yield pa.record_batch([ids.take(pa.array(who)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), *([pa.array(pieces, pa.list_(pa.int32()))] if with_ids else [])], names)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = True, group_rows: int = 2_000, most_groups: int = 1 << 17) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids unless with_ids is off.

    A null or empty text is its end mark alone; a very long text is cut into as many full windows as it fills. Equal rows are
    packed as separate pieces; an empty table gives no rows; other input columns aren't carried, whatever their names. The driver sees counts by length and, for lengths with more than group_rows
    pieces, by salt: at most capacity + most_groups numbers.
    """
    spark = session(docs)
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(tokenized(docs, id_col, text_col, tokenizer_path, capacity, end, with_ids), "pieces")
    histogram = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    per_group = max(group_rows, -(-total // most_groups))
    salts = {length: -(-n // per_group) for length, n in histogram.items() if n > per_group}
    n_salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]), F.col("length")), F.lit(1)) if salts else F.lit(1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), n_salts).cast("int"))
    base, seen = {}, dict.fromkeys(histogram, 0)
    if salts:
        for r in salted.where(F.col("length").isin([*salts])).groupBy("length", "_salt").agg(F.count("*").alias("n")).orderBy("length", "_salt").collect():
            base[r.length, r["_salt"]] = seen[r.length]
            seen[r.length] += r["n"]
    runs: dict[int, tuple] = {}
    for length, *rest in plan(histogram, capacity):
        runs.setdefault(length, []).append(rest)
    runs = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, salt: pa.Array, rank: pa.Array) -> pa.Array:
        n, s = length.to_numpy(), salt.to_numpy()
        r = rank.to_numpy() - 1 + np.array([base.get(x, 0) for x in zip(n.tolist(), s.tolist(), strict=True)], np.int64)
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            mine = n == x
            first, _, window, used = runs[int(x)]
            k = np.searchsorted(first, r[mine], "right") - 1
            seq[mine], off[mine] = window[k] + r[mine] - first[k], used[k]
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    order = Window.partitionBy("length", "_salt").orderBy(id_col, "start", "ids_crc32")
    out = salted.withColumn("_rank", F.row_number().over(order).cast("long")).withColumn("_at", place("length", "_salt", "_rank"))
    return out.select(*pieces.columns, "_at.*")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


QUERIES = {"op8_packing": op8_packing}

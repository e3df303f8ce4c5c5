"""Benchmark decontamination as a prefix-filtered set join between benchmark windows and documents.

A window (13 consecutive item words, or a whole shorter item) is a set of word shingles and a document contains it only
if it contains all of them, so one shingle is a sufficient prefix: the rarest by its count over all documents. Documents
are joined on those shingles alone; an occurrence then gives a candidate start, which must leave room for the window
on both sides (positional and length bound), and is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, combine, free_name, hash_words, session, table, without

#: UTF-8 bytes of benchmark text that are made into windows at a time; a larger benchmark takes more counts of shingles.
BLOCK_BYTES = 2 << 20
SHINGLE = 3
OWN = ("n_words", "n_hit", "hits", "items")
_RESULT = "n_words long, n_hit long, hits array<struct<start:int,end:int>>, items array<string>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


class Keys:
    """A sorted set of hashes; a bit table in front answers most lookups."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.sorted & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes of members, and which members they are."""
        at = np.flatnonzero(self.mask[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        k = np.searchsorted(self.sorted, hashes[at])
        hit = (k < len(self.sorted)) & (self.sorted[np.minimum(k, len(self.sorted) - 1)] == hashes[at]) if len(self.sorted) else np.zeros(len(at), bool)
        return at[hit], k[hit]


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(hashes) - size + 1)
    return combine(*[hashes[i : i + n] for i in range(size)])


class Block:
    """The distinct windows of some items, by length, and the items that each belongs to."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        found: dict[tuple, set] = {}
        for words in hash_words(texts, NOT_ALNUM):
            for k in range(len(words)):
                h = words.hashes[words.bounds[k] : words.bounds[k + 1]]
                for i in range(max(1, len(h) - window + 1) if len(h) else 0):
                    found.setdefault(tuple(h[i : i + window].tolist()), set()).add(ids[words.first + k])
        self.windows = sorted(found)
        self.items = [sorted(x for x in found[w] if x is not None) for w in self.windows]
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.words = np.zeros((len(self.windows), window), np.uint64)
        for i, w in enumerate(self.windows):
            self.words[i, : len(w)] = w
        of_size: dict[int, list] = {}
        for i, w in enumerate(self.windows):
            s = min(SHINGLE, len(w))
            of_size.setdefault(s, []).append(i)
        self.sizes = {s: np.array(v) for s, v in of_size.items()}
        self.parts = {s: [shingles(self.words[i, : self.size[i]], s) for i in v] for s, v in of_size.items()}

    def keys(self) -> dict[int, Keys]:
        return {s: Keys(np.concatenate(p)) for s, p in self.parts.items()}

    def prefix(self, counts: dict[int, np.ndarray], keys: dict[int, Keys]) -> Prefix:
        """Orders each window's shingles by rarity and keeps the first; windows with an absent shingle can't occur."""
        chosen = {}
        for s, rows in self.sizes.items():
            hashes, windows, offsets = [], [], []
            for i, part in zip(rows, self.parts[s], strict=True):
                n = counts[s][np.searchsorted(keys[s].sorted, part)]
                k = int(np.lexsort((part, n))[0])
                if n[k]:
                    hashes.append(part[k]), windows.append(i), offsets.append(k)
            if hashes:
                order = np.argsort(np.array(hashes, np.uint64), kind="stable")
                h = np.array(hashes, np.uint64)[order]
                member = Keys(h)
                bounds = np.searchsorted(h, member.sorted, "left").tolist() + [len(h)]
                chosen[s] = (member, np.array(bounds), np.array(windows)[order], np.array(offsets)[order])
        return Prefix(chosen, self.words, self.size, self.items)


class Prefix:
    def __init__(self, chosen, words, size, items):
        self.chosen, self.words, self.size, self.items = chosen, words, size, items

    def match(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and window of each occurrence in texts whose words are h[bounds[k]:bounds[k+1]]."""
        out = [(np.zeros(0, np.int64),) * 3]
        for s, (member, runs, windows, offsets) in self.chosen.items():
            at, key = member.find(shingles(h, s))
            n = runs[key + 1] - runs[key]
            pos, j = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs[key], n)
            w, first = windows[j], pos - offsets[j]
            doc = np.searchsorted(bounds, pos, "right") - 1
            fits = (first >= bounds[doc]) & (first + self.size[w] <= bounds[doc + 1])
            doc, first, w = doc[fits], first[fits], w[fits]
            good = np.ones(len(w), bool)
            for i in range(self.words.shape[1]):
                inside = i < self.size[w]
                good &= ~inside | (h[np.minimum(first + i, len(h) - 1)] == self.words[w, i])
            out.append((doc[good], first[good], w[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if size and size + len(r[1] or "") > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0]), texts.append(r[1])
        size += len(r[1] or "")
    yield ids, texts


def _rarity(docs: DataFrame, text_col: str, keys: dict[int, Keys]) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""

    def count(batches):
        n = {s: np.zeros(len(k.sorted), np.int64) for s, k in keys.items()}
        for b in batches:
            for words in hash_words(b.column(0).to_pylist(), NOT_ALNUM):
                for s, k in keys.items():
                    n[s] += np.bincount(k.find(shingles(words.hashes, s))[1], minlength=len(n[s]))
        for s, c in n.items():
            full = np.flatnonzero(c)
            yield pa.record_batch([pa.array(np.full(len(full), s, np.int32)), pa.array(full), pa.array(c[full])], ["size", "key", "n"])

    out = {s: np.zeros(len(k.sorted), np.int64) for s, k in keys.items()}
    for r in docs.select(text_col).mapInArrow(count, "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n")).collect():
        out[r["size"]][r.key] = r.n
    return out


def _scan(prefix: Prefix):
    @F.arrow_udf(_RESULT)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = [None] * len(batch)
            for words in hash_words(batch.to_pylist(), NOT_ALNUM):
                doc, first, w = prefix.match(words.hashes, words.bounds)
                for k in range(len(words)):
                    out[words.first + k] = {"n_words": int(words.bounds[k + 1] - words.bounds[k]), "n_hit": 0, "hits": [], "items": []}
                for k in np.unique(doc):
                    mine, lo = doc == k, words.bounds[k]
                    edge = np.zeros(words.bounds[k + 1] - lo + 1, np.int64)
                    np.add.at(edge, first[mine] - lo, 1)
                    np.add.at(edge, first[mine] - lo + prefix.size[w[mine]], -1)
                    out[words.first + k] |= _hits(np.cumsum(edge)[:-1] > 0) | {"items": sorted(set().union(*(prefix.items[x] for x in np.unique(w[mine]))))}
            yield pa.array(out, _ARROW)

    return scan


def _hits(mask: np.ndarray) -> dict:
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return {"n_hit": int(mask.sum()), "hits": [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]}


def _merge():
    @F.arrow_udf(_RESULT)
    def merge(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            mask = np.zeros(x["n_words"], bool)
            for s in (*x["hits"], *y["hits"]):
                mask[s["start"] : s["end"]] = True
            out.append({"n_words": x["n_words"], "items": sorted({*x["items"], *y["items"]})} | _hits(mask))
        return pa.array(out, _ARROW)

    return merge


def find_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence), hits (maximal runs of such words) and items (ids, sorted as strings).

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A null text has no words; an item
    without words has no window; an item whose id is null counts for hits but isn't listed; equal items are all listed;
    empty tables give no hits or no rows; a very long text is read whole. Input columns named like the operator's own are
    replaced. The benchmark is a query set: its windows are made and counted in blocks of block_bytes, and all of them, some
    130 bytes a word, go to the executors with the one pass that looks for them, so it has to fit there.
    """
    session(docs)
    out, state, made = without(docs, *OWN), None, free_name(docs)
    for ids, texts in _blocks(items, item_id_col, item_text_col, block_bytes):
        block = Block(ids, texts, window)
        keys = block.keys()
        scan = _scan(block.prefix(_rarity(docs, text_col, keys) if keys else {}, keys))
        one: Column = scan(F.col(text_col))
        state = one if state is None else _merge()(state, one)
    kept = out.columns
    return out.withColumn(made, state).select(*[f"`{c}`" for c in kept], *[F.col(f"`{made}`.{c}").alias(c) for c in OWN])


def contaminated(least_share: int = 20) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


# The query as SQL: windows as joined words, all windows of the documents beside them.
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
spot AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + 12], ' ') AS t FROM spot),
place AS (SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) s WHERE len(w) >= s.n),
hit AS (SELECT doc_id, item_id, k, place.n FROM place JOIN win ON win.n = place.n AND win.t = array_to_string(place.w[k:k + place.n - 1], ' ')),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": _SQL}

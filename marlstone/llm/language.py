"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (n = 1 to 3, words padded with one blank) in rank order. A
text's distance to a language is the sum over its own profile of how far each n-gram is out of place in the
language's; absent n-grams cost the longest distance. The nearest language wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, session, table, without

#: N-grams in a profile.
PROFILE = 300
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BLANK = np.int64(32)


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers of up to three 21-bit code points; none for a text without letters."""
    words = _NOT_LETTERS.sub(" ", text.lower())
    if not any(map(str.isalpha, words)):
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {words.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = c[:-1] | c[1:] << 21
    three = (two[:-1] | c[2:] << 42)[c[1:-1] != _BLANK]
    return np.concatenate([c[c != _BLANK], two, three])


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, most frequent first, ties by code."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:n]


class Profiles:
    """Languages in name order, each with its n-grams sorted and their ranks."""

    def __init__(self, of: dict[str, list[int]], size: int):
        self.size = size
        self.names = sorted(of)
        self.tables = []
        for name in self.names:
            codes = np.array(of[name], np.int64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - distance / longest distance; ties go to the first name."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """What nearest gives, and the number of n-grams in the text's own profile."""
        g = grams(text or "")
        if not len(g) or not self.names:
            return UNKNOWN, 0.0, 0
        own = ranked(*np.unique(g, return_counts=True), self.size)
        place = np.arange(len(own))
        far = []
        for codes, ranks in self.tables:
            k = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            far.append(int(np.where(codes[k] == own, np.abs(ranks[k] - place), self.size).sum()))
        best = int(np.argmin(far))
        return self.names[best], 1.0 - min(1.0, far[best] / (len(own) * self.size)), len(own)


def held_out(id_col: str = "doc_id", modulus: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == fold


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Counts every n-gram of all rows with a language, then takes each language's most frequent.

    Only sums leave the executors' tasks and only size codes a language reach the driver. A null text or language teaches
    nothing; repeated rows count as often as they are there; an empty table gives no profiles; a very long text is read
    whole; other columns don't matter, whatever their names.
    """
    session(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting = 0
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                at = 0
                while at < len(texts):
                    run, n = [], 0
                    while at < len(texts) and n < 1 << 19:
                        run.append(texts[at])
                        n += len(texts[at])
                        at += 1
                    got = np.unique(np.concatenate([grams(t) for t in run]), return_counts=True)
                    held.setdefault(lang, []).append(got)
                    waiting += len(got[0])
            if waiting > 1 << 21:
                held = {k: [_sum(v)] for k, v in held.items()}
                waiting = 0
        for lang, parts in held.items():
            codes, n = _sum(parts)
            for i in range(0, len(codes), 1 << 16):
                yield pa.record_batch([pa.array([lang] * len(codes[i : i + 65536])), pa.array(codes[i : i + 65536]), pa.array(n[i : i + 65536])], ["lang", "gram", "n"])

    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= size)
    of: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "place", "gram").collect()):
        of.setdefault(r.lang, []).append(r.gram)
    return Profiles(of, size)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, back, np.concatenate([p[1] for p in parts]))
    return codes, n


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", with_grams: bool = False) -> DataFrame:
    """docs with lang_pred and score (0 to 1), and with_grams the n-grams (n_grams) that the score is over.

    A null text, one without letters, or an empty set of profiles gives und and 0. Equal texts get equal results; long
    texts are read whole; an empty table gives an empty result; input columns of the same names are replaced.
    """
    session(docs)
    kinds = {"lang_pred": pa.string(), "score": pa.float64()} | ({"n_grams": pa.int64()} if with_grams else {})

    @F.arrow_udf("lang_pred string, score double" + ", n_grams long" * with_grams)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            got = [profiles.judge(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in got], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    kept, made = without(docs, *kinds), free_name(docs)
    return kept.withColumn(made, predict(F.col(text_col))).select(*[f"`{c}`" for c in kept.columns], *[F.col(f"`{made}`.{c}").alias(c) for c in kinds])


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = learn_profiles(docs.where("not held_out"))
    return identify(docs, profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}

"""Brute-force comparisons and edge cases of the operators that hold texts against each other."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import repeats, scoring, similarity, suffixes
from marlstone.llm.common import Scratch
from marlstone.llm.components import components
from marlstone.llm.language import held_out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def near_copies(n_groups, rng, size=120):
    out = []
    for _ in range(n_groups):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([3, 9, 12, 30, size]))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([["new"], [], [t[k], "more"]])
            out.append(" ".join(t) + rng.choice(["", " ", "\n"]))
    passage = " ".join(f"p{i}" for i in range(60))
    return out + [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(150)]


def brute_groups(docs, size, num):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= num * (len(sets[i]) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
                links.update((i, j))
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "num", "least"), [(3, 90, 64), (5, 80, 20)])
def test_jaccard_groups_against_brute_force(spark, monkeypatch, size, num, least):
    monkeypatch.setattr(similarity, "WIDESPREAD", least)
    docs = list(enumerate(near_copies(45, random.Random(num)))) + [(5000, None), (5001, ""), (5002, "two words"), (5003, "Two  WORDS"), (5004, "\t\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("n", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in similarity.jaccard_groups(df, size=size, num=num, block_sets=8).collect()}
    assert got == brute_groups(docs, size, num)


def test_jaccard_edges(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "x y z"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in similarity.jaccard_groups(df).where("doc_id is not null").collect())
    assert got == [(3, 2, 3, 2), (3, 2, 3, 2), (4, 0, 4, 0)]
    assert similarity.jaccard_groups(df.limit(0)).count() == 0
    assert similarity.keep_one(df, similarity.jaccard_groups(df)).where("doc_id = 3").count() == 1


def test_keep_one_goes_by_rows_when_ids_repeat_or_are_null(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base, "end"])
    rows = [(1, " ".join(base)), (2, near), (2, "quite another text here"), (2, "quite another text here"), (7, "one more of id seven"), (7, "and yet another with it"),
            (None, near), (None, "copied without an id"), (None, "copied without an id"), (None, "alone without an id"), (8, None), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = similarity.keep_one(df, similarity.jaccard_groups(df, by_row=True)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([rows[k] for k in (0, 2, 4, 5, 7, 9, 10, 11, 12)])


def test_ranges_cover_all_linked_sizes():
    for num, den in ((90, 100), (80, 100)):
        r = similarity.Ranges(num, den, {1: 1, 3000: 1})
        for n in range(1, 400):
            for m in range(n, n * den // num + 1):
                need = -(-num * (n + m) // (num + den))
                if need <= n:
                    i = max(r.of(n)[0], r.of(m)[0])
                    assert i in r.of(n) and i in r.of(m) and n + m - 2 * need <= r.differ[i]


def test_the_boundary_moves_with_the_data():
    sizes = range(1, 400)
    few, many = {n: 100 for n in sizes}, {n: 10**7 for n in sizes}
    at = lambda histogram, meet: similarity.Ranges(90, 100, histogram, meet).boundary
    assert at(few, 0.0) == 0 and at(many, 0.0) == 0  # nothing strays, so single parts are cheapest
    assert 0 < at(many, 0.05) < at(many, 0.6) and at(few, 0.05) < at(many, 0.05)
    r = similarity.Ranges(90, 100, many, 0.3)
    whole = lambda k: sum(c[0] for c in r.costs[:k]) + sum(c[1] for c in r.costs[k:])
    assert whole(r.boundary) == min(map(whole, range(len(r.costs) + 1)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(20)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    by = collections.defaultdict(set)
    for x, root in got.items():
        by[root].add(find(x))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({find(x) for x in got})


# suffixes and repeats


def brute_starts(c, length):
    keys = [tuple(c[i : i + length].tolist()) if i + length <= len(c) and 0 not in c[i : i + length] else None for i in range(len(c))]
    n = collections.Counter(keys)
    return np.array([k is not None and n[k] > 1 for k in keys], bool)


@pytest.mark.parametrize("bound", [1 << 28, 200])
def test_suffix_sorting_against_brute_force(monkeypatch, bound):
    monkeypatch.setattr(suffixes, "QUEUE_BYTES", bound)
    rng = random.Random(bound)
    for _ in range(300):
        length, parts = rng.choice([2, 3, 5, 8, 20]), []
        base = [rng.choice([1, 2, 3]) for _ in range(40)]
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.5:
                i = rng.randint(0, 30)
                parts += base[i : i + rng.randint(0, 30)]
            else:
                parts += [rng.randint(1, rng.choice([1, 2, 4, 200])) for _ in range(rng.randint(0, 40))]
            parts.append(0)
        c = np.array(parts, np.uint16)
        assert (suffixes.repeated_starts(c, length) == brute_starts(c, length)).all(), (length, parts)


def brute_repeats(docs, length):
    seen = collections.defaultdict(list)
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]].append((i, k))
    cover = {i: np.zeros(len((t or "").encode()), bool) for i, t in docs}
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                cover[i][k : k + length] = True
    out = {}
    for i, t in docs:
        b, m = np.frombuffer((t or "").encode(), np.uint8), cover[i]
        out[i] = (len(b), int(m.sum()), int(np.diff(m.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(b[~m].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("many", [1000, 1])
def test_repeats_against_brute_force(spark, many):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage, copy = noise(150), noise(300)
    texts = [copy, copy, noise(20), None, "", "ab" * 200, noise(500)]
    texts += [noise(rng.randint(0, 80)) + passage[rng.randint(0, 60) : rng.randint(90, 150)] + noise(rng.randint(0, 80)) for _ in range(60)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("kept", F.lit(0))
    got = repeats.remove_repeats(df, length=40, gram=8, many=many, shard_bytes=4000).collect()
    mine = {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got}
    assert mine == brute_repeats(docs, 40)


def test_repeats_edges(spark):
    df = spark.createDataFrame([(None, "x" * 500), (1, "x" * 399), (2, None)], "doc_id long, text string")
    got = {r.n_bytes: sum(x.end - x.start for x in r.removed) for r in repeats.remove_repeats(df).collect()}
    assert got == {500: 500, 399: 0, 0: 0}
    assert repeats.remove_repeats(df.limit(0)).count() == 0


# scoring


def grams_of(seq, n):
    return [tuple(seq[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(seq))]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_brute_force(spark, monkeypatch, order):
    """Every probability by the recursive formula over plain counts; long texts are walked in several parts."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "cat", "Sat", "on", f"w{rng.randint(0, 50)}"]) for _ in range(rng.choice([0, 3, 30, 700 if i % 20 == 0 else 9])))) for i in range(80)] + [(200, None), (201, "never seen"), (201, "never seen")]
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    counts, n_docs = {n: collections.Counter() for n in range(1, order + 1)}, 0
    tokens = [(i, [*words(t), "</s>"]) for i, t in docs]
    for i, t in tokens:
        if not out[i]:
            n_docs += 1
            for n in counts:
                counts[n].update(grams_of(["<s>", *t], n))
    total, kinds = sum(counts[1].values()), len(counts[1])

    def p(seq, i, n, k):
        gram = tuple(seq[i - n + 1 : i + 1])
        if n == 1:
            return (counts[1][gram] + 0.1) / (total + 0.1 * (kinds + 1))
        k_n = k / scoring.LESS ** (n - 2)
        history = n_docs if gram[:-1] == ("<s>",) else counts[n - 1][gram[:-1]]
        return (counts[n][gram] + k_n * p(seq, i, n - 1, k)) / (history + k_n)

    got = scoring.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), held_out(modulus=10, fold=0), block_bytes=3000, order=order).collect()
    assert len(got) == len(docs)
    fits, by_id = collections.Counter(), dict(tokens)
    for r in got:
        t = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(counts[1][(w,)] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10(p(["<s>", *t], i + 1, 1, 0)) for i in range(len(t))), abs_tol=1e-6)
        for k in scoring.BACKOFF:
            seq = ["<s>", *t]
            fits[k] += math.isclose(r.score, sum(math.log10(p(seq, i, min(order, i + 1), k)) for i in range(1, len(seq))), abs_tol=1e-6)
    assert max(fits.values()) == len(docs)


def test_the_walk_takes_failure_arcs_and_arrives_at_the_longest_history():
    texts = ["a b c a b d", "b c", "x", "a b c x a"]
    tokens = scoring.Tokens(texts)
    train = tokens.text < 2
    grams, first, counts = [], [], []
    for n in (1, 2, 3):
        has = tokens.has(n)
        _, one, back = np.unique(tokens.keys(n), return_index=True, return_inverse=True)
        gram = np.full(len(tokens.token), -1, np.int32)
        gram[has] = back
        grams.append(gram), first.append(has[one]), counts.append(np.bincount(back[train[has]], minlength=len(one)))
    auto = scoring.Automaton(tokens, grams, first, counts, int(train.sum()), int((counts[0] > 0).sum()), 2)
    state, falls = np.array([1]), []
    last = np.flatnonzero(tokens.text == 3)
    for at in last:
        before = auto.level[state[0]]
        chance = np.ones((1, len(scoring.BACKOFF)))
        state = auto._step(np.array([at]), state, chance)
        assert state[0] == auto.after(np.array([at]))[0] and (chance < 1).all() and (chance > 0).all()
        falls.append((int(before), int(auto.level[state[0]])))
    # a, then a b, then b c; x was never seen, so the walk falls to the root; a again; and the end
    assert falls == [(1, 2), (2, 2), (2, 2), (2, 0), (0, 1), (1, 1)]


def test_scoring_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    got = scoring.score_texts(df, F.lit(True)).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert scoring.score_texts(df.limit(0), F.lit(False)).count() == 0


def test_number_blobs():
    for x in ([], [0], [1, 255, 256], [2**63, 5]):
        assert scoring.grow(scoring.shrink(np.array(x, np.uint64))).tolist() == x


def test_counted_cells_are_those_of_a_count_in_one_place(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 1 << 16)
    monkeypatch.setattr(similarity, "WIDESPREAD", 8)
    rng = random.Random(12)
    common = " ".join(f"c{i}" for i in range(50))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) + f" {common}" * (k % 2) for k in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    sets = list(similarity.shingle_sets(texts))
    total = sum(map(len, sets))
    got, meet = similarity._widespread(docs, "text", 3, len(sets), total, Scratch(spark, "test"))
    n = np.zeros(1 << 16, np.int64)
    for part in docs.rdd.glom().collect():  # cells that a task met less than 4 times aren't reported
        own = np.zeros(1 << 16, np.int64)
        for s in similarity.shingle_sets([r.text for r in part]):
            np.add.at(own, np.unique((s & np.uint64((1 << 16) - 1)).astype(np.int64)), 1)
        n += np.where(own >= 4, own, 0)
    n[n < 8] = 0
    hot = n >= 8 + 4 * n.sum() // (1 << 16)
    assert 0 < hot.sum() < (n > 0).sum() > 50_000
    assert np.array_equal(np.unpackbits(got).astype(bool), hot)
    rest = max(0, total - n.sum())
    assert math.isclose(meet, (rest * max(1.0, rest / 65536) + float((n[~hot] ** 2).sum())) / total / len(sets))
    empty, none = similarity._widespread(docs.limit(0), "text", 3, 0, 0, Scratch(spark, "test"))
    assert not empty.any() and len(empty) == 1 << 13 and none == 0


def test_op3_leaves_the_driver_few_rows(spark, tmp_path, monkeypatch):
    """Most cells are met often here, and many nodes are in clusters; neither reaches the driver row by row."""
    monkeypatch.setattr(similarity, "CELLS", 1 << 16)
    monkeypatch.setattr(similarity, "WIDESPREAD", 8)
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(400)]
    texts += [" ".join(f"{k}x{i}" for i in range(n)) for k in range(1500) for n in (60, 61)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = []
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(type(docs), name, lambda self, *a, f=getattr(type(docs), name): rows.append(len(out := f(self, *a))) or out)
    out = similarity.op3_ngram_jaccard(spark, str(tmp_path))
    assert out.where("n_links = 1").count() == 3000 and out.where("n_links = 0").count() == 400
    assert out.select("component_id").distinct().count() == 1900
    assert max(rows) < 600 and sum(rows) < 1500


def test_linked_sets_share_a_signature_whatever_is_widespread():
    rng = np.random.default_rng(6)
    kinds = [(num, similarity.Ranges(num, 100, {k: 10**6 for k in range(1, 90)}, meet)) for num in (80, 90) for meet in (0.0, 0.2, 0.9)]
    assert len({r.boundary for _, r in kinds}) > 2
    linked = 0
    for _ in range(3000):
        num, ranges = kinds[rng.integers(len(kinds))]
        n, most = int(rng.integers(2, 60)), 0
        pool = np.unique(rng.integers(0, 1 << 63, n + 10, dtype=np.uint64) * np.uint64(2))
        most = max(1, n * (100 - num) // 100)
        a = np.sort(rng.choice(pool, n, replace=False))
        b = np.setdiff1d(a, rng.choice(a, int(rng.integers(0, most + 1)), replace=False))
        b = np.union1d(b, rng.choice(np.setdiff1d(pool, a), min(int(rng.integers(0, most + 1)), len(pool) - n), replace=False))
        both = len(np.intersect1d(a, b))
        if both * 100 >= num * (len(a) + len(b) - both):
            linked += 1
            hot = [np.setdiff1d(b, a), rng.choice(b, int(rng.integers(0, len(b))), replace=False), pool][rng.integers(3)]
            assert np.intersect1d(ranges.signatures(a, ~np.isin(a, hot)), ranges.signatures(b, ~np.isin(b, hot))).size
    assert linked > 500

"""The corpus pipeline, stage by stage, against brute force on a small fixture."""

import random
import re

import pytest

from marlstone.llm import similarity
from test_corpus_ops import brute_groups
from test_text_ops import brute_spans, brute_windows

cp = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: rng.choice("ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu".split()) + rng.choice("lan mer nis ror sut".split())
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(25)) for i in range(5)]
    rows = [prose(rng.randint(30, 120)) for _ in range(60)]
    rows += [rows[0], rows[1] + " extra", rows[2].replace(" ", "\n", 1)]
    rows += [prose(20) + " " + items[i][1] for i in range(5)] + [prose(400) + " " + " ".join(items[0][1].split()[:13])]
    rows += [f"{prose(40)} mail me{i}@mail.example.com or +1 (555) 555-{1000 + i} {prose(10)}" for i in range(8)]
    rows += [None, "", "12345 %%%", "!!!"]
    docs = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "pack"]
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        texts = [(i, r.text) for i, r in before.items()]
        if name == "language":
            assert {r.doc_id for r in docs.collect()} == {i for i, t in texts if re.search("[a-z]", t or "")}
        elif name == "near_duplicates":
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, root, _) in brute_groups(texts, 5, 80).items() if i == root}
        elif name == "decontaminate":
            gone = {i for i, (_, hit, _) in brute_windows(texts, items).items() if hit}
            assert gone and {r.doc_id for r in docs.collect()} == before.keys() - gone
        elif name == "personal_data":
            after = {r.doc_id: r for r in docs.collect()}
            assert after.keys() == before.keys()
            for i, t in texts:
                for kind, a, b in reversed(sorted(brute_spans(t), key=lambda s: s[1])):
                    t = t[:a] + f"<{kind.upper()}>" + t[b:]
                assert after[i].text == t and after[i].n_chars == len(t)
        else:
            pieces = docs.toPandas()
            assert set(pieces.doc_id) == before.keys()
            assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
            assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_language_stage_rejects_by_score(spark, sf_dir):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = [r.text for r in docs.where("length(text) > 200").orderBy("doc_id").limit(20).collect()]
    dutch = "De kat zat op de mat en keek naar de vogels in de tuin terwijl de kinderen buiten speelden met een rode bal. Later die avond ging iedereen samen aan tafel zitten om te eten en te praten over de dag. Het was een mooie zomer en niemand wilde naar binnen gaan voordat het donker werd, want de lucht was nog warm en de bomen stonden vol met rijpe appels."
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400))
    short = [" ".join(t.split()[:4]) for t in known]
    extra = spark.createDataFrame([(1000 + i, t, None, "x", len(t)) for i, t in enumerate([dutch, noise, *short])], docs.schema)
    left = {r.doc_id for r in cp.language_stage(spark, docs.unionByName(extra), sf_dir).where("doc_id >= 1000").collect()}
    assert left == {1002 + i for i in range(len(short))}


def test_run_gives_the_last_stage(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_near_duplicates_leave_the_driver_few_rows(spark, sf_dir, monkeypatch):
    """Most cells are met often here, and many nodes are in clusters; neither reaches the driver row by row."""
    monkeypatch.setattr(similarity, "CELLS", 1 << 16)
    monkeypatch.setattr(similarity, "WIDESPREAD", 8)
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(400)]
    texts += [" ".join(f"{k}x{i}" for i in range(n)) for k in range(1500) for n in (60, 61)]
    docs = spark.createDataFrame([(k, t, "en", "x", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    rows = []
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(type(docs), name, lambda self, *a, f=getattr(type(docs), name): rows.append(len(out := f(self, *a))) or out)
    left = cp.near_duplicate_stage(spark, docs, sf_dir)
    assert left.count() == 400 + 1500
    assert max(rows) < 600 and sum(rows) < 1500

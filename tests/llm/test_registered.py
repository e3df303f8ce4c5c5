"""The registered queries on whole tables: against their SQL where they have one, and else against brute force on their contracts."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import pytest

from marlstone.llm import media
from marlstone.llm.queries import ORACLES, QUERIES
from test_text_ops import brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, items string, removed string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Small tables with nulls, empty and long texts, copies, near copies, benchmark passages, personal data, and columns whose names clash."""
    rng = random.Random(21)
    syllables = {"en": "the an er on ing ed wh sh", "fr": "le é aux que oi en ment ai", "de": "der sch ung ein ü ver keit"}
    word = lambda lang: "".join(rng.choice(syllables[lang].split()) for _ in range(rng.randint(1, 3)))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(i, prose("en", rng.choice([4, 13, 30]))) for i in range(6)] + [(90, None), (91, "")]
    rows = [(lang, prose(lang, rng.randint(5, 200))) for lang in syllables for _ in range(25)]
    rows += [rows[0], rows[0], ("en", rows[1][1] + " tail"), ("en", prose("en", 60) + " " + rows[2][1] + " " + prose("en", 60)), ("fr", rows[30][1].upper())]
    rows += [("en", f"{prose('en', 20)} {items[i][1]} {prose('en', 5)}") for i in range(6)] + [("en", prose("en", 3000))]
    rows += [("de", f"mail a{i}@b.example.com card 4111 1111 1111 1111 ip 10.0.0.{i} tel +1 (555) 555-01{i:02d}, 999.1.1.1 password=3b{i:02d}9fe87309f41074") for i in range(12)]
    rows += [(None, None), ("en", ""), (None, " \n\t"), ("de", "123 %% !!"), ("en", "a \0first:b <|endoftext|> x"), (None, "一二 三")]
    docs = [(i, t, lang, f"s{i % 3}", None if t is None else len(t), 0.5, "x", None, "y") for i, (lang, t) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    chats = [(c, t, rng.choice(["user", "Assistant", "human", "system", "tool", None]), rng.choice(["hi", "so <|end|>", "", None])) for c in range(12) for t in (0, 1, 1, 2)]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def run(spark, name, sf_dir):
    return QUERIES[name](spark, sf_dir).collect()


def crc(text):
    return zlib.crc32((text or "").encode())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    assert collections.Counter(map(tuple, df.select(*want.columns).collect())) == collections.Counter(want.fetchall())


def test_op2(spark, sf_dir, texts):
    rows = run(spark, "op2_histogram_sort", sf_dir)
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        t = texts[r.doc_id][0]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 8, crc(t), "bytes", None) and 0 <= r.shard < 24
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in some) == list(range(len(some))) for some in by.values())


def test_op4(spark, sf_dir, texts):
    rows = run(spark, "op4_media_sniffing", sf_dir)
    same = collections.defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id][0] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.store(payload, media.STORED[zlib.crc32(payload) % 5])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.feature.split(";")[0] == media.STORED[zlib.crc32(payload) % 5]
        same[raw].add((r.media_sha256, r.feature))
    assert len(rows) == len(texts) and all(len(v) == 1 for v in same.values())


def test_op5(spark, sf_dir, texts):
    rows = run(spark, "op5_language_id", sf_dir)
    right = [r.lang_pred == texts[r.doc_id][1] for r in rows if r.held_out and texts[r.doc_id][1] and len(texts[r.doc_id][0]) > 60]
    assert len(rows) == len(texts) and sum(right) >= 0.95 * len(right)
    for r in rows:
        t = texts[r.doc_id][0]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and r.lang_pred in {"und", "en", "fr", "de"}


def test_op7(spark, sf_dir, texts):
    rows = run(spark, "op7_pii", sf_dir)
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r.doc_id][0] or "")
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))
        listed = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(listed) and r.n_spans == len(listed)
        order = ["email", "ip", "card", "phone", "secret", "iban", "ssn"]
        assert listed == sorted(listed, key=lambda s: (order.index(s.split(":")[0]), int(s.split(":")[1])))
    assert sum("secret:" in r.spans for r in rows) == 12


def test_op8(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = run(spark, "op8_packing", sf_dir)
    of_doc, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append((r.offset, r.length))
    for i, (t, _) in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(of_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in of_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(of_sequence) == list(range(len(of_sequence))) and len(of_sequence) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_op10(spark, sf_dir, texts):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*low(t), None] for i, (t, _) in texts.items()}
    c = collections.Counter(w for i, t in tokens.items() if not out[i] for w in t)
    total, kinds = sum(c.values()), len(c)
    rows = run(spark, "op10_backoff_scoring", sf_dir)
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(c[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0
    known = [r for r in rows if not r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_chat_formatting"}))
def test_an_empty_table_gives_no_rows(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert run(spark, name, str(tmp_path)) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_its_sql_on_the_test_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    want = con.sql(ORACLES[name])
    assert collections.Counter(map(tuple, QUERIES[name](spark, sf).select(*want.columns).collect())) == collections.Counter(want.fetchall())

import base64
import gzip
import hashlib
import io
import os
import subprocess
import sys
import unicodedata
import zipfile
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseg.llm import decontamination, language_id, pii, quality_rules, sentencepiece_codec, sharding, textkernel, url_filters, warc_zip
from sparkseg.llm.components import connected_components
from sparkseg.llm.fmindex import FMIndex
from sparkseg.llm.minhash_dedup import BYTES, _compare, minhash_dedup
from sparkseg.llm.minhash_dedup import ORACLE_SQL as NEAR_SQL
from sparkseg.llm.queries import ORACLE_SQL, QUERIES
from sparkseg.llm.substring_dedup import ORACLE_SQL as SUBSTRING_SQL
from sparkseg.llm.substring_dedup import substring_dedup

PASSAGE = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", " \n\t", "one", "ONE", "a b c d", PASSAGE, PASSAGE, f"x {PASSAGE} y", PASSAGE.replace("w30", "z"), "la " * 300, "é ñ ü " * 40, "word " * 30 + PASSAGE, "123 4", "longword" * 20000, PASSAGE.upper()]


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like the operators' own."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, PASSAGE, None, None, None), (None, None, None, None, None), (6, PASSAGE, "en", "s", 1), (3, "another text", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *(f"{i} as `{c}`" for i, c in enumerate(("id", "body", "k1", "node", "quality", "pii", "hits", "ids", "score", "lang_pred", "shard"))))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, sf_dir), ORACLE_SQL[name])


@pytest.mark.parametrize("hot", [1, 20_000])
def test_substring_dedup_on_odd_rows(spark, same_as_sql, hot):
    docs = odd_docs(spark)
    same_as_sql(substring_dedup(docs, keep_text=False, hot=hot), SUBSTRING_SQL, {"documents": docs.select("doc_id", "text").toArrow()})
    kept = {r.doc_id: r.kept for r in substring_dedup(docs).where("doc_id = 8").collect()}
    assert kept == {8: "x y"}
    assert substring_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("settings", [{}, {"leaf": 1, "depth": 2, "cluster_shingles": 60}, {"leaf": 1, "depth": 3, "cluster_shingles": 60, "hot_share": 10**9, "held": 1}])
def test_near_dedup_on_odd_rows(spark, same_as_sql, settings):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    same_as_sql(minhash_dedup(docs, similarity=Fraction(85, 100), **settings), NEAR_SQL, {"documents": docs.select("doc_id", "text").toArrow()})
    odd = minhash_dedup(odd_docs(spark))
    assert odd.count() == len(TEXTS) + 4 and odd.where("doc_id is null and kept").count() == 0
    assert {r.component_id for r in odd.where("n_shingles = 56").collect()} == {6}
    assert minhash_dedup(docs.limit(0)).count() == 0


def test_near_dedup_of_a_large_cluster(spark, same_as_sql):
    """A chain: neighbours are linked, the ends aren't; it is dealt over many blocks."""
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words[int(rng.integers(150))] = f"n{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same_as_sql(minhash_dedup(docs, similarity=Fraction(85, 100), leaf=7, cluster_shingles=900), NEAR_SQL, {"documents": docs.toArrow()})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=9), min_size=1, max_size=5), st.data())
def test_matching_statistics(lists, data):
    sequences = [np.array(x, dtype=np.uint64) for x in lists]
    weights = np.array([data.draw(st.integers(1, 2)) for _ in lists])

    def times(part):
        return sum(int(w) * sum(s[i : i + len(part)] == part for i in range(len(s))) for s, w in zip(lists, weights, strict=True))

    for q, found in zip(lists, FMIndex(sequences, weights).matching_statistics(sequences), strict=True):
        for i, n in enumerate(found):
            assert (n == 0 or times(q[i : i + n]) >= 2) and (i + n == len(q) or times(q[i : i + n + 1]) < 2)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(1000, 1000 + i) for i in range(80)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = QUERIES["op3_language_id"](spark, sf_dir)
    row = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 20 and row.a >= 0.95
    assert found.count() == docs.count()


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    learned = language_id.learn_prototypes(docs)
    found = language_id.identify_language(docs, learned)
    assert sorted(learned) == ["de", "en"] and found.count() == docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in found.collect())
    assert {r.lang_pred for r in language_id.identify_language(docs, {}).collect()} == {"und"}
    assert language_id.identify_language(docs.limit(0), learned).count() == 0 and language_id.learn_prototypes(docs.limit(0)) == {}


def test_bundle_is_the_sum_of_bound_trigrams():
    text = "Aé, b!  c"
    vectors, letters = language_id.bundles([text, "", "12"])
    symbols = language_id.letter_vectors(np.array([ord(c) if c.isalpha() else 0 for c in "aé b c "])).astype(int)
    want = sum(symbols[i] * np.roll(symbols[i + 1], 1) * np.roll(symbols[i + 2], 2) for i in range(len(symbols) - 2))
    assert (vectors[0] == want).all() and letters.tolist() == [4, 0, 0]


def test_quality_and_pii_on_odd_rows(spark, same_as_sql):
    docs = odd_docs(spark)
    tables = {"documents": docs.select("doc_id", "text").toArrow()}
    out = quality_rules.quality_rules(docs.select("doc_id", "text")).select("doc_id", *(f"quality.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))
    same_as_sql(out, quality_rules.ORACLE_SQL, tables)
    assert quality_rules.quality_rules(docs).count() == docs.count() and set(pii.redact_pii(docs).columns) == set(docs.columns)
    assert pii.redact_pii(docs).select("pii").distinct().collect()[0][0] == 5


PRIVATE = ["a@b.c a@b.c%d@e.f x@y", "1.2.3.4 999.1.1.1 1.2.3.4.5 001.02.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111.", "+1 (807) 555-5623 +12 3 +49", "pay DE89370400440532013000 or GB82WEST12345698765432 or GB82WEST12345698765433", "é" * 5 + "x@y.zz" + "\n+44 20 7946 0958 x@y.zz", "9" * 30000, "a." * 20000 + "@b.c", None, "", "@", "1 " * 9000, "10.0.0.1 0.0.0.0 00.0.256.1 192.168.0.000 0.0.0.300", "IBAN DE89 3704 0044 0532 0130 00, GB82 WEST 1234 5698 7654 32.", 'SSN: 078-05-1120, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "order 078-05-1120 of shiptoken 04dbebab91ab85687d33eeaaf9ac699e1188f962, 000-12-3456 ssn, XX57WEST12345698765432", "account XX57WEST12345698765432 and secret aaaaaaaaaaaaaaaaaaaaaaaa", "a_token=abc123abc123abc123abc1 é" * 3, "ip 1.2.3.4 ship 1.2.3.5" + " " * 40 + "zip 9.9.9.9"]


def test_pii_spans(spark, same_as_sql):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    found = pii.find_pii(docs)
    spans = {r.doc_id: [(r.text[x.s : x.e], pii.KINDS[x.kind].name) for x in r.pii] for r in found.collect() if r.text}
    assert spans[0] == [("a@b.c", "email"), ("a@b.c", "email"), ("%d@e.f", "email")]
    assert [x for x in spans[4] if x[1] == "iban"] == [("DE89370400440532013000", "iban"), ("GB82WEST12345698765432", "iban")]
    assert [x[0] for x in spans[2]] == ["4111 1111 1111 1111", "4111111111111111"]
    assert [x[0] for x in spans[12]] == ["10.0.0.1", "0.0.0.0", "192.168.0.000"]
    assert [x for x in spans[14] if x[1] in ("ssn", "secret")] == [("078-05-1120", "ssn"), ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret")] and not spans[15] and [x[1] for x in spans[16]] == ["iban", "secret"]
    assert [x[0] for x in spans[13] if x[1] == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    same_as_sql(pii.span_digest(docs), pii.ORACLE_SQL, {"documents": docs.toArrow()})
    clean = {r.doc_id: r.text for r in pii.redact_pii(docs).collect()}
    assert clean[5] == "ééééé[EMAIL]\n[PHONE] [EMAIL]" and clean[8] is None and clean[6] == PRIVATE[6]
    scores = {x.score for r in found.where("doc_id = 2").collect() for x in r.pii}
    assert scores == {0.8}
    assert [x.score for x in found.where("doc_id = 18").first().pii] == [0.8, 0.8, 0.7]


def test_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    slots = defaultdict(list)
    for r in QUERIES["op6_sharding"](spark, sf_dir).collect():
        data = texts[r.doc_id].encode()
        draws = [int(hashlib.md5(f"k{r.doc_id}:{s}".encode()).hexdigest()[:13], 16) for s in range(17)]
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == int(np.argmax(draws[:16])) and r.grown_shard == int(np.argmax(draws))
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == len(texts)
    heavy = Counter(r.shard for r in sharding.shard(spark.range(3000).selectExpr("id as doc_id", "'' as text"), weights=[1.0, 3.0], grown=None).collect())
    assert 0.7 < heavy[1] / 3000 < 0.8
    odd = sharding.shard(odd_docs(spark)).collect()
    assert len(odd) == len(TEXTS) + 4 and sharding.shard(odd_docs(spark).limit(0)).count() == 0
    assert len({r.shard for r in odd if r.doc_id is None}) == 1


def test_decontamination_against_brute_force(spark, sf_dir):
    """Recall by length, over copies with up to the allowed edits and some with more; parts of the benchmark give the same."""
    rng = np.random.default_rng(1)
    lengths = (3, 9, 10, 14, 20, 33, 59, 130, 400)
    items = {i: [f"i{i}w{rng.integers(40)}" for _ in range(n)] for i, n in enumerate(lengths)}
    rows, want = [], {}
    for d in range(270):
        i = d % len(items)
        words, n = list(items[i]), len(items[i])
        for _ in range(int(rng.integers(0, n // 5 + 4))):
            kind, at = rng.integers(3), int(rng.integers(len(words)))
            if kind == 0:
                words[at] = f"e{rng.integers(99)}"
            elif kind == 1 and len(words) > 1:
                del words[at]
            else:
                words.insert(at, f"e{rng.integers(99)}")
        full = [f"p{rng.integers(500)}" for _ in range(rng.integers(0, 40))] + words + [f"q{rng.integers(500)}" for _ in range(rng.integers(0, 40))]
        rows.append((d, " ".join(full).upper() if d % 3 == 0 else " ".join(full)))
        want[d] = {j for j, item in items.items() if _within(item, full) <= decontamination.allowed_edits(len(item))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None), (98, ""), (None, "x")], "item_id long, text string")
    found = {r.doc_id: {(h.item, h.at, h.words, h.edits) for h in r.hits} for r in decontamination.find_benchmark(docs, bench).collect()}
    pairs = {(d, i) for d, s in want.items() for i in s}
    got = {(d, h[0]) for d, s in found.items() for h in s}
    assert got <= pairs and len(got) >= 0.99 * len(pairs) and len(pairs) > 120
    assert all(sum((d, i) in got for d in want) >= 0.95 * sum((d, i) in pairs for d in want) >= 3 for i in items)
    texts = {d: t.lower().split() for d, t in rows}
    assert all(_distance(texts[d][a : a + n], items[i]) == e for d, s in found.items() for i, a, n, e in s)
    parts = decontamination.find_benchmark(docs.unionAll(docs), bench, item_bytes=900)
    assert Counter((r.doc_id, frozenset((h.item, h.at, h.words, h.edits) for h in r.hits)) for r in parts.collect()) == Counter({(d, frozenset(s)): 2 for d, s in found.items()})
    assert decontamination.find_benchmark(odd_docs(spark), bench).count() == decontamination.find_benchmark(odd_docs(spark), bench, item_bytes=900).count() == len(TEXTS) + 4
    assert decontamination.find_benchmark(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_decontamination_of_odd_rows(spark):
    """Null and empty texts have no hits; clashing columns stay; repeated items and rows, and an item that a text repeats, give a hit each."""
    docs = odd_docs(spark).drop("hits")
    bench = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (3, "one"), (4, None), (None, PASSAGE)], "item_id long, text string")
    rows = decontamination.find_benchmark(docs.withColumn("c0", F.lit(7)).withColumn("body", F.lit("x")), bench).collect()
    assert all(r.c0 == 7 and r.body == "x" for r in rows)
    for r in rows:
        words = (r.text or "").lower().split()
        whole = _within(PASSAGE.split(), words) <= 12 if len(words) < 1000 else False
        assert {h.item for h in r.hits} == ({1, 2} if whole else set()) | ({3} if "one" in words else set())
    twice = spark.createDataFrame([(1, f"{PASSAGE} x {PASSAGE}")], "doc_id long, text string")
    assert [(h.item, h.at) for h in decontamination.find_benchmark(twice, bench).first().hits] == [(1, 0), (1, 61), (2, 0), (2, 61)]


def _within(item, words):
    """Least edits between item and any run of words."""
    before = np.zeros(len(words) + 1, dtype=int)
    place = np.array(words, dtype=object)
    for i, x in enumerate(item):
        now = np.concatenate([[i + 1], np.minimum(before[:-1] + (place != x), before[1:] + 1)]) - np.arange(len(words) + 1)
        before = np.minimum.accumulate(now) + np.arange(len(words) + 1)
    return before.min()


def _distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        before = now
    return before[-1]


def test_url_aliases(spark, same_as_sql):
    rows = [(1, "http://a.example.org/x", '<link rel="canonical" href="http://b.example.net/fr/y">'), (2, "https://b.example.net/fr/y", None), (3, "http://c.example.org/", '<META http-equiv=refresh content="0; url=http://A.example.org/x#f">'), (4, "http://foo.com/a", '<link href="http://b.example.net/fr/y" rel=canonical>'), (5, None, None), (6, "http://z.org", ""), (7, "www.example.com/en/", ""), (None, "HTTP://EXAMPLE.COM/en/", None), (8, "x://a.www.example.com/en/1?q#f", None), (8, "x://a.www.example.com/en/1?q#f", None), (9, "http://z.org?a/b", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("own", F.lit(2))
    verdict = {r.page_id: r.verdict for r in url_filters.filter_urls(pages).collect()}
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", None: "block", 8: "allow", 9: "allow"}
    logged = spark.createDataFrame([("http://z.org", "http://moved.org/"), ("http://moved.org/", "http://a.example.org/x"), (None, "x")], "source string, target string")
    assert {r.page_id: r.verdict for r in url_filters.filter_urls(pages, logged).collect()}[6] == "block"
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    same_as_sql(url_filters.filter_urls(pages), url_filters.ORACLE_SQL, {"pages": pages.select("page_id", "url", "html").toArrow()})


def _bytes(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _bytes(number << 3) + _bytes(value)
    return _bytes(number << 3 | 2) + _bytes(len(value)) + value


def unigram_model():
    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, -float(i) / 3 - 1, 1) for i, p in enumerate(["▁the", "▁", "e", "t", "h", "th", "a", "▁a", "cat", "c", "s", "▁cats", "ing", "i", "n", "g"])]
    body = b"".join(_field(1, _field(1, p.encode()) + _bytes(2 << 3 | 5) + struct.pack("<f", s) + _field(3, k)) for p, s, k in pieces)
    return body + _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_sentencepiece_parity(spark, sf_dir, kind):
    import sentencepiece

    model = sentencepiece_codec.load_model(spark) if kind == "bpe" else unigram_model()
    reference = sentencepiece.SentencePieceProcessor(model_proto=model)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "  a   b", "x▁y", " a", "a ", "日本 語😀", "\x00", "<s> </s> <0x0A>", " " * 51 + "q", "the cats thing", "x" * 300 + " the"])], "doc_id long, text string")
    docs = odd.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")) if kind == "bpe" else odd
    found = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(docs, model), model).collect()
    for r in found:
        assert r.ids == reference.encode(r.text or "") and r.n_ids == len(r.ids)
        assert r.decoded == (r.text or "").replace("▁", " ") and r.exact
    assert sentencepiece_codec.encode_texts(odd_docs(spark), model).count() == len(TEXTS) + 4
    assert sentencepiece_codec.encode_texts(docs.limit(0), model).count() == 0


def test_sentencepiece_codec_is_built_once_a_worker(monkeypatch):
    data = sentencepiece_codec.load_model(None)
    built, build = [], sentencepiece_codec.Codec.__init__
    monkeypatch.setattr(sentencepiece_codec, "_spare", {}, raising=False)
    monkeypatch.setattr(sentencepiece_codec.Codec, "__init__", lambda self, *a: built.append(1) or build(self, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(["the cat", None, "a  b"])] * 2, names=["c0", "body"])
    found = [list(sentencepiece_codec._encode(data, 2, True, 1)(iter([batch, batch]))) for _ in range(3)]
    assert len(built) == 1 and found[0] == found[1] == found[2]
    failed = sentencepiece_codec._encode(data, 2, True, 1)(iter([batch]))
    next(failed)
    failed.close()  # a task that didn't end leaves no codec behind
    assert next(sentencepiece_codec._encode(data, 2, True, 1)(iter([batch]))) == found[0][0] and len(built) == 2


def test_sentencepiece_chunks_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CHUNKS", 40)
    rng = np.random.default_rng(5)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_model(None))
    common = [f"often{i}" for i in range(10)]
    seen = []
    monkeypatch.setattr(codec, "_keep", lambda chunks, keep=codec._keep: seen.extend(chunks) or keep(chunks))
    for i in range(30):
        texts = [" ".join([*common, f"once{i}x{j}", "y" * (60 + j), *rng.choice(common, 5)]) for j in range(8)] + [None, "", f" {i}  z", "a▁b"]
        ids, ends = codec.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == codec.reference.encode([t or "" for t in texts])
        assert len(codec.place) <= 40 + 20
    assert all(seen.count(c) == 1 for c in common)  # what comes again and again stays


HELD = """
import re, sys
import numpy as np, pyarrow as pa
from sparkseg.llm import language_id, sentencepiece_codec

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = np.random.default_rng(3)
words = ["".join(map(chr, w)) for w in rng.integers(97, 123, (120_000, 7))]
batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words[j] for j in rng.integers(0, len(words), 500)) for _ in range(3000)])], names=["body"])
tasks = [sentencepiece_codec._encode(sentencepiece_codec.load_model(None), 2, True, 0), language_id._predict(["a"], np.ones((1, language_id.DIMENSIONS), np.float32))]
for task in tasks:
    list(task(iter([batch.slice(0, 1)])))
before = held()
for task in tasks:
    assert sum(x.num_rows for x in task(iter([batch]))) == 3000
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_worker_holds_little_after_its_tasks():
    run = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[2])
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < 50


def test_pieces_are_bounded_by_bytes():
    sizes = [0, 5, textkernel.BLOCK_BYTES, textkernel.BLOCK_BYTES, 1, 5 * textkernel.BLOCK_BYTES, *[3] * 700]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes) + 1)), pa.array([*("é" * (n // 2) + "a" * (n % 2) for n in sizes), None])], names=["c0", "body"])
    for part in (batch, batch.slice(2), batch.slice(0, 0)):
        found = list(textkernel.pieces(part, 1))
        assert pa.Table.from_batches(found, part.schema).equals(pa.Table.from_batches([part]))
        assert all(x.num_rows <= 512 and (x.num_rows == 1 or sum(len(t.encode()) for t in x.column(1).to_pylist() if t) <= 2 * textkernel.BLOCK_BYTES) for x in found)
    texts = pa.RecordBatch.from_arrays([pa.array(["the cat " * 8000 + "sat"] * 100)], names=["body"])
    assert max(x.num_rows for x in sentencepiece_codec._encode(sentencepiece_codec.load_model(None), 2, True, 0)(iter([texts]))) <= 2 * textkernel.BLOCK_BYTES // 64_000


def test_warc_round_trip(spark, sf_dir, tmp_path, same_as_sql):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(1000, "u", "a"), (1001, "u\n x", "a"), (1002, None, "a"), (1003, "u", None), (None, "u", ""), (1003, "u", None)], "page_id long, url string, html string")
    pages = pages.unionByName(odd)
    rows = pages.collect()
    last = {}
    for r in rows:
        last[r.html or ""] = max(last.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
    want = Counter()
    for r in rows:
        data = (r.html or "").encode()
        first = last[r.html or ""] == r.page_id
        want[(r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else last[r.html or ""])] += 1
    found = warc_zip.read_archives(warc_zip.write_archives(pages)).collect()
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    digests = warc_zip.read_archives(warc_zip.write_archives(pages)).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
    same_as_sql(digests, warc_zip.ORACLE_SQL, {"pages": pages.select("page_id", "html").toArrow()})
    html = {r.page_id: (r.html or "").encode() for r in rows}
    assert all(bytes(r.payload) == html[r.id] for r in found if r.record_type == "response")
    small = warc_zip.read_archives(warc_zip.write_archives(pages, least_bytes=2)).where("record_type = 'revisit'")
    assert small.count() == 0 and warc_zip.read_archives(warc_zip.write_archives(pages.limit(0))).count() == 0
    odd = pages.selectExpr("*", *(f"{i} as `{c}`" for i, c in enumerate(("id", "hex", "size", "last", "n", "archive", "content", "revisit"))))
    for archives in (warc_zip.write_archives(odd, archive_bytes=100_000, most_broadcast=0), warc_zip.write_archives(odd, folder=str(tmp_path))):
        found = warc_zip.read_archives(warc_zip.archive_files(spark, [r.archive for r in archives.collect()])).collect()
        assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    assert all(zipfile.ZipFile(f).testzip() is None for f in tmp_path.iterdir()) and list(tmp_path.iterdir())


def test_warc_of_very_long_payloads_and_cells(spark, monkeypatch):
    """Payloads beyond a range and an archive; archives as cells where a folder's scheme is unknown."""
    pages = spark.createDataFrame([(i, "u", "long " * 400_000 * (i % 3) + str(i % 5)) for i in range(12)], "page_id long, url string, html string").repartition(2)
    text = {r.page_id: r.html.encode() for r in pages.collect()}
    for kind in ("file", "cell"):
        monkeypatch.setattr(warc_zip, "_known", lambda folder, kind=kind: kind == "file")
        found = warc_zip.read_archives(warc_zip.write_archives(pages, archive_bytes=3_000_000)).collect()
        assert {r.id: bytes(r.payload) for r in found} == text and all(r.payload_bytes == len(text[r.id]) for r in found)


def test_archives_of_other_writers(spark, tmp_path):
    """A compressed index with names without folders and numbers as text; data without any index; members that are compressed are no data."""
    records = [warc_zip.warc_record("response", i, f"http://h/{i}", b"x" * i, warc_zip.payload_digest(b"x" * i)) for i in range(20)]
    packed, lines, at = b"", [], 0
    for i, r in enumerate(records):
        member = gzip.compress(r)
        lines.append(f'org,h)/{i} 2024 {{"offset": "{len(packed)}", "length": "{len(member)}", "filename": "a.warc.gz"}}')
        packed += member
    for name, index in (("with", True), ("without", False)):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_STORED) as z:
            z.writestr("archive/a.warc.gz", packed)
            z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
            if index:
                z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(["!meta 0", *lines]).encode()))
    for name in ("with", "without"):
        found = warc_zip.read_archives(warc_zip.archive_files(spark, [str(tmp_path / name)])).collect()
        assert sorted((r.id, r.payload_bytes) for r in found) == [(i, i) for i in range(20)]
    with pytest.raises(ValueError):
        list(warc_zip._gzip_members(lambda a, n: packed[:-3][a : a + n], 0, len(packed) - 3))
    assert [len(r) for r in warc_zip.ranges([(0, 5), (5, 5), (10, 90), (100, 1), (102, 1)], 10)] == [2, 1, 1, 1]


def test_zip64_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"first")
        z.writestr("b", b"second")
    data = out.getvalue()
    end = data.rfind(b"PK\x05\x06")
    start, size = int.from_bytes(data[end + 16 : end + 20], "little"), int.from_bytes(data[end + 12 : end + 16], "little")
    wide = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\0" * 12 + (2).to_bytes(8, "little") * 2 + size.to_bytes(8, "little") + start.to_bytes(8, "little")
    locator = b"PK\x06\x07" + b"\0" * 4 + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    big = data[:end] + wide + locator + b"PK\x05\x06" + b"\0" * 4 + b"\xff" * 12 + b"\0\0"
    for archive in (data, big):
        found = warc_zip.members(lambda at, n, a=archive: a[at : at + n], len(archive))
        assert {k: archive[o : o + n] for k, (o, n) in found.items()} == {"a": b"first", "b": b"second"}
    with pytest.raises(ValueError):
        warc_zip.members(lambda at, n: data[: end - 5][at : at + n], end - 5)


def test_decontamination_of_a_head_truncated_item_in_a_later_text():
    item = [f"i{i}" for i in range(40)]
    items = decontamination.Items([7], [" ".join(item)])
    for cut in range(1, 4):
        texts = ["an innocent text of some words", " ".join(item[cut:] + ["and", "more"]), "another one"]
        block = next(decontamination.blocks(pa.array(texts), lower=True))
        found = decontamination._block_hits(block.words, block.offsets, items)
        assert {r: [(h[0], h[3]) for h in hits] for r, hits in found.items()} == {1: [(0, cut)]}


def test_near_dedup_compares_whole_nodes_at_the_last_depth():
    """A chain whose neighbours alone are similar, in a node larger than leaf and in any order, hangs together."""
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 256, BYTES).astype(np.uint8)]
    for i in range(199):
        rows.append(rows[-1].copy())
        rows[-1][[i * 16 % BYTES + j for j in range(16)]] += 1
    order = rng.permutation(200)
    table = pa.table({"key": pa.array([3] * 200, pa.int64()), "node": pa.array(order, pa.int64()), "sketch": pa.array([rows[i].tobytes() for i in order], pa.binary()), "other": pa.nulls(200, pa.int64())})
    edges = [(a, b) for out in _compare(20, BYTES - 20, 0.85, True)(table.to_batches(max_chunksize=33)) for a, b in zip(out["node"].to_pylist(), out["other"].to_pylist(), strict=True)]
    assert len(edges) == 199 and {tuple(sorted(e)) for e in edges} == {(i, i + 1) for i in range(199)}


def test_near_dedup_finds_pairs_in_a_large_family(spark):
    """Pages take two thirds of a template's words, so all words are common and nodes branch many times; each page has one near copy."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(2000):
        order = rng.permutation(156)
        rows += [(2 * i, " ".join(f"t{j}" for j in order[:100])), (2 * i + 1, " ".join(f"t{j}" for j in order[8:108]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in minhash_dedup(docs, similarity=Fraction(85, 100), k=1, leaf=8).collect()}
    assert [d for d in found if found[d] != d // 2 * 2] == []


def test_account_numbers_before_capital_words(spark):
    valid = ["ES9121000418450200051332", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201"]
    texts = [f"{v} {w}" for v in valid for w in ("EUR", "BANK OF", "and", "DE89370400440532013000")] + ["BE68 5390 0754 7035 EUR"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [r.text[x.s : x.e] for x in r.pii if pii.KINDS[x.kind].name == "iban"] for r in pii.find_pii(docs).collect()}
    assert found == {i: [v] + [w] * w.startswith("DE") for i, (v, w) in enumerate((v, w) for v in valid for w in ("EUR", "BANK OF", "and", "DE89370400440532013000"))} | {16: []}


def test_urls_that_are_only_targets_are_judged(spark, same_as_sql):
    link = '<link rel=canonical href="{}">'
    rows = [(1, "http://a.org/x", link.format("http://x.net/es/y")), (2, "http://b.org/p/q", link.format("/r?s#t")), (3, "http://b.org/r?s", '<meta http-equiv="refresh" content="0; url=//m.net/fr/1">'), (4, "http://c.org/d/e/f", link.format("../g")), (5, "http://c.org/d/g", link.format("http://n.net/fr/")), (6, "http://d.org/", link.format("mailto:x@x.net")), (7, "http://e.org/", link.format("/r?u=http://x.net/es/")), (8, "http://f.org/z", link.format("http://ok.net/en/"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r.page_id: r.verdict for r in url_filters.filter_urls(pages).collect()}
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow"}
    logged = spark.createDataFrame([("http://f.org/z", "http://l.net/es/")], "source string, target string")
    assert {r.page_id: r.verdict for r in url_filters.filter_urls(pages, logged).collect()}[8] == "block"
    same_as_sql(url_filters.filter_urls(pages), url_filters.ORACLE_SQL, {"pages": pages.toArrow()})
    same_as_sql(url_filters.filter_urls(pages, logged), url_filters.oracle_sql("SELECT 'http://f.org/z', 'http://l.net/es/'"), {"pages": pages.toArrow()})
    cases = {"/a": "http://h.o/a", "b": "http://h.o/p/b", "./b/../c/": "http://h.o/p/c/", "..": "http://h.o/", "../../../x": "http://h.o/x", "?k": "http://h.o/p/q?k", "#f": "http://h.o/p/q?z", "//o.p/c": "http://o.p/c", "x://y/z": "x://y/z", "mailto:a": None}
    found = spark.createDataFrame([("http://h.o/p/q?z#y", t) for t in cases], "url string, t string").select("t", url_filters.resolved(F.col("url"), F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in found} == cases


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n], out[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_different_words_have_different_hashes(n):
    """Patterns on which sums of powers modulo 2**64 meet, as words and as words' sequences."""
    a, b = thue_morse(n)
    block = next(textkernel.blocks(pa.array([f"{a} {b}", " ".join(a), " ".join(b)])))
    assert block.words[0] != block.words[1]
    spans = textkernel.span_hashes(block.words, block.offsets[1:3], block.offsets[2:4])
    assert spans[0] != spans[1] and textkernel.gram_hashes(block.words[block.offsets[1] : block.offsets[2]], n)[0] != textkernel.gram_hashes(block.words[block.offsets[2] : block.offsets[3]], n)[0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9), st.data())
def test_hashes_of_runs_tell_runs_apart(symbols, k, data):
    x = np.array(symbols, dtype=np.uint64)
    grams = textkernel.gram_hashes(x, k)
    assert len(grams) == max(0, len(x) - k + 1) and all((grams[i] == grams[j]) == (symbols[i : i + k] == symbols[j : j + k]) for i in range(len(grams)) for j in range(i))
    spans = [sorted(data.draw(st.tuples(st.integers(0, len(x)), st.integers(0, len(x))))) for _ in range(8)]
    found = textkernel.span_hashes(x, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert all((found[i] == found[j]) == (symbols[slice(*spans[i])] == symbols[slice(*spans[j])]) for i in range(8) for j in range(i))


def test_windows_that_differ_in_one_long_word_stay(spark):
    a, b = thue_morse(2048)
    head = " ".join(f"q{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{head} {a}"), (2, f"{head} {b}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(docs).collect()} == {0}


def test_substring_dedup_of_many_equal_rows(spark):
    """Rows that are equal in id and text, or repeat one passage within a text, stay linear."""
    rows = spark.range(20_000).selectExpr("cast(null as long) as doc_id", f"'{PASSAGE}' as text").unionAll(spark.range(1).selectExpr("id as doc_id", f"repeat('{PASSAGE} ', 3000) as text"))
    found = substring_dedup(rows, keep_text=False).groupBy("n_words", "n_removed").count().collect()
    assert {tuple(r) for r in found} == {(60, 60, 20_000), (180_000, 180_000, 1)}


def test_all_tags_of_a_page_name_aliases(spark, same_as_sql):
    """Several tags, quoted or not, entities, a base element, dots, empty targets and tags of other kinds."""
    html = {
        1: "<link rel=next href=/n><link data-href='/no' rel='canonical' href='http://a.org/ok'><LINK href=http://x.net/es/1 rel=canonical>",
        2: "<link rel=canonical href='http://c.org/p?a=1&amp;b=2'>",
        3: "<base href='//y.net/fr/'><link rel='canonical' href='./x'>",
        4: "<meta http-equiv='Refresh' content='5;URL=\"http://z.net/es/q\"'>",
        5: "<meta name=description content='0; url=http://z.net/es/q'><link rel=stylesheet href=http://z.net/es/q>",
        6: "<link rel=canonical href=''><link rel=canonical>",
        7: "<base href='http://q.net/fr/a/b'><meta http-equiv=refresh content='0;url=../../en/'>",
        8: "<link rel=\"canonical\" href=' ../../../es/.. '>",
    }
    rows = [(i, f"http://h{i}.org/u/v", h) for i, h in html.items()] + [(9, "http://c.org/p?a=1&b=2", "<link rel=canonical href=http://w.net/es/>"), (10, "http://h10.com/", html[1]), (11, None, html[1]), (12, "no scheme", html[1]), (13, "http://long.org/", "x" * 300_000 + html[4]), (1, "http://h1.org/u/v", html[1]), (14, "http://e.org", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r.page_id: r.verdict for r in url_filters.filter_urls(pages.selectExpr("*", "1 as id", "2 as own", "3 as node", "4 as blocked", "5 as source", "6 as target")).collect()}
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "allow", 12: "allow", 13: "block", 14: "allow"}
    same_as_sql(url_filters.filter_urls(pages), url_filters.ORACLE_SQL, {"pages": pages.toArrow()})


def test_prototypes_and_predictions_against_brute_force(spark):
    """Cosines by plain loops; of equal cosines the first name; repeated rows alike; marks and letters beyond 16 bits are symbols of their own."""
    texts = ["abc abd", "xyz xyz", "हिन्दी में", "ไทยแลนด์", "𐐀𐐁𐐂 𐐀𐐁", "日本語です", None, "", "12", "\u0301\u0302", "abc abd", "q"]
    langs = ["a", "b", "c", "d", "e", "f", "a", "b", None, None, "z", "y"]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))] * 2, "doc_id long, text string, lang string")

    def bundle(text):
        out, last = [], " "
        for c in (text or "").lower():
            keep = c.isalpha() or unicodedata.category(c)[0] == "M"
            if keep or last != " " or not out:
                out.append(ord(c) if keep else 0)
            last = c if keep else " "
        out += [0] if not out or out[-1] else []
        v = language_id.letter_vectors(np.array(out)).astype(int)
        return sum((v[i] * np.roll(v[i + 1], 1) * np.roll(v[i + 2], 2) for i in range(len(v) - 2)), np.zeros(language_id.DIMENSIONS, int))

    sums = {g: sum(2 * bundle(t) for t, x in zip(texts, langs, strict=True) if x == g) for g in sorted(set(langs) - {None})}
    learned = language_id.learn_prototypes(docs)
    assert sorted(learned) == sorted(sums) and all(np.allclose(learned[g], v / max(np.linalg.norm(v), 1e-9), atol=1e-6) for g, v in sums.items())
    found = language_id.identify_language(docs, learned).collect()
    assert len(found) == 2 * len(texts) and len({(r.doc_id, r.lang_pred, r.score) for r in found}) == len(texts)
    by = {r.doc_id: r for r in found}
    assert {by[i].lang_pred for i in (6, 7, 8, 9)} == {"und"} and by[10].lang_pred == by[0].lang_pred == "a"
    for i, t in enumerate(texts):
        b = bundle(t)
        if any(c.isalpha() for c in t or "") and b.any():
            best = max(float(b @ v) / np.linalg.norm(b) / max(np.linalg.norm(v), 1e-9) for v in sums.values())
            assert by[i].score == pytest.approx(min(1, max(0, best)), abs=1e-5)


def test_sharding_of_equal_ids(spark):
    """Equal ids share a shard whatever their text; slots stay gapless, and equal rows get different ones."""
    rows = [(i % 5 if i % 7 else None, f"t{i % 3}") for i in range(210)] + [(9, None)] * 4
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("id", F.lit(2))).collect()
    assert len(found) == 214 and all(len({r.shard for r in found if r.doc_id == i}) == 1 for i in {r.doc_id for r in found})
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_near_dedup_settles_families_where_they_lie(spark, same_as_sql):
    """A family of near copies, some linked only to a few of it, among texts that share its first words; its nodes are hot."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(int(rng.integers(0, 4)) if i % 13 else 5):
            words[int(rng.integers(120))] = f"n{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:25] + [f"o{rng.integers(10**6)}" for _ in range(60)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in ({"leaf": 100, "hot_share": 10**9}, {"leaf": 100, "hot_share": 10**9, "held": 1}):
        same_as_sql(minhash_dedup(docs, similarity=Fraction(85, 100), **settings), NEAR_SQL, {"documents": docs.toArrow()})

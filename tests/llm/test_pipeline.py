from collections import Counter
from fractions import Fraction

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from sparkseg.llm import decontamination, pii
from sparkseg.llm.frames import cut
from sparkseg.llm.sentencepiece_codec import MODEL


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text.split()
    edited = [w for i, w in enumerate(passage) if i % 12 != 5]
    edited[3:3], edited[8] = ["inserted"], "replaced"
    junk = spark.createDataFrame([(90001, "12 34 !", None, None, None), (90002, None, None, None, None), (90003, "Привет мир это русский текст о погоде " * 20, None, None, None), (90004, "zxqv wkjf qqpw vbnm xzcv plok mjnh " * 20, "en", None, None), (90005, "kept", None, None, None), (90006, " ".join(["one", "two", *edited, "three"]), "en", None, None), (90007, " ".join(passage), "en", "x", 1)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "language_id":
            docs = docs.unionByName(junk)
        before = {r.doc_id: r for r in docs.collect()}
        docs = cut(stage(spark, docs, sf_dir))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns
        if name == "language_id":
            assert set(before) - set(after) == {90001, 90002, 90003, 90004} and after[90005].lang is not None
        elif name == "minhash_dedup":
            sets, root = {d: shingle_set(r.text) for d, r in before.items()}, {d: d for d in before}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            ids = sorted(sets)
            for i, a in enumerate(ids):
                for b in ids[i + 1 :]:
                    both = len(sets[a] & sets[b])
                    if both and Fraction(both, len(sets[a] | sets[b])) >= Fraction(4, 5):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
            assert set(after) == {d for d in ids if find(d) == d}
        elif name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(i in " ".join(r.text.lower().split()) for r in after.values() for i in items)
            assert len(after) < len(before) and 90006 in before and 90006 not in after and 90007 not in after and 90005 in after
        else:
            assert set(after) == set(before)
            assert pii.find_pii(docs).where(F.size("pii") > 0).count() == 0
            assert all(r.n_chars == len(r.text) for r in after.values())
    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(out) == docs.count() and all(r.exact and r.ids == reference.encode(after[r.doc_id].text) for r in out)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in out} - {90005}


def test_near_dedup_keeps_null_ids_and_drops_repeats(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 int"
    rows = [(None, "alone here", "en", None, 1, 7), (1, "two of these", "en", None, 1, 9), (1, "two of these", "en", None, 1, 8), (1, "two of these", "en", None, 1, 8), (2, "two of these", "en", None, 1, 9), (3, None, None, None, None, 1)]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, schema), sf_dir).collect()
    assert Counter((r.doc_id, r.k1) for r in out) == Counter({(None, 7): 1, (1, 8): 1, (3, 1): 1})


def test_stages_of_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_pipeline_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert decontamination.op7_decontamination.__name__ in __spark_entry__.queries()

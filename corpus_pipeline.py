"""A corpus pipeline: language, near-duplicates, benchmark passages, personal data, token ids.

Each stage reads what its predecessor wrote.  All but the last return the columns of documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseg.llm.decontamination import find_benchmark
from sparkseg.llm.frames import cut, drop_cut, row_key
from sparkseg.llm.language_id import held_out, identify_language, learn_prototypes
from sparkseg.llm.minhash_dedup import minhash_dedup
from sparkseg.llm.pii import redact_pii
from sparkseg.llm.sentencepiece_codec import encode_texts, load_model

#: Texts of so many characters whose best cosine is below this resemble no learned language: gibberish and other
#: scripts have 0.02 by chance, related languages and lists of numbers up to 0.1, good texts 0.2 and more.
LEAST_COSINE, LEAST_CHARACTERS = 0.12, 200


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too), and those like no learned language; a null lang becomes the predicted one.

    A text of less than LEAST_CHARACTERS has too few trigrams to tell and stays if it has a letter.
    """
    found = identify_language(docs, learn_prototypes(docs.where(~held_out())), out=("__lang", "__score"))
    kept = found.where((F.col("__lang") != "und") & ((F.col("__score") >= LEAST_COSINE) | (F.length("text") < LEAST_CHARACTERS)))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group (a null id only where all are null).  Of rows equal in id and text the one stays whose other columns come first as JSON."""
    keyed = docs.withColumns(dict(zip(("__k1", "__k2"), row_key("doc_id", "text"), strict=True)))
    named = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__k1").alias("k1"), F.col("__k2").alias("k2")).alias("id"), "text")
    kept = minhash_dedup(named, "id", "text", similarity=Fraction(4, 5)).where("kept").select(F.col("id.k1").alias("__k1"), F.col("id.k2").alias("__k2"))
    whole, rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    one = keyed.join(kept, ["__k1", "__k2"], "left_semi").groupBy("__k1", "__k2").agg(F.min_by(whole, F.to_json(rest)).alias("__row"))
    return one.select("__row.*").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name="__hits")
    return found.where(F.size("__hits") == 0).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts marks for personal data and counts the characters again."""
    return redact_pii(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return encode_texts(docs, load_model(spark)).select("doc_id", "lang", "source", "ids", "n_ids", "exact")


STAGES = [("language_id", language_stage), ("minhash_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("sentencepiece", tokens_stage)]

#: SQL can express neither the profiles nor the tokenizer; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if last is not None:
            drop_cut(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

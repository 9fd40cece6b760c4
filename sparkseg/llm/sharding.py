"""Rendezvous hashing over weighted shards.

A key goes to the shard with the largest -weight / ln(u), u being a hash of key and shard in (0, 1).
No draw depends on another shard, so a new shard takes its share from all and nothing else moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots are counted in this many parts of each shard, so that no task numbers a whole shard.
PARTS = 512


def _draw(key: Column, shard: int) -> Column:
    """52 bits of MD5 of key:shard, moved into the open unit interval."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key (as text; null is a key of its own); equal scores go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scores = [F.struct((-F.log(_draw(text, i)) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, grown: float | None = 1.0, parts: int = PARTS) -> DataFrame:
    """Returns the id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot and grown_shard (with one more shard of weight `grown`).

    The id and the weights alone decide the shard, so equal rows share one and equal texts need not.  Slots
    count from 0 in each shard without a gap, by part and then by id; equal ids are told apart by crc and
    size.  A null id is a key of its own, a null text has size 1 and the crc of nothing.  The texts stay
    where they are: only ids and numbers are shuffled.
    """
    weights = [1.0] * 16 if weights is None else weights
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.col("id")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    more = rendezvous(key, [*weights, grown]) if grown else F.lit(None).cast("int")
    part = F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(parts)).cast("int")
    rows = rows.select("*", rendezvous(key, weights).alias("shard"), more.alias("grown_shard"), part.alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", F.expr("sum(n) over (partition by shard order by part) - n").alias("first"))
    number = F.expr("row_number() over (partition by shard, part order by id, text_crc32, size) - 1")
    out = rows.select("*", number.alias("number")).join(F.broadcast(before), ["shard", "part"])  # at most shards x parts rows
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("number")).cast("long").alias("slot"), "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Readers of the two public benchmark layouts, from local or shared files, to one schema, and plain sinks.

benchmark(dataset string, window_size int, cps array<long>, labels array<string>, time_series array<array<double>>):
labels are of segments, and time_series has a row of channels for each point.  Nothing is downloaded.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDOOR = ("x-acc", "y-acc", "z-acc", "x-gyro", "y-gyro", "z-gyro", "x-mag", "y-mag", "z-mag")
OUTDOOR = ("x-acc", "y-acc", "z-acc", "lat", "lon", "speed")
HAS_WINDOW = 50


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.split("value", ",").alias("f"))


def read_tssb(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """desc.txt, properties.txt and <name>.txt of a folder; only the named series' files are read."""
    number = lambda x: F.trim(x).cast("long")
    desc = _lines(spark, f"{folder}/desc.txt").select(F.trim(F.col("f")[0]).alias("dataset"), F.trim(F.col("f")[1]).cast("int").alias("window_size"), F.transform(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))), number).alias("cps"))
    props = _lines(spark, f"{folder}/properties.txt").select(F.trim(F.col("f")[0]).alias("dataset"), number(F.col("f")[2]).alias("cut"), F.transform(F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))), number).alias("raw"))
    both = desc.join(props, "dataset")
    if names is not None:
        both = both.where(F.col("dataset").isin(names))
    kept = [r[0] for r in both.select("dataset").collect()]  # file names of a benchmark of dozens
    if not kept:
        return both.select("dataset", "window_size", "cps", F.array().cast("array<string>").alias("labels"), F.array().cast("array<array<double>>").alias("time_series"))
    raw = spark.read.text([f"{folder}/{n}.txt" for n in kept], wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    values = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: F.array(x.cast("double")))
    series = raw.select(F.url_decode(name).alias("dataset"), values.alias("time_series"))
    labels = F.transform("raw", lambda x: (F.floor(x / (F.col("cut") + 1)) + 1).cast("string"))
    return both.join(series, "dataset").select("dataset", "window_size", "cps", labels.alias("labels"), "time_series")


def point_labels(benchmark: DataFrame) -> DataFrame:
    """(series_id, t, label): a benchmark's segment labels at every point."""
    n = F.size("time_series").cast("long")
    seg = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.col("cps")).alias("start"), F.concat(F.col("cps"), F.array(n)).alias("stop"), F.col("labels").alias("label"))
    one = benchmark.select(F.col("dataset").alias("series_id"), F.explode(seg).alias("s")).where("s.stop > s.start")
    return one.select("series_id", F.explode(F.sequence(F.col("s.start"), F.col("s.stop") - 1)).alias("t"), F.col("s.label").alias("label"))


HAS_COLUMNS = ("group", "subject", "routine", "ts_challenge_id", "change_points", "activities", *INDOOR, "lat", "lon", "speed")


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every CSV member of zipped files, a batch of rows at a time."""
    csv.field_size_limit(1 << 30)
    for batch in batches:
        for content in batch.column("content"):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                for name in sorted(n for n in z.namelist() if n.endswith(".csv")):
                    with z.open(name) as member:
                        rows = csv.DictReader(io.TextIOWrapper(member, encoding="utf-8", newline=""))
                        while part := list(islice(rows, 16)):
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in part], pa.string()) for c in HAS_COLUMNS], names=list(HAS_COLUMNS))


def read_has(spark: SparkSession, path: str) -> DataFrame:
    """The activity benchmark's CSV, plain or zipped; list cells are parsed as JSON, never evaluated."""
    if path.endswith(".zip"):
        raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unzipped, ", ".join(f"`{c}` string" for c in HAS_COLUMNS))
    else:
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    numbers = lambda c: F.from_json(F.translate(F.col(f"`{c}`"), "'", '"'), "array<double>")
    zipped = lambda names: F.transform(F.arrays_zip(*(numbers(c).alias(f"c{i}") for i, c in enumerate(names))), lambda x: F.array(*(x[f"c{i}"] for i in range(len(names)))))
    indoor = F.col("group").startswith("indoor")
    name = F.concat_ws("_", "group", "subject", "routine", "ts_challenge_id")
    return raw.select(
        name.alias("dataset"), F.lit(HAS_WINDOW).alias("window_size"), F.from_json("change_points", "array<long>").alias("cps"), F.from_json(F.translate("activities", "'", '"'), "array<string>").alias("labels"),
        F.when(indoor, zipped(INDOOR)).otherwise(zipped(OUTDOOR)).alias("time_series"),
    )


def benchmark_points(benchmark: DataFrame) -> DataFrame:
    """A benchmark to points(series_id, t, dim, value)."""
    one = benchmark.select(F.col("dataset").alias("series_id"), F.posexplode("time_series").alias("t", "row"))
    return one.select("series_id", F.col("t").cast("long").alias("t"), F.posexplode("row").alias("dim", "value"))


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Results as Parquet, in folders by the given columns."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)

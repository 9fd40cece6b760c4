"""Series as rows: points(series_id, t, dim, value), and the basic operators on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def frame(w: int, *keys: str) -> Window:
    """The window of w points that starts at a row."""
    return Window.partitionBy(*(keys or ("series_id", "dim"))).orderBy("t").rowsBetween(0, w - 1)


def points(df: DataFrame, series: Column | str, order: Column | str, value: Column | str, dim: Column | str | None = None) -> DataFrame:
    """Rows in the order of `order` become points t = 0, 1, ...; null and non-finite values are rejected rows."""
    dim = F.lit(0) if dim is None else F.col(dim) if isinstance(dim, str) else dim
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select(col(series).cast("string").alias("series_id"), col(order).alias("o"), dim.cast("int").alias("dim"), col(value).alias("value"))
    out = out.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & (F.abs(F.col("value").cast("double")) < float("inf")))
    t = F.row_number().over(Window.partitionBy("series_id", "dim").orderBy("o", "value")) - 1
    return out.select("series_id", t.cast("long").alias("t"), "dim", "value")


def from_arrays(df: DataFrame, series: str, values: str) -> DataFrame:
    """One row a series with an array of numbers to points."""
    return df.select(F.col(series).cast("string").alias("series_id"), F.posexplode(values).alias("t", "value")).select("series_id", F.col("t").cast("long").alias("t"), F.lit(0).alias("dim"), F.col("value").cast("double").alias("value"))


def to_arrays(p: DataFrame) -> DataFrame:
    """Points to one row a series and channel, values in order."""
    return p.groupBy("series_id", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("values"))


def dealt(p: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over all shuffle partitions: kernels work far longer than their rows' bytes tell, so small partitions are not to be joined up."""
    return p.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_batches(rows: DataFrame, order: tuple[str, ...], run: Callable[[pd.DataFrame, list[int]], pd.DataFrame], schema: str, most: int = 65_536) -> DataFrame:
    """run(frame, bounds) on whole series at once, in order: series i lies between bounds i and i + 1.

    A call by group costs more than a short series' own work, so a frame holds some `most` rows, or one series that is longer.
    """

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, whole, last = [], 0, 0, None  # frames, their rows, rows before the last series, its name

        def done(frame):
            ids = frame["series_id"].to_numpy(dtype=object)
            return run(frame, [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)])

        for frame in frames:
            if not len(frame):
                continue
            ids = frame["series_id"].to_numpy(dtype=object)
            new = np.flatnonzero(ids[1:] != ids[:-1])
            whole = n + int(new[-1]) + 1 if len(new) else n if n and ids[0] != last else whole
            held.append(frame)
            n, last = n + len(frame), ids[-1]
            if whole >= most:
                frame = pd.concat(held, ignore_index=True)
                yield done(frame[:whole])
                held, n, whole = [frame[whole:].reset_index(drop=True)], n - whole, 0
        if n:
            yield done(pd.concat(held, ignore_index=True))

    return dealt(rows, "series_id").sortWithinPartitions("series_id", *order).mapInPandas(step, schema)


def check_series(p: DataFrame) -> DataFrame:
    """Raises TypeError unless p has the columns of points and a numeric value."""
    missing = {"series_id", "t", "value"} - set(p.columns)
    if missing or not isinstance(p.schema["value"].dataType, NUMERIC):
        raise TypeError(f"not a series: missing {sorted(missing)}" if missing else "a series must be numeric")
    return p


def check_integers(df: DataFrame, column: str) -> DataFrame:
    """Raises TypeError unless a column of change points or labels holds integers."""
    kind = df.schema[column].dataType
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{column} must hold integers")
    return df


def check_excl_radius(k: int, radius: int) -> None:
    if radius <= k:
        raise ValueError("the exclusion radius must be larger than the number of neighbours")


def by_name(df: DataFrame, names: list[str] | None, column: str = "dataset") -> DataFrame:
    return df if names is None else df.where(F.col(column).isin(names))


def channel(p: DataFrame, dim: int) -> DataFrame:
    return p.where(F.col("dim") == dim)


def between(p: DataFrame, low: int, high: int) -> DataFrame:
    """Points low <= t < high."""
    return p.where((F.col("t") >= low) & (F.col("t") < high))


def scaled(p: DataFrame) -> DataFrame:
    """Values to [0, 1] by each series' least and largest; a constant series to 0."""
    w = Window.partitionBy("series_id", "dim")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return p.withColumn("value", F.when(high > low, (F.col("value") - low).cast("double") / (high - low)).otherwise(F.lit(0.0)))


def rolled(p: DataFrame, by: int = -1, fill: float | None = None) -> DataFrame:
    """Values moved by places, as a shift register: -1 takes the next value, and the fill enters at the end."""
    w = Window.partitionBy("series_id", "dim").orderBy("t")
    value = F.lead("value", -by, fill).over(w) if by < 0 else F.lag("value", by, fill).over(w)
    return p.withColumn("value", value)


def windows(p: DataFrame, w: int) -> DataFrame:
    """(series_id, dim, i, window): every full run of w values."""
    out = p.select("series_id", "dim", F.col("t").alias("i"), F.collect_list("value").over(frame(w)).alias("window"))
    return out.where(F.size("window") == w)


def rolling_stats(p: DataFrame, w: int) -> DataFrame:
    """(series_id, dim, i, mean, std, energy, complexity) of every full window.

    std below 0.001 counts as 1.  complexity sums the squared steps at the window's places, so from the
    second window on it holds the step into the window, and 0.00001 more.
    """
    f, order = frame(w), Window.partitionBy("series_id", "dim").orderBy("t")
    stepped = p.withColumn("step", F.coalesce(F.pow(F.col("value") - F.lag("value").over(order), 2), F.lit(0.0)))
    out = stepped.select(
        "series_id", "dim", F.col("t").alias("i"), F.count("value").over(f).alias("n"), F.avg("value").over(f).alias("mean"), F.stddev_pop("value").over(f).alias("std"),
        F.sum(F.col("value") * F.col("value")).over(f).alias("energy"), (F.sum("step").over(f) + 1e-5).alias("complexity"),
    ).where(F.col("n") == w)
    return out.select("series_id", "dim", "i", "mean", F.when(F.col("std") < 1e-3, 1.0).otherwise(F.col("std")).alias("std"), "energy", "complexity")


def dense_states(segments: DataFrame) -> DataFrame:
    """(series_id, start, end, state) to one row a point; each segment is opened on its own, with no join."""
    return segments.where("end > start").select("series_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("t"), "state")


def segments_of(cps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, cp) and (series_id, n) to (series_id, seg_id, start, end)."""
    bounds = cps.select("series_id", F.col("cp").alias("start")).unionAll(lengths.select("series_id", F.lit(0).cast("long").alias("start")))
    w = Window.partitionBy("series_id").orderBy("start")
    out = bounds.join(lengths, "series_id").select("series_id", (F.row_number().over(w) - 1).alias("seg_id"), "start", F.coalesce(F.lead("start").over(w), F.col("n")).alias("end"))
    return out

"""k nearest windows as rows: knn(series_id, i, rank, j, dist), and the score profile from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .series import dealt, rolling_stats, windows


def _znormed(w: int, dot: Column) -> Column:
    a, b = F.col("a"), F.col("b")
    return 2.0 * w * (1 - (dot - w * a["mean"] * b["mean"]) / (w * a["std"] * b["std"]))


def _euclidean(w: int, dot: Column) -> Column:
    return F.col("a.energy") + F.col("b.energy") - 2 * dot


def _complexity(w: int, dot: Column) -> Column:
    x, y = F.col("a.complexity"), F.col("b.complexity")
    return _euclidean(w, dot) * F.greatest(x, y) / F.least(x, y)


#: The registry of distances as Column builders; the kernels hold the same names.
DISTANCES = {"znormed_euclidean_distance": _znormed, "euclidean_distance": _euclidean, "cinvariant_euclidean_distance": _complexity}


#: Windows whose pairs make one group of the join.
JOIN_BLOCK = 128


def self_join(p: DataFrame, w: int, k: int, distance: str = "znormed_euclidean_distance", low: int | None = None, high: int | None = None) -> DataFrame:
    """The theta self-join with top k, declared: for one channel and short series, within [low, high) if given.

    Each pair is made within its series only, and row_number <= k is pushed below the shuffle.  A series'
    pairs are dealt by blocks of JOIN_BLOCK windows, so that one series fills many tasks.  For long series
    use blocked_knn, which holds a block of distances and makes no rows of pairs.
    """
    rule = kernels.pick(DISTANCES, distance, "distance")
    parts = windows(p, w).join(rolling_stats(p, w), ["series_id", "dim", "i"])
    if low is not None:
        parts = parts.where((F.col("i") >= low) & (F.col("i") <= high - w))
    a = parts.select("series_id", F.struct("i", "window", "mean", "std", "energy", "complexity").alias("a"))
    b = parts.select("series_id", F.struct("i", "window", "mean", "std", "energy", "complexity").alias("b"))
    dot = F.aggregate(F.zip_with("a.window", "b.window", lambda x, y: x * y), F.lit(0).cast("double"), lambda s, x: s + x)
    last = parts.groupBy("series_id").agg(F.expr(f"max(i) div {JOIN_BLOCK}").alias("last"))
    a = a.withColumn("block", F.expr(f"a.i div {JOIN_BLOCK}"))
    b = b.join(last, "series_id").select("series_id", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block"))
    pairs = a.join(b, ["series_id", "block"]).where(F.abs(F.col("a.i") - F.col("b.i")) > w // 2)
    d = pairs.select("series_id", F.col("a.i").alias("i"), F.col("b.i").alias("j"), rule(w, dot).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("series_id", "i").orderBy("dist", "j"))
    return d.select("series_id", "i", rank.alias("rank"), "j", "dist").where(F.col("rank") <= k)


def grouped_knn(p: DataFrame, w: int, k: int, distance: str = "znormed_euclidean_distance", constraints: list[tuple[int, int]] | None = None) -> DataFrame:
    """knn rows of every series, any number of channels, by one kernel call a series; dist is z-scored over each row."""

    def run(key, frame):
        x = frame.pivot(index="t", columns="dim", values="value").sort_index().to_numpy(dtype=float)
        if len(x) < w * k:
            return pd.DataFrame({"series_id": pd.Series([], dtype=object), **{c: pd.Series([], dtype="int64") for c in ("tc_id", "i", "rank", "j")}, "dist": pd.Series([], dtype="float64")})
        offsets, dists = kernels.neighbours(x, w, k, distance, constraints)
        l, m, _ = offsets.shape
        idx = [g.ravel() for g in np.mgrid[0:l, 0:m, 0:k]]
        return pd.DataFrame({"series_id": key[0], "tc_id": idx[1], "i": idx[0], "rank": idx[2] + 1, "j": offsets.ravel(), "dist": dists.ravel()})

    return dealt(p, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, tc_id int, i long, rank int, j long, dist double")


def blocked_knn(p: DataFrame, w: int, k: int, distance: str = "znormed_euclidean_distance", block_rows: int = 4096) -> DataFrame:
    """The same rows for long series: each series is packed, and every block of its windows is one row of work, so one series runs as many tasks as it has blocks.

    A task holds one packed series and a bounded block of distances; a series of n points is sent n / block_rows times.
    """
    packed = p.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "dim", "value"))).alias("v"), (F.max("dim") + 1).alias("dims"))
    packed = packed.select("series_id", "dims", F.transform("v", lambda x: x["value"].cast("double")).alias("values")).where(F.size("values") >= F.lit(w * k) * F.col("dims"))
    last = (F.size("values") / F.col("dims")).cast("int") - w
    work = packed.select("*", F.explode(F.sequence(F.lit(0), last, F.lit(block_rows))).alias("first"))
    work = dealt(work, "series_id", "first")

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                x = np.asarray(row.values).reshape(-1, row.dims)
                stop = min(row.first + block_rows, len(x) - w + 1)
                offsets, dists = kernels.neighbours(x, w, k, distance, None, (row.first, stop))
                idx = [g.ravel() for g in np.mgrid[row.first : stop, 0:k]]
                yield pd.DataFrame({"series_id": row.series_id, "tc_id": 0, "i": idx[0], "rank": idx[1] + 1, "j": offsets.ravel(), "dist": dists.ravel()})

    return work.mapInPandas(run, "series_id string, tc_id int, i long, rank int, j long, dist double")


def rolling_dots(p: DataFrame, w: int) -> DataFrame:
    """(series_id, i, j, dot) for i <= j, declared: the products of points a lag apart, summed along each lag."""
    x = p.select("series_id", "t", "value")
    pairs = x.join(x.select("series_id", F.col("t").alias("u"), F.col("value").alias("other")), "series_id").where("u >= t")
    along = Window.partitionBy("series_id", "lag").orderBy("i").rowsBetween(0, w - 1)
    lagged = pairs.select("series_id", F.col("t").alias("i"), (F.col("u") - F.col("t")).alias("lag"), (F.col("value") * F.col("other")).alias("product"))
    out = lagged.select("series_id", "i", "lag", F.sum("product").over(along).alias("dot"), F.count("*").over(along).alias("n")).where(F.col("n") == w)
    return out.select("series_id", "i", (F.col("i") + F.col("lag")).alias("j"), "dot")


def constrain(knn: DataFrame, low: int, high: int, w: int) -> DataFrame:
    """Rows of the windows inside [low, high), counted from low."""
    return knn.where((F.col("i") >= low) & (F.col("i") <= high - w)).withColumn("i", F.col("i") - low).withColumn("j", F.col("j") - low)


def reverse_knn(knn: DataFrame) -> DataFrame:
    """Who has j as a neighbour."""
    return knn.groupBy("series_id", "j").agg(F.array_sort(F.collect_list("i")).alias("of"))


def thresholds(knn: DataFrame, k: int) -> DataFrame:
    """(series_id, i, th): a majority of i's neighbours lies at or after split s if and only if th >= s."""
    return knn.groupBy("series_id", "i").agg(F.element_at(F.sort_array(F.collect_list("j"), asc=False), k // 2 + 1).alias("th"))


def score_profile(th: DataFrame, w: int, m: int, score: str = "roc_auc") -> DataFrame:
    """(series_id, s, score) of every split in [m, l - m + w), from counts at places summed up along s: no pair of split and window is made."""
    if score not in kernels.SCORES:
        raise ValueError(f"unknown score {score!r}; known: {', '.join(kernels.SCORES)}")
    i, t = F.col("i"), F.col("th")
    change = F.array(
        F.struct(F.lit("hit").alias("what"), (F.least(i, t) + 1).alias("s"), F.lit(-1).alias("d")),
        F.struct(F.lit("one").alias("what"), (t + 1).alias("s"), F.lit(-1).alias("d")),
        F.struct(F.lit("zone").alias("what"), F.when(F.greatest(i, t) + 1 <= i + w, F.greatest(i, t) + 1).alias("s"), F.lit(1).alias("d")),
        F.struct(F.lit("zone").alias("what"), F.when(F.greatest(i, t) + 1 <= i + w, i + w + 1).alias("s"), F.lit(-1).alias("d")),
        F.struct(F.lit("at").alias("what"), i.alias("s"), F.lit(0).alias("d")),
    )
    places = th.select("series_id", F.explode(change).alias("c")).select("series_id", "c.*").where("s is not null")
    count = lambda *names: F.sum(F.when(F.col("what").isin(*names), F.col("d")).otherwise(0))
    places = places.groupBy("series_id", "s").agg(count("hit").alias("hit"), count("one", "zone").alias("one"), F.sum(F.when(F.col("what") == "at", 1).otherwise(0)).alias("here"))
    along = Window.partitionBy("series_id").orderBy("s")
    l = F.sum("here").over(Window.partitionBy("series_id"))
    summed = places.select("series_id", "s", l.alias("l"), (l + F.sum("hit").over(along)).alias("p1r"), (l + F.sum("one").over(along)).alias("p1"), "here")
    counts = summed.where("here > 0").withColumn("p0", F.col("l") - F.col("p1")).withColumn("p0r", F.col("l") - F.col("s") - F.col("p1r"))
    counts = counts.where((F.col("s") >= m) & (F.col("s") < F.col("l") - m + w))
    p1r, p1, p0r, p0 = (F.col(c).cast("double") for c in ("p1r", "p1", "p0r", "p0"))
    if score == "roc_auc":
        value = F.when((p1 > 0) & (p0 > 0), (1 + p1r / p1 - p0r / p0) / 2)
    else:
        tp, fp, fn = p0 - p0r, p0r, p1 - p1r
        value = F.when((tp > 0) & (p1r > 0), (2 * tp / (2 * tp + fp + fn) + 2 * p1r / (2 * p1r + fp + fn)) / 2)
    return counts.select("series_id", "s", value.alias("score"))


def best_split(profile: DataFrame) -> DataFrame:
    """(series_id, cp, score): the first of the best splits."""
    best = profile.where("score is not null").groupBy("series_id").agg(F.max_by(F.struct("s", "score"), F.struct("score", -F.col("s"))).alias("b"))
    return best.select("series_id", F.col("b.s").alias("cp"), F.col("b.score").alias("score"))


def critical(threshold: float) -> float:
    """|z| at which twice the normal tail is the threshold, to 8 places."""
    if not 0 < threshold <= 1:
        raise ValueError("a significance threshold is above 0 and at most 1")
    low, high = 0.0, 40.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(middle / math.sqrt(2)) > threshold else (low, middle)
    return round(low, 8)


def validated(th: DataFrame, split: DataFrame, w: int, threshold: float = 1e-15) -> DataFrame:
    """(series_id, cp, score, z, valid): rank sums of the votes on both sides of each split."""
    vote = F.when((F.col("i") >= F.col("cp") - w) & (F.col("i") < F.col("cp")), 1).otherwise((F.col("th") >= F.col("cp")).cast("int"))
    sums = th.join(split, "series_id").select("series_id", "cp", "score", "i", vote.alias("v")).groupBy("series_id", "cp", "score").agg(
        F.count("*").alias("n"), F.sum(1 - F.col("v")).alias("zeros"), F.sum(F.when(F.col("i") < F.col("cp"), F.col("v")).otherwise(0)).alias("left1"))
    n, n1, zeros, left1 = F.col("n").cast("double"), F.col("cp").cast("double"), F.col("zeros").cast("double"), F.col("left1").cast("double")
    total = (n1 - left1) * (zeros + 1) / 2 + left1 * (zeros + n + 1) / 2
    z = (total - n1 * (n + 1) / 2) / F.sqrt(n1 * (n - n1) * (n + 1) / 12)
    return sums.select("series_id", "cp", "score", z.alias("z"), (F.abs(z) >= critical(threshold)).alias("valid"))


def interpolated(profile: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, s, score) without gaps for s < l of (series_id, l): linear inside, constant beyond."""
    grid = lengths.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l").cast("long") - 1)).alias("s"))
    on = grid.join(profile.select("series_id", F.col("s").cast("long").alias("s"), "score"), ["series_id", "s"], "left")
    w = Window.partitionBy("series_id").orderBy("s")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("score").isNotNull(), F.struct("s", "score"))
    on = on.select("series_id", "s", F.last(known, True).over(back).alias("a"), F.first(known, True).over(ahead).alias("b"))
    a, b = F.col("a"), F.col("b")
    line = a["score"] + (b["score"] - a["score"]) * (F.col("s") - a["s"]) / F.when(b["s"] > a["s"], b["s"] - a["s"]).otherwise(1)
    return on.select("series_id", "s", F.coalesce(line, a["score"], b["score"]).alias("score"))


def merged(*profiles: DataFrame) -> DataFrame:
    """The larger score of several profiles at each split."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out.groupBy("series_id", "s").agg(F.max("score").alias("score"))

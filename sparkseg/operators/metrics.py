"""Segmentation and state metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import in_batches


def change_point_distance(truth: DataFrame, found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, distance): summed distance of found change points to the nearest true one, over their number times the length; 6 places."""
    n_true = truth.groupBy("series_id").agg(F.count("*").alias("k"))
    near = nearest(found, truth).where("match is not null").select("series_id", F.abs(F.col("cp") - F.col("match")).alias("d"))
    total = near.groupBy("series_id").agg(F.sum("d").alias("d")).join(n_true, "series_id").join(lengths, "series_id")
    return total.select("series_id", F.round(F.col("d") / (F.col("k") * F.col("n")), 6).alias("distance"))


def covering(truth: DataFrame, found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, covering): each true segment's best overlap (intersection over union), weighted by its length.

    Between neighbouring bounds of either kind lies just the overlap of one true and one found segment, so
    the bounds are put in order once and no segments are paired.
    """
    mark = lambda df, a, b: df.select("series_id", F.col("cp").cast("long").alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = mark(truth, 1, 0).unionAll(mark(found, 0, 1)).unionAll(lengths.select("series_id", F.lit(0).cast("long"), F.lit(1), F.lit(1)))
    both = both.groupBy("series_id", "x").agg(F.max("a").alias("a"), F.max("b").alias("b")).join(lengths, "series_id").where("x >= 0 and x < n")
    order = Window.partitionBy("series_id").orderBy("x")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    at = lambda c: F.when(F.col(c) == 1, F.col("x"))
    ends = {f"s{c}": F.last(at(c), True).over(back) for c in "ab"} | {f"e{c}": F.coalesce(F.first(at(c), True).over(ahead), F.col("n")) for c in "ab"}
    pieces = both.select("series_id", (F.coalesce(F.lead("x").over(order), F.col("n")) - F.col("x")).alias("shared"), *(v.alias(k) for k, v in ends.items()))
    best = pieces.groupBy("series_id", "sa", "ea").agg(F.max(F.col("shared") / (F.greatest("ea", "eb") - F.least("sa", "sb"))).alias("o"))
    return best.groupBy("series_id").agg((F.sum((F.col("ea") - F.col("sa")) * F.col("o")) / F.sum(F.col("ea") - F.col("sa"))).alias("covering"))


def true_positives(truth, found, margin: int = 5) -> list[int]:
    """True change points, ascending, that take a found one within the margin, the nearest (then the least) first; each is taken once."""
    x, out, at = sorted(set(found)), [], 0
    after, before = list(range(len(x) + 1)), list(range(len(x) + 1))  # the first free place from i on, and one more than the last free place below i

    def free(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = i = links[links[i]]
        return i

    for t in sorted(truth):
        while at < len(x) and x[at] < t:
            at += 1
        low, high = free(before, at), free(after, at)
        place = low - 1 if low and (high == len(x) or t - x[low - 1] <= x[high] - t) else high
        if place < len(x) and abs(t - x[place]) <= margin:
            out.append(t)
            after[place], before[place + 1] = place + 1, place
    return out


def f_of(annotations: list, predictions, margin: int = 5, alpha: float = 0.5) -> tuple[float, float, float]:
    """F, precision and recall over annotators; 0 is a change point of all."""
    sets, x = [{0, *a} for a in annotations], {0, *predictions}
    p = len(true_positives(set().union(*sets), x, margin)) / len(x)
    r = sum(len(true_positives(s, x, margin)) / len(s) for s in sets) / len(sets)
    return p * r / (alpha * r + (1 - alpha) * p), p, r


def f_measure(annotations: DataFrame, found: DataFrame, margin: int = 5, alpha: float = 0.5) -> DataFrame:
    """(series_id, annotator, cp) and (series_id, cp) to (series_id, f, precision, recall); a null cp is an annotator without any."""

    notes = annotations.where("annotator is not null").select("series_id", F.col("annotator").cast("string").alias("annotator"), F.col("cp").cast("long").alias("cp"))
    return f_of_marks(notes.unionAll(found.select("series_id", F.lit(None).cast("string"), F.col("cp").cast("long"))), margin, alpha)


def f_of_marks(marks: DataFrame, margin: int = 5, alpha: float = 0.5) -> DataFrame:
    """f_measure of one table (series_id, annotator, cp), where found change points have no annotator."""

    def run(frame, bounds):
        ids, who, cp = frame["series_id"].to_numpy(dtype=object), frame["annotator"].to_numpy(dtype=object), frame["cp"].to_numpy(dtype=float)
        holds = ~np.isnan(cp)
        places = np.where(holds, cp, 0).astype(np.int64).tolist()  # 0 is a change point of all
        start = np.ones(len(frame), dtype=bool)
        start[1:] = (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])
        runs = [*np.flatnonzero(start).tolist(), len(frame)]
        out, i = [], 0
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            sets, found = [], []
            while runs[i] < high:
                part = places[runs[i] : runs[i + 1]]
                if who[runs[i]] is None:
                    found = part
                else:
                    sets.append(part)
                i += 1
            out.append((ids[low], *f_of(sets or [[]], found, margin, alpha)))
        return pd.DataFrame(out, columns=["series_id", "f", "precision", "recall"])

    rows = marks.select(F.col("series_id").cast("string").alias("series_id"), F.col("annotator").cast("string").alias("annotator"), F.col("cp").cast("long").alias("cp"))
    return in_batches(rows, ("annotator",), run, "series_id string, f double, precision double, recall double")


def adjusted_mutual_information(counts: list[tuple[int, int, int]]) -> float:
    """AMI (arithmetic mean) of a contingency table of (truth, prediction, n)."""
    n = sum(c for *_, c in counts)
    a: dict[int, int] = {}
    b: dict[int, int] = {}
    for u, v, c in counts:
        a[u], b[v] = a.get(u, 0) + c, b.get(v, 0) + c
    if len(a) == len(b) == 1 or n == 0:
        return 1.0
    h = lambda m: -sum(c / n * math.log(c / n) for c in m.values())
    mi = sum(c / n * math.log(n * c / (a[u] * b[v])) for u, v, c in counts if c)
    g = math.lgamma
    expected = 0.0
    for x in a.values():
        for y in b.values():
            for c in range(max(1, x + y - n), min(x, y) + 1):
                log = g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1) - g(c + 1) - g(x - c + 1) - g(y - c + 1) - g(n - x - y + c + 1)
                expected += c / n * math.log(n * c / (x * y)) * math.exp(log)
    mean = (h(a) + h(b)) / 2
    return (mi - expected) / (mean - expected) if abs(mean - expected) > 1e-15 else 1.0


def ami(labels: DataFrame) -> DataFrame:
    """(series_id, truth, state) of every point to (series_id, ami): the table is counted first, only it reaches the kernel."""
    table = labels.groupBy("series_id", "truth", "state").agg(F.count("*").alias("n"))

    def run(key, t):
        return pd.DataFrame({"series_id": [key[0]], "ami": [adjusted_mutual_information(list(zip(t["truth"], t["state"], t["n"].astype(int), strict=True)))]})

    return table.groupBy("series_id").applyInPandas(run, "series_id string, ami double")


def summary(scores: DataFrame, column: str) -> DataFrame:
    return scores.agg(F.avg(column).alias("mean"), F.median(column).alias("median"), F.stddev(column).alias("std"), F.count(column).alias("n"))


def dense_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard overlap of two array columns `x` joined by series_id."""
    j = a.join(b.withColumnRenamed("x", "y"), "series_id")
    return j.select("series_id", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("overlap"))


def nearest(left: DataFrame, right: DataFrame, margin: int | None = None) -> DataFrame:
    """(series_id, cp) each with the nearest of right's cp (within the margin, if given), or null; of equals the smaller.

    Both are put in one order, where the nearest is the last before or the first after.
    """
    rows = left.select("series_id", "cp", F.lit(1).alias("asks")).unionAll(right.select("series_id", "cp", F.lit(0)))
    order = Window.partitionBy("series_id").orderBy("cp", "asks")
    known = F.when(F.col("asks") == 0, F.col("cp"))
    rows = rows.select("series_id", "cp", "asks", F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.first(known, True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    match = F.when(F.col("b").isNull() | (F.col("cp") - F.col("a") <= F.col("b") - F.col("cp")), F.col("a")).otherwise(F.col("b"))
    out = rows.where("asks = 1").select("series_id", "cp", match.alias("match"))
    return out if margin is None else out.withColumn("match", F.when(F.abs(F.col("match") - F.col("cp")) <= margin, F.col("match")))

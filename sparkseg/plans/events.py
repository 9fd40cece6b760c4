"""Registered queries over the driver tables: each operator on a real series, with SQL that states the same naively."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import metrics, panel
from ..operators import neighbours as nb
from ..operators import series as se
from ..streaming.online import replayed

W, K, M = 12, 3, 60
EUCLID = "euclidean_distance"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture H: hourly sums of event values in cents, hours without events skipped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return se.points(cents, F.lit("H"), "hour", "cents")


def _scaled_hourly(spark, sf_dir):
    """H in whole tens, as doubles that stay exact through sums of squares."""
    return hourly(spark, sf_dir).withColumn("value", (F.col("value") / 10).cast("long").cast("double"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture U: one series of event values a user."""
    return se.points(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", F.struct("ts", "event_id"), "value")


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture D: quantity by ship day."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_shipdate").agg(F.sum(F.col("l_quantity").cast("double")).alias("q"))
    return se.points(d, F.lit("D"), "l_shipdate", "q")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture E: embeddings as series."""
    return se.from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding")


H_SQL = """h AS (SELECT 'H' AS series_id, row_number() OVER (ORDER BY hour) - 1 AS t, v FROM (SELECT date_trunc('hour', ts) AS hour, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1)),
x AS (SELECT t, CAST(trunc(v / 10.0) AS DOUBLE) AS v FROM h)"""
KNN_SQL = f"""{H_SQL},
w AS MATERIALIZED (SELECT a.t AS i, list(b.v ORDER BY b.t) AS win, max(a.n) AS n FROM (SELECT *, count(*) OVER () AS n FROM x) a JOIN x b ON b.t BETWEEN a.t AND a.t + {W - 1} GROUP BY a.t HAVING count(*) = {W}),
d AS (SELECT a.i, b.i AS j, list_sum(list_transform(list_zip(a.win, b.win), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM w a JOIN w b ON abs(a.i - b.i) > {W // 2}),
knn AS MATERIALIZED (SELECT i, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank, j, dist FROM d QUALIFY rank <= {K})"""
def profile_sql(knn: str, windows: str = "w") -> str:
    """Counts by split of votes and sides, stated naively over every pair of split and window."""
    return f"""{knn},
l AS (SELECT max(i) + 1 AS l FROM {windows}),
s AS (SELECT unnest(range({M}, (SELECT l FROM l) - {M} + {W})) AS s),
v AS (SELECT s, i, CASE WHEN i >= s - {W} AND i < s THEN 1 WHEN 2 * count(*) FILTER (j >= s) > {K} THEN 1 ELSE 0 END AS p, CASE WHEN i >= s THEN 1 ELSE 0 END AS y FROM s, knn GROUP BY s, i),
c AS (SELECT s, count(*) FILTER (p = 1 AND y = 1) AS tn, count(*) FILTER (p = 1 AND y = 0) AS fn, count(*) FILTER (p = 0 AND y = 1) AS fp, count(*) FILTER (p = 0 AND y = 0) AS tp FROM v GROUP BY s)"""


PROFILE_SQL = profile_sql(KNN_SQL)
M_SQL = """e AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL), ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS dim FROM (SELECT DISTINCT event_type FROM events)),
x AS (SELECT dim, row_number() OVER (PARTITION BY dim ORDER BY hour) - 1 AS t, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT DISTINCT hour FROM e) CROSS JOIN ty LEFT JOIN e USING (hour, event_type))"""
MULTI_SQL = f"""{M_SQL}, w AS MATERIALIZED (SELECT a.dim, a.t AS i, list(b.v ORDER BY b.t) AS win FROM x a JOIN x b ON a.dim = b.dim AND b.t BETWEEN a.t AND a.t + {W - 1} GROUP BY a.dim, a.t HAVING count(*) = {W}),
d AS (SELECT a.dim, a.i, b.i AS j, list_sum(list_transform(list_zip(a.win, b.win), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM w a JOIN w b USING (dim)),
m AS (SELECT dim, i, j, CASE WHEN abs(i - j) <= {W // 2} THEN max(d) OVER (PARTITION BY dim, i) ELSE d END AS d FROM d),
z AS (SELECT dim, i, j, (d - avg(d) OVER q) / CASE WHEN stddev_pop(d) OVER q = 0 THEN 1 ELSE stddev_pop(d) OVER q END / (SELECT count(*) FROM ty) AS z FROM m WINDOW q AS (PARTITION BY dim, i)),
t AS (SELECT i, j, list_sum(list(z ORDER BY dim)) AS dist FROM z GROUP BY i, j),
knn AS MATERIALIZED (SELECT i, row_number() OVER (PARTITION BY i ORDER BY round(dist, 11), j) AS rank, j, dist FROM t QUALIFY rank <= {K})"""
AUC_SQL = "CASE WHEN tn + fn > 0 AND fp + tp > 0 THEN round((1 + tn / (tn + fn) - fp / (fp + tp)) / 2, 9) END AS score"


def knn_hourly(spark, sf_dir):
    return nb.self_join(_scaled_hourly(spark, sf_dir), W, K, EUCLID).select("i", "rank", "j", "dist")


def _thresholds(spark, sf_dir):
    """Kept, since a split and its validation read it more than once; three numbers a window."""
    return nb.thresholds(nb.grouped_knn(_scaled_hourly(spark, sf_dir), W, K, EUCLID), K).persist()


def profile_auc(spark, sf_dir):
    return nb.score_profile(_thresholds(spark, sf_dir), W, M).select(F.col("s").cast("long").alias("s"), F.round("score", 9).alias("score"))


def profile_f1(spark, sf_dir):
    return nb.score_profile(_thresholds(spark, sf_dir), W, M, "f1").select(F.col("s").cast("long").alias("s"), F.round("score", 9).alias("score"))


def split_hourly(spark, sf_dir):
    th = _thresholds(spark, sf_dir)
    best = nb.best_split(nb.score_profile(th, W, M))
    return nb.validated(th, best, W).select(F.col("cp").cast("long").alias("cp"), F.round("score", 9).alias("score"), F.round("z", 6).alias("z"), "valid")


def rolling_users(spark, sf_dir):
    r = nb.rolling_stats(users(spark, sf_dir), 10)
    return r.select("series_id", F.col("i").cast("long").alias("i"), *(F.round(c, 6).alias(c) for c in ("mean", "std", "energy", "complexity")))


def scaled_users(spark, sf_dir):
    return se.scaled(users(spark, sf_dir)).select("series_id", "t", F.round("value", 9).alias("value"))


def rolled_users(spark, sf_dir):
    return se.rolled(se.between(users(spark, sf_dir), 5, 40), -1, 0.0).select("series_id", "t", F.round("value", 9).alias("value"))


def suss_scores(spark, sf_dir):
    """Z1 at w = 10 for every user's scaled series, as expressions."""
    p = se.scaled(users(spark, sf_dir))
    whole = p.groupBy("series_id").agg(F.avg("value").alias("gm"), F.stddev_pop("value").alias("gs"), (F.max("value") - F.min("value")).alias("gr"))
    f = se.frame(10)
    part = p.select("series_id", "t", F.count("value").over(f).alias("n"), F.avg("value").over(f).alias("m"), F.stddev_pop("value").over(f).alias("s"), (F.max("value").over(f) - F.min("value").over(f)).alias("r")).where("n = 10 and t > 0")
    d = F.sqrt(F.pow(F.col("m") - F.col("gm"), 2) + F.pow(F.col("s") - F.col("gs"), 2) + F.pow(F.col("r") - F.col("gr"), 2)) / F.sqrt(F.lit(10.0))
    return part.join(whole, "series_id").groupBy("series_id").agg(F.round(F.avg(d), 6).alias("score"))


def window_sizes(spark, sf_dir):
    """All three methods on every embedding, in one pass."""
    return panel.all_window_sizes(vectors(spark, sf_dir)).drop("dim")


def ordered(spark, sf_dir) -> DataFrame:
    """(series_id, t, status, priority, price): the orders of each customer in order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").cast("string").alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.lag("o_orderstatus").over(w).alias("status0"), F.lag("o_orderpriority").over(w).alias("priority0"), F.lag("o_totalprice").over(w).alias("price0"))


def _changes(p: DataFrame, condition: str) -> DataFrame:
    return p.where(f"t > 0 and ({condition})").select("series_id", F.col("t").alias("cp"))


def _truth_found(spark, sf_dir):
    """Changes of order status as truth, and jumps of the price as found change points, of every customer's orders."""
    p = ordered(spark, sf_dir)
    return _changes(p, "status <> status0"), _changes(p, "abs(price - price0) > 200000"), p.groupBy("series_id").agg(F.count("*").alias("n"))


_TF_SQL = """p AS (SELECT CAST(o_custkey AS VARCHAR) AS series_id, row_number() OVER w - 1 AS t, o_orderstatus <> lag(o_orderstatus) OVER w AS status, o_orderpriority <> lag(o_orderpriority) OVER w AS priority, abs(o_totalprice - lag(o_totalprice) OVER w) > 200000 AS price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
tr AS (SELECT series_id, t AS cp FROM p WHERE t > 0 AND status), fo AS (SELECT series_id, t AS cp FROM p WHERE t > 0 AND price), ids AS (SELECT series_id, count(*) AS n FROM p GROUP BY series_id)"""
_COVER_SQL = """ab AS (SELECT series_id, cp AS s FROM tr UNION ALL SELECT series_id, 0 FROM ids), bb AS (SELECT series_id, cp AS s FROM fo UNION ALL SELECT series_id, 0 FROM ids),
a AS (SELECT series_id, s, coalesce(lead(s) OVER (PARTITION BY series_id ORDER BY s), n) AS e FROM ab JOIN ids USING (series_id)), b AS (SELECT series_id, s, coalesce(lead(s) OVER (PARTITION BY series_id ORDER BY s), n) AS e FROM bb JOIN ids USING (series_id)),
o AS (SELECT a.series_id, a.s, a.e, max(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s))) AS o FROM a JOIN b USING (series_id) GROUP BY ALL)"""


def covering(spark, sf_dir):
    return metrics.covering(*_truth_found(spark, sf_dir)).select("series_id", F.round("covering", 9).alias("covering"))


def cp_distance(spark, sf_dir):
    return metrics.change_point_distance(*_truth_found(spark, sf_dir))


def nearest_cp(spark, sf_dir):
    truth, found, _ = _truth_found(spark, sf_dir)
    return metrics.nearest(found, truth, 2)


def score_summary(spark, sf_dir):
    return metrics.summary(covering(spark, sf_dir), "covering").select(*(F.round(c, 6).alias(c) for c in ("mean", "median", "std")), "n")


def _event_states(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return se.points(e.withColumn("state", F.ascii("event_type")), F.col("user_id"), F.struct("ts", "event_id"), "state").select("series_id", "t", F.col("value").cast("int").alias("state"))


def event_segments(spark, sf_dir):
    return panel.collapsed(_event_states(spark, sf_dir)).select("series_id", "seg_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "state")


def event_transitions(spark, sf_dir):
    return panel.transitions(panel.collapsed(_event_states(spark, sf_dir))).select("series_id", "from_state", "to_state", "n", F.round("prob", 9).alias("prob"))


def dense_labels(spark, sf_dir):
    return se.dense_states(panel.collapsed(_event_states(spark, sf_dir))).select("series_id", F.col("t").cast("long").alias("t"), "state")


def state_f1(spark, sf_dir):
    s = _event_states(spark, sf_dir).select(F.col("state").alias("y_true"), guessed().alias("y_pred"))
    return panel.macro_f1(panel.confusion(s)).select(F.round("f1", 9).alias("f1"))


_ES_SQL = "e AS (SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, ascii(event_type) AS state FROM events)"
_RUN_SQL = f"""{_ES_SQL}, g AS (SELECT *, t - row_number() OVER (PARTITION BY series_id, state ORDER BY t) AS grp FROM e),
r AS (SELECT series_id, min(t) AS "start", max(t) + 1 AS "end", state FROM g GROUP BY series_id, state, grp)"""
_U_SQL = "u AS (SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"


def _segmented(p: DataFrame, **settings) -> DataFrame:
    """(series_id, n, change_points, scores) of every series, those without a change point too."""
    cps = panel.segment(p, **settings).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("cp", "score"))).alias("c"))
    out = p.groupBy("series_id").agg(F.count("*").alias("n")).join(cps, "series_id", "left")
    none = F.array().cast("array<long>")
    return out.select("series_id", "n", F.coalesce(F.transform("c", lambda x: x["cp"]), none).alias("change_points"), F.coalesce(F.transform("c", lambda x: F.round(x["score"], 9)), F.array().cast("array<double>")).alias("scores"))


def segment_ensemble(spark, sf_dir):
    """Change points of all user series, and of the hourly series, by the whole method with its random parts."""
    return _segmented(users(spark, sf_dir).unionByName(hourly(spark, sf_dir).withColumn("value", F.col("value").cast("double"))), window_size=5)


def segment_shipped(spark, sf_dir):
    return _segmented(shipped(spark, sf_dir))


def stream_replay(spark, sf_dir):
    """The online segmentation over stored series, point by point: what a stream of them would have made known."""
    p = vectors(spark, sf_dir).unionByName(hourly(spark, sf_dir).withColumn("value", F.col("value").cast("double")))

    def run(frame, bounds):
        ids, value, alike = frame["series_id"].to_numpy(dtype=object), frame["value"].to_numpy(dtype=float), {}
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            alike.setdefault(high - low, []).append(low)
        out = []
        for n, starts in alike.items():
            for some in np.array_split(starts, -(-len(starts) * n // 65_536)):
                found = replayed(np.stack([value[i : i + n] for i in some]), n_timepoints=min(600, max(60, n)), window_size=5)
                out += [(ids[i], n, *f) for i, f in zip(some, found, strict=True)]
        return pd.DataFrame(out, columns=["series_id", "n", "n_change_points", "last_cp"])

    return se.in_batches(p.select("series_id", "t", "value"), ("t",), run, "series_id string, n long, n_change_points long, last_cp long")


def channels(spark, sf_dir) -> DataFrame:
    """Fixture M: hourly counts by event type, one channel each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("hour", "ts").alias("hour"), "event_type")
    types = e.select("event_type").distinct().select("event_type", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("event_type")) - 1).alias("dim"))
    counted = e.groupBy("hour", "event_type").agg(F.count("*").alias("n"))
    grid = e.select("hour").distinct().crossJoin(F.broadcast(types))  # hours x types
    full = grid.join(counted, ["hour", "event_type"], "left").select("hour", "dim", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return se.points(full, F.lit("M"), "hour", "n", "dim").withColumn("value", F.col("value").cast("double"))


def knn_multichannel(spark, sf_dir):
    """Neighbours by the mean of the channels' z-scored distances."""
    return nb.grouped_knn(channels(spark, sf_dir), W, K, EUCLID).select("i", "rank", "j", F.round("dist", 6).alias("dist"))


def multichannel_profile(spark, sf_dir):
    th = nb.thresholds(nb.grouped_knn(channels(spark, sf_dir), W, K, EUCLID), K)
    return nb.score_profile(th, W, M).select(F.col("s").cast("long").alias("s"), F.round("score", 9).alias("score"))


def states_vectors(spark, sf_dir):
    p = vectors(spark, sf_dir)
    cps = p.where("t = 32").select("series_id", F.col("t").alias("cp"))
    return panel.states(p, cps, window_size=8, classifier="quant")


def knn_complexity(spark, sf_dir):
    return nb.self_join(_scaled_hourly(spark, sf_dir), W, K, "cinvariant_euclidean_distance").select("i", "rank", "j", F.round("dist", 3).alias("dist"))


def knn_znormed(spark, sf_dir):
    return nb.self_join(_scaled_hourly(spark, sf_dir), W, K).select("i", "rank", "j", F.round("dist", 6).alias("dist"))


def knn_constrained(spark, sf_dir):
    """Neighbours inside hours 100 to 400, counted from 100."""
    return nb.constrain(nb.self_join(_scaled_hourly(spark, sf_dir), W, K, EUCLID, 100, 400), 100, 400, W).select("i", "rank", "j", "dist")


def reverse_neighbours(spark, sf_dir):
    found = nb.reverse_knn(nb.grouped_knn(_scaled_hourly(spark, sf_dir), W, K, EUCLID))
    return found.select("j", F.array_join("of", ",").alias("of"))


def profile_interpolated(spark, sf_dir):
    """The AUC profile without gaps over all windows."""
    th = _thresholds(spark, sf_dir)
    lengths = th.groupBy("series_id").agg(F.count("*").alias("l"))
    return nb.interpolated(nb.score_profile(th, W, M), lengths).select("s", F.round("score", 9).alias("score"))


def profile_merged(spark, sf_dir):
    """The larger of the AUC and F1 scores of each split."""
    th = _thresholds(spark, sf_dir)
    return nb.merged(nb.score_profile(th, W, M), nb.score_profile(th, W, M, "f1")).select(F.col("s").cast("long").alias("s"), F.round("score", 9).alias("score"))


def online_profile(spark, sf_dir):
    """The online score of each split: windows that start within W of it are left out."""

    def run(key, frame):
        offsets = frame.sort_values(["i", "rank"])["j"].to_numpy().reshape(-1, K)
        p = kernels.stream_profile(offsets, W, M)
        at = np.arange(len(p))[M : len(p) - M]
        return pd.DataFrame({"s": at, "score": np.where(np.isfinite(p[at]), p[at], np.nan)})

    found = nb.grouped_knn(_scaled_hourly(spark, sf_dir), W, K, EUCLID).groupBy("series_id").applyInPandas(run, "s long, score double")
    return found.select("s", F.when(~F.isnan("score"), F.round("score", 9)).alias("score"))


def segment_values(spark, sf_dir):
    """The points of each segment as one array: what a segmentation returns when it isn't asked for change points alone."""
    cuts = users(spark, sf_dir).select("series_id").distinct().select("series_id", F.explode(F.array(F.lit(10).cast("long"), F.lit(25).cast("long"))).alias("cp"))
    p = users(spark, sf_dir)
    bounds = se.segments_of(cuts, p.groupBy("series_id").agg(F.count("*").alias("n"))).where("end > start")
    held = p.join(bounds, "series_id").where("t >= start and t < end").groupBy("series_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("t", F.round("value", 6).alias("value")))).alias("v"))
    return held.select("series_id", F.col("seg_id").cast("int").alias("seg_id"), F.size("v").cast("long").alias("n"), F.element_at("v", 1)["value"].alias("first"), F.element_at("v", -1)["value"].alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["value"]), 4).alias("total"))


def labelled_windows(spark, sf_dir):
    """Windows of user series that change their state at point 25."""
    p = users(spark, sf_dir)
    segments = se.segments_of(p.select("series_id").distinct().withColumn("cp", F.lit(25).cast("long")), p.groupBy("series_id").agg(F.count("*").alias("n"))).withColumn("state", F.col("seg_id").cast("int"))
    w = panel.labelled_windows(p, segments, 10)
    return w.select("series_id", F.col("i").cast("long").alias("i"), "state", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def state_confusion(spark, sf_dir):
    s = _event_states(spark, sf_dir).select(F.col("state").alias("y_true"), guessed().alias("y_pred"))
    return panel.confusion(s)


def state_scores(spark, sf_dir):
    """Confusion of the cross-validated window classifier on embeddings cut in two."""
    p = vectors(spark, sf_dir)
    return panel.state_scores(p, p.where("t = 32").select("series_id", F.col("t").alias("cp")), "freshprince", 8)


def f_measure(spark, sf_dir):
    """Price jumps against two annotators: changes of status, and of priority."""
    p = ordered(spark, sf_dir)
    # an annotator without any change still counts
    mark = lambda who, changed: F.when(F.expr(f"t = 0 or {changed}"), F.struct(F.lit(who).cast("string").alias("annotator"), F.when(F.col("t") > 0, F.col("t")).alias("cp")))
    marks = p.select("series_id", F.explode(F.array(mark(0, "status <> status0"), mark(1, "priority <> priority0"), mark(None, "abs(price - price0) > 200000"))).alias("m")).where("m is not null").select("series_id", "m.annotator", "m.cp")
    return metrics.f_of_marks(marks, 1).select("series_id", *(F.round(c, 9).alias(c) for c in ("f", "precision", "recall")))


def guessed():
    """A second opinion on states: every fourth is another."""
    return F.when(F.col("t") % 4 == 0, F.lit(112)).otherwise(F.col("state"))


def mutual_information(spark, sf_dir):
    s = _event_states(spark, sf_dir).select("series_id", F.col("state").alias("truth"), guessed().alias("state"))
    return metrics.ami(s).select("series_id", F.round("ami", 6).alias("ami"))


QUERIES = {
    "knn_self_join": knn_hourly, "profile_roc_auc": profile_auc, "profile_f1": profile_f1, "split_validated": split_hourly, "rolling_stats": rolling_users, "min_max_scaled": scaled_users, "rolled_slice": rolled_users, "suss_scores": suss_scores,
    "window_sizes": window_sizes, "covering": covering, "cp_distance": cp_distance, "nearest_cp": nearest_cp, "score_summary": score_summary, "event_segments": event_segments, "state_transitions": event_transitions, "dense_states": dense_labels, "macro_f1": state_f1,
    "segment_ensemble": segment_ensemble, "segment_long": segment_shipped, "multichannel_profile": multichannel_profile, "detect_states": states_vectors, "stream_replay": stream_replay,
    "knn_multichannel": knn_multichannel, "knn_complexity": knn_complexity, "knn_znormed": knn_znormed, "knn_constrained": knn_constrained, "reverse_knn": reverse_neighbours, "profile_interpolated": profile_interpolated, "profile_merged": profile_merged, "online_profile": online_profile,
    "segment_values": segment_values, "labelled_windows": labelled_windows, "state_confusion": state_confusion, "state_scores": state_scores, "f_measure": f_measure, "mutual_information": mutual_information,
}

ORACLE_SQL = {
    "knn_self_join": f"WITH {KNN_SQL} SELECT i, CAST(rank AS INT) AS rank, j, dist FROM knn",
    "profile_roc_auc": f"WITH {PROFILE_SQL} SELECT s, CASE WHEN tn + fn > 0 AND fp + tp > 0 THEN round((1 + tn / (tn + fn) - fp / (fp + tp)) / 2, 9) END AS score FROM c",
    "profile_f1": f"WITH {PROFILE_SQL} SELECT s, CASE WHEN tp > 0 AND tn > 0 THEN round((2.0::DOUBLE * tp / (2 * tp + fp + fn) + 2.0::DOUBLE * tn / (2 * tn + fp + fn)) / 2, 9) END AS score FROM c",
    "split_validated": f"""WITH {PROFILE_SQL}, b AS (SELECT s, (1 + tn / (tn + fn) - fp / (fp + tp)) / 2 AS score FROM c WHERE tn + fn > 0 AND fp + tp > 0 ORDER BY score DESC, s LIMIT 1),
q AS (SELECT b.s, score, avg_rank, y FROM b JOIN (SELECT s, y, (rank() OVER (PARTITION BY s ORDER BY p) + rank() OVER (PARTITION BY s ORDER BY p) + count(*) OVER (PARTITION BY s, p) - 1) / 2 AS avg_rank FROM v) USING (s)),
z AS (SELECT s, score, count(*) AS n, sum(avg_rank) FILTER (y = 0) AS r FROM q GROUP BY s, score), f AS (SELECT s, score, (r - s * (n + 1) / 2) / sqrt(CAST(s AS DOUBLE) * (n - s) * (n + 1) / 12) AS z FROM z)
SELECT s AS cp, round(score, 9) AS score, round(z, 6) AS z, abs(z) >= 8.02685888 AS valid FROM f""",
    "rolling_stats": f"""WITH {_U_SQL}, d AS (SELECT *, coalesce(power(v - lag(v) OVER (PARTITION BY series_id ORDER BY t), 2), 0) AS step FROM u)
SELECT a.series_id, a.t AS i, round(avg(b.v), 6) AS mean, round(CASE WHEN stddev_pop(b.v) < 0.001 THEN 1 ELSE stddev_pop(b.v) END, 6) AS std, round(sum(b.v * b.v), 6) AS energy, round(sum(b.step) + 1e-5, 6) AS complexity
FROM d a JOIN d b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 9 GROUP BY a.series_id, a.t HAVING count(*) = 10""",
    "min_max_scaled": f"WITH {_U_SQL} SELECT series_id, t, round(CASE WHEN max(v) OVER s > min(v) OVER s THEN (v - min(v) OVER s) / (max(v) OVER s - min(v) OVER s) ELSE 0 END, 9) AS value FROM u WINDOW s AS (PARTITION BY series_id)",
    "rolled_slice": f"WITH {_U_SQL}, k AS (SELECT * FROM u WHERE t >= 5 AND t < 40) SELECT a.series_id, a.t, round(coalesce(b.v, 0), 9) AS value FROM k a LEFT JOIN k b ON a.series_id = b.series_id AND b.t = a.t + 1",
    "suss_scores": f"""WITH {_U_SQL}, z AS (SELECT series_id, t, (v - min(v) OVER s) / (max(v) OVER s - min(v) OVER s) AS v FROM u WINDOW s AS (PARTITION BY series_id)),
g AS (SELECT series_id, avg(v) AS gm, stddev_pop(v) AS gs, max(v) - min(v) AS gr FROM z GROUP BY series_id),
p AS (SELECT a.series_id, a.t, avg(b.v) AS m, stddev_pop(b.v) AS s, max(b.v) - min(b.v) AS r FROM z a JOIN z b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 9 WHERE a.t > 0 GROUP BY a.series_id, a.t HAVING count(*) = 10)
SELECT series_id, round(avg(sqrt(power(m - gm, 2) + power(s - gs, 2) + power(r - gr, 2)) / sqrt(10.0::DOUBLE)), 6) AS score FROM p JOIN g USING (series_id) GROUP BY series_id""",
    "covering": f"WITH {_TF_SQL}, {_COVER_SQL} SELECT series_id, round(sum((e - s) * o) / sum(e - s), 9) AS covering FROM o GROUP BY series_id",
    "score_summary": f"WITH {_TF_SQL}, {_COVER_SQL}, q AS (SELECT series_id, sum((e - s) * o) / sum(e - s) AS c FROM o GROUP BY series_id) SELECT round(avg(round(c, 9)), 6) AS mean, round(median(round(c, 9)), 6) AS median, round(stddev(round(c, 9)), 6) AS std, count(*) AS n FROM q",
    "cp_distance": f"WITH {_TF_SQL}, d AS (SELECT fo.series_id, fo.cp, min(abs(fo.cp - tr.cp)) AS d FROM fo JOIN tr USING (series_id) GROUP BY ALL), k AS (SELECT series_id, count(*) AS k FROM tr GROUP BY 1) SELECT series_id, round(sum(d) / (k * n), 6) AS distance FROM d JOIN k USING (series_id) JOIN ids USING (series_id) GROUP BY series_id, k, n",
    "nearest_cp": f"WITH {_TF_SQL} SELECT fo.series_id, fo.cp, (SELECT arg_min(tr.cp, abs(tr.cp - fo.cp) * 10000 + tr.cp) FROM tr WHERE tr.series_id = fo.series_id AND abs(tr.cp - fo.cp) <= 2) AS match FROM fo",
    "event_segments": f'WITH {_RUN_SQL} SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY "start") - 1 AS INT) AS seg_id, "start", "end", state FROM r',
    "state_transitions": f"""WITH {_RUN_SQL}, n AS (SELECT series_id, state AS from_state, lead(state) OVER (PARTITION BY series_id ORDER BY "start") AS to_state FROM r), c AS (SELECT series_id, from_state, to_state, count(*) AS n FROM n WHERE to_state IS NOT NULL GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY series_id, from_state), 9) AS prob FROM c""",
    "dense_states": f"WITH {_ES_SQL} SELECT series_id, t, state FROM e",
    "macro_f1": f"""WITH {_ES_SQL}, y AS (SELECT state AS a, CASE WHEN t % 4 = 0 THEN 112 ELSE state END AS b FROM e), k AS (SELECT a AS c FROM y UNION SELECT b FROM y)
SELECT round(avg(f), 9) AS f1 FROM (SELECT c, 2.0::DOUBLE * count(*) FILTER (a = c AND b = c) / (count(*) FILTER (a = c) + count(*) FILTER (b = c)) AS f FROM k, y GROUP BY c)""",
    "knn_complexity": f"""WITH {H_SQL}, g AS (SELECT *, coalesce(power(v - lag(v) OVER (ORDER BY t), 2), 0) AS step FROM x),
w AS MATERIALIZED (SELECT a.t AS i, list(b.v ORDER BY b.t) AS win, sum(b.step) + 1e-5 AS ce FROM g a JOIN g b ON b.t BETWEEN a.t AND a.t + {W - 1} GROUP BY a.t HAVING count(*) = {W}),
d AS (SELECT a.i, b.i AS j, list_sum(list_transform(list_zip(a.win, b.win), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * greatest(a.ce, b.ce) / least(a.ce, b.ce) AS dist FROM w a JOIN w b ON abs(a.i - b.i) > {W // 2})
SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY dist, j) AS INT) AS rank, j, round(dist, 3) AS dist FROM d QUALIFY rank <= {K}""",
    "knn_znormed": f"""WITH {H_SQL}, w AS MATERIALIZED (SELECT a.t AS i, list(b.v ORDER BY b.t) AS win, avg(b.v) AS m, CASE WHEN stddev_pop(b.v) < 0.001 THEN 1 ELSE stddev_pop(b.v) END AS s FROM x a JOIN x b ON b.t BETWEEN a.t AND a.t + {W - 1} GROUP BY a.t HAVING count(*) = {W}),
d AS (SELECT a.i, b.i AS j, 2.0::DOUBLE * {W} * (1 - (list_dot_product(a.win, b.win) - {W} * a.m * b.m) / ({W} * a.s * b.s)) AS dist FROM w a JOIN w b ON abs(a.i - b.i) > {W // 2})
SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY dist, j) AS INT) AS rank, j, round(dist, 6) AS dist FROM d QUALIFY rank <= {K}""",
    "knn_constrained": f"WITH {KNN_SQL}, q AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank, j, dist FROM d WHERE i BETWEEN 100 AND {400 - W} AND j BETWEEN 100 AND {400 - W} QUALIFY rank <= {K}) SELECT i - 100 AS i, CAST(rank AS INT) AS rank, j - 100 AS j, dist FROM q",
    "reverse_knn": f"WITH {KNN_SQL} SELECT j, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS \"of\" FROM knn GROUP BY j",
    "profile_interpolated": f"""WITH {PROFILE_SQL}, a AS (SELECT s, CASE WHEN tn + fn > 0 AND fp + tp > 0 THEN (1 + tn / (tn + fn) - fp / (fp + tp)) / 2 END AS y FROM c), k AS (SELECT s, y FROM a WHERE y IS NOT NULL),
b AS (SELECT i AS s, (SELECT max(s) FROM k WHERE k.s <= w.i) AS lo, (SELECT min(s) FROM k WHERE k.s >= w.i) AS hi FROM w)
SELECT b.s, round(CASE WHEN lo IS NULL THEN h.y WHEN hi IS NULL OR lo = hi THEN l.y ELSE l.y + (h.y - l.y) * (b.s - lo) / (hi - lo) END, 9) AS score FROM b LEFT JOIN k l ON l.s = lo LEFT JOIN k h ON h.s = hi""",
    "profile_merged": f"WITH {PROFILE_SQL} SELECT s, round(greatest(CASE WHEN tn + fn > 0 AND fp + tp > 0 THEN (1 + tn / (tn + fn) - fp / (fp + tp)) / 2 END, CASE WHEN tp > 0 AND tn > 0 THEN (2.0::DOUBLE * tp / (2 * tp + fp + fn) + 2.0::DOUBLE * tn / (2 * tn + fp + fn)) / 2 END), 9) AS score FROM c",
    "online_profile": f"""WITH {KNN_SQL}, l AS (SELECT max(i) + 1 AS l FROM w), s AS (SELECT unnest(range({M}, (SELECT l FROM l) - {M})) AS s),
v AS (SELECT s, i, 2 * count(*) FILTER (j >= s) > {K} AS p, i >= s AS y FROM s, knn WHERE i < s OR i >= s + {W} GROUP BY s, i),
c AS (SELECT s, count(*) FILTER (p AND y) AS tn, count(*) FILTER (p AND NOT y) AS fn, count(*) FILTER (NOT p AND y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tp FROM v GROUP BY s)
SELECT s, CASE WHEN tp > 0 AND tn > 0 THEN round((2.0::DOUBLE * tp / (2 * tp + fp + fn) + 2.0::DOUBLE * tn / (2 * tn + fp + fn)) / 2, 9) END AS score FROM c""",
    "segment_values": f"""WITH {_U_SQL}, g AS (SELECT series_id, t, round(v, 6) AS v, CAST(CASE WHEN t < 10 THEN 0 WHEN t < 25 THEN 1 ELSE 2 END AS INT) AS seg_id FROM u)
SELECT series_id, seg_id, count(*) AS n, arg_min(v, t) AS first, arg_max(v, t) AS last, round(sum(v), 4) AS total FROM g GROUP BY series_id, seg_id""",
    "labelled_windows": f"""WITH {_U_SQL} SELECT a.series_id, a.t AS i, CAST(a.t >= 25 AS INT) AS state, round(sum(b.v), 6) AS total FROM u a JOIN u b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 9
WHERE a.t % 5 = 0 AND NOT a.t BETWEEN 21 AND 24 GROUP BY a.series_id, a.t HAVING count(*) = 10""",
    "knn_multichannel": f"WITH {MULTI_SQL} SELECT i, CAST(rank AS INT) AS rank, j, round(dist, 6) AS dist FROM knn",
    "multichannel_profile": f"WITH {profile_sql(MULTI_SQL)} SELECT s, {AUC_SQL} FROM c",
    "f_measure": f"""WITH RECURSIVE {_TF_SQL}, a AS (SELECT series_id, k, list_sort(list_distinct([0::BIGINT] || coalesce(list(t) FILTER (t > 0 AND CASE k WHEN 0 THEN status WHEN 1 THEN priority ELSE status OR priority END), []))) AS truth, list_sort(list_distinct([0::BIGINT] || coalesce(list(t) FILTER (t > 0 AND price), []))) AS found FROM p, range(3) r(k) GROUP BY series_id, k),
g AS (SELECT series_id, k, 1 AS pos, found AS free, 0 AS hits, truth FROM a UNION ALL
SELECT series_id, k, pos + 1, CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda x: x <> best) END, hits + CASE WHEN best IS NULL THEN 0 ELSE 1 END, truth
FROM (SELECT *, list_min(list_transform(list_filter(free, lambda x: abs(x - truth[pos]) <= 1), lambda x: abs(x - truth[pos]) * 1000000 + x)) % 1000000 AS best FROM g WHERE pos <= len(truth))),
h AS (SELECT series_id, k, max(hits) AS hits FROM g GROUP BY series_id, k),
q AS (SELECT series_id, max(hits / len(found)) FILTER (k = 2) AS p, avg(hits / len(truth)) FILTER (k < 2) AS r FROM h JOIN a USING (series_id, k) GROUP BY series_id)
SELECT series_id, round(p * r / (0.5::DOUBLE * r + 0.5::DOUBLE * p), 9) AS f, round(p, 9) AS precision, round(r, 9) AS recall FROM q""",
    "mutual_information": f"""WITH {_ES_SQL}, c AS (SELECT series_id, state AS u, CASE WHEN t % 4 = 0 THEN 112 ELSE state END AS v, count(*) AS n FROM e GROUP BY ALL),
a AS (SELECT series_id, u, sum(n)::DOUBLE AS x FROM c GROUP BY ALL), b AS (SELECT series_id, v, sum(n)::DOUBLE AS y FROM c GROUP BY ALL), s AS (SELECT series_id, sum(n)::DOUBLE AS n FROM c GROUP BY ALL),
h AS (SELECT series_id, (SELECT -sum(x / s.n * ln(x / s.n)) FROM a WHERE a.series_id = s.series_id) AS ha, (SELECT -sum(y / s.n * ln(y / s.n)) FROM b WHERE b.series_id = s.series_id) AS hb, (SELECT count(*) FROM a WHERE a.series_id = s.series_id) AS ka, (SELECT count(*) FROM b WHERE b.series_id = s.series_id) AS kb FROM s),
i AS (SELECT series_id, sum(c.n / s.n * ln(s.n * c.n / (x * y))) AS mi FROM c JOIN a USING (series_id, u) JOIN b USING (series_id, v) JOIN s USING (series_id) GROUP BY series_id),
k AS (SELECT series_id, x, y, n, unnest(range(CAST(greatest(1, x + y - n) AS BIGINT), CAST(least(x, y) AS BIGINT) + 1))::DOUBLE AS k FROM a JOIN b USING (series_id) JOIN s USING (series_id)),
m AS (SELECT series_id, sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS emi FROM k GROUP BY series_id)
SELECT series_id, round(CASE WHEN ka = 1 AND kb = 1 OR abs((ha + hb) / 2 - emi) <= 1e-15 THEN 1 ELSE (mi - emi) / ((ha + hb) / 2 - emi) END, 6) AS ami FROM h JOIN i USING (series_id) JOIN m USING (series_id)""",
    "state_confusion": f"WITH {_ES_SQL} SELECT state AS y_true, CASE WHEN t % 4 = 0 THEN 112 ELSE state END AS y_pred, count(*) AS n FROM e GROUP BY ALL",
}

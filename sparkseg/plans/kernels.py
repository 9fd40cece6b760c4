"""Registered queries of the kernels and of what needs whole series at once, with SQL that states the same naively."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import metrics, panel
from ..operators import neighbours as nb
from ..operators import series as se
from ..streaming.stream import stream_change_points
from . import events as ev
from .events import EUCLID, KNN_SQL, K, M, W

RANGES = ((0, 300), (100, 400), (250, 500))


def array_points(spark, sf_dir):
    """Arrays of numbers as points."""
    return ev.vectors(spark, sf_dir).select("series_id", "t", "value")


def named_channel(spark, sf_dir):
    """One channel of series with some names, checked."""
    named = se.by_name(se.check_series(ev.channels(spark, sf_dir)), ["M", "N"], "series_id")
    return se.channel(se.check_integers(named, "t"), 2).select("series_id", "t", "value")


def knn_row_blocks(spark, sf_dir):
    """Neighbours of one series by blocks of its windows, each a task of its own."""
    return nb.blocked_knn(ev._scaled_hourly(spark, sf_dir), W, K, EUCLID, 100).select("i", "rank", "j")


def rolling_dots(spark, sf_dir):
    """Dot products of all pairs of windows of the hourly series, summed along each lag."""
    return nb.rolling_dots(ev._scaled_hourly(spark, sf_dir), W).select("i", "j", "dot")


def knn_ranges(spark, sf_dir):
    """Neighbours inside several ranges of hours at once."""
    found = nb.grouped_knn(ev._scaled_hourly(spark, sf_dir), W, K, EUCLID, list(RANGES))
    inside = F.lit(False)
    for c, (low, high) in enumerate(RANGES):
        inside = inside | ((F.col("tc_id") == c) & (F.col("i") >= low) & (F.col("i") < high))
    return found.where(inside).select("tc_id", "i", "rank", "j")


def ensemble_parts(spark, sf_dir):
    """The best of the profiles of three parts of the hourly series, each averaged with its share."""

    def run(key, frame):
        x = frame.sort_values("t")["value"].to_numpy(dtype=float)[:, None]
        fit = kernels.ensemble(x, W, K, EUCLID, "roc_auc", M // W, 0, False, None, 0.0, 0, [(0, 520), *RANGES])
        at = np.flatnonzero(np.isfinite(fit.profile))
        return pd.DataFrame({"low": fit.low, "high": fit.high, "s": at, "score": fit.profile[at]})

    found = ev._scaled_hourly(spark, sf_dir).where("t < 520").groupBy("series_id").applyInPandas(run, "low long, high long, s long, score double")
    return found.select("low", "high", "s", F.round("score", 9).alias("score"))


def segment_panel(spark, sf_dir):
    """Change points of all user series in cents: best first, whole ranges only, by a least score."""
    p = ev.users(spark, sf_dir).withColumn("value", F.round(F.col("value") * 100))
    found = panel.segment(p, n_estimators=1, window_size=5, distance=EUCLID, validation="score_threshold", threshold=0.75)
    return found.select("series_id", "cp", F.round("score", 9).alias("score"))


def segment_arrays(spark, sf_dir):
    """The points of each segment of the same segmentation as one array."""
    p = ev.users(spark, sf_dir).withColumn("value", F.round(F.col("value") * 100))
    cps = panel.segment(p, n_estimators=1, window_size=5, distance=EUCLID, validation="score_threshold", threshold=0.75).select("series_id", "cp")
    held = panel.segment_arrays(p, cps)
    return held.select("series_id", F.col("seg_id").cast("int").alias("seg_id"), F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("values", 1).alias("first"))


def channel_window_sizes(spark, sf_dir):
    """The window size of the hourly counts: the least of max(3, half the dominant period) over channels."""
    return panel.window_sizes(ev.channels(spark, sf_dir), "fft")


def change_sets(spark, sf_dir):
    """Jaccard overlap of the sets of true and found change points of each customer."""
    truth, found, n = ev._truth_found(spark, sf_dir)
    whole = lambda df: df.unionAll(n.select("series_id", F.lit(0).cast("long"))).groupBy("series_id").agg(F.collect_set("cp").alias("x"))
    return metrics.dense_overlap(whole(truth), whole(found)).select("series_id", F.round("overlap", 9).alias("overlap"))


def classification_gain(spark, sf_dir):
    return panel.classification_gain(ev.state_confusion(spark, sf_dir)).select(F.round("gain", 9).alias("gain"))


def merged_states(spark, sf_dir):
    """States of users' events, merged where every fourth label is wrong: numbers from 1."""
    s = ev._event_states(spark, sf_dir)
    pairs = s.select("series_id", F.col("state").alias("y_true"), ev.guessed().alias("y_pred")).groupBy("series_id", "y_true", "y_pred").agg(F.count("*").alias("n"))
    return panel.merged_states(pairs)


def process_nodes(spark, sf_dir):
    nodes = panel.process_nodes(panel.collapsed(ev._event_states(spark, sf_dir)))
    return nodes.select("series_id", "state", "n", "points", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def stream_users(spark, sf_dir):
    """Change points of all users' and the hourly series through a stream with state, in three micro-batches of rising times."""
    folder = _scratch(spark)
    points = ev.users(spark, sf_dir).unionByName(ev.hourly(spark, sf_dir).withColumn("value", F.col("value").cast("double"))).select("series_id", "t", "value")
    for part in ("t < 30", "t >= 30 and t < 200", "t >= 200"):
        points.where(part).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema("series_id string, t long, value double").parquet(f"{folder}/in")
        found = stream_change_points(source, n_timepoints=48, window_size=5, jump=1, validation="score_threshold", threshold=0.5, k_neighbours=1, excl_radius=2)
        found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("series_id string, t long, change_point long, score double").parquet(f"{folder}/out")


def _scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one; only a session within one machine may go without that."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


QUERIES = {
    f.__name__: f
    for f in (array_points, named_channel, knn_row_blocks, rolling_dots, knn_ranges, ensemble_parts, segment_panel, segment_arrays, channel_window_sizes, change_sets, classification_gain, merged_states, process_nodes, stream_users)
}


def _range_profiles(ranges: str, points: str, w: int, k: int, m: int) -> str:
    """CTEs from ranges (r, series_id, lo, hi) and points (series_id, t, v): knn by range, counts, and the AUC of every split (r, series_id, lo, hi, s, auc)."""
    return f"""xw AS MATERIALIZED (SELECT a.series_id, a.t AS i, list(b.v ORDER BY b.t) AS win FROM {points} a JOIN {points} b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + {w - 1} GROUP BY a.series_id, a.t HAVING count(*) = {w}),
xd AS MATERIALIZED (SELECT a.series_id, a.i, b.i AS j, list_sum(list_transform(list_zip(a.win, b.win), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM xw a JOIN xw b ON a.series_id = b.series_id AND abs(a.i - b.i) > {w // 2}),
{_split(ranges, "1", w, k, m)}"""


def _split(ranges: str, tag: str, w: int, k: int, m: int) -> str:
    return f"""k{tag} AS (SELECT r, lo, hi, series_id, i - lo AS i, j - lo AS j FROM {ranges} JOIN xd USING (series_id) WHERE i BETWEEN lo AND hi - {w} AND j BETWEEN lo AND hi - {w} QUALIFY row_number() OVER (PARTITION BY r, series_id, lo, hi, i ORDER BY dist, j) <= {k}),
s{tag} AS (SELECT r, series_id, lo, hi, unnest(range({m}, hi - lo - {w} + 1 - {m} + {w})) AS s FROM {ranges}),
v{tag} AS (SELECT r, series_id, lo, hi, s, i, CASE WHEN i >= s - {w} AND i < s THEN 1 WHEN 2 * count(*) FILTER (j >= s) > {k} THEN 1 ELSE 0 END AS p, CASE WHEN i >= s THEN 1 ELSE 0 END AS y FROM s{tag} JOIN k{tag} USING (r, series_id, lo, hi) GROUP BY r, series_id, lo, hi, s, i),
c{tag} AS (SELECT r, series_id, lo, hi, s, count(*) FILTER (p = 1 AND y = 1) AS tn, count(*) FILTER (p = 1 AND y = 0) AS fn, count(*) FILTER (p = 0 AND y = 1) AS fp, count(*) FILTER (p = 0 AND y = 0) AS tp FROM v{tag} GROUP BY r, series_id, lo, hi, s),
a{tag} AS (SELECT r, series_id, lo, hi, s, (1 + tn / (tn + fn) - fp / (fp + tp)) / 2 AS auc FROM c{tag} WHERE tn + fn > 0 AND fp + tp > 0)"""


#: Best-first search with two levels, so at most two change points: enough for users of up to 99 points, as in the test tables; where a third has room, the kernel finds it and this does not.
_SEGMENT_SQL = f"""{ev._U_SQL}, x AS (SELECT series_id, t, round(v * 100) AS v FROM u), n AS (SELECT series_id, count(*) AS n FROM x GROUP BY series_id),
r1 AS (SELECT 0 AS r, series_id, 0 AS lo, n AS hi FROM n WHERE n >= 50), {_range_profiles("r1", "x", 5, 3, 25)},
b1 AS (SELECT series_id, hi AS n, s AS cp, (auc + 1) / 2 AS score FROM a1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY auc DESC, s) = 1),
f1 AS (SELECT * FROM b1 WHERE score >= 0.75 AND cp >= 25 AND cp < n - 25),
r2 AS (SELECT h AS r, series_id, CASE h WHEN 0 THEN 0 ELSE cp END AS lo, CASE h WHEN 0 THEN cp ELSE n END AS hi FROM f1, range(2) q(h) WHERE n // 25 > 2 AND CASE h WHEN 0 THEN cp ELSE n - cp END >= 50), {_split("r2", "2", 5, 3, 25)},
b2 AS (SELECT r, series_id, lo + s AS cp, (auc + 1) / 2 AS score FROM a2 QUALIFY row_number() OVER (PARTITION BY series_id, r ORDER BY auc DESC, s) = 1),
f2 AS (SELECT series_id, b2.cp, b2.score FROM b2 JOIN f1 USING (series_id) WHERE b2.score >= 0.75 AND b2.cp >= 25 AND b2.cp < n - 25 AND NOT (b2.cp >= f1.cp - 25 AND b2.cp < f1.cp + 25) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY b2.score DESC, r) = 1),
found AS (SELECT series_id, cp, score FROM f1 UNION ALL SELECT series_id, cp, score FROM f2)"""

_SUSS_SQL = """x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings),
z AS MATERIALIZED (SELECT vec_id, t, (v - min(v) OVER q) / (max(v) OVER q - min(v) OVER q) AS v FROM x WINDOW q AS (PARTITION BY vec_id)),
g AS (SELECT vec_id, avg(v) AS gm, stddev_pop(v) AS gs, max(v) - min(v) AS gr, count(*) AS n FROM z GROUP BY vec_id),
p AS (SELECT vec_id, w, sqrt(power(avg(b.v) - any_value(gm), 2) + power(stddev_pop(b.v) - any_value(gs), 2) + power(max(b.v) - min(b.v) - any_value(gr), 2)) / sqrt(w::DOUBLE) AS d FROM z a JOIN g USING (vec_id) JOIN range(1, 64) r(w) ON a.t >= 1 AND a.t + w <= n JOIN z b USING (vec_id) WHERE b.t BETWEEN a.t AND a.t + w - 1 GROUP BY vec_id, a.t, w),
s AS (SELECT vec_id, w, avg(d) AS s FROM p GROUP BY vec_id, w),
f AS MATERIALIZED (SELECT vec_id, w, 1 - (s - b) / (a - b) AS f FROM s JOIN (SELECT vec_id, max(s) FILTER (w = 1) AS a, max(s) FILTER (w = 63) AS b FROM s GROUP BY vec_id) USING (vec_id)),
e AS (SELECT vec_id, CASE WHEN max(f) FILTER (w = 16) > 0.89 THEN 16 WHEN max(f) FILTER (w = 32) > 0.89 THEN 32 ELSE 64 END AS e FROM f GROUP BY vec_id),
o AS (SELECT vec_id, greatest(10, e // 2) AS low, least(e + 1, 63) + 1 AS hi FROM e
UNION ALL SELECT vec_id, CASE WHEN f < 0.89 THEN w + 1 ELSE low END, CASE WHEN f < 0.89 THEN hi ELSE w END FROM o JOIN f USING (vec_id) WHERE low < hi AND w = (low + hi - 1) // 2),
suss AS (SELECT vec_id, max(2 * low) AS suss FROM o WHERE low >= hi GROUP BY vec_id)"""

ORACLE_SQL = {
    "array_points": "SELECT CAST(vec_id AS VARCHAR) AS series_id, generate_subscripts(embedding, 1) - 1 AS t, unnest(embedding)::DOUBLE AS value FROM embeddings",
    "named_channel": f"WITH {ev.M_SQL} SELECT 'M' AS series_id, t, v AS value FROM x WHERE dim = 2",
    "knn_row_blocks": f"WITH {KNN_SQL} SELECT i, CAST(rank AS INT) AS rank, j FROM knn",
    "rolling_dots": f"WITH {ev.H_SQL}, w AS (SELECT a.t AS i, list(b.v ORDER BY b.t) AS win FROM x a JOIN x b ON b.t BETWEEN a.t AND a.t + {W - 1} GROUP BY a.t HAVING count(*) = {W}) SELECT a.i, b.i AS j, list_dot_product(a.win, b.win) AS dot FROM w a JOIN w b ON a.i <= b.i",
    "knn_ranges": f"WITH {KNN_SQL}, r AS (SELECT * FROM (VALUES {', '.join(f'({c}, {a}, {b})' for c, (a, b) in enumerate(RANGES))}) t(tc_id, lo, hi)) SELECT tc_id, i, CAST(row_number() OVER (PARTITION BY tc_id, i ORDER BY dist, j) AS INT) AS rank, j FROM d JOIN r ON i >= lo AND i < hi AND j >= lo AND j <= hi - {W} QUALIFY rank <= {K}",
    "ensemble_parts": f"""WITH {ev.H_SQL}, y AS (SELECT 'H' AS series_id, t, v FROM x), r AS (SELECT r, 'H' AS series_id, lo, hi FROM (VALUES {', '.join(f'({c}, {a}, {b})' for c, (a, b) in enumerate([(0, 520), *RANGES]))}) t(r, lo, hi)), {_range_profiles("r", "y", W, K, M)},
q AS (SELECT *, (auc + (hi - lo) / 520) / 2 AS score FROM a1), o AS (SELECT r FROM q ORDER BY score DESC, r LIMIT 1)
SELECT CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high, lo + s AS s, round(score, 9) AS score FROM q JOIN o USING (r)""",
    "segment_panel": f"WITH {_SEGMENT_SQL} SELECT series_id, cp, round(score, 9) AS score FROM found",
    "segment_arrays": f"""WITH {_SEGMENT_SQL}, g AS (SELECT series_id, t, v, CAST((SELECT count(*) FROM found WHERE found.series_id = x.series_id AND found.cp <= x.t) AS INT) AS seg_id FROM x)
SELECT series_id, seg_id, count(*) AS n, sum(v) AS total, arg_min(v, t) AS first FROM g GROUP BY series_id, seg_id""",
    "window_sizes": f"""WITH RECURSIVE {_SUSS_SQL},
fft AS (SELECT vec_id, arg_max(period, mag) AS fft FROM (SELECT vec_id, k, CAST(trunc(1 / (k::DOUBLE / 64)) AS BIGINT) AS period, sqrt(power(sum(v * cos(2 * pi() * k * t / 64)), 2) + power(sum(v * sin(2 * pi() * k * t / 64)), 2)) AS mag FROM x, range(1, 33) r(k) GROUP BY vec_id, k) WHERE period >= 10 AND period < 1000 GROUP BY vec_id),
m AS (SELECT vec_id, t, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM x), l AS (SELECT a.vec_id, lag, sum(a.c * b.c) AS r FROM m a JOIN range(33) q(lag) ON true JOIN m b ON b.vec_id = a.vec_id AND b.t = a.t + lag GROUP BY a.vec_id, lag),
n AS (SELECT vec_id, lag, r, lag(r) OVER o AS r0, lead(r) OVER o AS r1 FROM l WINDOW o AS (PARTITION BY vec_id ORDER BY lag)),
acf AS (SELECT vec_id, coalesce(arg_max(lag, r) FILTER (r > r0 AND r > r1 AND lag >= 10), 10) AS acf FROM n GROUP BY vec_id)
SELECT CAST(vec_id AS VARCHAR) AS series_id, CAST(suss AS BIGINT) AS suss, fft, CAST(acf AS BIGINT) AS acf FROM suss JOIN fft USING (vec_id) JOIN acf USING (vec_id)""",
    "channel_window_sizes": f"""WITH {ev.M_SQL}, n AS (SELECT count(*) AS n FROM x WHERE dim = 0), q AS (SELECT dim, k, any_value(n) AS n, sqrt(power(sum(v * cos(2 * pi() * k * t / n)), 2) + power(sum(v * sin(2 * pi() * k * t / n)), 2)) AS mag FROM x, n, range(1, 400) r(k) WHERE k <= n // 2 GROUP BY dim, k),
b AS (SELECT dim, arg_max(CAST(trunc(1 / (k::DOUBLE / n)) AS BIGINT), mag) AS period FROM q WHERE trunc(1 / (k::DOUBLE / n)) >= 10 AND trunc(1 / (k::DOUBLE / n)) < 1000 GROUP BY dim)
SELECT 'M' AS series_id, CAST(min(greatest(3, period // 2)) AS INT) AS window_size FROM b""",
    "change_sets": f"WITH {ev._TF_SQL}, a AS (SELECT series_id, list(DISTINCT cp) AS x FROM (SELECT * FROM tr UNION ALL SELECT series_id, 0 FROM ids) GROUP BY 1), b AS (SELECT series_id, list(DISTINCT cp) AS y FROM (SELECT * FROM fo UNION ALL SELECT series_id, 0 FROM ids) GROUP BY 1) SELECT series_id, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 9) AS overlap FROM a JOIN b USING (series_id)",
    "classification_gain": f"""WITH {ev._ES_SQL}, y AS (SELECT state AS a, CASE WHEN t % 4 = 0 THEN 112 ELSE state END AS b FROM e), k AS (SELECT a AS c FROM y UNION SELECT b FROM y),
f AS (SELECT avg(f) AS f1 FROM (SELECT c, 2.0::DOUBLE * count(*) FILTER (a = c AND b = c) / (count(*) FILTER (a = c) + count(*) FILTER (b = c)) AS f FROM k, y GROUP BY c)),
g AS (SELECT avg(p) AS chance FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM y) AS p FROM y GROUP BY a)) SELECT round(f1 - chance, 9) AS gain FROM f, g""",
    "process_nodes": f"""WITH {ev._RUN_SQL}, q AS (SELECT series_id, state, count(*) AS n, CAST(sum("end" - "start") AS BIGINT) AS points FROM r GROUP BY series_id, state), a AS (SELECT *, 2 * pi() * (row_number() OVER (PARTITION BY series_id ORDER BY state) - 1) / count(*) OVER (PARTITION BY series_id) AS turn FROM q)
SELECT series_id, state, n, points, round(cos(turn), 6) AS x, round(sin(turn), 6) AS y FROM a""",
}

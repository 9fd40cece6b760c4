"""Segmentation, window sizes and states of every series of a panel: one kernel call a series, series in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, kernels
from .series import dealt, in_batches, windows


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    if "dim" not in frame:
        return frame.sort_values("t", kind="stable")["value"].to_numpy(dtype=float)
    wide = frame.pivot(index="t", columns="dim", values="value").sort_index()
    if wide.isna().to_numpy().any():
        raise ValueError("the channels of a series must hold the same points")
    return wide.to_numpy(dtype=float)


def _rows(n: int, key: str, **columns) -> pd.DataFrame:
    """n rows of one series; names are plain objects, also where there are no rows."""
    return pd.DataFrame({"series_id": pd.Series([key] * n, dtype=object), **{k: pd.Series(v if hasattr(v, "__len__") else [v] * n, dtype="float64" if k == "score" else "int64") for k, v in columns.items()}})


def segment(p: DataFrame, **settings) -> DataFrame:
    """(series_id, cp, score, window_size) of every series; a series without a change point has no row."""

    def run(key, frame):
        out = kernels.segment(_matrix(frame), **settings)
        return _rows(len(out.change_points), key[0], cp=out.change_points, score=out.scores, window_size=out.window_size)

    return dealt(p, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, cp long, score double, window_size int")


def profiles(p: DataFrame, **settings) -> DataFrame:
    """(series_id, s, score): the merged and interpolated profile of every series, also what a plot would show."""

    def run(key, frame):
        curve = kernels.segment(_matrix(frame), **settings).profile
        return pd.DataFrame({"series_id": key[0], "s": np.arange(len(curve)), "score": curve})

    return dealt(p, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, s long, score double")


def window_sizes(p: DataFrame, method: str = "suss", rule: str = "segmentation") -> DataFrame:
    """(series_id, window_size): of channels, the least of max(3, half) for segmentation, the mean of max(1, whole) for states; as is for streams."""
    kernels.pick(kernels.WINDOW_METHODS, method, "window size method")

    def run(key, frame):
        return pd.DataFrame({"series_id": [key[0]], "dim": [int(key[1])], "w": [kernels.window_size_of(frame.sort_values("t")["value"].to_numpy(dtype=float), method)]})

    each = dealt(p, "series_id", "dim").groupBy("series_id", "dim").applyInPandas(run, "series_id string, dim int, w long")
    return _by_rule(each, rule)


def all_window_sizes(p: DataFrame) -> DataFrame:
    """(series_id, dim, suss, fft, acf): every method in one pass over each channel."""
    names = list(kernels.WINDOW_METHODS)

    def run(key, frame):
        x = frame.sort_values("t")["value"].to_numpy(dtype=float)
        return pd.DataFrame({"series_id": [key[0]], "dim": [int(key[1])], **{n: [kernels.window_size_of(x, n)] for n in names}})

    return dealt(p, "series_id", "dim").groupBy("series_id", "dim").applyInPandas(run, "series_id string, dim int, " + ", ".join(f"{n} long" for n in names))


def _by_rule(each: DataFrame, rule: str) -> DataFrame:
    value = {"segmentation": F.min(F.greatest(F.lit(3), F.expr("w div 2"))), "states": F.floor(F.avg(F.greatest(F.lit(1), F.col("w")))), "stream": F.min("w")}
    return each.groupBy("series_id").agg(kernels.pick(value, rule, "rule").cast("int").alias("window_size"))


def segment_arrays(p: DataFrame, cps: DataFrame) -> DataFrame:
    """(series_id, seg_id, values) of one channel: a segmentation's dense output; the segments' starts are put among the points in order, so no point is joined to a range."""
    w = Window.partitionBy("series_id").orderBy("t")
    marked = p.select("series_id", "t", "value").join(cps.select("series_id", F.col("cp").alias("t"), F.lit(1).alias("new")).distinct(), ["series_id", "t"], "left")
    held = marked.select("series_id", "t", "value", F.sum(F.coalesce("new", F.lit(0))).over(w).alias("seg_id"))
    return held.groupBy("series_id", "seg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("values"))


def merged_states(pairs: DataFrame) -> DataFrame:
    """(series_id, y_true, y_pred, n), a confusion of each series, to (series_id, label, state): labels that are confused become one state, numbered from 1."""

    def run(key, frame):
        labels = np.unique(np.concatenate([frame["y_true"], frame["y_pred"]]))
        y, pred, n = (np.searchsorted(labels, frame[c]) if c != "n" else frame[c].to_numpy() for c in ("y_true", "y_pred", "n"))
        state, _, _ = classify.merge_states(np.arange(len(labels)), np.repeat(y, n), np.repeat(pred, n))
        return pd.DataFrame({"series_id": key[0], "label": labels.astype("int64"), "state": state.astype("int64")})

    return pairs.groupBy("series_id").applyInPandas(run, "series_id string, label long, state int")


def states(p: DataFrame, cps: DataFrame | None = None, **settings) -> DataFrame:
    """(series_id, seg_id, start, end, state) of every series; cps (series_id, cp) are found if none are given."""

    def rows(key, x, given):
        found = classify.detect_states(x, given, **settings)
        bounds = [0, *found.change_points, len(x)]
        return _rows(len(bounds) - 1, key[0], seg_id=list(range(len(bounds) - 1)), start=bounds[:-1], end=bounds[1:], state=found.segment_states)

    schema = "series_id string, seg_id int, start long, end long, state int"
    w = settings.get("window_size", "suss")
    if cps is not None and not isinstance(w, str):

        def many(frame, bounds):
            out = []
            for names, x, at in _alike(frame, bounds):
                for name, (found, kinds) in zip(names, classify.detect_states_many(x, at, **settings), strict=True):
                    edges = [0, *found, x.shape[1]]
                    out += [(name, i, edges[i], edges[i + 1], kind) for i, kind in enumerate(kinds)]
            return pd.DataFrame(out, columns=["series_id", "seg_id", "start", "end", "state"])

        return in_batches(_with_cuts(p, cps), ("cut", "t", "dim"), many, schema)
    if cps is None:
        return dealt(p, "series_id").groupBy("series_id").applyInPandas(lambda key, frame: rows(key, _matrix(frame), None), schema)
    return dealt(p, "series_id").groupBy("series_id").cogroup(dealt(cps, "series_id").groupBy("series_id")).applyInPandas(lambda key, frame, c: rows(key, _matrix(frame), sorted(c["cp"].tolist())) if len(frame) else _rows(0, key[0], seg_id=[], start=[], end=[], state=[]), schema)


def state_scores(p: DataFrame, cps: DataFrame, classifier: str = "rocket", window_size: int = 10, n_splits: int = 5, sample_size: int = 1000, seed: int = 2357) -> DataFrame:
    """(series_id, y_true, y_pred, n): the confusion of the cross-validated window classifier, a label a segment."""

    def run(frame, bounds):
        out = [pd.DataFrame({"series_id": pd.Series([], dtype=object), **{n: pd.Series([], dtype="int64") for n in ("y_true", "y_pred", "n")}})]
        for names, x, at in _alike(frame, bounds):
            y, found = classify.predicted_many(x, at, window_size, classifier, n_splits, sample_size, seed)
            kinds = len(at) + 1
            cells, n = np.unique((np.arange(len(x))[:, None] * kinds + y[None]) * kinds + found, return_counts=True)
            out.append(pd.DataFrame({"series_id": np.array(names, dtype=object)[cells // kinds**2], "y_true": cells // kinds % kinds, "y_pred": cells % kinds, "n": n}))
        return pd.concat(out, ignore_index=True)

    return in_batches(_with_cuts(p, cps), ("cut", "t", "dim"), run, "series_id string, y_true int, y_pred int, n long")


def _with_cuts(p: DataFrame, cps: DataFrame) -> DataFrame:
    """Points and change points as rows of one table."""
    dim = F.col("dim") if "dim" in p.columns else F.lit(None)
    points = p.select(F.col("series_id").cast("string").alias("series_id"), F.lit(False).alias("cut"), F.col("t").cast("long").alias("t"), dim.cast("int").alias("dim"), F.col("value").cast("double").alias("value"))
    return points.unionAll(cps.select(F.col("series_id").cast("string"), F.lit(True), F.col("cp").cast("long"), F.lit(None).cast("int"), F.lit(None).cast("double")))


def _alike(frame: pd.DataFrame, bounds: list[int]):
    """(names, (series, n, channels), change points) of the series of a batch that have points, those of one shape and the same change points together."""
    ids, cut, t, value = frame["series_id"].to_numpy(dtype=object), frame["cut"].to_numpy(dtype=bool), frame["t"].to_numpy(), frame["value"].to_numpy(dtype=float)
    dim = frame["dim"].to_numpy(dtype=float)
    groups: dict[tuple, tuple[list, list]] = {}
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        split = low + int((~cut[low:high]).sum())  # points come first
        if split == low:
            continue
        x, places, channel = value[low:split], t[low:split], dim[low:split]
        dims = 1 if channel[0] == channel[-1] or np.isnan(channel[0]) else len(np.unique(channel))
        if not np.isnan(channel[0]) and (len(x) % dims or (channel.reshape(-1, dims) != channel[:dims]).any() or (places.reshape(-1, dims) != places[::dims, None]).any() or (np.diff(places[::dims]) == 0).any()):
            raise ValueError("the channels of a series must hold the same points")
        x = kernels.as_series(x.reshape(-1, dims))
        names, series = groups.setdefault((x.shape, tuple(t[split:high].tolist())), ([], []))
        names.append(ids[low])
        series.append(x)
    for (_, at), (names, series) in groups.items():
        yield names, np.stack(series), [int(c) for c in at]


def collapsed(labels: DataFrame) -> DataFrame:
    """(series_id, t, state) of every point to segments: neighbouring points of one state become one segment."""
    w = Window.partitionBy("series_id").orderBy("t")
    new = (F.lag("state").over(w).isNull() | (F.lag("state").over(w) != F.col("state"))).cast("int")
    runs = labels.select("series_id", "t", "state", new.alias("new")).select("series_id", "t", "state", F.sum("new").over(w).alias("run"))
    out = runs.groupBy("series_id", "run").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"), F.first("state").alias("state"))
    return out.select("series_id", (F.col("run") - 1).cast("int").alias("seg_id"), "start", "end", "state")


def transitions(segments: DataFrame) -> DataFrame:
    """(series_id, from_state, to_state, n, prob): how often states follow each other, by the share of all that follow the first."""
    w = Window.partitionBy("series_id").orderBy("start")
    pairs = segments.select("series_id", F.col("state").alias("from_state"), F.lead("state").over(w).alias("to_state")).where("to_state is not null and from_state <> to_state")
    counted = pairs.groupBy("series_id", "from_state", "to_state").agg(F.count("*").alias("n"))
    return counted.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("series_id", "from_state")))


def labelled_windows(p: DataFrame, segments: DataFrame, w: int) -> DataFrame:
    """(series_id, dim, i, window, state): half-overlapping windows with the state at their start; starts just before a change are left out.

    segments is (series_id, seg_id, start, end, state).  Each is opened into its own window starts, which
    are then looked up by place, so no window is compared with a range.
    """
    stride, last = max(1, w // 2), F.max("seg_id").over(Window.partitionBy("series_id"))
    free = F.when(F.col("seg_id") < F.col("last"), F.col("end") - (w // 2 - 1)).otherwise(F.col("end"))
    first = F.ceil(F.col("start") / stride) * stride
    open_ = segments.withColumn("last", last).select("series_id", "state", first.alias("first"), free.alias("free")).where("free > first")
    starts = open_.select("series_id", F.explode(F.sequence(F.col("first"), F.col("free") - 1, F.lit(stride).cast("long"))).alias("i"), "state")
    return windows(p, w).join(starts, ["series_id", "i"]).select("series_id", "dim", "i", "window", "state")


def classification_gain(confused: DataFrame) -> DataFrame:
    """One row, gain: macro F1 of a confusion (y_true, y_pred, n) less the mean share of its true classes."""
    share = confused.groupBy("y_true").agg(F.sum("n").alias("t")).agg(F.avg("t").alias("a"), F.sum("t").alias("n")).select((F.col("a") / F.col("n")).alias("chance"))
    return macro_f1(confused).crossJoin(share).select((F.col("f1") - F.col("chance")).alias("gain"))  # one row each


def process_nodes(segments: DataFrame) -> DataFrame:
    """(series_id, state, n, points, x, y): the states of a process, how many segments and points they have, and places on a circle for a drawing."""
    w = Window.partitionBy("series_id")
    nodes = segments.groupBy("series_id", "state").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("points"))
    turn = 2 * math.pi * (F.row_number().over(w.orderBy("state")) - 1) / F.count("*").over(w)
    return nodes.select("series_id", "state", "n", "points", F.cos(turn).alias("x"), F.sin(turn).alias("y"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def macro_f1(confused: DataFrame) -> DataFrame:
    """One row, f1: the mean over all classes that occur as truth or prediction."""
    truth = confused.groupBy(F.col("y_true").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    guess = confused.groupBy(F.col("y_pred").alias("c")).agg(F.sum("n").alias("p"))
    both = truth.join(guess, "c", "full").na.fill(0, ["t", "p", "hit"])
    return both.agg(F.avg(2.0 * F.col("hit") / (F.col("t") + F.col("p"))).alias("f1"))

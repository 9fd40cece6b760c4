"""Structured Streaming: change points of many series, state kept per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .online import OnlineSegmentation

OUTPUT = "series_id string, t long, change_point long, score double"


def stream_change_points(points: DataFrame, **settings) -> DataFrame:
    """(series_id, t, value) of a stream in; (series_id, t, change_point, score) out, a row when a change is known.

    Within a micro-batch points are taken in the order of t; a point at or before the last one taken is
    late and dropped, and so are points with a null or non-finite value.  Results don't depend on how points
    are dealt into micro-batches.  The state is the online segmentation's buffers as packed arrays, bounded by
    n_timepoints but for the list of change points; change points found before are not sent again.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, blob = state.get
            model = OnlineSegmentation.load(bytes(blob))
        else:
            last, model = None, OnlineSegmentation(**settings)
        rows = []
        batch = pd.concat(list(frames)).sort_values("t", kind="stable")
        for t, value in zip(batch["t"].tolist(), batch["value"].tolist(), strict=True):
            if value is None or value - value != 0 or (last is not None and t <= last):
                continue
            last, known = t, len(model.change_points)
            if model.update(value):
                rows += [(key[0], t, c, s) for c, s in zip(model.change_points[known:], model.scores[known:], strict=True)]
        state.update((last if last is not None else -(2**63), model.dump()))
        if rows:
            yield pd.DataFrame(rows, columns=["series_id", "t", "change_point", "score"])

    clean = points.selectExpr("cast(series_id as string) as series_id", "cast(t as long) as t", "cast(value as double) as value").where("t is not null and series_id is not null")
    return clean.groupBy("series_id").applyInPandasWithState(step, OUTPUT, "last long, model binary", "append", GroupStateTimeout.NoTimeout)

"""Volumes of a stream of events by windows of event time, and a running score of each voxel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCORES = "vox long, n long, mean double, z double"


def volumes(events: DataFrame, vox, value, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """``(window, vox, value)``: sums by voxel and window; a window closes once the watermark has passed it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("ts", vox.alias("vox"), value.alias("value"))
    return rows.groupBy(F.window("ts", window), "vox").agg(F.sum("value").alias("value"))


def running_scores(rows: DataFrame) -> DataFrame:
    """For each voxel ``(vox, value)`` its last value's distance from the running mean, in running deviations.

    The state of a voxel is a count, a mean and a sum of squares, so it stays small however long the stream runs.
    """

    def merge(one: tuple[int, float, float], x: np.ndarray) -> tuple[int, float, float]:
        """Count, mean and sum of squares of one part and the values of another."""
        n, mean, square = one
        if not len(x):
            return one
        total, step = n + len(x), x.mean() - mean
        return total, mean + step * len(x) / total, square + ((x - x.mean()) ** 2).sum() + step * step * n * len(x) / total

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState):
        seen = state.get if state.exists else (0, 0.0, 0.0)
        z = 0.0
        for pdf in parts:
            x = pdf["value"].to_numpy(float)
            if len(x):
                n, mean, square = before = merge(seen, x[:-1])
                sd = (square / (n - 1)) ** 0.5 if n > 1 else 0.0
                z = float((x[-1] - mean) / sd) if sd > 0 else 0.0
                seen = merge(before, x[-1:])
        n, mean, square = int(seen[0]), float(seen[1]), float(seen[2])
        state.update((n, mean, square))
        yield pd.DataFrame({"vox": [key[0]], "n": [n], "mean": [mean], "z": [z]})

    return rows.groupBy("vox").applyInPandasWithState(update, SCORES, "n long, mean double, square double", "update", GroupStateTimeout.NoTimeout)

"""Streaming: filters whose state is carried between micro-batches, windows with watermarks, frozen baselines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import kernels as K


def stateful_filter(stream: DataFrame, b: np.ndarray, a: np.ndarray, late: str = "10 seconds", idle: float = 3600.0) -> DataFrame:
    """(session_id, i, filtered) of samples (session_id, i, ts, value): the same recurrence as in batch, continued from the state of the batch before.

    Samples wait in the state until the watermark has passed their ts and are filtered in order of i; a sample that comes later than that, or twice, is left out. A null repeats the value before it (0 at the start). A session's
    state ends ``idle`` seconds after its last sample.
    """

    def run(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, last, wait, upto = state.get if state.exists else ([], [], [], 0.0)
        rows = np.array(wait, float).reshape(-1, 3)
        for p in parts:
            rows = np.concatenate([rows, p[["i", "ms", "value"]].to_numpy(float)])
            upto = max(upto, float(p["ms"].max()))
        mark = float(state.getCurrentWatermarkMs())
        ready = rows[:, 1] <= mark if mark > 0 else np.zeros(len(rows), bool)
        wait, rows = rows[~ready], rows[ready]
        rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
        if last:
            rows = rows[rows[:, 0] > last[0]]
        if len(rows):
            x = pd.Series(np.concatenate([[last[1] if last else 0.0], rows[:, 2]])).ffill().to_numpy()[1:]
            y, held = K.recur(x, b, a, np.array(z) if len(z) else None)
            z, last = held.tolist(), [float(rows[-1, 0]), float(x[-1])]
            yield pd.DataFrame({"session_id": key[0], "i": rows[:, 0].astype(np.int64), "filtered": y})
        if state.hasTimedOut and not len(wait) and mark >= upto + 1000 * idle:
            state.remove()
        else:
            state.update((z, last, wait.ravel().tolist(), upto))
            state.setTimeoutTimestamp(int(max(mark + 1, wait[:, 1].min() if len(wait) else upto + 1000 * idle)))

    rows = stream.withWatermark("ts", late).where("ts is not null and i is not null")
    rows = rows.select("session_id", "ts", F.col("i").cast("double").alias("i"), (F.unix_micros("ts") / 1000).alias("ms"), F.col("value").cast("double").alias("value"))
    kind = stream.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").applyInPandasWithState(run, f"session_id {kind}, i long, filtered double", "z array<double>, last array<double>, wait array<double>, upto double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed(stream: DataFrame, width: str, step: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Tumbling or sliding event-time windows behind a watermark: count, mean and spread per session."""
    once = stream.withWatermark("ts", late)
    return once.groupBy("session_id", F.window("ts", width, step) if step else F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def deduplicated(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """One row per session and timestamp within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "ts"])


def worn(stream: DataFrame, gap: str = "30 minutes", late: str = "10 seconds") -> DataFrame:
    """Session windows that a gap closes."""
    return stream.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def calibrated(stream: DataFrame, base: DataFrame) -> DataFrame:
    """z against a frozen per-session baseline (session_id, mean, std): a stream-static join."""
    z = F.when(F.coalesce(F.col("std"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("value") - F.col("mean"), F.col("std")))
    return stream.join(base, "session_id", "left").withColumn("z", z)

"""How long a stream's batches and a model's scores take, as tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

PROGRESS = "batch long, at string, rows long, trigger_ms long, work_ms long, plan_ms long, commit_ms long, state_rows long, state_bytes long, late_rows long"


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """A row for each batch that the query still remembers: its time in all, for the work, for planning and for commits, and the state it holds."""
    rows = []
    for p in query.recentProgress:
        took, state = dict(p.durationMs), p.stateOperators
        rows.append((p.batchId, p.timestamp, p.numInputRows, took.get("triggerExecution", 0), took.get("addBatch", 0), took.get("queryPlanning", 0), took.get("walCommit", 0) + took.get("commitOffsets", 0), sum(s.numRowsTotal for s in state), sum(s.memoryUsedBytes for s in state), sum(s.numRowsDroppedByWatermark for s in state)))
    return spark.createDataFrame(rows, PROGRESS)


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, p50, p95 and the largest of a time, of all rows or by keys."""
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max(value).alias("longest"))


def score_times(rows: DataFrame, names: list[str], models: dict[str, Callable[[np.ndarray], np.ndarray]], warm: int = 20, repeats: int = 1000) -> DataFrame:
    """(model, run, ms): times of scoring one row, after ``warm`` runs that don't count; rows are taken in turn. One task for each model, over at most ``repeats`` rows, which is the measurement."""
    spark = rows.sparkSession
    held = rows.select(*[F.col(c).cast("double") for c in names]).limit(repeats).toPandas().to_numpy(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for name in p["model"]:
                score, took = models[name], []
                for k in range(warm + repeats if len(held) else 0):
                    x = held[k % len(held)][None, :]
                    t = time.perf_counter()
                    score(x)
                    took.append((time.perf_counter() - t) * 1000)
                yield pd.DataFrame({"model": name, "run": range(len(took) - warm if took else 0), "ms": took[warm:]})

    return spark.createDataFrame([(m,) for m in models], "model string").repartition(max(len(models), 1)).mapInPandas(run, "model string, run long, ms double")

"""Queries over tables that the library has written and read back: runs of several outputs under one commit, build-or-load."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import windows as W
from tidewatch.plans.registry import S, query, r
from tidewatch.sources import stores
from tidewatch.sources import tables as T
from tidewatch.sources.scratch import shared_dir


@query(f"WITH {S} SELECT session_id, count(*) AS n, count(*) FILTER (i % 2 = 0) AS n_stride, round(sum(value), 6) AS total, round(sum(value) FILTER (i % 2 = 0), 6) AS total_stride, max(code)::INT AS top FROM s GROUP BY 1")
def stored_pair(spark, sf_dir):
    """Samples at a stride of one and of two, as Parquet and as CSV of one run, read back through its pointer."""
    rows = T.samples(spark, sf_dir).select("code", "session_id", "i", "value")
    root = f"{shared_dir(spark)}/tidewatch-stored/{uuid.uuid4().hex}"
    stores.committed(spark, root, {"stride_1": stores.Output(rows), "stride_2": stores.Output(rows.where("i % 2 = 0"), "csv", last=("code",))}, {"source": sf_dir})
    whole, half = stores.stored(spark, root, "stride_1"), stores.stored(spark, root, "stride_2", "session_id long, i long, value double, code int")
    a = whole.groupBy("session_id").agg(F.count("*").alias("n"), r(F.sum("value"), "total"), F.max("code").cast("int").alias("top"))
    b = half.groupBy("session_id").agg(F.count("*").alias("n_stride"), r(F.sum("value"), "total_stride"))
    return a.join(b, "session_id").select("session_id", "n", "n_stride", "total", "total_stride", "top")


@query(f"WITH {S} SELECT session_id, i // 10 AS win, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY ALL HAVING count(*) = 10")
def built_or_loaded(spark, sf_dir):
    """Windows of ten samples, built once under the key of their settings, code and input, and loaded from there."""
    root, width = f"{shared_dir(spark)}/tidewatch-built", 10

    def build():
        rows = W.tumbling(T.samples(spark, sf_dir), width).groupBy("session_id", F.col("window").alias("win"))
        return rows.agg(F.count("*").alias("n"), r(F.avg("value"), "mean"), r(F.stddev_pop("value"), "std")).where(F.col("n") == width)

    key = stores.key_of({"width": width}, [W, build], stores.listing(spark, f"{sf_dir}/events.parquet"))
    stores.build_or_load(spark, root, key, build)
    return stores.build_or_load(spark, root, key, build)[0]

"""Streams against the same rows as a batch."""

from datetime import datetime, timedelta

import pytest

from tidewatch.streaming import causal

T0 = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(1, T0 + timedelta(seconds=s), float(v)) for s, v in [(0, 1), (20, 3), (20, 3), (59, 5), (60, 7), (7000, 9)]]
    spark.createDataFrame(rows, "session_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(query, name):
        source = spark.readStream.schema("session_id long, ts timestamp, value double").parquet(f"{tmp_path}/in")
        q = query(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
        return spark.table(name).collect()

    return run


def test_windows_close_behind_the_watermark(stream):
    got = sorted(((r.window.start - T0).seconds, r.n, r.mean) for r in stream(lambda s: causal.windowed(s, "60 seconds"), "w"))
    assert got == [(0, 4, 3.0), (60, 1, 7.0)]


def test_repeated_timestamps_go(stream):
    assert len(stream(causal.deduplicated, "d")) == 5


def test_gaps_close_session_windows(stream):
    assert [r.n for r in stream(causal.worn, "g")] == [5]


def test_scores_use_the_frozen_baseline(stream, spark):
    base = spark.createDataFrame([(1, 3.0, 2.0)], "session_id long, mean double, std double")
    assert sorted(r.z for r in stream(lambda s: causal.calibrated(s, base), "c")) == [-1.0, 0.0, 0.0, 1.0, 2.0, 3.0]

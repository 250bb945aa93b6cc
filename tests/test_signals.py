"""Every query with SQL against DuckDB, kernels by their properties, streams against batches."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import kernels as K
from tidewatch.operators import windows as W
from tidewatch.plans import catalog
from tidewatch.streaming import causal, latency

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(d: pd.DataFrame) -> list[str]:
    cols = sorted(d.columns)
    show = lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(round(float(v), 4)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    return sorted("|".join(show(v) for v in row) for row in d[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("order", [1, 2])
def test_lowpass_gain(order):
    b, a = K.lowpass(1.0, 16.0, order)
    at = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 16)) / np.polyval(a, np.exp(2j * np.pi * f / 16))) ** 2
    assert at(0) == pytest.approx(1) and at(1.0) == pytest.approx(0.5)


def test_bandpass_gain():
    b, a = K.bandpass(0.5, 8, 64)
    at = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 64)) / np.polyval(a, np.exp(2j * np.pi * f / 64))) ** 2
    assert [round(at(f), 3) for f in (0.0, 0.5, 2.0, 8.0)] == [0, 0.5, 1.0, 0.5]


def test_state_continues_exactly():
    x = np.random.default_rng(1).normal(size=2000)
    b, a = K.bandpass(0.5, 8, 64)
    whole, _ = K.recur(x, b, a)
    one, z = K.recur(x[:777], b, a)
    assert (np.concatenate([one, K.recur(x[777:], b, a, z)[0]]) == whole).all()


def test_constant_in_constant_out():
    assert np.allclose(K.recur(np.full(50, 3.0), *K.lowpass(0.05, 4, 2))[0], 3.0)


@pytest.mark.parametrize("bpm", [50, 75, 120, 170])
def test_beats_of_pulses(bpm):
    t = np.arange(0, 30, 1 / 64)
    x = np.exp(-0.5 * (((t * bpm / 60 + 0.5) % 1 - 0.5) * 60 / bpm / 0.06) ** 2)
    gaps = np.diff(K.beats(x, 64)) / 64
    assert np.allclose(np.median(gaps), 60 / bpm, atol=0.03)


def test_response_times():
    x = np.concatenate([np.zeros(8), np.linspace(0, 1, 9), np.linspace(1, 0, 17)[1:], np.zeros(8)])
    ((onset, peak, height, rise, index, recovery),) = K.responses(x, 4)
    assert (onset, peak, index) == (8, 16, 24) and (height, rise, recovery) == (1.0, 2.0, 2.0)


def test_bands_tell_frequencies_apart():
    n = np.cumsum(np.full(400, 0.8))
    low, high = (K.bands(800 + 50 * np.sin(2 * np.pi * f * n)) for f in (0.1, 0.25))
    assert low["lf"] > 5 * low["hf"] and high["hf"] > 5 * high["lf"]
    assert K.bands(np.full(10, 800.0))["lf"] is None


def test_tumbling_drops_nothing(spark):
    rows = spark.range(25).select(F.lit(1).alias("session_id"), F.col("id").alias("i"))
    assert W.tumbling(rows, 10).groupBy("window").count().count() == 3


def test_stream_equals_batch(spark, tmp_path):
    """Samples come shuffled, some late and some twice; a far later one of another session ends the streams."""
    n, rng = 200, np.random.default_rng(2)
    rows = pd.DataFrame({"session_id": np.repeat([1, 2], n), "i": np.tile(np.arange(n), 2), "value": rng.normal(size=2 * n)})
    rows["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rows.i / 4, unit="s")
    comes = rows.i // 40 + (rng.random(2 * n) < 0.1)
    sent = pd.concat([rows.assign(k=comes), rows.assign(k=comes + 1).iloc[::17], pd.DataFrame({"session_id": [9], "i": [0], "value": [0.0], "ts": [pd.Timestamp("2024-01-02")], "k": [9]})])
    for k in sorted(sent.k.unique()):
        spark.createDataFrame(sent[sent.k == k].drop(columns="k").sample(frac=1, random_state=int(k))).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    b, a = K.lowpass(0.5, 4, 2)
    stream = spark.readStream.schema("session_id long, i long, value double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = causal.stateful_filter(stream, b, a, late="15 seconds", idle=60).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(200)
    told = latency.progress(spark, q)
    q.stop()
    got = spark.table("filtered").toPandas().sort_values(["session_id", "i"])
    want = np.concatenate([K.recur(g.sort_values("i").value.to_numpy(), b, a)[0] for _, g in rows.groupby("session_id")])
    assert len(got) == 2 * n and np.allclose(got.filtered, want)
    rows = told.orderBy("batch").collect()
    assert sum(r.rows for r in rows) == len(sent) and rows[-1].state_rows == 1 and max(r.state_rows for r in rows) >= 2  # ended sessions leave the state
    s = latency.summary(told.where("rows > 0"), "trigger_ms").first()
    assert s.n >= 6 and 0 < s.p50 <= s.p95 <= s.longest


def test_score_times(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    took = latency.score_times(rows, ["a", "b"], {"sum": lambda x: x.sum(axis=1), "exp": lambda x: np.exp(x).sum(axis=1)}, warm=2, repeats=50)
    got = {r.model: r for r in latency.summary(took, "ms", ["model"]).collect()}
    assert set(got) == {"sum", "exp"} and all(r.n == 50 and 0 < r.p50 <= r.p95 for r in got.values())
    assert latency.score_times(rows.limit(0), ["a", "b"], {"sum": lambda x: x}).isEmpty()


def test_whole_feature_matrix(spark, monkeypatch):
    seen = {}
    for module, name in ((catalog.X, "correlations"), (catalog.X, "anova"), (catalog.M, "held_out"), (catalog.M, "fold_information"), (catalog.linear, "held_out")):
        monkeypatch.setattr(module, name, lambda rows, names, *a, f=getattr(module, name), n=(module.__name__, name): seen.update({(n, *a): (len(names), set(names) <= set(rows.columns))}) or f(rows, names, *a))
    monkeypatch.setattr(catalog.trees.tuning, "held_out", lambda rows, names, fit, f=catalog.trees.tuning.held_out, **more: seen.update({("trees",): (len(names), set(names) <= set(rows.columns))}) or f(rows, names, fit, **more))
    for name in ("correlated_pairs_all", "anova_rank_all", "mi_stability", "loso_eval", "loso_boosting", "loso_forest", "loso_svm", "loso_ensemble"):
        catalog.QUERIES[name](spark, SF)
    assert len(seen) == 8 and set(seen.values()) == {(64, True)}
    assert catalog.QUERIES["mi_stability"](spark, SF).count() == catalog.QUERIES["anova_rank_all"](spark, SF).count() == 64
    rows = catalog.T.features(spark, SF, 64)
    assert catalog.X.correlations(rows, catalog.ALL).count() == catalog.X.correlations(rows.limit(0), catalog.ALL).count() == 2016

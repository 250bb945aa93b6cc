"""Recordings, device folders, stores and configuration: what is written comes back, what is wrong is told."""

import io
import pickle
import sys

import numpy as np
import pytest

from tidewatch import config
from tidewatch.operators import builder as B
from tidewatch.sources import recordings as R
from tidewatch.sources import stores
from tidewatch.sources import tables as T

sys.path.insert(0, "tests")


def recording(seed):
    r = np.random.default_rng(seed)
    wrist = {"EDA": r.normal(2, 1, (400, 1)), "BVP": r.normal(0, 1, (6400, 1)), "TEMP": r.normal(33, 1, (400, 1)), "ACC": r.integers(-64, 64, (3200, 3)).astype(float)}
    return {"subject": f"S{seed}", "signal": {"wrist": wrist, "chest": {"ECG": r.normal(size=(50, 1))}}, "label": r.integers(0, 5, 70000)}


class Evil:
    def __reduce__(self):
        return (print, ("run",))


def test_recordings_come_back_sample_by_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 1000)
    for seed in (2, 3):
        (tmp_path / f"S{seed}").mkdir()
        (tmp_path / f"S{seed}" / f"S{seed}.pkl").write_bytes(pickle.dumps(recording(seed), protocol=2))
    archive = io.BytesIO()
    np.savez(archive, **{"wrist.EDA": np.arange(5.0), "label": np.array([1, 2])})
    (tmp_path / "S9.npz").write_bytes(archive.getvalue())
    (tmp_path / "bad.pkl").write_bytes(b"not a recording")
    (tmp_path / "evil.pkl").write_bytes(pickle.dumps(Evil()))
    rows = R.recordings(spark, str(tmp_path))
    assert {r.session_id for r in R.unreadable(rows).collect()} == {"bad", "evil"}
    got = {}
    for r in sorted(R.recorded_samples(rows).collect(), key=lambda r: (r.session_id, r.channel, r.i)):
        got.setdefault((r.session_id, r.channel), []).append((r.x,) if r.channel != "acc" else (r.x, r.y, r.z))
    for seed in (2, 3):
        held = recording(seed)
        for name, channel in R.WRIST.items():
            np.testing.assert_array_equal(np.array(got[f"S{seed}", channel]), held["signal"]["wrist"][name])
        np.testing.assert_array_equal(np.array(got[f"S{seed}", "label"])[:, 0], held["label"])
    assert got["S9", "eda"] == [(float(k),) for k in range(5)] and len(got) == 12
    some = R.recordings(spark, str(tmp_path), ["wrist.EDA"])
    assert {(r.place, r.channel) for r in some.where("error is null").collect()} == {("wrist", "EDA")}
    chest = R.recordings(spark, str(tmp_path), ["chest.ECG"]).where("error is null").collect()
    assert {r.session_id for r in chest} == {"S2", "S3"} and all(len(r.samples) == 50 for r in chest)


def test_window_table_of_recordings(spark, tmp_path):
    (tmp_path / "S2.pkl").write_bytes(pickle.dumps(recording(2), protocol=2))
    s = B.Settings(width=20, step=20, motion_limit=1e9, most_invalid=1.0)
    rows = R.window_table(spark, str(tmp_path), {k: f"l{k}" for k in range(5)}, s).collect()
    assert sorted(r.window_start_sec for r in rows) == [0, 20, 40, 60, 80] and {r.session_id for r in rows} == {"S2"}
    wrist = recording(2)["signal"]["wrist"]
    g = wrist["ACC"][640:1280] / 64
    at = next(r for r in rows if r.window_start_sec == 20)
    assert at.acc_x_std == pytest.approx(g[:, 0].std()) and at.acc_energy == pytest.approx((g**2).sum(axis=1).mean())


HEAD = "LocalTimestamp,EmotiBitTimestamp,PacketNumber,DataLength,TypeTag,ProtocolVersion,DataReliability,"


def export(folder, prefix, tag, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{prefix}_{tag}.csv").write_text(HEAD + tag[:2] + "\n" + "".join(f"{t},1,2,1,{tag[:2]},1,100,{v}\n" for t, v in rows))


def test_device_folders_with_and_without_side_files(spark, tmp_path):
    export(tmp_path / "one", "p1", "EA", [(100 + k / 4, k) for k in range(41)] + [(102, 99), ("x", 5), (103.1, "oops")])
    export(tmp_path / "one", "p1", "AX", [(100, 1)])
    export(tmp_path / "one", "p1", "AX 1", [(100, 2)])
    export(tmp_path / "one", "p1", "UN", [(102, "first"), (104, ""), (105, "second"), (107.5, "third")])
    export(tmp_path / "two" / "deep", "p2", "EA", [(50, 1), (1050, 2)])
    export(tmp_path / "two" / "deep", "p2", "UN", [(60, "only one")])
    export(tmp_path / "three", "p3", "EA", [(0, 1), (500, 2)])
    rows = R.device_folder(spark, str(tmp_path))
    series = R.device_series(rows)
    ea = sorted((r.t, r.value) for r in series.where("prefix = 'p1' and tag = 'EA'").collect())
    assert len(ea) == 42 and dict(ea)[2.0] == 8.0 and [v for t, v in ea if t == pytest.approx(3.1)] == [None]  # the first row of a time stays; a bad number is null
    assert {(r.tag, r.value) for r in series.where("tag = 'AX'").collect()} == {("AX", 1.0)}
    assert {r.value for r in R.device_folder(spark, str(tmp_path), ["AX"], {"AX": "AX 1"}).collect()} == {2.0}
    fs = {r.prefix: (r.n, r.fs) for r in R.rates(series.where("tag = 'EA'"), intervals=False).collect()}
    assert fs["p1"] == (42, pytest.approx(4.2)) and fs["p2"][1] == pytest.approx(2 / 1000)
    assert {r.prefix: r.fs for r in R.rates(series.where("tag = 'EA'")).collect()}["p1"] == pytest.approx(4.1)
    got = {(r.prefix, r.phase): (r.t0, r.t1, r.marked) for r in R.marks(rows).collect()}
    assert got["p1", "Baseline 1"] == (2, 5, True) and got["p1", "Stress"] == (5, 7.5, True) and got["p1", "Baseline 2"] == (7.5, 10, True)
    assert got["p2", "Baseline 1"] == (60, 360, False) and got["p2", "Baseline 2"] == (480, 780, False) and got["p3", "Baseline 2"] == (480, 500, False)
    one = T.device_csv(spark, f"{tmp_path}/one/p1_EA.csv", "EA")
    assert sorted((r.t, r.value) for r in one.collect())[8] == (2.0, 8.0) and one.count() == 42
    assert T.sampling_rate(one).first().fs == pytest.approx(4.1) and T.sampling_rate(one, intervals=False).first().fs == pytest.approx(4.2)


def test_explode_recordings(spark):
    rows = spark.createDataFrame([("a", "eda", 4.0, [1.0, 2.0]), ("b", "eda", 2.0, [])], T.RECORDING)
    assert [tuple(r) for r in T.explode_recordings(rows).orderBy("i").collect()] == [("a", "eda", 4.0, 0, 1.0, 0.0), ("a", "eda", 4.0, 1, 2.0, 0.25)]


def test_build_or_load(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    root = str(tmp_path / "store")
    (tmp_path / "input").write_text("a")
    key = lambda setting: stores.key_of({"w": setting}, [build], stores.listing(spark, f"{tmp_path}/inp*"))
    first = key(60)
    rows, new = stores.build_or_load(spark, root, first, build)
    assert new and rows.count() == 3 and built == [1]
    rows, new = stores.build_or_load(spark, root, key(60), build)
    assert not new and rows.count() == 3 and built == [1]
    assert stores.build_or_load(spark, root, key(30), build)[1] and built == [1, 1]  # a changed setting
    (tmp_path / "input").write_text("ab")
    assert key(60) != first  # a changed input
    torn = tmp_path / "store" / "torn" / "data-1"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"half a fi")
    rows, new = stores.build_or_load(spark, root, "torn", build)
    assert new and rows.count() == 3


def test_runs_are_seen_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([("S2", 1.5, None, "calm", 3), ("S2", 2.5, "", "target", 2), ("S10", -0.25, 'a,"b"', "calm", 2)], "session_id string, f1 double, note string, label string, raw_label int").withColumn("f1_z", 2 * T.F.col("f1"))
    meta = ("label", "session_id", "raw_label")
    made = stores.manifest(rows, [*meta, "note"], {"window_size": 60})
    assert made["total_windows"] == 3 and made["raw_features"] == 1 and made["normalized_features"] == 1 and made["class_distribution"] == {"calm": 2, "target": 1} and made["windows_per_subject"] == {"S2": 2, "S10": 1}
    with pytest.raises(FileNotFoundError):
        stores.current(spark, root)
    run = stores.committed(spark, root, {"csv": stores.Output(rows, "csv", meta), "pq": stores.Output(rows, last=meta), "stride": stores.Output(rows.where("raw_label = 2"), partition_by=("session_id",))}, made)
    held = stores.current(spark, root)
    assert held["run"] == run and held["outputs"]["csv"] == {"format": "csv", "columns": ["f1", "note", "f1_z", "label", "session_id", "raw_label"], "rows": 3} and held["outputs"]["stride"]["rows"] == 2
    back = stores.stored(spark, root, "csv", "f1 double, note string, f1_z double, label string, session_id string, raw_label int")
    assert sorted(map(str, back.collect())) == sorted(map(str, stores.stored(spark, root, "pq").collect()))
    with pytest.raises(Exception):  # noqa: B017  a run that fails leaves the one before
        stores.committed(spark, root, {"pq": stores.Output(rows), "no": stores.Output(rows.select(T.F.raise_error(T.F.lit("no")).alias("x")))})
    assert stores.current(spark, root)["run"] == run and stores.stored(spark, root, "pq").count() == 3


def test_configuration(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c.yaml")
    with pytest.raises(FileNotFoundError):
        config.load(spark, path)
    (tmp_path / "c.yaml").write_text("windowing: {window_size: 30, step_size: 15}\npreprocessing: {bvp: {band_low_hz: 0.7, band_high_hz: 5, order: 2}, acc: {activity_cutoff_hz: 2}}\nlabels: {mapping: {1: calm, 2: target}}\npaths: {data: /a}\n")
    monkeypatch.setenv("TIDEWATCH_DATA", "/b")
    held = config.load(spark, path, environment={"TIDEWATCH_DATA": "paths.data", "TIDEWATCH_NONE": "x.y"}, required=("labels.mapping", "paths.data"))
    assert held["paths"] == {"data": "/b"} and held["labels"]["mapping"] == {1: "calm", 2: "target"} and "x" not in held
    s = config.settings(held)
    assert (s.width, s.step, s.band, s.band_order, s.activity_hz, s.lookback) == (30, 15, (0.7, 5.0), 2, 2, 180)
    with pytest.raises(ValueError, match="a.b, c"):
        config.load(spark, path, required=("a.b", "c"))
    base = {"windowing": {"window_size": 60, "step_size": 60}, "labels": {"mapping": {"0": "none"}}}
    assert config.load(spark, f"{path}.no", base)["labels"]["mapping"] == {0: "none"}
    both = config.load(spark, path, base)
    assert both["windowing"] == {"window_size": 30, "step_size": 15} and both["labels"]["mapping"] == {0: "none", 1: "calm", 2: "target"} and base["windowing"]["window_size"] == 60

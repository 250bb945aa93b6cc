"""The window table of a stream: channels of different rates in one stateful query, delay lines and lookbacks in its state, windows told when nothing can change them.

The input is one tagged stream (session_id, channel, i, ts, x, y, z) of all channels' samples. Rows may come late, repeated and out of order: they wait in the
session's state until the watermark has passed their ts, and are then cleaned in order by the same kernel as a batch, with filters, the 26-sample delay line, runs and
open responses continued from the state. Cleaned rows of open windows and the beats of the lookback are what else the state holds, so it is bounded by window and lookback, not by the
length of the session. A window is told when each channel has settled past its end. A session is ended ``idle`` seconds after its last sample: tails
are padded as in a batch, the last windows told, the state dropped.

Windows are the rows of ``builder.build`` over the same samples, if no row comes later than the watermark allows (such rows count as missing) and each channel begins with its session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import session as S
from tidewatch.operators import builder as B

STATE = "names array<string>, sizes array<int>, data array<double>"
COLUMNS = ["window_start_sec", "raw_label", "label", "motion_corrupted", "hrv_valid", "hrv_n_peaks", *B.FEATURES]


def output(session_id: T.StructField) -> T.StructType:
    kinds = {"raw_label": T.IntegerType(), "label": T.StringType(), "motion_corrupted": T.IntegerType(), "hrv_valid": T.IntegerType(), "hrv_n_peaks": T.IntegerType()}
    return T.StructType([T.StructField("session_id", session_id.dataType), *[T.StructField(c, kinds.get(c, T.DoubleType())) for c in COLUMNS]])


def slope(x: np.ndarray, i: np.ndarray) -> float | None:
    """Least-squares slope; none for less than two samples."""
    d = i - i.mean() if len(i) else i
    return float((d * x).sum() / (d * d).sum()) if len(x) > 1 else None


def moment(x: np.ndarray, k: int, less: float = 0.0) -> float | None:
    d = x - x.mean()
    v = float((d * d).mean())
    return float((d**k).mean() / v ** (k / 2) - less) if v > 0 else None


def features(k: int, rows: dict[str, tuple[np.ndarray, np.ndarray]], labels: dict[int, str], s: S.Settings) -> dict[str, Any] | None:
    """The row of window k from the cleaned rows (index, values) of each kind in it; none if a gate drops it. The same definitions as the batch's aggregation."""
    index, e = rows["eda"]
    if not len(e):
        return None
    smoothed, tonic, valid, code = e[:, 0], e[:, 1], e[:, 3], e[:, 4]
    codes = code[~np.isnan(code)].astype(int)
    values, counts = np.unique(codes, return_counts=True)
    label = int(values[np.argmax(counts)]) if len(values) else None
    if label not in labels or (1 - valid).mean() > s.most_invalid:
        return None
    out: dict[str, Any] = dict.fromkeys(B.FEATURES, 0.0) | dict.fromkeys(B.HRV)
    out |= {"scl_mean": tonic.mean(), "scl_std": tonic.std(), "scl_min": tonic.min(), "scl_max": tonic.max(), "scl_range": tonic.max() - tonic.min(), "scl_median": np.median(tonic), "scl_slope": slope(tonic, index.astype(float)) or 0.0}
    out |= {"scl_auc": tonic.sum() - (tonic[0] + tonic[-1]) / 2, "eda_skewness": moment(smoothed, 3), "eda_kurtosis": moment(smoothed, 4, 3.0)}
    r = rows["response"][1]
    r = r[(r[:, 0] >= s.least_amplitude) & (r[:, 0] <= s.most_amplitude)]
    if len(r):
        known = r[~np.isnan(r[:, 2]), 2]
        out |= {"scr_peak_count": float(len(r)), "scr_amplitude_mean": r[:, 0].mean(), "scr_amplitude_max": r[:, 0].max(), "scr_amplitude_std": r[:, 0].std(), "scr_amplitude_sum": r[:, 0].sum(), "scr_rise_time_mean": r[:, 1].mean(), "scr_recovery_time_mean": known.mean() if len(known) else 0.0}
    t, v = rows["temp"]
    if len(v):
        v = v[:, 0]
        out |= {"temp_mean": v.mean(), "temp_std": v.std(), "temp_min": v.min(), "temp_max": v.max(), "temp_median": np.median(v), "temp_slope": slope(v, t.astype(float)) or 0.0}
    a, moved = rows["acc"][1], False
    if len(a):
        mag, jerk = a[:, 3], a[:, 5]
        out |= {f"acc_{c}_std": a[:, j].std() for j, c in enumerate("xyz")} | {"acc_magnitude_mean": mag.mean(), "acc_magnitude_std": mag.std(), "acc_magnitude_max": mag.max(), "acc_sma": np.abs(a[:, :3]).sum(axis=1).mean(), "acc_energy": (mag * mag).mean()}
        out |= {"acc_activity_mean": a[:, 4].mean(), "acc_jerk_mag_mean": jerk.mean(), "acc_jerk_mag_std": jerk.std(), "acc_jerk_mag_p95": float(np.percentile(jerk, 95))}
        moved = out["acc_jerk_mag_p95"] > s.motion_limit
    beats = rows["beat"][0].astype(float)
    if not moved and len(beats) >= 2:
        ibi = np.diff(beats) * (1000.0 / s.fs_beat)
        change = np.diff(ibi)
        out |= {"hrv_mean_hr": 60000.0 / ibi.mean(), "hrv_pnn50": 100.0 * (np.abs(change) > 50).sum() / (len(change) + 1), "hrv_mean_rr": ibi.mean(), "hrv_median_rr": np.median(ibi), "hrv_min_rr": ibi.min(), "hrv_max_rr": ibi.max()}
        out |= {"hrv_rmssd": np.sqrt((change * change).mean()) if len(change) else None, "hrv_sdnn": ibi.std(ddof=1) if len(ibi) > 1 else None, "hrv_sdsd": change.std(ddof=1) if len(change) > 1 else None}
        if len(rows["spectrum"][1]):
            out |= {name: None if np.isnan(x) else x for name, x in zip(B.HRV[9:], rows["spectrum"][1][0], strict=False)}
    return out | {"window_start_sec": k * float(s.step), "raw_label": label, "label": labels[label], "motion_corrupted": int(moved), "hrv_valid": int(not moved and len(beats) >= 2), "hrv_n_peaks": 0 if moved else len(beats)}


class Live:
    """A session of the stream: samples that wait, the cleaning's state, and cleaned rows of open windows, all in one dict of arrays."""

    def __init__(self, settings: S.Settings, labels: dict[int, str], state: S.State | None = None):
        self.s, self.labels = settings, labels
        self.session = S.Session(settings, state)
        self.state = self.session.state
        self.rates = {"eda": settings.fs_eda, "response": settings.fs_eda, "beat": settings.fs_beat, "temp": settings.fs_temp, "acc": settings.fs_acc}

    def waiting(self) -> np.ndarray:
        """Rows (channel, i, ms, x, y, z) that the watermark hasn't passed."""
        return self.state.get("wait", np.zeros(0)).reshape(-1, 6)

    def put(self, rows: np.ndarray) -> None:
        if len(rows):
            self.state["wait"] = np.concatenate([self.waiting(), rows]).ravel()
            self.session.put("last.ms", max(self.session.get("last.ms"), rows[:, 2].max()))

    def release(self, upto_ms: float) -> list[dict]:
        """Windows that the rows up to a time complete."""
        rows = self.waiting()
        ready = rows[:, 2] <= upto_ms
        self.state["wait"] = rows[~ready].ravel()
        rows = rows[ready]
        for c, channel in enumerate(S.CHANNELS):
            own = rows[rows[:, 0] == c]
            if len(own):
                own = own[np.argsort(own[:, 1], kind="stable")]
                self.hold(self.session.push(channel, own[:, 1].astype(np.int64), own[:, 3:6] if channel == "acc" else own[:, 3:4]))
        return self.told(False)

    def end(self) -> list[dict]:
        self.hold(self.session.finish())
        return self.told(True)

    def hold(self, rows: S.Rows) -> None:
        for kind, index, values in rows:
            both = np.column_stack([index.astype(float), values])
            self.state[f"held.{kind}"] = np.concatenate([self.held(kind), both]).ravel()

    def held(self, kind: str) -> np.ndarray:
        return self.state.get(f"held.{kind}", np.zeros(0)).reshape(-1, 1 + S.WIDTH)

    def told(self, end: bool) -> list[dict]:
        s, k, out = self.s, int(self.session.get("window")), []
        while True:
            stop = k * s.step + s.width
            settled = self.session.settled()
            if settled["eda"] < round(stop * s.fs_eda):
                break
            present = [kind for kind, channel in (("response", "eda"), ("beat", "bvp"), ("temp", "temp"), ("acc", "acc")) if self.session.seen(channel)]
            if not end and any(settled[kind] < round(stop * self.rates[kind]) for kind in present):
                break
            rows = {}
            for kind in S.KINDS:
                held = self.held(kind)
                first, last = (k, k) if kind == "spectrum" else (round(k * s.step * self.rates[kind]), round(stop * self.rates[kind]) - 1)
                here = held[(held[:, 0] >= first) & (held[:, 0] <= last)]
                rows[kind] = here[:, 0].astype(np.int64), here[:, 1:]
            found = features(k, rows, self.labels, s)
            if found:
                out.append(found)
            k += 1
            for kind in S.KINDS:
                held = self.held(kind)
                self.state[f"held.{kind}"] = held[held[:, 0] >= (k if kind == "spectrum" else round(k * s.step * self.rates[kind]))].ravel()
        self.session.put("window", k)
        return out


def packed(state: S.State) -> tuple[list[str], list[int], list[float]]:
    held = {k: v for k, v in state.items() if len(v)}
    return list(held), [len(v) for v in held.values()], np.concatenate(list(held.values())).tolist() if held else []


def unpacked(names: list[str], sizes: list[int], data: list[float]) -> S.State:
    ends = np.cumsum(sizes).tolist()
    flat = np.array(data, float)
    return {name: flat[b - n : b] for name, n, b in zip(names, sizes, ends, strict=True)}


def live_windows(stream: DataFrame, labels: dict[int, str], s: S.Settings, late: str = "10 seconds", idle: float = 60.0) -> DataFrame:
    """The window table of a stream of samples (session_id, channel, i, ts, x, y, z)."""
    if s.beat_level is None:
        raise ValueError("a stream needs the wave's mean square (beat_level), e.g. of the calibration: the whole session's isn't known")
    schema = output(stream.schema["session_id"])
    rows = stream.withWatermark("ts", late).where(F.col("channel").isin(*S.CHANNELS) & F.col("i").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select("session_id", "ts", (F.array_position(F.array(*map(F.lit, S.CHANNELS)), F.col("channel")) - 1).cast("double").alias("c"), F.col("i").cast("double").alias("i"), (F.unix_micros("ts") / 1000).alias("ms"), *[F.col(c).cast("double").alias(c) for c in "xyz"])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = Live(s, labels, unpacked(*state.get) if state.exists else None)
        for p in parts:
            live.put(p[["c", "i", "ms", "x", "y", "z"]].to_numpy(float))
        mark = float(state.getCurrentWatermarkMs())
        found = live.release(mark) if mark > 0 else []
        last = live.session.get("last.ms")
        if state.hasTimedOut and not len(live.waiting()) and mark >= last + 1000 * idle:
            found += live.end()
            state.remove()
        else:
            state.update(packed(live.state))
            wait = live.waiting()
            state.setTimeoutTimestamp(int(max(mark + 1, wait[:, 2].min() if len(wait) else last + 1000 * idle)))
        if found:
            out = pd.DataFrame(found)[COLUMNS]
            out.insert(0, "session_id", key[0])
            yield out

    return rows.groupBy("session_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch_windows(samples: DataFrame, labels: dict[int, str], s: S.Settings) -> DataFrame:
    """The same windows by the batch's plan, for comparison with a stream's output."""
    return B.build(samples.select("session_id", "channel", "i", "x", "y", "z"), labels, s)

"""Window feature catalogue, normalisation, alignment and reports as aggregate expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level(value: str = "value", i: str = "i") -> dict[str, Column]:
    """Level, spread and trend of a window; std is of the population, slope per sample, area by unit trapezoids."""
    return {
        "mean": F.avg(value), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value), "range": F.max(value) - F.min(value), "median": F.median(value),
        "slope": F.regr_slope(value, i), "auc": F.sum(value) - (F.min_by(value, i) + F.max_by(value, i)) / 2, "skewness": F.skewness(value), "kurtosis": F.kurtosis(value),
    }


def motion(x: str = "x", y: str = "y", z: str = "z", magnitude: str = "mag", jerk: str = "jerk") -> dict[str, Column]:
    """Accelerometer features of a window."""
    return {
        "x_std": F.stddev_pop(x), "y_std": F.stddev_pop(y), "z_std": F.stddev_pop(z), "mag_mean": F.avg(magnitude), "mag_std": F.stddev_pop(magnitude), "mag_max": F.max(magnitude),
        "sma": F.avg(F.abs(x) + F.abs(y) + F.abs(z)), "energy": F.avg(F.col(magnitude) * F.col(magnitude)), "jerk_mean": F.avg(jerk), "jerk_std": F.stddev_pop(jerk), "jerk_p95": F.percentile(jerk, F.lit(0.95)),
    }


def heart(ibi: str = "ibi", diff: str = "d") -> dict[str, Column]:
    """Time-domain beat features; successive differences within the window. The share of large ones is over differences + 1."""
    return {
        "n_beats": F.count(ibi), "mean_rr": F.avg(ibi), "median_rr": F.median(ibi), "min_rr": F.min(ibi), "max_rr": F.max(ibi), "mean_hr": F.try_divide(F.lit(60000.0), F.avg(ibi)),
        "sdnn": F.stddev_samp(ibi), "rmssd": F.sqrt(F.avg(F.col(diff) * F.col(diff))), "sdsd": F.stddev_samp(diff), "pnn50": 100.0 * F.count_if(F.abs(diff) > 50) / (F.count(diff) + 1),
    }


def rounded(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(k) for k, c in columns.items()]


def baseline(rows: DataFrame, names: list[str], code: str = "code", calm: int = 1, sample: bool = True) -> DataFrame:
    """Add mean and std of each feature over a session's calibration rows."""
    w = Window.partitionBy("session_id")
    std = F.stddev_samp if sample else F.stddev_pop
    own = lambda f: F.when(F.col(code) == calm, F.col(f))
    return rows.withColumns({f"{f}_base": F.avg(own(f)).over(w) for f in names} | {f"{f}_spread": std(own(f)).over(w) for f in names})


def z_score(f: str) -> Column:
    """(x - mean) / std of the baseline; 0 where the spread is 0 or undefined, null without a baseline."""
    z = F.try_divide(F.col(f) - F.col(f"{f}_base"), F.col(f"{f}_spread"))
    return F.when(F.col(f"{f}_base").isNull(), F.lit(None)).when(F.coalesce(f"{f}_spread", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(z)


def percent_change(f: str) -> Column:
    return F.when(F.coalesce(f"{f}_base", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(100 * F.try_divide(F.col(f) - F.col(f"{f}_base"), F.col(f"{f}_base")))


def robust_z(rows: DataFrame, f: str, code: str = "code", calm: int = 1) -> DataFrame:
    """(x - median) / (1.4826 MAD) over calibration rows; 0 where the MAD is 0."""
    own = F.when(F.col(code) == calm, F.col(f))
    w = Window.partitionBy("session_id")
    out = rows.withColumn("_m", F.median(own).over(w)).withColumn("_d", F.median(F.abs(own - F.col("_m"))).over(w))
    z = F.when(F.col("_d") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(f) - F.col("_m"), 1.4826 * F.col("_d")))
    return out.withColumn(f"{f}_robust", z).drop("_m", "_d")


def median_fill(f: str, group: str = "session_id") -> Column:
    return F.coalesce(F.col(f), F.median(f).over(Window.partitionBy(group)), F.lit(0.0))


def align_labels(rows: DataFrame, labels: DataFrame, fs: int, fs_label: int) -> DataFrame:
    """Label of the first label sample at or after each sample's time, clipped to the last: an equi-join on a uniform grid."""
    last = labels.groupBy("session_id").agg(F.max("j").alias("_last"))
    at = rows.join(last, "session_id").withColumn("j", F.least(F.ceil(F.col("i") * fs_label / fs), F.col("_last")))
    return at.join(labels, ["session_id", "j"]).drop("_last")


def phases(marks: DataFrame) -> DataFrame:
    """Half-open [t0, t1) between one mark of a session and the next; the last is open."""
    w = Window.partitionBy("session_id").orderBy("t0")
    return marks.withColumns({"phase": F.row_number().over(w), "t1": F.coalesce(F.lead("t0").over(w), F.lit(float("inf")))})


def in_phases(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Samples with the phase that covers them, by one ordered pass over a session's samples and phases: the last phase begun, if it has not ended. Phases of a session don't overlap; of those that begin together the longest counts."""
    phase = F.struct(*[c for c in bounds.columns if c != "session_id"])
    marks = bounds.where("t0 is not null").select("session_id", F.col("t0").cast("double").alias("_at"), phase.alias("_phase"))
    every = rows.withColumn("_at", F.col("t").cast("double")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("_at", F.col("_phase").isNull(), "_phase.t1").rowsBetween(Window.unboundedPreceding, 0)
    inside = every.withColumn("_in", F.last("_phase", ignorenulls=True).over(w)).where("_phase is null and t < _in.t1")
    return inside.select(*rows.columns, "_in.*")


def effect_size(rows: DataFrame, f: str, code: str = "code", target: int = 2) -> DataFrame:
    """Per session: mean difference and Cohen's d with pooled sample std (0 where undefined)."""
    a, b = F.when(F.col(code) == target, F.col(f)), F.when(F.col(code) != target, F.col(f))
    g = rows.groupBy("session_id").agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.stddev_samp(a).alias("_sa"), F.stddev_samp(b).alias("_sb"), F.count(a).alias("_na"), F.count(b).alias("_nb")).where("_na > 0")
    pooled = F.sqrt(F.try_divide((F.col("_na") - 1) * F.col("_sa") ** 2 + (F.col("_nb") - 1) * F.col("_sb") ** 2, F.col("_na") + F.col("_nb") - 2))
    return g.select("session_id", (F.col("_ma") - F.col("_mb")).alias("diff"), F.coalesce(F.try_divide(F.col("_ma") - F.col("_mb"), F.nullif(pooled, F.lit(0.0))), F.lit(0.0)).alias("d"))


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) of every pair of features, missing values left out pair by pair: one pass, one row per pair. Aggregated by the first of a pair, so wide tables have no expression of all pairs."""
    none = rows.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f) for f in names])  # pairs without rows are told too
    every = rows.select(*[F.col(f).cast("double").alias(f) for f in names]).unionByName(none)
    long = every.select(*names, F.posexplode(F.array(*names)).alias("_k", "_v"))
    wide = long.groupBy("_k").agg(*[F.corr("_v", f).alias(f) for f in names])
    out = wide.select("_k", F.posexplode(F.array(*names)).alias("_l", "r")).where("_k < _l")
    name = lambda c: F.get(F.lit(names), F.col(c))
    return out.select(name("_k").alias("a"), name("_l").alias("b"), "r")


def anova(rows: DataFrame, names: list[str], target: str = "target") -> DataFrame:
    """F score of each feature against the classes, from counts, sums and squares."""
    long = rows.select(target, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in names])).alias("x")).select(target, "x.*").where("v is not null")
    by = long.groupBy("feature", target).agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    g = by.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("c"))
    between, within = F.col("c") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("c")
    return g.select("feature", F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k"))).alias("f"))


def metrics(rows: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy (0 where a share has no rows)."""
    c = lambda e: F.count_if(F.expr(e))
    g = rows.groupBy(*by).agg(c(f"{y} = 1 and {p} = 1").alias("tp"), c(f"{y} = 0 and {p} = 1").alias("fp"), c(f"{y} = 1 and {p} = 0").alias("fn"), c(f"{y} = 0 and {p} = 0").alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return g.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": share(tp + tn, tp + fp + fn + tn)})


def threshold_sweep(rows: DataFrame, thresholds: list[float], y: str = "y", score: str = "score") -> DataFrame:
    """Metrics at each threshold; the grid is a literal, a few rows for each scored row."""
    at = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return metrics(at.withColumn("p", (F.col(score) >= F.col("threshold")).cast("int")), ["threshold"], y)


def auc(rows: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve from average ranks; null with one class. Ranks come from counts per distinct score."""
    s = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    g = s.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    n = F.col("n") - F.col("p")
    return g.select(*by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * n).alias("auc"))


#: Fixed values of the two-rule classifier: intervals below 800 ms, more than 3.5 responses a minute.
def rule_threshold(rr: str, scr: str, rr_below: float = 800.0, scr_above: float = 3.5) -> Column:
    """Both conditions; a missing value makes its condition false."""
    return (F.coalesce(F.col(rr) < rr_below, F.lit(False)) & F.coalesce(F.col(scr) > scr_above, F.lit(False))).cast("int")


@dataclass(frozen=True)
class Rule:
    """Points for a feature that lies below or above a limit, an SQL expression of its baseline b."""

    feature: str
    side: str
    limit: str
    points: int


#: The points of the weighted scoring, and the score from which a window is a target.
WEIGHTED, LEAST_SCORE = (
    Rule("hrv_time_mean_hr", "<", "b - 50", 20), Rule("hrv_time_rmssd", "<", "0.7 * b", 10), Rule("eda_scr_rate", ">", "b + 1.5", 20), Rule("eda_phasic_std", ">", "1.5 * b", 20), Rule("acc_activity_intensity", ">", "1.3 * b", 15), Rule("temp_mean", "<", "b - 0.3", 15),
), 35


def scoring_baseline(rows: DataFrame, rules: Sequence[Rule] = WEIGHTED, target: str = "y") -> DataFrame:
    """One row: the mean of each rule's feature over all training rows that are no target. Features that rows lack are left out."""
    return rows.where(F.col(target) == 0).agg(*[F.avg(r.feature).alias(f"_b_{r.feature}") for r in rules if r.feature in rows.columns] or [F.count("*").alias("_n")])


def weighted_scores(rows: DataFrame, base: DataFrame, rules: Sequence[Rule] = WEIGHTED, least: int = LEAST_SCORE) -> DataFrame:
    """Rows with points, the sum of the rules that hold against the baseline, and p, whether they reach the limit. A missing value or baseline makes its rule false."""
    held = rows.crossJoin(F.broadcast(base))  # one row
    tests = [(F.expr(f"`{r.feature}` {r.side} {re.sub(r'[b]', f'`_b_{r.feature}`', r.limit)}"), r.points) for r in rules if f"_b_{r.feature}" in base.columns]
    points = sum((F.when(F.coalesce(t, F.lit(False)), F.lit(k)).otherwise(F.lit(0)) for t, k in tests), F.lit(0))
    return held.withColumn("points", points).withColumn("p", (F.col("points") >= least).cast("int")).drop(*base.columns)


def class_counts(rows: DataFrame, label: str, names: dict[int, str], target: int, normalised: Sequence[str]) -> DataFrame:
    """(session_id, a count for each class, other, total, no_baseline, all_null): windows by class; the first class named is the baseline; all_null counts windows without any normalised value."""
    code = F.col(label)
    first = next(iter(names))
    none = F.lit(len(normalised) > 0)
    for c in normalised:
        none = none & F.col(c).isNull()
    return rows.groupBy("session_id").agg(
        *[F.count_if(code == k).alias(name) for k, name in names.items()], F.count_if(code.isin([k for k in names if k != target])).alias("other"), F.count("*").alias("total"),
        (F.count_if(code == first) == 0).alias("no_baseline"), F.count_if(none).alias("all_null"),
    )


def phase_table(cleaned: DataFrame, bounds: DataFrame, rates: dict[str, float], low: float = 40.0, high: float = 180.0) -> DataFrame:
    """(session_id, phase, t0, t1, tonic_mean, phasic_std, hr_mean, hr_std, rmssd, temp_mean, acc_std) of cleaned rows (session_id, kind, i, v0..) in phases [t0, t1) of their session.

    Rates a minute lie in the middle of the interval between two beats, within the plausible range; successive differences are of intervals whose beats all lie in the phase, more than two of them.
    Phases of a session are few; rows meet them by session.
    """
    fs = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(v))) for k, v in rates.items()])
    rows = cleaned.where(F.col("kind").isin(*rates)).withColumn("t", F.col("i") / fs)
    before, before2 = F.col("v0") / rates["beat"], F.col("v1") / rates["beat"]
    held = rows.join(bounds, "session_id").where((F.col("t") >= F.col("t0")) & ((F.col("t") < F.col("t1")) | ((F.col("kind") == "beat") & ((F.col("t") + before) / 2 < F.col("t1")))))
    of = lambda kind, k: F.when((F.col("kind") == kind) & (F.col("t") < F.col("t1")), F.col(f"v{k}"))
    middle, rate = (F.col("t") + before) / 2, F.try_divide(F.lit(60.0), F.col("t") - before)
    hr = F.when((F.col("kind") == "beat") & (middle >= F.col("t0")) & (middle < F.col("t1")) & rate.between(low, high), rate)
    change = F.when((F.col("kind") == "beat") & (F.col("t") < F.col("t1")) & (before2 >= F.col("t0")), 1000.0 * ((F.col("t") - before) - (before - before2)))
    return held.groupBy("session_id", "phase", "t0", "t1").agg(
        F.avg(of("eda", 1)).alias("tonic_mean"), F.stddev_pop(of("eda", 2)).alias("phasic_std"), F.avg(hr).alias("hr_mean"), F.stddev_pop(hr).alias("hr_std"), F.sqrt(F.avg(change * change)).alias("rmssd"), F.avg(of("temp", 0)).alias("temp_mean"), F.stddev_pop(of("acc", 3)).alias("acc_std"),
    )


def rule_score(tests: list[tuple[Column, int]], least: int) -> Column:
    """Sum of the points whose test holds, against a limit."""
    total = sum((F.when(F.coalesce(t, F.lit(False)), F.lit(k)).otherwise(F.lit(0)) for t, k in tests), F.lit(0))
    return (total >= least).cast("int")

"""Quality and session reports as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column, of: Column | None = None) -> Column:
    """Percentage of rows (of those that ``of`` keeps) for which a condition holds; 0 without any."""
    own = condition if of is None else condition & of
    return 100.0 * F.count_if(own) / F.greatest(F.lit(1), F.count("*") if of is None else F.count_if(of))


def assertions(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, ok, failed): whether a condition holds in all rows. Null does not hold."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    long = counts.unpivot([], list(checks), "check", "failed")
    return long.select("check", (F.col("failed") == 0).alias("ok"), "failed")


def require(rows: DataFrame, checks: dict[str, Column]) -> None:
    """Raise if a check fails."""
    bad = {r["check"]: r["failed"] for r in assertions(rows, checks).where("not ok").collect()}  # a row per check
    if bad:
        raise ValueError(f"checks that fail, and in how many rows: {bad}")


def transposed(rows: DataFrame, names: list[str]) -> DataFrame:
    """(parameter, median, mean, min, max, std): one row per column."""
    long = rows.select(*[F.col(f).cast("double").alias(f) for f in names]).unpivot([], names, "parameter", "v")
    return long.groupBy("parameter").agg(F.median("v").alias("median"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_samp("v").alias("std"))


def guarded_correlation(a: str, b: str, least: int = 3) -> Column:
    """Pearson's r over rows that have both; null with fewer than ``least`` of them or where one is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when((F.count(x) >= least) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


def mass(p: str, low: float = 0.001, high: float = 0.999) -> dict[str, Column]:
    """How many probabilities are very low, very high and between."""
    return {"low": F.count_if(F.col(p) < low), "high": F.count_if(F.col(p) > high), "middle": F.count_if((F.col(p) >= low) & (F.col(p) <= high))}


def motion_by_phase(rows: DataFrame, value: str, phase: str = "phase", k: float = 3.0) -> DataFrame:
    """(session_id, phase, mean, std, high_pct): how much of each phase lies over mean + k std of the whole session. Two aggregations, no window over sessions."""
    limit = rows.groupBy("session_id").agg((F.avg(value) + k * F.stddev_pop(value)).alias("_limit"))
    g = rows.join(limit, "session_id").groupBy("session_id", phase)
    return g.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), share(F.col(value) > F.col("_limit")).alias("high_pct"))


def variants(results: DataFrame, target: float = 0.5) -> DataFrame:
    """(variant, n_folds, mean_f1, std_f1, mean_recall, min_recall, n_below): held-out metrics of each variant over its folds; std of the sample."""
    return results.groupBy("variant").agg(
        F.count("*").alias("n_folds"), F.avg("f1").alias("mean_f1"), F.stddev_samp("f1").alias("std_f1"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.count_if(F.col("recall") < target).alias("n_below")
    )


def matrix(results: DataFrame, rows: str, across: str, value: str, names: list) -> DataFrame:
    """A value by two keys, one row per first key."""
    wide = results.groupBy(rows).pivot(across, names).agg(F.first(value))
    return wide


def plateau(curve: DataFrame, n: str = "n_features", score: str = "f1", least: str = "min_recall", floor: float = 0.5, slack: float = 0.005) -> DataFrame:
    """The smallest number of features whose score is within ``slack`` of the best and whose worst fold reaches the floor; the best one if none does."""
    best = curve.agg(F.max(score).alias("_best"))
    near = curve.crossJoin(F.broadcast(best)).withColumn("_fine", (F.col(score) >= F.col("_best") - slack) & (F.col(least) >= floor))
    order = [F.desc("_fine"), F.when(F.col("_fine"), F.col(n)).otherwise(F.lit(0)), F.desc(score), F.col(n)]
    return near.orderBy(*order).limit(1).drop("_best", "_fine")


def eliminated(pairs: DataFrame, score: DataFrame) -> list[str]:
    """Features that go, of correlated pairs (a, b, r): from the strongest pair on, the one of lower score (feature, f) goes if both are left. Pairs of features are few: bounded by the schema, not the rows."""
    f = {r["feature"]: r["f"] for r in score.collect()}
    gone: list[str] = []
    for r in sorted(pairs.collect(), key=lambda r: (-abs(r["r"]), r["a"], r["b"])):
        if r["a"] not in gone and r["b"] not in gone:
            gone.append(r["b"] if f[r["a"]] >= f[r["b"]] else r["a"])
    return gone


def marked_phases(marks: DataFrame, sessions: DataFrame, defaults: list[tuple[float, float]]) -> DataFrame:
    """(session_id, phase, t0, t1): a session with exactly as many marks as phases has each phase end at its mark, the first begins at 0; others have the defaults."""
    n = len(defaults)
    by = marks.groupBy("session_id").agg(F.sort_array(F.collect_list("t")).alias("_m"))  # marks of a session are set by hand: a few
    given = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.alias("phase"), F.when(k == 1, F.lit(0.0)).otherwise(F.get("_m", k - 2)).alias("t0"), F.get("_m", k - 1).alias("t1")))
    usual = F.array(*[F.struct(F.lit(k + 1).alias("phase"), F.lit(float(a)).alias("t0"), F.lit(float(b)).alias("t1")) for k, (a, b) in enumerate(defaults)])
    rows = sessions.join(by, "session_id", "left").select("session_id", F.explode(F.when(F.size("_m") == n, given).otherwise(usual)).alias("p"))
    return rows.select("session_id", "p.*")


def running(rows: DataFrame, value: str, seconds: float) -> Column:
    """Mean over a centred frame of time, by t in seconds; the sample itself is always in it."""
    ms = (F.col("t") * 1000).cast("long")
    half = int(seconds * 500)
    return F.avg(value).over(Window.partitionBy("session_id").orderBy(ms).rangeBetween(-half, half))

"""Ordered operators on samples: windows, labels, differences, runs, frames, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def order() -> WindowSpec:
    """A session's samples in order."""
    return Window.partitionBy("session_id").orderBy("i")


def session() -> WindowSpec:
    return Window.partitionBy("session_id")


def tumbling(rows: DataFrame, width: int) -> DataFrame:
    """Start-anchored windows of ``width`` samples: window = index of the window. Partial last windows stay until full() drops them."""
    return rows.withColumn("window", F.floor(F.col("i") / width))


def sliding(rows: DataFrame, width: int, step: int) -> DataFrame:
    """Each sample once per window that covers it; window k covers [k step, k step + width)."""
    first = F.greatest(F.ceil((F.col("i") - width + 1) / step), F.lit(0))
    return rows.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("i") / step))))


def end_anchored(rows: DataFrame, short: int, long: int, step: int) -> DataFrame:
    """Windows that end at long, long + step, ...: each sample with every end whose long lookback covers it, and whether the short one does."""
    k0 = F.greatest(F.ceil((F.col("i") + 1 - long) / step), F.lit(0))
    ends = F.explode(F.sequence(k0, F.floor(F.col("i") / step)))
    out = rows.withColumn("window", ends).withColumn("end", F.col("window") * step + long)
    return out.withColumn("recent", F.col("i") >= F.col("end") - short)


def majority(code: str = "code") -> Column:
    """Most frequent label; the smallest on ties."""
    return F.mode(code, True)


def any_target(code: str = "code", target: int = 2) -> Column:
    return F.when(F.max((F.col(code) == target).cast("int")) == 1, F.lit(target)).otherwise(F.mode(code, True))


def center(code: str = "code", i: str = "i") -> Column:
    """Label at the middle sample of each window; all windows have their first sample as the least index."""
    return F.get(F.sort_array(F.collect_list(F.struct(i, code))), (F.count("*") / 2).cast("int"))[code]


def difference(value: str = "value") -> Column:
    """Backward difference; the first is 0."""
    return F.col(value) - F.coalesce(F.lag(value).over(order()), F.col(value))


def jerk(fs: float, axes: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """Length of the axes' backward difference a second; the first is 0. A turn at equal magnitude has jerk."""
    return F.sqrt(sum((difference(a) * difference(a) for a in axes), F.lit(0.0))) * float(fs)


def gradient(value: str = "value") -> Column:
    """Central difference, one-sided at both ends."""
    before, after, x = F.lag(value).over(order()), F.lead(value).over(order()), F.col(value)
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def runs(rows: DataFrame, flag: Column) -> DataFrame:
    """Islands of equal flag: run number, first and last index, length."""
    change = (F.lag(flag).over(order()).isNull() | (F.lag(flag).over(order()) != flag)).cast("int")
    marked = rows.withColumns({"flag": flag, "_change": change}).withColumn("run", F.sum("_change").over(order()))
    return marked.groupBy("session_id", "run").agg(F.first("flag").alias("flag"), F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"))


def long_runs(rows: DataFrame, flag: Column, least: int) -> DataFrame:
    """Runs where flag holds for ``least`` samples or more."""
    return runs(rows, flag).where(F.col("flag") & (F.col("n") >= least))


def ectopic(rows: DataFrame, value: str, low: float, high: float, share: float, lookback: int = 5, need: int = 2) -> DataFrame:
    """Replace a value that is further than share from the median of the plausible raw ones before it."""
    frame = order().rowsBetween(-lookback, -1)
    fine = F.when(F.col(value).between(low, high), F.col(value))
    out = rows.withColumns({"_n": F.count(fine).over(frame), "_m": F.percentile(fine, F.lit(0.5)).over(frame)})
    off = (F.col("_n") >= need) & (F.abs(F.col(value) - F.col("_m")) > share * F.col("_m"))
    return out.withColumns({"corrected": F.when(off, F.col("_m")).otherwise(F.col(value)), "ectopic": F.coalesce(off, F.lit(False))}).drop("_n", "_m")


def rolling_mean(value: str, before: int, after: int, need: int = 1) -> Column:
    frame = order().rowsBetween(-before, after)
    return F.when(F.count(value).over(frame) >= need, F.avg(value).over(frame))


def running_max(value: str) -> Column:
    return F.max(value).over(order().rowsBetween(Window.unboundedPreceding, 0))


def shift_ahead(value: str, by: int) -> Column:
    """Shift forward in time, the tail padded with the last value."""
    last = F.last(value).over(order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(F.lead(value, by).over(order()), last)


def interpolate(rows: DataFrame, value: str, bad: Column) -> DataFrame:
    """Linear interpolation over flagged samples by index; ends clamp to the nearest good value."""
    good, at = F.when(~bad, F.col(value)), F.when(~bad, F.col("i"))
    back, ahead = order().rowsBetween(Window.unboundedPreceding, 0), order().rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumns({"_v0": F.last(good, True).over(back), "_i0": F.last(at, True).over(back), "_v1": F.first(good, True).over(ahead), "_i1": F.first(at, True).over(ahead)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(F.col("i") - F.col("_i0"), F.col("_i1") - F.col("_i0"))
    return out.withColumn("filled", F.when(F.col("_i0") == F.col("_i1"), F.col("_v0")).otherwise(F.coalesce(line, "_v0", "_v1"))).drop("_v0", "_i0", "_v1", "_i1")


def lookback(rows: DataFrame, width: int, step: int, long: int) -> DataFrame:
    """Each sample with every window in whose lookback it lies: window k ends at k step + width and looks ``long`` samples back, cut at the session's start."""
    first = F.greatest(F.ceil((F.col("i") + 1 - width) / step), F.lit(0))
    last = F.floor((F.col("i") + long - width) / step)
    return rows.withColumn("window", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def configured(rows: DataFrame, configurations: list[tuple[int, int]]) -> DataFrame:
    """Each sample once per configuration (width, step) and window of it that covers the sample."""
    grid = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(s).alias("step")) for w, s in configurations]))
    out = rows.withColumn("_c", grid).withColumns({"width": F.col("_c.width"), "step": F.col("_c.step")}).drop("_c")
    first = F.greatest(F.ceil((F.col("i") - F.col("width") + 1) / F.col("step")), F.lit(0))
    return out.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("i") / F.col("step")))))


def outliers(rows: DataFrame, value: str, low: float, high: float, k: float = 10.0, most: float = 0.05) -> DataFrame:
    """Rows with bad: outside the plausible range, or further than k MAD from the session's median, the latter only where it flags less than ``most`` of the session."""
    middle = rows.groupBy("session_id").agg(F.median(value).alias("_m"))
    off = rows.join(middle, "session_id").withColumn("_off", F.abs(F.col(value) - F.col("_m")))
    spread = off.groupBy("session_id").agg(F.median("_off").alias("_d"))
    far = off.join(spread, "session_id").withColumn("_far", F.col("_off") > k * F.col("_d"))
    share = F.avg(F.col("_far").cast("int")).over(session())
    return far.withColumn("bad", ~F.col(value).between(low, high) | (F.col("_far") & (share < most))).drop("_m", "_off", "_d", "_far")


def maxima(rows: DataFrame, value: str, least: float) -> DataFrame:
    """Samples above their predecessor, not below their successor, and over a height."""
    out = rows.withColumns({"_b": F.lag(value).over(order()), "_f": F.lead(value).over(order())})
    return out.where((F.col(value) > F.col("_b")) & (F.col(value) >= F.col("_f")) & (F.col(value) > least)).drop("_b", "_f")

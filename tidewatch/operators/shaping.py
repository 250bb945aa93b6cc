"""Joins, projections and fills that put feature tables into shape."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.scratch import written


def chained_left(base: DataFrame, others: list[DataFrame], on: list[str]) -> DataFrame:
    """base with each of the others joined on its keys; rows of base always stay."""
    return reduce(lambda left, right: left.join(right, on, "left"), others, base)


def side_by_side(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Columns of frames that have the same keys, one row per key."""
    return reduce(lambda left, right: left.join(right, keys), frames)


def map_codes(code: Column, names: Mapping[int, str], default: str | None = None) -> Column:
    """A code's name by a literal map; the default, or null, where the map has none."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def interpolated_onto(grid: DataFrame, series: DataFrame, value: str = "value") -> DataFrame:
    """The series' value at each time of the grid (session_id, t), linear between its samples, clamped at its ends; null for a session without samples.

    One sort per session over both: no range join.
    """
    both = grid.select("session_id", "t", F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_grid")).union(series.select("session_id", "t", F.col(value).cast("double"), F.lit(False)))
    order = Window.partitionBy("session_id").orderBy("t")
    back, ahead = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("_v").isNotNull(), F.struct("t", "_v"))
    both = both.withColumns({"_a": F.last(at, True).over(back), "_b": F.first(at, True).over(ahead)}).where("_grid")
    share = F.try_divide(F.col("t") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    line = F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * share
    return both.select("session_id", "t", F.when(F.col("_a.t") == F.col("_b.t"), F.col("_a._v")).otherwise(F.coalesce(line, "_a._v", "_b._v")).alias(value))


def inverse(x: Column) -> Column:
    """1 / x; null at 0, for interpolation."""
    return F.try_divide(F.lit(1.0), x)


def bucketed(rows: DataFrame, keys: list[str], raw: list[str], z: Mapping[str, Column]) -> DataFrame:
    """Keys, then the raw features under raw_ and the normalised ones under z_."""
    return rows.select(*keys, *[F.col(f).alias(f"raw_{f}") for f in raw], *[c.alias(f"z_{f}") for f, c in z.items()])


def filled(rows: DataFrame, names: list[str], how: str | float = "mean") -> DataFrame:
    """Missing values by the mean of the whole column, or by a constant. One pass for all means."""
    if how != "mean":
        return rows.na.fill(float(how), names)
    means = rows.agg(*[F.avg(f).alias(f"_{f}") for f in names])  # one row
    return rows.crossJoin(F.broadcast(means)).select(*[F.coalesce(f, f"_{f}").alias(f) if f in names else F.col(f) for f in rows.columns])


def split_sessions(rows: DataFrame, held: list, key: str = "session_id") -> DataFrame:
    """Rows with part: "test" for the sessions held out, else "train"."""
    return rows.withColumn("part", F.when(F.col(key).isin(held), "test").otherwise("train"))


def first_rows(rows: DataFrame, order: list[Column], k: int, by: list[str] | None = None) -> DataFrame:
    """The first k rows by an order, of all or of each group, with their place. Of all: each partition sends k rows at most."""
    if by:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place in an order of all rows: range partitions are ordered apart, and each adds the rows of those before it."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [f"_k{k}" for k in range(len(order))]
    dealt = written(rows.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_before", *keys)


def natural(name: str) -> list[Column]:
    """Sort keys under which S2 comes before S10."""
    return [F.regexp_extract(name, r"^(\D*)", 1), F.regexp_extract(name, r"(\d+)", 1).cast("long"), F.col(name)]

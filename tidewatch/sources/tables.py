"""Scans: session samples, three-axis series and feature tables under one schema, and device CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Label codes of the surrogate event types; 1 is the calibration (baseline) class, 2 the target.
CODES = {"error": 0, "click": 1, "purchase": 2, "view": 3, "signup": 4}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Epoch seconds of a wall-clock timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / 1e6


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, i, t, value, code): one uniform signal per session, in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    code = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in CODES.items()])
    rows = scan(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", code.alias("code"))
    return rows.select(F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), seconds("ts").alias("t"), "value", "code")


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, i, x, y, z): a three-axis series per session."""
    cols = ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    order = Window.partitionBy("l_suppkey").orderBy(*cols, "l_returnflag", "l_linestatus")
    rows = scan(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))


def features(spark: SparkSession, sf_dir: str, n: int = 8, folds: int = 14) -> DataFrame:
    """(row_id, fold, target, f0..): a feature matrix with groups."""
    rows = scan(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % folds).cast("int").alias("fold"), (F.col("label") == 2).cast("int").alias("target"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(n)])


def device_csv(spark: SparkSession, path: str, value_col: str, time_col: str = "LocalTimestamp") -> DataFrame:
    """Irregular device series from CSV: first row of each timestamp, seconds since the start. Fields that are no numbers are null, and rows without a time go; a file with other columns before, between or after keeps its own order."""
    head = spark.read.option("header", True).option("inferSchema", False).csv(path)
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    rows = head.select(F.col("_metadata.file_path").alias("session_id"), number(time_col).alias("ts"), number(value_col).alias("value"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))
    first = Window.partitionBy("session_id", "ts").orderBy("line")
    rows = rows.where("ts is not null").withColumn("k", F.row_number().over(first)).where("k = 1")
    start = rows.groupBy("session_id").agg(F.min("ts").alias("t0"))
    return rows.join(start, "session_id").select("session_id", (F.col("ts") - F.col("t0")).alias("t"), "ts", "value")


def sampling_rate(rows: DataFrame, time_col: str = "t", intervals: bool = True) -> DataFrame:
    """Estimated rate of each session: intervals over their total duration, or all samples over it."""
    return rows.groupBy("session_id").agg(F.try_divide(F.count(time_col) - (1 if intervals else 0), F.max(time_col) - F.min(time_col)).alias("fs"))


#: One recording: a channel of a session as an array, for ingest from files of whole recordings.
RECORDING = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("fs", T.DoubleType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])


def explode_recordings(recordings: DataFrame) -> DataFrame:
    """Recordings to long form, time implied by index and rate."""
    out = recordings.select("session_id", "channel", "fs", F.posexplode("samples").alias("i", "value"))
    return out.withColumn("t", F.col("i") / F.col("fs"))

"""Recordings into Spark: files of whole sessions, folders of device exports with side files that may be absent.

Files are read by Spark's own scans (bytes of whole files, or CSV under one schema), so that any store it reads will do; a file's content never passes the driver. One file of a recording is
one row of a task; its arrays leave it in pieces of ``PIECE`` samples.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import builder as B

PIECE = 1 << 16
RECORDED = "session_id string, place string, channel string, width int, start long, samples array<double>, error string"
#: Names that recordings of wrist sensors give the channels.
WRIST = {"EDA": "eda", "BVP": "bvp", "TEMP": "temp", "ACC": "acc"}


class _Arrays(pickle.Unpickler):
    """Reads plain containers and numpy arrays, and nothing that could run code."""

    def find_class(self, module: str, name: str):
        root = module.split(".")[0]
        if root == "numpy" and name in ("ndarray", "dtype", "_reconstruct", "scalar"):
            return getattr(__import__(module, fromlist=[name]), name)
        if (module, name) == ("_codecs", "encode"):
            import codecs

            return codecs.encode
        raise pickle.UnpicklingError(f"{module}.{name} is not an array")


def _arrays(content: bytes) -> Iterator[tuple[str | None, str, str, np.ndarray]]:
    """(subject, place, channel, array) of a recording: a nested dict {subject, signal: {place: {channel: array}}, label}, or an archive of arrays named place.channel."""
    if content[:2] == b"PK":
        with np.load(io.BytesIO(content), allow_pickle=False) as held:
            for name in held.files:
                place, _, channel = name.rpartition(".")
                yield None, place, channel, held[name]
        return
    held = _Arrays(io.BytesIO(content), encoding="latin1").load()
    subject = held.get("subject")
    for place, channels in held["signal"].items():
        for channel, values in channels.items():
            yield subject, place, channel, values
    if "label" in held:
        yield subject, "", "label", held["label"]


def recordings(spark: SparkSession, path: str, channels: Sequence[str] | None = None) -> DataFrame:
    """(session_id, place, channel, width, start, samples, error): the arrays of recording files in pieces, row by row for arrays of several columns.

    A session is named by its file's subject, or by the file. Only the named channels ("place.channel", "label") leave a file. A file that can't be read is one row with its error.
    """
    wanted = None if channels is None else set(channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["session_id", "place", "channel", "width", "start", "samples", "error"]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.string()]
        row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(v, types, strict=True)], names)
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                file = where.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    found = [(str(s) if s is not None else file, p, c, np.asarray(v, float)) for s, p, c, v in _arrays(content.as_buffer().to_pybytes()) if wanted is None or (f"{p}.{c}" if p else c) in wanted]
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file is told in its row
                    yield row(file, None, None, None, None, None, f"{type(e).__name__}: {e}")
                    continue
                for session, place, channel, values in found:
                    width = values.shape[1] if values.ndim > 1 else 1
                    flat = values.reshape(len(values), -1)
                    for k in range(0, len(flat), PIECE):
                        yield row(session, place, channel, width, k, flat[k : k + PIECE].ravel(), None)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, RECORDED)


def recorded_samples(rows: DataFrame, place: str = "wrist") -> DataFrame:
    """Samples (session_id, channel, i, x, y, z) of recordings, in the form that the window table takes: the channels of one place, and labels."""
    names = F.create_map(*[F.lit(x) for k in WRIST.items() for x in k])
    own = rows.where(F.col("error").isNull() & ((F.col("place") == place) | (F.col("channel") == "label")))
    own = own.withColumn("name", F.when(F.col("channel") == "label", F.lit("label")).otherwise(F.try_element_at(names, F.col("channel")))).where("name is not null")
    at = own.select("session_id", F.col("name").alias("channel"), "start", "width", "samples", F.explode(F.expr("sequence(0, size(samples) div width - 1)")).alias("k"))
    value = lambda c: F.when(F.col("width") > c, F.get("samples", F.col("k") * F.col("width") + c))
    return at.select("session_id", "channel", (F.col("start") + F.col("k")).alias("i"), value(0).alias("x"), value(1).alias("y"), value(2).alias("z"))


def unreadable(rows: DataFrame) -> DataFrame:
    """(session_id, error) of the files that could not be read."""
    return rows.where("error is not null").select("session_id", "error")


# device exports: <folder>/<prefix>_<tag>.csv, the value in the last column

#: The header of a device's export; the last column is named by its tag.
HEADER = ("LocalTimestamp", "EmotiBitTimestamp", "PacketNumber", "DataLength", "TypeTag", "ProtocolVersion", "DataReliability")
NAME = r"([^/]*)/([^/]*)_([A-Z0-9]{2})( \d+)?\.csv$"


def device_folder(spark: SparkSession, path: str, tags: Sequence[str] | None = None, suffixes: dict[str, str] | None = None) -> DataFrame:
    """(folder, prefix, tag, ts, text, value, line) of all exports under a folder, one scan for all channels; files of other tags aren't opened.

    ``suffixes`` names, by tag, the ending of the file to take where an export was saved with another one ("AX": "AX 1" takes _AX 1.csv); else files with a number after the tag are left out. Fields that are no numbers are null.
    """
    schema = ", ".join(f"`{c}` string" for c in (*HEADER, "payload"))
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_*.csv").csv(path)
    file = F.regexp_replace(F.col("_metadata.file_path"), "%20", " ")
    part = lambda k: F.regexp_extract(file, NAME, k)
    ending = F.create_map(*[F.lit(x) for tag, full in (suffixes or {"": ""}).items() for x in (tag, full)])
    rows = rows.where(part(3) != "").where(F.concat(part(3), part(4)) == F.coalesce(F.try_element_at(ending, part(3)), part(3)))
    if tags is not None:
        rows = rows.where(part(3).isin(*tags))
    order = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    return rows.select(part(1).alias("folder"), part(2).alias("prefix"), part(3).alias("tag"), number("LocalTimestamp").alias("ts"), F.col("payload").alias("text"), number("payload").alias("value"), order.alias("line"))


def device_series(rows: DataFrame, by: Sequence[str] = ("folder", "prefix", "tag")) -> DataFrame:
    """Exports as series: rows without a time go, of rows that repeat a time the first in the file stays, t is seconds since the series began."""
    key = list(by)
    first = Window.partitionBy(*key, "ts").orderBy("line")
    once = rows.where("ts is not null").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    start = once.groupBy(*key).agg(F.min("ts").alias("_t0"))
    return once.join(start, key).select(*key, (F.col("ts") - F.col("_t0")).alias("t"), "ts", "value", "text")


def rates(rows: DataFrame, by: Sequence[str] = ("folder", "prefix", "tag"), intervals: bool = True) -> DataFrame:
    """(by, n, seconds, fs): samples a second, by the mean interval, or by all samples over the duration."""
    g = rows.groupBy(*by).agg(F.count("t").alias("n"), (F.max("t") - F.min("t")).alias("seconds"))
    return g.withColumn("fs", F.try_divide(F.col("n") - (1 if intervals else 0), F.col("seconds")))


def marks(rows: DataFrame, clock: str = "EA", tag: str = "UN", need: int = 3, defaults: Sequence[tuple[str, float, float]] = (("Baseline 1", 60.0, 360.0), ("Stress", 360.0, 480.0), ("Baseline 2", 480.0, 780.0))) -> DataFrame:
    """(folder, prefix, phase, t0, t1, marked): phases of each session from its side file of markers, whose times are the ends of phases, or the defaults where the file is absent or hasn't ``need`` markers.

    Times count from the start of the clock channel; the last phase ends with it.
    """
    key = ["folder", "prefix"]
    span = rows.where(F.col("tag") == clock).groupBy(*key).agg(F.min("ts").alias("begin"), (F.max("ts") - F.min("ts")).alias("stop"))
    side = rows.where((F.col("tag") == tag) & F.col("ts").isNotNull() & (F.length(F.trim("text")) > 0)).groupBy(*key).agg(F.sort_array(F.collect_list("ts")).alias("at"))
    both = span.join(side.where(F.size("at") == need), key, "left").withColumn("at", F.expr("transform(at, x -> x - begin)"))
    phases = []
    for k, (name, a, b) in enumerate(defaults):
        until: Column = F.get("at", F.lit(k + 1)) if k + 1 < need else F.col("stop")
        marked = F.struct(F.lit(name).alias("phase"), F.get("at", F.lit(k)).alias("t0"), until.alias("t1"), F.lit(True).alias("marked"))
        plain = F.struct(F.lit(name).alias("phase"), F.lit(a).alias("t0"), (F.least(F.lit(b), F.col("stop")) if k + 1 == len(defaults) else F.lit(b)).alias("t1"), F.lit(False).alias("marked"))
        phases.append(F.when(F.col("at").isNotNull(), marked).otherwise(plain))
    return both.select(*key, F.explode(F.array(*phases)).alias("p")).select(*key, "p.*")


def window_table(spark: SparkSession, path: str, labels: dict[int, str], settings: B.Settings, place: str = "wrist") -> DataFrame:
    """The window table of a folder of recordings."""
    return B.build(recorded_samples(recordings(spark, path, [*(f"{place}.{c}" for c in WRIST), "label"]), place), labels, settings)

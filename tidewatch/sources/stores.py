"""Stored results: build-or-load by key, several outputs under one commit, run manifests; small files through the Hadoop file system, so that any store Spark writes to will do.

A reader never sees a torn write. ``committed`` writes its outputs into a folder of their own, then the manifest, and last a pointer file by rename; readers follow the
pointer. ``build_or_load`` names a folder by a hash of what the result depends on; its marker is written when all else is done, and a folder without it is built anew elsewhere.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from types import ModuleType
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER, POINTER, MANIFEST = "_COMMITTED.json", "_CURRENT", "manifest.json"
#: How CSV tells a null from an empty text: an empty field is written for the one and two quotes for the other; reading, an empty field becomes the mark that is null.
WRITE_CSV, READ_CSV = {"header": True, "nullValue": "", "emptyValue": '""'}, {"header": True, "nullValue": "\u0001", "emptyValue": ""}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _fs(spark, path)
    return fs.exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text; an absent one is a FileNotFoundError."""
    place, fs = _fs(spark, path)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then renamed, so that it is there whole or not at all."""
    place, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"{path} could not be written")


def listing(spark: SparkSession, *patterns: str) -> list[list]:
    """Path, size and time of change of each input file: what a build reads. Folders are listed with what they hold."""
    out = []
    for pattern in patterns:
        place, fs = _fs(spark, pattern)
        for status in fs.globStatus(place) or []:
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                f = files.next()
                out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def key_of(settings: Any, code: Sequence[ModuleType | Callable], inputs: Any) -> str:
    """A hash of settings, the source of the code that builds, and the listing of its inputs."""
    held = [settings, [inspect.getsource(c) for c in code], inputs]
    return hashlib.sha256(json.dumps(held, sort_keys=True, default=repr).encode()).hexdigest()[:32]


def build_or_load(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table stored under a key, and whether it was built now. Two builders at once both write; the marker names one of the folders, whole."""
    marker = f"{root}/{key}/{MARKER}"
    if exists(spark, marker):
        return spark.read.parquet(f"{root}/{key}/{json.loads(read_text(spark, marker))['data']}"), False
    data = f"data-{uuid.uuid4().hex}"
    build().write.parquet(f"{root}/{key}/{data}")
    stored = spark.read.parquet(f"{root}/{key}/{data}")
    write_text(spark, marker, json.dumps({"data": data, "rows": stored.count(), "columns": stored.columns}))
    return stored, True


@dataclass(frozen=True)
class Output:
    """One output of a run: rows, format and columns that go last."""

    rows: DataFrame
    format: str = "parquet"
    last: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


def ordered(rows: DataFrame, last: Sequence[str]) -> DataFrame:
    """Other columns first, then the named ones that there are, in their order."""
    tail = [c for c in last if c in rows.columns]
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in tail], *tail)


def committed(spark: SparkSession, root: str, outputs: dict[str, Output], manifest: dict | None = None) -> str:
    """Write all outputs of a run and its manifest, then point readers to it; the run's id. CSV has a header; a null is an empty field and an empty text two quotes."""
    run = uuid.uuid4().hex
    counts = {}
    for name, o in outputs.items():
        rows = ordered(o.rows, o.last)
        csv = o.format == "csv"
        writer = rows.write.format(o.format).options(**(WRITE_CSV if csv else {}) | o.options)
        (writer.partitionBy(*o.partition_by) if o.partition_by else writer).save(f"{root}/runs/{run}/{name}")
        counts[name] = {"format": o.format, "columns": rows.columns, "rows": spark.read.format(o.format).options(**(READ_CSV if csv else {}) | o.options).schema(rows.schema).load(f"{root}/runs/{run}/{name}").count()}
    write_text(spark, f"{root}/runs/{run}/{MANIFEST}", json.dumps((manifest or {}) | {"run": run, "outputs": counts}, indent=1, sort_keys=True, default=str))
    write_text(spark, f"{root}/{POINTER}", run)
    return run


def current(spark: SparkSession, root: str) -> dict:
    """The manifest of the run that readers see."""
    return json.loads(read_text(spark, f"{root}/runs/{read_text(spark, f'{root}/{POINTER}')}/{MANIFEST}"))


def stored(spark: SparkSession, root: str, name: str, schema: Any = None) -> DataFrame:
    """An output of the current run."""
    held = current(spark, root)
    kind = held["outputs"][name]["format"]
    reader = spark.read.format(kind).options(**(READ_CSV if kind == "csv" else {}))
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", kind == "csv") if kind == "csv" else reader).load(f"{root}/runs/{held['run']}/{name}")


def manifest(rows: DataFrame, metadata: Sequence[str], config: dict, subject: str = "session_id", label: str = "label", normalised: Sequence[str] = ("_percent_change", "_z_score", "_z")) -> dict:
    """A run manifest of a window table: counts in all, by class and by subject, sizes of the feature lists, and the configuration. As many entries as there are classes and subjects."""
    names = [c for c in rows.columns if c not in metadata]
    norm = [c for c in names if c.endswith(tuple(normalised))]
    count = lambda c: {str(r[0]): r["count"] for r in rows.groupBy(c).count().collect()}
    by_subject = count(subject)
    return {
        "config": config, "subjects": sorted(by_subject), "total_windows": sum(by_subject.values()), "total_features": len(names), "raw_features": len(names) - len(norm), "normalized_features": len(norm),
        "class_distribution": count(label), "windows_per_subject": by_subject,
    }

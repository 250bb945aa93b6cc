"""Helpers that the training-data operators share: scratch tables, batch sizes, byte helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: whole texts are large, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Rows and bytes of the parts in which functions work that make many arrays of a batch's words: a worker keeps what its largest part took.
PART_ROWS, PART_BYTES = 500, 2 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session may do without: it gets a folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tidewatch.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.tidewatch.scratch", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under this application's scratch folder."""
    return f"{shared_dir(spark)}/tidewatch-scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote on the way; call it when its results are stored, as they read these tables."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidewatch-scratch/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, nothing is recomputed."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null counts as the empty text."""
    return [t or "" for t in column.to_pylist()]


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; other columns and clashes fall away."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_bytes(encoded: list) -> list[bytes]:
    """Little-endian 32-bit ids of each of the tokenizers library's encodings."""
    lists = [e.ids for e in encoded]
    ends = np.cumsum([0, *map(len, lists)])
    raw = np.fromiter(chain.from_iterable(lists), "<u4", int(ends[-1])).tobytes()
    ends = (ends * 4).tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes: what is done once per distinct word pays off more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of at most so many rows and about size bytes."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and names it in body; a column would be expanded inside lambdas, once per element."""
    return f"transform(array({value}), {name} -> {body})[0]"

"""The stages of the corpus pipeline, each an operator applied to the documents that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import materialise, table
from tidewatch.llm.op1_packing import pack
from tidewatch.llm.op2_substring import substring_stage
from tidewatch.llm.op4_bagminhash import near_duplicate_stage
from tidewatch.llm.op6_quality import quality_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept texts, packed into sequences. Null and empty texts are one end id, repeated rows and null doc_ids are packed each on its own, an empty table gives no pieces; other columns of docs fall away."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

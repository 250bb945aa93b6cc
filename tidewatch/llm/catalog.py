"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.op10_licences import ORACLE as LICENCE_SQL
from tidewatch.llm.op10_licences import op10_licence_scan
from tidewatch.llm.op11_variants import op11_spelling_variants
from tidewatch.llm.op12_chat import op12_chat_format
from tidewatch.llm.op13_runs import op13_periodic_runs
from tidewatch.llm.op1_packing import op1_packing
from tidewatch.llm.op2_substring import ORACLE as SUBSTRING_SQL
from tidewatch.llm.op2_substring import op2_substring_dedup
from tidewatch.llm.op3_bpe import op3_bpe_round_trip
from tidewatch.llm.op4_bagminhash import op4_near_duplicates
from tidewatch.llm.op5_pages import op5_page_text
from tidewatch.llm.op6_quality import op6_quality_rules
from tidewatch.llm.op7_counts import op7_token_counts
from tidewatch.llm.op8_iblt import op8_fingerprints
from tidewatch.llm.op9_simple8b import op9_simple8b
from tidewatch.llm.stages import run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_bpe_round_trip, op4_near_duplicates, op5_page_text, op6_quality_rules, op7_token_counts, op8_fingerprints, op9_simple8b, op10_licence_scan, op11_spelling_variants, op12_chat_format, op13_periodic_runs)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over whole documents."""
    return run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
#: SQL for the results that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {"op2_substring_dedup": SUBSTRING_SQL, "op10_licence_scan": LICENCE_SQL}

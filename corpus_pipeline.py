"""The training-corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), reads the Parquet that the stage before it wrote, and applies its operator to all of
it. All but the last return the columns of ``documents``, whatever others a table has beside them. Rows with a null or a repeated
doc_id are judged by their own text; null and empty texts fail the base rule of the first stage; of rows that repeat whole one stays; an empty table gives
an empty result. The stages are in ``tidewatch/llm/stages.py``.
"""

from __future__ import annotations

from tidewatch.llm.stages import STAGES, run

#: SQL can express neither the learned rules nor the packing; tests compare with brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""Where queries and the SQL that states their results are registered, and the SQL of the surrogate sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

S = """s AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, value,
 CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 END AS code FROM events)"""
A = """a AS (SELECT l_suppkey AS session_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS i,
 l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem)"""
NAMES = [f"f{k}" for k in range(8)]
E = "e AS (SELECT vec_id AS row_id, (vec_id % 14)::INT AS fold, (label = 2)::INT AS target, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS f{k}" for k in range(8)) + " FROM embeddings)"
#: The whole matrix. NAMES stays for the queries whose SQL states eight values.
ALL = [f"f{k}" for k in range(64)]
E_ALL = "e AS (SELECT vec_id AS row_id, (vec_id % 14)::INT AS fold, (label = 2)::INT AS target, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {f}" for k, f in enumerate(ALL)) + " FROM embeddings)"
O = "OVER (PARTITION BY session_id ORDER BY i)"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("round(", "0e0 + round(")  # no negative zeros
        return f

    return add


def r(c, name: str | None = None, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits).alias(name) if name else F.round(c, digits)

"""Name -> (Spark plan, DuckDB oracle SQL) for every registered query.

Each plan takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables. Output columns are flat scalars with the same names as
the oracle's, so the two results can be compared row for row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def _utc(spark: SparkSession) -> None:
    """Timestamps in the job tables are UTC wall-clock values; hour windows
    and rendered times need the session in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def register(name: str, oracle: str | None = None):
    def deco(fn: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
            _utc(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = plan
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from runlens.plans import (q_admission, q_atoms, q_core, q_files, q_health,  # noqa: F401
                               q_stream, q_sync)

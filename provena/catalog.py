"""Every query of the engine by name, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of ``provena.plans``; each has QUERIES (name -> callable) and ORACLES (name -> SQL).
PLANS = ("integrity", "process", "rules", "evidence_rules", "streams", "documents")


def queries() -> dict[str, Query]:
    return {k: f for m in PLANS for k, f in import_module(f"provena.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in PLANS for k, s in import_module(f"provena.plans.{m}").ORACLES.items()}

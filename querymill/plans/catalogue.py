"""The registered queries, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querymill.plans import evolution, measuring, tables, workloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in (tables, workloads, measuring, evolution):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES

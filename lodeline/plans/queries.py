"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("history_queries", "graph_queries", "ranking_queries", "file_queries", "board_queries", "stream_queries", "extra_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"lodeline.plans.{m}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")

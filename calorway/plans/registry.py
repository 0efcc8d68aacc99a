"""Named queries over the benchmark tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STAGES: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def stage(spark: SparkSession, sf: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A shared intermediate table, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf, label)
    if staged(spark, sf, label) is None:
        _STAGES[key] = materialize(build(), label)
    return _STAGES[key]


def staged(spark: SparkSession, sf: str, label: str) -> DataFrame | None:
    """A shared intermediate table if it has been written."""
    return _STAGES.get((spark.sparkContext.applicationId, sf, label))

"""Named queries over the given tables, each with its check in SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keepsift.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql)
        return fn

    return add


def positions(ordered: DataFrame) -> DataFrame:
    """Ordered rows with their position from 1, so that a comparison sees the order."""
    rows = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    schema = T.StructType([*ordered.schema.fields, T.StructField("position", T.LongType())])
    return ordered.sparkSession.createDataFrame(rows, schema)


def load() -> None:
    """Import all modules that register queries."""
    from keepsift.plans import q_cull, q_files, q_filters, q_inference, q_joins, q_rollups, q_scalars, q_selection, q_similarity, q_streaming, q_tables  # noqa: F401

"""Named queries over the survey view, with SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavegrid.sources import survey

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query. ``{headers}`` and ``{traces}`` in its SQL become the views."""

    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.replace("{headers}", survey.view_sql("headers", survey.HEADERS, "lineitem")).replace("{traces}", survey.view_sql("traces", survey.TRACES, "embeddings")).strip()
        return f

    return add

"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grafwerk.plans import bindings, diagnosis

FLAGSHIP = "called_pous"
#: Modules that bind queries as they are imported.
BOUND = (bindings, diagnosis)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(bindings.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(bindings.SQL)

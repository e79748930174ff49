"""All queries over the library's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from commitgrain.plans import queries_models, queries_profile, queries_rows, queries_text

ALL = {**queries_rows.QUERIES, **queries_text.QUERIES, **queries_profile.QUERIES, **queries_models.QUERIES}
flagship = queries_rows.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text is not None}

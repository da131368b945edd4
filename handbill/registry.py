"""All queries of the toolkit's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_drafts, queries_inputs, queries_posts, queries_tables, queries_verify

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (queries_tables, queries_posts, queries_drafts, queries_verify, queries_inputs)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source, how many posts have each field, from the posts' text."""
    return queries_posts.QUERIES["a1_completeness"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}

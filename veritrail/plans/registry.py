"""All queries over the reference operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import plugin_queries, rank_queries, search_queries, store_queries, text_queries
from .base import QUERIES, SQL, Query

__all__ = ["flagship", "oracle_sql", "plugin_queries", "queries", "rank_queries", "search_queries", "store_queries", "text_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and dense, fused."""
    return search_queries.i5_hybrid_search(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

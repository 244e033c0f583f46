"""All queries of the engine, by name, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramix.plans import analytics_queries, engine_queries, extra_queries, graph_queries, ingest_queries, retrieval_queries
from engramix.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]
PARTS = (retrieval_queries, graph_queries, ingest_queries, analytics_queries, extra_queries, engine_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: hybrid retrieval for every benchmark item."""
    return QUERIES["hybrid_fusion"](spark, sf_dir)

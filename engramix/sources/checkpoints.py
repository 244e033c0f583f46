"""Resuming: what is done is left out of what is to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def valid_markers(markers: DataFrame, chunk_size: int) -> DataFrame:
    """Markers of complete ingestions that used the same chunk size."""
    return markers.where((F.col("status") == "complete") & (F.col("chunk_size") == chunk_size))

"""The batch forms of the stateful steps, for history and for checking the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, by: str, mark: str, order: list[str]) -> DataFrame:
    """session: rises where the mark changes."""
    w = Window.partitionBy(by).orderBy(*order)
    changed = F.when(F.lag(mark).over(w) == F.col(mark), 0).otherwise(1)
    return rows.withColumn("_new", changed).withColumn("session", F.sum("_new").over(w).cast("long")).drop("_new")


def count_batches(rows: DataFrame, by: str, order: list[str], threshold: int) -> DataFrame:
    """batch: rows in groups of the threshold; the last, smaller group is pending."""
    w = Window.partitionBy(by).orderBy(*order)
    n = F.row_number().over(w)
    total = F.count("*").over(Window.partitionBy(by))
    batch = F.floor((n - 1) / threshold).cast("long")
    return rows.withColumn("batch", batch).withColumn("pending", batch * threshold + threshold > total)


def ring(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """The last rows of each key."""
    w = Window.partitionBy(by).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def preceding(rows: DataFrame, by: str, order: list[str], size: int, value: str) -> DataFrame:
    """context: the values of the rows before each one, at most so many, in order."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-size, -1)
    return rows.withColumn("context", F.collect_list(value).over(w))

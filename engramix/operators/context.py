"""Ordering and rendering of retrieved memories for an answerer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions.text import estimated_tokens

#: Estimated tokens of a context.
BUDGET = 2000


def ordered(results: DataFrame, mode: str = "relevance") -> DataFrame:
    """position within each query: by score, by time (missing times last), or by month and then score."""
    known = F.when(F.coalesce("created_at", F.lit("")) == "", 1).otherwise(0)
    keys = {"relevance": [F.desc("score")], "chronological": [known, F.col("created_at")], "hybrid": [known, F.substring("created_at", 1, 7), F.desc("score")]}[mode]
    return results.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys, "id")))


def human_date(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, d MMMM yyyy")


def line(text: Column, ts: Column, speaker: Column) -> Column:
    stamp = F.when(F.coalesce(ts, F.lit("")) == "", "").otherwise(F.concat(F.lit("["), F.substring(ts, 1, 10), F.lit("] ")))
    who = F.when(F.coalesce(speaker, F.lit("")) == "", "").otherwise(F.concat(speaker, F.lit(": ")))
    return F.concat(stamp, who, text)


def within_budget(rows: DataFrame, by: str, order: str, text: str, budget: int = BUDGET) -> DataFrame:
    """Rows with their estimated tokens and the sum so far, up to the first that passes the budget."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("tokens", estimated_tokens(F.col(text))).withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def synthesize(results: DataFrame, mode: str = "relevance", budget: int = BUDGET) -> DataFrame:
    """query_id, context: lines in order up to the budget; the first that passes it ends the context."""
    rows = ordered(results, mode).withColumn("line", line(F.col("memory"), F.col("created_at"), F.col("speaker")))
    kept = within_budget(rows, "query_id", "position", "line", budget)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("context"))


def profile(facts: Column) -> Column:
    """Facts as a list for a prompt."""
    return F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")

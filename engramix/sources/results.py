"""Result files of evaluation runs: reading, the unified form of several formats, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULT = "array<struct<id:string,memory:string,text:string,content:string,score:double,source:string,created_at:string,metadata:struct<route:string,route_scores:struct<route:string>>>>"
EVALUATION = (
    "struct<question_id:string,conversation_idx:int,category:string,category_name:string,question_type:string,question:string,ground_truth_answer:string,evidence:array<string>,user_id:string,"
    f"retrieval:struct<search_query:string,search_latency_ms:double,total_results:int,search_results:{RESULT},query_debug:struct<routes:struct<timing_ms:map<string,double>>>>,"
    "cutoff_results:map<string,struct<judgment:string,score:double,generated_answer:string,memories_evaluated:int,reason:string,error:string>>>"
)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Evaluations of a run file, the last of equal ids; those without an id are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.evaluations"), f"array<{EVALUATION}>")).alias("n", "e"))
    w = Window.partitionBy("e.question_id").orderBy(F.desc("n"))
    return rows.where("coalesce(e.question_id, '') <> ''").withColumn("k", F.row_number().over(w)).where("k = 1").select("e.*")


def read_questions(spark: SparkSession, folder: str, pattern: str = "conv*_q*.json") -> DataFrame:
    """One file for each question; names that begin with an underscore aren't read."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).withColumn("file", F.input_file_name())
    return rows.where(~F.element_at(F.split("file", "/"), -1).startswith("_")).select("file", F.from_json("value", EVALUATION).alias("e")).select("file", "e.*")


def result_text(r: Column) -> Column:
    return F.coalesce(r["memory"], r["text"], r["content"], F.lit(""))


def route_name(r: Column) -> Column:
    return F.coalesce(r["metadata"]["route"], r["source"], r["metadata"]["route_scores"]["route"], F.lit("unknown"))


def flat(evaluations: DataFrame, cutoff: str, k: int) -> DataFrame:
    """question_id, category, answer, correct, reply, texts, routes, latency_ms, total_ms of a run at a cutoff, for diagnosis and comparison."""
    c = F.try_element_at("cutoff_results", F.lit(cutoff))
    top = F.slice(F.coalesce("retrieval.search_results", F.array().cast(RESULT)), 1, k)
    total = F.try_element_at("retrieval.query_debug.routes.timing_ms", F.lit("total"))
    return evaluations.select(
        "question_id", "question", F.coalesce("category_name", "category", "question_type").alias("category"), F.col("ground_truth_answer").alias("answer"), (F.coalesce(c["judgment"], F.lit("")) == "CORRECT").alias("correct"),
        F.coalesce(c["generated_answer"], F.lit("")).alias("reply"), F.transform(top, result_text).alias("texts"), F.transform(top, route_name).alias("routes"), F.coalesce("retrieval.search_latency_ms", total).alias("latency_ms"), total.alias("total_ms"),
    )


def cutoff_rows(evaluations: DataFrame) -> DataFrame:
    """question_id, grp, cutoff, score, judgment, error: a row for each cutoff."""
    grp = F.coalesce("category_name", "category", "question_type")
    return evaluations.select("question_id", grp.alias("grp"), F.explode("cutoff_results").alias("name", "c")).select("question_id", "grp", F.regexp_extract("name", "([0-9]+)$", 1).cast("int").alias("cutoff"), "c.score", "c.judgment", "c.error")


def detect_format(run: Column) -> Column:
    """The format of a run file (JSON text) by its keys."""
    first = F.get_json_object(run, "$.evaluations[0]")
    has = lambda c, p: F.get_json_object(c, p).isNotNull()
    return (
        F.when(has(first, "$.nugget_scores") | has(run, "$.metadata.chat_size") | has(first, "$.ability"), "beam")
        .when(has(first, "$.question_type"), "longmemeval")
        .when(has(first, "$.category") | has(first, "$.category_name"), "locomo")
        .when(has(run, "$.evaluations"), "unified")
        .otherwise("unknown")
    )


def verdict(judgment: Column, score: Column, error: Column) -> Column:
    """correct, incorrect or error of any format's judgment."""
    good = F.upper(F.coalesce(judgment, F.lit(""))).isin("CORRECT", "PASS", "YES")
    bad = F.upper(F.coalesce(judgment, F.lit(""))).isin("WRONG", "FAIL", "NO", "INCORRECT")
    failed = (F.coalesce(judgment, F.lit("")) == "ERROR") | (F.coalesce(error, F.lit("")) != "")
    return F.when(failed, "error").when(good, "correct").when(bad, "incorrect").when(score >= 0.5, "correct").otherwise("incorrect")


def unified(evaluations: DataFrame, predictions: DataFrame | None, cutoff: str) -> DataFrame:
    """question_id, grp, question, answer, reply, verdict, score, latency_ms; retrieval from the predictions where the run lacks it."""
    c = F.try_element_at("cutoff_results", F.lit(cutoff))
    grp = F.coalesce("category_name", "category", "question_type", F.lit("unknown"))
    out = evaluations.select("question_id", grp.alias("grp"), "question", F.col("ground_truth_answer").alias("answer"), c["generated_answer"].alias("reply"), verdict(c["judgment"], c["score"], c["error"]).alias("verdict"), c["score"].alias("score"), F.col("retrieval.search_latency_ms").alias("own_ms"))
    if predictions is None:
        return out.withColumnRenamed("own_ms", "latency_ms")
    p = predictions.select("question_id", F.col("retrieval.search_latency_ms").alias("their_ms"))
    return out.join(p, "question_id", "left").withColumn("latency_ms", F.coalesce("own_ms", "their_ms")).drop("own_ms", "their_ms")


def average_latency(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Mean of the latencies above 0, overall or by group."""
    mean = F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("avg_latency_ms")
    return rows.groupBy(by).agg(mean) if by else rows.agg(mean)


def page(rows: DataFrame, number: int, size: int, grp: str | None = None, wanted: str | None = None) -> DataFrame:
    """A page of results, filtered by group and verdict."""
    if grp:
        rows = rows.where(F.col("grp") == grp)
    if wanted:
        rows = rows.where(F.col("verdict") == wanted)
    return rows.orderBy("question_id").offset(number * size).limit(size)


def regressions_first(changes: DataFrame) -> DataFrame:
    return changes.orderBy(F.when(F.col("change") == "regression", 0).when(F.col("change") == "improvement", 1).otherwise(2), "question_id")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Nested cells as JSON."""
    nested = [c for c, t in rows.dtypes if t.startswith(("array", "struct", "map"))]
    rows.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A table of a report's first rows."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(most).collect()])

"""Logs as tables: ingestion logs of conversations, progress of runs, usage of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USAGE = "ts string, component string, provider string, model string, call_type string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of text files."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def ingestion_log(lines: DataFrame) -> DataFrame:
    """file, session_id, date, epoch, chunk, kind (message or memory), speaker, text, line_no of a log's lines.

    Headers carry forward; the epoch of a session header and the word memories of a chunk header may be missing.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    session = F.regexp_extract("line", "^SESSION:\\s+(\\S+)\\s+\\|\\s+Date:\\s+(.+?)(?:\\s+\\|\\s+Epoch:\\s+(\\d+))?\\s*$", 1)
    date, epoch = (F.regexp_extract("line", "^SESSION:\\s+(\\S+)\\s+\\|\\s+Date:\\s+(.+?)(?:\\s+\\|\\s+Epoch:\\s+(\\d+))?\\s*$", i) for i in (2, 3))
    chunk = F.regexp_extract("line", "^--- Chunk (\\d+) \\(", 1)
    memories = F.col("line").rlike("^--- Chunk \\d+ \\(extracted( memories)?\\) ---$")
    header = F.struct(session.alias("id"), date.alias("date"), F.nullif(epoch, F.lit("")).cast("bigint").alias("epoch"), F.col("line_no").alias("at"))
    rows = lines.withColumn("s", F.last(F.when(session != "", header), True).over(w))
    mode = F.when(session != "", F.struct(F.lit(-1).alias("chunk"), F.lit("none").alias("mode"), F.col("line_no").alias("at"))).when(memories, F.struct(chunk.cast("int").alias("chunk"), F.lit("memory").alias("mode"), F.col("line_no").alias("at"))).when(chunk != "", F.struct(chunk.cast("int").alias("chunk"), F.lit("message").alias("mode"), F.col("line_no").alias("at")))
    rows = rows.withColumn("c", F.last(mode, True).over(w)).where((session == "") & (chunk == "") & F.col("s").isNotNull() & (F.col("c.chunk") >= 0))
    speaker, said = (F.regexp_extract("line", "^\\s+(?:user|assistant):\\s+(\\S+?):\\s+(.+)$", i) for i in (1, 2))
    role, plain = (F.regexp_extract("line", "^\\s+(user|assistant):\\s+(.+)$", i) for i in (1, 2))
    body = F.trim("line")
    memory = F.regexp_replace(body, "^- ", "")
    is_message = (F.col("c.mode") == "message") & (role != "")
    ruled = body.rlike("^(\\*\\*\\*|═|─|---|SESSION)")
    is_memory = (F.col("c.mode") == "memory") & (body != "") & ~ruled & (body != "(no memories extracted)") & (F.trim(F.regexp_replace(body, "(?i)^\\s*\\[?(ADD|UPDATE|DELETE|NOOP)\\]?[:\\s]*", "")) != "")
    return rows.where(is_message | is_memory).select(
        "file", F.col("s.id").alias("session_id"), F.col("s.date").alias("date"), F.col("s.epoch").alias("epoch"), F.col("s.at").alias("session_line"), F.col("c.chunk").alias("chunk"), F.when(is_message, "message").otherwise("memory").alias("kind"),
        F.when(~is_message, F.lit(None).cast("string")).when(speaker != "", speaker).when(role == "user", "User").otherwise("Assistant").alias("speaker"), F.when(~is_message, memory).when(speaker != "", said).otherwise(plain).alias("text"), "line_no",
    )


def merge_restarts(rows: DataFrame) -> DataFrame:
    """Of the copies of a chunk that restarts left, the richest stays (messages and memories that say something); the first of equals."""
    key = ["file", "session_id", "chunk"]
    filled = F.when((F.col("kind") == "message") | (F.regexp_replace("text", "^\\s*\\[?\\w+\\]?\\s*$", "") != ""), 1).otherwise(0)
    sizes = rows.groupBy(*key, "session_line").agg(F.sum(filled).alias("size"))
    best = sizes.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("size"), "session_line"))).where("n = 1")
    return rows.join(best.select(*key, "session_line"), [*key, "session_line"], "left_semi")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, line_no, line: conversations (conv_id, turn, role, text) as such a log, a chunk for each turn."""
    head = turns.groupBy("conv_id").agg(F.lit(-1).alias("turn")).select("conv_id", "turn", F.lit(0).alias("part"), F.concat(F.lit("SESSION: "), F.col("conv_id").cast("string"), F.lit(" | Date: 1 May, 2023 | Epoch: 1682899200")).alias("line"))
    chunk = turns.select("conv_id", "turn", F.lit(0).alias("part"), F.concat(F.lit("--- Chunk "), F.col("turn").cast("string"), F.lit(" (1 messages) ---")).alias("line"))
    said = turns.select("conv_id", "turn", F.lit(1).alias("part"), F.concat(F.lit("  "), F.col("role"), F.lit(": "), F.regexp_replace("text", "\\s+", " ")).alias("line"))
    rows = head.unionByName(chunk).unionByName(said)
    return rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part")).alias("line_no"), "line")


def progress(lines: DataFrame) -> DataFrame:
    """label, percent, done, total of the latest progress bar of each label (line_no, line)."""
    p = "^(.*?):?\\s*(\\d+)%\\|.*?\\|\\s*(\\d+)/(\\d+)"
    parts = F.flatten(F.transform(F.array("line"), lambda x: F.split(x, "\r")))
    bars = lines.select("line_no", F.posexplode(parts).alias("part", "bar")).where(F.col("bar").rlike(p))
    rows = bars.select(F.trim(F.regexp_extract("bar", p, 1)).alias("label"), *(F.regexp_extract("bar", p, i).cast("int").alias(n) for i, n in ((2, "percent"), (3, "done"), (4, "total"))), F.struct("line_no", "part").alias("at"))
    return rows.groupBy("label").agg(F.max_by(F.struct("percent", "done", "total"), "at").alias("x")).select("label", "x.*")


def overall(bars: DataFrame, elapsed_s: float) -> DataFrame:
    """One row: done, total, percent and the seconds left at the pace so far."""
    s = bars.agg(F.sum("done").alias("done"), F.sum("total").alias("total"))
    return s.withColumns({"percent": F.round(100 * F.col("done") / F.col("total"), 1), "eta_s": F.when(F.col("done") > 0, elapsed_s * (F.col("total") - F.col("done")) / F.col("done"))})


def tail(lines: DataFrame, n: int = 200) -> DataFrame:
    return lines.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def append_usage(rows: DataFrame, path: str) -> None:
    rows.select(*(c.split()[0] for c in USAGE.split(", "))).write.mode("append").json(path)


def usage(spark: SparkSession, path: str) -> DataFrame:
    """Calls and tokens by component and model."""
    return spark.read.schema(USAGE).json(path).groupBy("component", "model").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens"))

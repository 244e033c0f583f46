"""Conversation datasets as tables: messages, questions, evidence. Nested shapes are read as JSON and flattened with expressions."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.functions import dates as da
from engramix.functions import text as tx

TURN = "struct<speaker:string,dia_id:string,text:string,blip_caption:string,blip:string,query:string,img_query:string>"
QA = "array<struct<question:string,answer:string,category:int,evidence:array<string>>>"
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}
# The order of question types.
ABILITIES = ["abstention", "contradiction_resolution", "event_ordering", "information_extraction", "instruction_following", "knowledge_update", "multi_session_reasoning", "preference_following", "summarization", "temporal_reasoning"]


def read_json(spark: SparkSession, path: str, least: int | None = None, exactly: int | None = None) -> DataFrame:
    """idx and raw (JSON) of the elements of files that hold one array each; the number of elements can be checked."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "raw"))
    n = rows.count() if least is not None or exactly is not None else 0
    if exactly is not None and n != exactly or least is not None and n < least:
        raise ValueError(f"{path} has {n} records")
    return rows


def dialogues(raw: DataFrame) -> DataFrame:
    """conv_idx, session, session_date, ts, turn, speaker, dia_id, text of two-speaker conversations (idx, raw), in order.

    A session meets its date inside the record, and leaves it without the record's other sessions.
    """
    conv = F.from_json(F.get_json_object("raw", "$.conversation"), "map<string,string>")
    named = F.filter(F.map_entries(conv), lambda e: e["key"].rlike("^session_[0-9]+(_date_time)?$"))
    number = lambda e: F.regexp_extract(e["key"], "([0-9]+)", 1).alias("n")
    # In this order a session is followed by its date, if it has one.
    entries = F.sort_array(F.transform(named, lambda e: F.struct(number(e), e["key"].endswith("_date_time").alias("dated"), e["value"].alias("value"))))
    paired = raw.select(F.col("idx").alias("conv_idx"), entries.alias("e")).select("conv_idx", F.filter(F.transform("e", lambda x, i: F.struct(x.alias("own"), F.get("e", i + 1).alias("next"))), lambda x: ~x["own"]["dated"]).alias("e"))
    each = paired.select("conv_idx", F.explode("e").alias("e")).select("conv_idx", "e.own", "e.next")
    date = F.when(F.col("next.dated") & (F.col("next.n") == F.col("own.n")), F.col("next.value"))
    sessions = each.select("conv_idx", F.col("own.n").cast("int").alias("session"), date.alias("session_date"), F.from_json("own.value", f"array<{TURN}>").alias("turns"))
    turns = sessions.select("conv_idx", "session", "session_date", F.posexplode("turns").alias("turn", "t"))
    text = tx.with_photo(F.coalesce("t.text", F.lit("")), F.coalesce("t.blip_caption", "t.blip", F.lit("")), F.coalesce("t.query", "t.img_query", F.lit("")))
    return turns.select("conv_idx", "session", "session_date", da.spoken(F.col("session_date")).alias("ts"), "turn", F.col("t.speaker").alias("speaker"), F.col("t.dia_id").alias("dia_id"), text.alias("text"))


def session_order(turns: DataFrame) -> DataFrame:
    """Turns with the place of their session: by its parsed date, then by number; undated sessions last."""
    s = turns.select("conv_idx", "session", "ts").distinct()
    w = Window.partitionBy("conv_idx").orderBy(F.col("ts").isNull(), "ts", "session")
    return turns.join(s.withColumn("session_pos", F.row_number().over(w)).drop("ts"), ["conv_idx", "session"])


def questions(raw: DataFrame, categories: tuple[int, ...] = (1, 2, 3, 4), first: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """question_id, conv_idx, q_idx, question, answer, category, category_name, evidence; filtered by category, then the first of each conversation, then ids."""
    qa = F.coalesce(F.from_json(F.get_json_object("raw", "$.qa"), QA), F.from_json(F.get_json_object("raw", "$.qa_pairs"), QA))
    rows = raw.select(F.col("idx").alias("conv_idx"), F.posexplode(qa).alias("q_idx", "q")).where(F.col("q.category").isin(list(categories)))
    if first is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_idx").orderBy("q_idx"))).where(F.col("n") <= first).drop("n")
    names = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    qid = F.concat(F.lit("conv"), F.col("conv_idx").cast("string"), F.lit("_q"), F.col("q_idx").cast("string"))
    out = rows.select(qid.alias("question_id"), "conv_idx", "q_idx", "q.question", "q.answer", "q.category", names[F.col("q.category")].alias("category_name"), "q.evidence")
    return out.where(F.col("question_id").isin(ids)) if ids else out


def evidence_lines(turns: DataFrame) -> DataFrame:
    """conv_idx, dia_id, evidence of turns (speaker, text, session_date) that have an id."""
    said = F.when(F.coalesce("session_date", F.lit("")) == "", "").otherwise(F.concat(F.lit(", said on "), F.col("session_date")))
    return turns.where(F.coalesce("dia_id", F.lit("")) != "").select("conv_idx", "dia_id", F.concat(F.lit("["), F.col("dia_id"), said, F.lit("] "), F.coalesce("speaker", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("evidence"))


def haystacks(raw: DataFrame) -> DataFrame:
    """question_id, session_id, ts, session_pos, turn, role, content, has_answer of records with parallel arrays of sessions."""
    kind = "struct<question_id:string,haystack_sessions:array<array<struct<role:string,content:string,has_answer:boolean>>>,haystack_dates:array<string>,haystack_session_ids:array<string>>"
    r = raw.select(F.from_json("raw", kind).alias("r")).select("r.question_id", F.explode(F.arrays_zip("r.haystack_session_ids", "r.haystack_dates", "r.haystack_sessions")).alias("z"))
    s = r.select("question_id", F.col("z.haystack_session_ids").alias("session_id"), F.col("z.haystack_dates").alias("date"), F.col("z.haystack_sessions").alias("turns")).withColumn("ts", da.numbered(F.col("date")))
    w = Window.partitionBy("question_id").orderBy(F.col("ts").isNull(), "ts", "session_id")
    s = s.withColumn("session_pos", F.row_number().over(w))
    return s.select("question_id", "session_id", "date", "ts", "session_pos", F.posexplode("turns").alias("turn", "t")).select("question_id", "session_id", "date", "ts", "session_pos", "turn", "t.role", "t.content", "t.has_answer")


def haystack_questions(raw: DataFrame) -> DataFrame:
    kind = "struct<question_id:string,question_type:string,question:string,answer:string,question_date:string,answer_session_ids:array<string>>"
    return raw.select(F.from_json("raw", kind).alias("r")).select("r.*").withColumn("abstention", F.col("question_id").endswith("_abs"))


CHAT_TURN = "struct<role:string,content:string,time_anchor:string>"


def _turns(raw: Column) -> Column:
    """Turns of a batch {turns: [turn or list of turns]}, each as JSON."""
    items = F.from_json(F.get_json_object(raw, "$.turns"), "array<string>")
    return F.flatten(F.transform(items, lambda i: F.when(F.ltrim(i).startswith("["), F.from_json(i, "array<string>")).otherwise(F.array(i))))


def chats(raw: DataFrame) -> DataFrame:
    """conversation_id, batch, turn, role, content, time_anchor of chats in any of their nestings.

    A list of lists of turns; a list of batches with turns; a list of maps from numbered plans to
    such batches (null plans are passed over); a flat list of turns; anything else is empty.
    """
    chat = F.get_json_object("raw", "$.chat")
    first = F.try_element_at(F.from_json(chat, "array<string>"), F.lit(1))
    items = F.from_json(chat, "array<string>")
    keys = F.map_keys(F.from_json(first, "map<string,string>"))
    plain = F.get_json_object(first, "$.role").isNotNull() | F.get_json_object(first, "$.content").isNotNull()
    shape = F.when(F.ltrim(first).startswith("["), "lists").when(F.array_contains(keys, "turns"), "batches").when(plain, "flat").when(F.ltrim(first).startswith("{"), "plans").otherwise("none")
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract(k, "-([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    ordered = lambda m: F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(number(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v")))), lambda e: e["v"])
    planned = F.flatten(F.transform(items, lambda s: F.flatten(F.transform(F.filter(ordered(F.from_json(s, "map<string,string>")), lambda v: v.isNotNull() & (v != "null")), lambda v: F.from_json(v, "array<string>")))))
    batches = (
        F.when(shape == "lists", F.transform(items, lambda b: F.from_json(b, "array<string>")))
        .when(shape == "batches", F.transform(items, _turns))
        .when(shape == "plans", F.transform(planned, _turns))
        .when(shape == "flat", F.array(items))
        .otherwise(F.array().cast("array<array<string>>"))
    )
    rows = raw.select(F.get_json_object("raw", "$.conversation_id").alias("conversation_id"), F.posexplode(batches).alias("batch", "turns"))
    rows = rows.select("conversation_id", "batch", F.posexplode("turns").alias("turn", "t")).withColumn("t", F.from_json("t", CHAT_TURN))
    return rows.select("conversation_id", "batch", "turn", "t.role", "t.content", "t.time_anchor")


def batch_anchor(turns: DataFrame) -> DataFrame:
    """conversation_id, batch, anchor: the first time anchor of a batch that can be read."""
    ts = F.coalesce(F.try_to_timestamp("time_anchor"), F.try_to_timestamp("time_anchor", F.lit("MMMM-dd-yyyy")), da.spoken(F.col("time_anchor")))
    return turns.withColumn("ts", ts).groupBy("conversation_id", "batch").agg(F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("turn"))).alias("anchor"))


def _literal(text: str) -> str | None:
    """A stringified dictionary as JSON, read as a literal first."""
    try:
        return json.dumps(ast.literal_eval(text))
    except (ValueError, SyntaxError):
        try:
            return json.dumps(json.loads(text))
        except ValueError:
            return None


def probing_questions(raw: DataFrame) -> DataFrame:
    """conversation_id, ability, n, question, rubric (JSON), nuggets, difficulty in the fixed order of abilities."""
    text = F.udf(_literal, T.StringType())  # one value a conversation
    probing = F.get_json_object("raw", "$.probing_questions")
    held = F.when(F.get_json_object(probing, "$").isNotNull() & F.ltrim(probing).startswith("{") & F.from_json(probing, "map<string,string>").isNotNull(), probing).otherwise(text(probing))
    rows = raw.select(F.get_json_object("raw", "$.conversation_id").alias("conversation_id"), F.explode(F.from_json(held, "map<string,string>")).alias("ability", "value"))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rows = rows.select("conversation_id", "ability", F.posexplode(listed).alias("n", "q"))
    question = F.coalesce(F.get_json_object("q", "$.question_text"), F.get_json_object("q", "$.question"), F.col("q"))
    order = F.array_position(tx.strings(ABILITIES), F.col("ability"))
    rubric = F.get_json_object("q", "$.rubric")
    return rows.select("conversation_id", "ability", order.alias("ability_pos"), "n", question.alias("question"), rubric.alias("rubric"), nuggets(rubric).alias("nuggets"), F.get_json_object("q", "$.difficulty").alias("difficulty"), source_ids(F.get_json_object("q", "$.source_chat_ids")).alias("source_chat_ids"))


def nuggets(rubric: Column) -> Column:
    """Descriptions of a rubric: {nuggets: [{description} or text]}, a list, or a single value."""
    held = F.coalesce(F.get_json_object(rubric, "$.nuggets"), rubric)
    items = F.when(F.ltrim(held).startswith("["), F.from_json(held, "array<string>")).otherwise(F.array(held))
    return F.filter(F.transform(items, lambda i: F.coalesce(F.get_json_object(i, "$.description"), i)), lambda i: i.isNotNull() & (i != ""))


def source_ids(value: Column) -> Column:
    """Ids of a list, a list of lists, or a map of lists, flat."""
    lists = F.when(F.ltrim(value).startswith("{"), F.map_values(F.from_json(value, "map<string,string>"))).otherwise(F.from_json(value, "array<string>"))
    flat = F.flatten(F.transform(lists, lambda i: F.when(F.ltrim(i).startswith("["), F.from_json(i, "array<string>")).otherwise(F.array(i))))
    return F.coalesce(flat, F.array().cast("array<string>"))


def chunks(turns: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Turns in chunks of a fixed size."""
    w = Window.partitionBy(*by).orderBy(*order)
    return turns.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def usable_chunks(turns: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Chunks without a blank message."""
    blank = turns.where(F.trim(F.coalesce(text, F.lit(""))) == "").select(*by).distinct()
    return turns.join(blank, by, "left_anti")


def index_range(spec: str) -> list[int]:
    """'0-2,5' as numbers, each once."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)-(\d+)", part)
        found.update(range(int(m[1]), int(m[2]) + 1) if m else [int(part)])
    return sorted(found)


def event_summaries(raw: DataFrame) -> DataFrame:
    """conv_idx, session, speaker, event of summaries by session."""
    held = F.from_json(F.get_json_object("raw", "$.event_summary"), "map<string,string>")
    s = raw.select(F.col("idx").alias("conv_idx"), F.explode(held).alias("key", "value")).where(F.col("key").rlike("^events_session_[0-9]+$"))
    people = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: k != "date")
    return s.select("conv_idx", F.regexp_extract("key", "([0-9]+)$", 1).cast("int").alias("session"), F.explode(people).alias("speaker", "list")).select("conv_idx", "session", "speaker", F.explode(F.from_json("list", "array<string>")).alias("event"))

"""The memory engine, dataset readers, result files, logs and validators over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix import schema as sc
from engramix.operators import memory as me
from engramix.operators import units as un
from engramix.operators.analytics import bottleneck, natural_key, support
from engramix.operators.context import line, profile, synthesize
from engramix.functions import text as tx
from engramix.plans.ingest_queries import SPLIT, WS, turns
from engramix.plans.registry import Tables, query
from engramix.sources import datasets as ds
from engramix.sources import logs as lg
from engramix.sources import results as rs
from engramix.storage import TableStore, materialize, shared_dir
from engramix.streaming import batch as sb
from engramix.streaming import stateful as ss

PLAIN = sc.Options(use_bfs=False, use_entity_store=False)


def fresh(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def engine(t: Tables) -> me.MemoryEngine:
    return me.MemoryEngine(t.spark, fresh(t, "engine"), PLAIN)


def messages(t: Tables) -> DataFrame:
    who = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    none = F.lit(None).cast("string")
    return t.conversations.select(who.alias("user_id"), none.alias("agent_id"), none.alias("run_id"), none.alias("actor_id"), F.col("turn").alias("msg_seq"), "role", F.col("text").alias("content"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))


def stored(t: Tables) -> me.MemoryEngine:
    """An engine whose memories are the documents: scopes are sources, days follow from the id."""
    e = engine(t)
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    own = {
        "id": F.col("doc_id").cast("string"), "scope": F.concat(F.lit("user_id="), F.col("source")), "user_id": F.col("source"), "data": F.col("text"), "hash": F.md5("text"), "created_at": day, "updated_at": day,
        "metadata": F.create_map(F.lit("lang"), F.col("lang")),
    }
    kinds = dict(f.split(" ", 1) for f in sc.MEMORIES.split(", "))
    e.store.append("memories", t.documents.select(*(own.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items())))
    return e


# Adding, reading and changing memories


@query("""WITH f AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id, md5(text) ORDER BY turn) = 1)
    SELECT 'user_id=c' || conv_id AS scope, role, md5(text) AS hash, lag(md5(text)) OVER w AS before, lead(md5(text)) OVER w AS after FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def raw_add(t: Tables) -> DataFrame:
    """One memory for each message that isn't the system's, without repeats of a scope, and its neighbours."""
    e = engine(t)
    e.add_batch(messages(t), infer=False)
    m = e.table("memories").select("id", "scope", "role", "hash", "prev_id", "next_id")
    near = m.select(F.col("id").alias("n"), F.col("hash").alias("h"))
    out = m.join(near.toDF("prev_id", "before"), "prev_id", "left").join(near.toDF("next_id", "after"), "next_id", "left")
    return out.select("scope", "role", "hash", "before", "after")


@query("""WITH f AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id, md5(text) ORDER BY turn) = 1)
    SELECT md5(text) AS new_md5, 'ADD' AS event, 0 AS is_deleted, count(*) AS n FROM f GROUP BY 1""")
def add_history(t: Tables) -> DataFrame:
    """Every added memory is recorded."""
    e = engine(t)
    e.add_batch(messages(t), infer=False)
    return e.table("history").groupBy(F.md5("new_memory").alias("new_md5"), "event", "is_deleted").agg(F.count("*").alias("n"))


@query("SELECT CAST(turn AS BIGINT) AS msg_seq, role, text AS content FROM conversations WHERE conv_id = 1 AND role <> 'system' ORDER BY turn DESC LIMIT 3")
def last_messages(t: Tables) -> DataFrame:
    """The last three messages of a scope (the limit is the feature)."""
    e = engine(t)
    e.add_batch(messages(t), infer=False)
    return e.last_messages({"user_id": "c1"}, 3).select("msg_seq", "role", "content")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS created_at, md5(text) AS memory_md5, lang FROM documents
    WHERE source = 'src1' AND lang IN ('en', 'fr') ORDER BY created_at, id LIMIT 100""")
def memory_listing(t: Tables) -> DataFrame:
    """A filtered listing in order of creation (the limit is the feature)."""
    e = stored(t)
    return e.get_all({"user_id": "src1", "lang": {"in": ["en", "fr"]}}, top_k=100).select("id", "created_at", F.md5("memory").alias("memory_md5"), F.col("metadata")["lang"].alias("lang"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS memory_md5, source AS user_id FROM documents WHERE doc_id = 7")
def memory_get(t: Tables) -> DataFrame:
    return stored(t).get("7").select("id", F.md5("memory").alias("memory_md5"), "user_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS memory_md5, md5(text) AS hash, source AS user_id, 'user_id=' || source AS scope, lang FROM documents")
def memory_projection(t: Tables) -> DataFrame:
    """What a reader sees of all memories."""
    return me.project(stored(t).table("memories")).select("id", F.md5("memory").alias("memory_md5"), "hash", "user_id", "scope", F.col("metadata")["lang"].alias("lang"))


def changed(t: Tables) -> me.MemoryEngine:
    """One memory rewritten, one deleted, then all of a scope."""
    e = stored(t)
    e.update("7", "a text of its own", now="2024-05-05T00:00:00")
    e.delete("8")
    e.delete_all(user_id="src3")
    return e


@query("""SELECT '7' AS memory_id, md5(text) AS old_md5, md5('a text of its own') AS new_md5, 'UPDATE' AS event, 0 AS is_deleted FROM documents WHERE doc_id = 7
    UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN doc_id = 7 THEN md5('a text of its own') ELSE md5(text) END, NULL, 'DELETE', 1 FROM documents WHERE doc_id = 8 OR source = 'src3'""")
def change_history(t: Tables) -> DataFrame:
    return changed(t).table("history").select("memory_id", F.md5("old_memory").alias("old_md5"), F.md5("new_memory").alias("new_md5"), "event", "is_deleted")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id = 7 THEN md5('a text of its own') ELSE md5(text) END AS memory_md5,
    CASE WHEN doc_id = 7 THEN '2024-05-05T00:00:00' ELSE '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS updated_at, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS created_at FROM documents WHERE doc_id <> 8 AND source <> 'src3'""")
def changed_memories(t: Tables) -> DataFrame:
    return changed(t).table("memories").select("id", F.md5("data").alias("memory_md5"), "updated_at", "created_at")


@query("SELECT CAST(0 AS BIGINT) AS before, CAST(count(*) AS BIGINT) AS added, CAST(0 AS BIGINT) AS after FROM documents")
def reset_all(t: Tables) -> DataFrame:
    """Memories before, after storing all documents, and after a reset."""
    e = stored(t)
    added = e.table("memories").agg(F.count("*").alias("added"))
    added = materialize(added, "added")
    e.reset()
    after = e.table("memories").agg(F.count("*").alias("after"))
    return added.crossJoin(after).select(F.lit(0).cast("long").alias("before"), "added", "after")  # a row each


@query("""SELECT source AS scope, CAST(sum(0.6) AS DOUBLE) AS weight, count(DISTINCT doc_id) AS n FROM documents GROUP BY source""")
def graph_tables(t: Tables) -> DataFrame:
    """Nodes written as a version, read again: the version is swapped as a whole."""
    store = TableStore(t.spark, fresh(t, "graph"))
    nodes = t.documents.select(F.col("source").alias("name"), F.col("source").alias("scope"), F.lit(0.6).alias("attention_weight_sum"), F.lit("SOURCE").alias("entity_type"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("summary_facts"))
    store.write("nodes", nodes.limit(0))
    store.write("nodes", nodes)
    return store.read("nodes", sc.NODES).groupBy("scope").agg(F.round(F.sum("attention_weight_sum"), 6).alias("weight"), F.count("*").alias("n"))


# Streams


@query("SELECT source AS scope, md5(text) AS hash FROM documents GROUP BY ALL")
def streamed_dedupe(t: Tables) -> DataFrame:
    """Texts of a scope once, by a stream over the whole table."""
    src = fresh(t, "stream-in")
    t.documents.select(F.col("source").alias("scope"), "text").write.parquet(src)
    stream = t.spark.readStream.schema("scope string, text string").parquet(src)
    out = fresh(t, "stream-out")
    ss.dedupe(stream).select("scope", "hash").writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh(t, "stream-cp")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("scope string, hash string").parquet(out)


@query("""WITH m AS (SELECT user_id, event_type AS name, least(1.0, 0.5) AS w FROM events UNION ALL SELECT user_id, 'k' || json_extract_string(props, '$.k'), 0.5 FROM events)
    SELECT 'u' || (user_id % 7) AS scope, name, round(CAST(sum(w) AS DOUBLE), 6) AS weight FROM m GROUP BY ALL""")
def streamed_graph(t: Tables) -> DataFrame:
    """Triples of all events into node weights, by micro-batches."""
    src = fresh(t, "stream-in")
    rows = t.events.select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("scope"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("sentence_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("head"), F.lit("has").alias("relation"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("tail"), F.lit(0.5).alias("confidence"))
    rows.write.parquet(src)
    store = TableStore(t.spark, fresh(t, "stream-graph"))
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(src)
    ss.maintain_graph(stream, store, fresh(t, "stream-cp")).start().awaitTermination()
    nodes, _, _ = ss.maintained(store)
    return nodes.select("scope", "name", F.round("attention_weight_sum", 6).alias("weight"))


@query("""WITH f AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id, md5(text) ORDER BY turn) = 1)
    SELECT 'user_id=c' || conv_id AS scope, count(*) AS memories FROM f GROUP BY conv_id""")
def streamed_ingest(t: Tables) -> DataFrame:
    """All conversations into an engine by a stream; a second start of the query finds nothing new."""
    src, cp = fresh(t, "stream-in"), fresh(t, "stream-cp")
    m = messages(t)
    m.repartition(2, "user_id").write.parquet(src)

    class Raw(me.MemoryEngine):
        def add_batch(self, rows: DataFrame, infer: bool = False, **named) -> DataFrame:
            return super().add_batch(rows, infer=False, **named)

    e = Raw(t.spark, fresh(t, "engine"), PLAIN)
    for _ in range(2):
        stream = t.spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(src)
        ss.ingest(stream, e, cp).start().awaitTermination()
    return e.table("memories").groupBy("scope").agg(F.count("*").alias("memories"))


@query("""WITH b AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch, batch * 4 + 4 > n AS pending FROM b""")
def buffered_batches(t: Tables) -> DataFrame:
    """Turns in batches that leave when they are full; the last are pending."""
    return sb.count_batches(t.conversations, "conv_id", ["turn"], 4).select("conv_id", "turn", "batch", "pending")


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def last_units(t: Tables) -> DataFrame:
    """The last four turns of each conversation: the ring buffer's content."""
    return sb.ring(t.conversations, "conv_id", ["turn"], 4).select("conv_id", "turn")


# Dataset readers


def listed(rows: DataFrame, by: list[str], order: str, *fields: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_v")))), lambda x: x["_v"]).alias("items"))


@query("SELECT CAST((row_number() OVER (PARTITION BY item_id // 10 ORDER BY item_id) - 1) AS INTEGER) AS idx, item_id, md5(text) AS text_md5 FROM benchmark")
def array_files(t: Tables) -> DataFrame:
    """Files that hold one array of records each."""
    path = fresh(t, "array-files")
    rows = listed(t.benchmark.withColumn("file", F.floor(F.col("item_id") / 10)), ["file"], "item_id", F.col("item_id"), F.col("text"))
    rows.select("file", F.to_json("items").alias("value")).repartition("file").write.partitionBy("file").text(path)
    raw = ds.read_json(t.spark, path, least=1)
    return raw.select("idx", F.get_json_object("raw", "$.item_id").cast("long").alias("item_id"), F.md5(F.get_json_object("raw", "$.text")).alias("text_md5"))


#: Sessions in a row of a dialogue record; a longer record comes in several rows, so that no row grows with the tables.
SESSIONS = 32


def dialogue_records(t: Tables) -> DataFrame:
    """Ten records of sessions, from all conversations, in rows of bounded size."""
    c = t.conversations.withColumn("idx", (F.col("conv_id") % 10).cast("int"))
    number = c.select("idx", "conv_id").distinct().withColumn("session", F.row_number().over(Window.partitionBy("idx").orderBy("conv_id")))
    s = listed(c, ["idx", "conv_id"], "turn", F.col("role").alias("speaker"), F.concat_ws(":", F.lit("D"), "conv_id", "turn").alias("dia_id"), F.col("text"), F.when(F.col("turn") == 1, "a cat").alias("blip_caption")).join(number, ["idx", "conv_id"])
    date = F.concat(F.lit("1:56 pm on "), (29 - F.col("session") % 28).cast("string"), F.lit(" May, 2023"))
    entries = s.select("idx", F.floor(F.col("session") / SESSIONS).alias("part"), F.explode(F.array(F.struct(F.concat(F.lit("session_"), "session").alias("k"), F.to_json("items").alias("v")), F.struct(F.concat(F.lit("session_"), "session", F.lit("_date_time")).alias("k"), date.alias("v")))).alias("e"))
    return entries.groupBy("idx", "part").agg(F.map_from_entries(F.collect_list("e")).alias("conversation")).select("idx", F.to_json(F.struct(F.to_json("conversation").alias("conversation"))).alias("raw"))


DIALOGUES = """d AS (SELECT CAST(conv_id % 10 AS INTEGER) AS conv_idx, CAST(dense_rank() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id) AS INTEGER) AS session, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, conv_id, turn AS t, role, text FROM conversations),
    x AS (SELECT *, 29 - session % 28 AS day, 'D:' || conv_id || ':' || t AS dia_id, CASE WHEN t = 1 THEN coalesce(text, '') || ' [shared photo]' END AS photo FROM d),
    p AS (SELECT conv_idx, session, row_number() OVER (PARTITION BY conv_idx ORDER BY day, session) AS session_pos FROM (SELECT DISTINCT conv_idx, session, day FROM x))"""


@query(f"""WITH {DIALOGUES} SELECT conv_idx, session, CAST(session_pos AS INTEGER) AS session_pos, turn, role AS speaker, dia_id, epoch(make_timestamp(2023, 5, day, 13, 56, 0.0))::BIGINT AS at, CASE WHEN t = 1 THEN -1 ELSE length(coalesce(text, '')) END AS n FROM x JOIN p USING (conv_idx, session)""")
def dialogue_turns(t: Tables) -> DataFrame:
    """Turns of the records in the order of their sessions' dates; n is the text's length, or -1 where a photo is described."""
    out = ds.session_order(ds.dialogues(dialogue_records(t)))
    photo = F.col("dia_id").rlike(":1$") & F.col("text").contains("a cat")
    return out.select("conv_idx", "session", "session_pos", "turn", "speaker", "dia_id", F.unix_timestamp("ts").alias("at"), F.when(photo, -1).otherwise(F.length("text")).alias("n"))


@query(f"""WITH {DIALOGUES} SELECT conv_idx, dia_id, '[' || dia_id || ', said on 1:56 pm on ' || day || ' May, 2023] ' || role || ': ' AS head FROM x WHERE t <> 1""")
def dialogue_evidence(t: Tables) -> DataFrame:
    """Evidence lines of the turns without a photo, up to their text."""
    found = ds.evidence_lines(ds.dialogues(dialogue_records(t))).where(~F.col("dia_id").rlike(":1$"))
    return found.select("conv_idx", "dia_id", F.regexp_extract("evidence", "(?s)^(\\[[^\\]]*\\] [a-z]+: )", 1).alias("head"))


@query("""WITH q AS (SELECT CAST(item_id % 10 AS INTEGER) AS conv_idx, CAST(row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id) - 1 AS INTEGER) AS q_idx, text, CAST(1 + item_id % 5 AS INTEGER) AS category, item_id FROM benchmark),
    f AS (SELECT * FROM q WHERE category < 5 QUALIFY row_number() OVER (PARTITION BY conv_idx ORDER BY q_idx) <= 3)
    SELECT 'conv' || conv_idx || '_q' || q_idx AS question_id, conv_idx, q_idx, md5(text) AS question_md5, category, CASE category WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open-domain' ELSE 'single-hop' END AS category_name, 'D' || item_id AS evidence FROM f""")
def dialogue_questions(t: Tables) -> DataFrame:
    """The first three questions of each record in the wanted categories (the limit is the feature)."""
    q = t.benchmark.withColumn("idx", (F.col("item_id") % 10).cast("int"))
    raw = listed(q, ["idx"], "item_id", F.col("text").alias("question"), F.lit("a").alias("answer"), (1 + F.col("item_id") % 5).alias("category"), F.array(F.concat(F.lit("D"), "item_id")).alias("evidence"))
    found = ds.questions(raw.select("idx", F.to_json(F.struct(F.col("items").alias("qa"))).alias("raw")), first=3)
    return found.select("question_id", "conv_idx", "q_idx", F.md5("question").alias("question_md5"), "category", "category_name", F.array_join("evidence", ",").alias("evidence"))


@query("""SELECT 'q' || conv_id AS question_id, 's' || (turn % 2) AS session_id, CAST(CASE WHEN turn % 2 = 1 THEN 1 ELSE dense_rank() OVER (PARTITION BY conv_id ORDER BY turn % 2 DESC) END AS INTEGER) AS session_pos,
    CAST(row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) - 1 AS INTEGER) AS turn, role, md5(text) AS content_md5, turn = 0 AS has_answer, epoch(CASE WHEN turn % 2 = 1 THEN TIMESTAMP '2023-05-01 21:05:00' ELSE TIMESTAMP '2023-05-20 02:21:00' END)::BIGINT AS at FROM conversations""")
def haystack_turns(t: Tables) -> DataFrame:
    """Records with parallel arrays of ids, dates and sessions."""
    c = t.conversations.withColumn("s", F.col("turn") % 2)
    s = listed(c, ["conv_id", "s"], "turn", F.col("role"), F.col("text").alias("content"), (F.col("turn") == 0).alias("has_answer"))
    r = s.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", "items"))).alias("x"))
    dates = F.transform("x", lambda e: F.when(e["s"] == 1, "2023/05/01 (Mon) 21:05").otherwise("2023/05/20 (Sat) 02:21"))
    record = F.struct(F.concat(F.lit("q"), "conv_id").alias("question_id"), F.transform("x", lambda e: F.concat(F.lit("s"), e["s"].cast("string"))).alias("haystack_session_ids"), dates.alias("haystack_dates"), F.transform("x", lambda e: e["items"]).alias("haystack_sessions"))
    found = ds.haystacks(r.select(F.col("conv_id").alias("idx"), F.to_json(record).alias("raw")))
    return found.select("question_id", "session_id", "session_pos", "turn", "role", F.md5("content").alias("content_md5"), "has_answer", F.unix_timestamp("ts").alias("at"))


@query("""WITH c AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS n, role, text FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CASE WHEN conv_id % 3 = 1 THEN n ELSE 0 END AS batch, CASE WHEN conv_id % 3 = 1 THEN 0 ELSE n END AS turn, role, md5(text) AS content_md5 FROM c""")
def chat_turns(t: Tables) -> DataFrame:
    """Chats in three nestings: flat, lists of turns, batches."""
    c = listed(t.conversations, ["conv_id"], "turn", F.col("role"), F.col("text").alias("content"))
    kind = F.col("conv_id") % 3
    chat = F.when(kind == 0, F.to_json("items")).when(kind == 1, F.to_json(F.transform("items", lambda i: F.array(i)))).otherwise(F.to_json(F.array(F.struct(F.col("items").alias("turns")))))
    found = ds.chats(c.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), chat.alias("chat"))).alias("raw")))
    return found.select("conversation_id", "batch", "turn", "role", F.md5("content").alias("content_md5"))


@query("""SELECT CAST(item_id AS VARCHAR) AS conversation_id, CASE WHEN item_id % 2 = 0 THEN 'abstention' ELSE 'temporal_reasoning' END AS ability, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 10 END AS ability_pos, md5(text) AS question_md5,
    CASE WHEN item_id % 2 = 0 THEN 'one' ELSE 'one,two' END AS nuggets, '1,' || item_id || ',3' AS sources FROM benchmark""")
def rubric_nuggets(t: Tables) -> DataFrame:
    """Probing questions with rubrics in two forms."""
    even = F.col("item_id") % 2 == 0
    rubric = F.when(even, F.lit('["one"]')).otherwise(F.lit('{"nuggets": [{"description": "one"}, "two"]}'))
    sources = F.concat(F.lit("[[1, "), F.col("item_id").cast("string"), F.lit("], [3]]"))
    asked = F.struct(F.col("text").alias("question"), rubric.alias("rubric"), sources.alias("source_chat_ids"))
    probing = F.to_json(F.create_map(F.when(even, "abstention").otherwise("temporal_reasoning"), F.array(asked)))
    found = ds.probing_questions(t.benchmark.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("conversation_id"), probing.alias("probing_questions"))).alias("raw")))
    return found.select("conversation_id", "ability", F.col("ability_pos").cast("int").alias("ability_pos"), F.md5("question").alias("question_md5"), F.array_join("nuggets", ",").alias("nuggets"), F.array_join("source_chat_ids", ",").alias("sources"))


@query("SELECT conv_id, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS INTEGER) AS chunk, turn FROM conversations QUALIFY NOT bool_or(turn % 5 = 3 OR trim(coalesce(text, '')) = '') OVER (PARTITION BY conv_id, (turn // 2))")
def usable_chunks(t: Tables) -> DataFrame:
    """Chunks of two turns without a blank one; every fifth turn is blanked."""
    c = t.conversations.withColumn("text", F.when(F.col("turn") % 5 == 3, " ").otherwise(F.col("text")))
    return ds.usable_chunks(ds.chunks(c, ["conv_id"], ["turn"], 2), ["conv_id", "chunk"]).select("conv_id", "chunk", "turn")


@query("""WITH e AS (SELECT CAST(doc_id % 10 AS INTEGER) AS conv_idx, doc_id, lang, source FROM documents)
    SELECT conv_idx, CAST(substr(source, 4) AS INTEGER) AS session, lang AS speaker, count(*) AS n, min(doc_id) AS first_event FROM e GROUP BY ALL""")
def event_summaries(t: Tables) -> DataFrame:
    """Events of sessions by speaker; the date of a session isn't one."""
    d = t.documents.withColumn("idx", (F.col("doc_id") % 10).cast("int")).groupBy("idx", "source", "lang").agg(F.to_json(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))).alias("events"))
    s = d.groupBy("idx", "source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "events"))).alias("m"))
    s = s.select("idx", F.concat(F.lit("events_session_"), F.substring("source", 4, 9)).alias("k"), F.to_json(F.map_concat("m", F.create_map(F.lit("date"), F.lit("8 May")))).alias("v"))
    raw = s.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).select("idx", F.to_json(F.struct(F.to_json("m").alias("event_summary"))).alias("raw"))
    return ds.event_summaries(raw).groupBy("conv_idx", "session", "speaker").agg(F.count("*").alias("n"), F.min(F.col("event").cast("long")).alias("first_event"))


# Result files


def run_files(t: Tables) -> DataFrame:
    """A run's evaluations, read from files of 200 each; every label is a question with two cutoffs."""
    path = fresh(t, "run-files")
    d = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    cut = lambda good, score: F.struct(F.when(good, "CORRECT").otherwise("WRONG").alias("judgment"), score.cast("double").alias("score"), F.lit("r").alias("generated_answer"))
    found = F.struct(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("memory"), "doc_id").alias("memory"), F.lit(0.5).alias("score"), F.when(F.col("doc_id") % 2 == 0, "graph_bfs").otherwise("vector").alias("source"))
    one = F.struct(
        F.concat(F.lit("conv"), (F.col("doc_id") % 9).cast("string"), F.lit("_q"), "doc_id").alias("question_id"), F.col("lang").alias("category_name"), F.lit("what").alias("question"), F.concat(F.lit("memory"), "doc_id").alias("ground_truth_answer"),
        F.struct((F.col("doc_id") % 50).cast("double").alias("search_latency_ms"), F.array(found).alias("search_results"), F.struct(F.struct(F.create_map(F.lit("total"), F.lit(9.0), F.lit("graph"), (F.col("doc_id") % 4).cast("double"), F.lit("vector"), F.lit(2.5)).alias("timing_ms")).alias("routes")).alias("query_debug")).alias("retrieval"),
        F.struct(cut(F.col("quality") == 1, F.col("quality")).alias("top_10"), cut(F.col("toxic") == 0, 1 - F.col("toxic")).alias("top_50")).alias("cutoff_results"),
    )
    rows = d.select(F.floor(F.col("doc_id") / 200).alias("file"), "doc_id", one.alias("e")).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.to_json("e").alias("e")))), lambda x: x["e"]).alias("e"))
    # The first evaluation of a file stands in it twice; an empty id is left out.
    value = F.concat(F.lit('{"evaluations": ['), F.array_join(F.concat(F.slice("e", 1, 1), F.array(F.lit('{"question_id": ""}')), F.col("e")), ","), F.lit("]}"))
    rows.select("file", value.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return rs.read_run(t.spark, path)


RUN = """r AS (SELECT 'conv' || (doc_id % 9) || '_q' || doc_id AS question_id, doc_id, lang, quality, toxic, CAST(doc_id % 50 AS DOUBLE) AS ms FROM labels JOIN documents USING (doc_id))"""


@query(f"""WITH {RUN} SELECT question_id, lang AS grp, 10 AS cutoff, CAST(quality AS DOUBLE) AS score, CASE WHEN quality = 1 THEN 'CORRECT' ELSE 'WRONG' END AS judgment FROM r
    UNION ALL SELECT question_id, lang, 50, CAST(1 - toxic AS DOUBLE), CASE WHEN toxic = 0 THEN 'CORRECT' ELSE 'WRONG' END FROM r""")
def run_cutoffs(t: Tables) -> DataFrame:
    """A row for each question and cutoff of a run's files, repeated ids once."""
    return rs.cutoff_rows(run_files(t)).select("question_id", "grp", "cutoff", "score", "judgment")


@query(f"WITH {RUN} SELECT question_id, lang AS grp, CASE WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict, CAST(quality AS DOUBLE) AS score, ms AS latency_ms FROM r")
def unified_results(t: Tables) -> DataFrame:
    return rs.unified(run_files(t), None, "top_10").select("question_id", "grp", "verdict", "score", "latency_ms")


@query(f"WITH {RUN} SELECT lang AS grp, round(avg(ms) FILTER (WHERE ms > 0), 6) AS avg_latency_ms FROM r GROUP BY lang")
def average_latency(t: Tables) -> DataFrame:
    return rs.average_latency(rs.unified(run_files(t), None, "top_10"), "grp").select("grp", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


@query(f"WITH {RUN} SELECT question_id FROM r WHERE lang = 'en' AND quality = 1 ORDER BY question_id LIMIT 10 OFFSET 10")
def result_page(t: Tables) -> DataFrame:
    """The second page of ten of a group's correct results (the limit is the feature)."""
    return rs.page(rs.unified(run_files(t), None, "top_10"), 1, 10, "en", "correct").select("question_id")


@query(f"""WITH {RUN} SELECT question_id, lang AS category, quality = 1 AS correct, 'memory' || doc_id AS texts, CASE WHEN doc_id % 2 = 0 THEN 'graph_bfs' ELSE 'vector' END AS routes, ms AS latency_ms, CAST(9 AS DOUBLE) AS total_ms,
    CASE WHEN doc_id % 4 > 2.5 THEN 'graph' ELSE 'vector' END AS slowest, CAST(1 AS DOUBLE) AS support FROM r""")
def flat_results(t: Tables) -> DataFrame:
    """Results as diagnosis reads them, with the slowest stage and the support of the answer."""
    e = run_files(t)
    slow = e.select("question_id", bottleneck(F.col("retrieval.query_debug.routes.timing_ms")).alias("slowest"))
    f = rs.flat(e, "top_10", 10).join(slow, "question_id")
    return f.select("question_id", "category", "correct", F.array_join("texts", ",").alias("texts"), F.array_join("routes", ",").alias("routes"), "latency_ms", "total_ms", "slowest", F.round(support(F.col("answer"), F.col("texts")), 6).alias("support"))


@query(f"""WITH {RUN}, k AS (SELECT question_id, doc_id % 9 AS c, doc_id AS q FROM r) SELECT question_id, CAST(row_number() OVER (ORDER BY c, q) AS INTEGER) AS place FROM k""")
def natural_order(t: Tables) -> DataFrame:
    """Questions by the numbers in their ids: the order of a report, numbered on one task as a report is."""
    ids = rs.unified(run_files(t), None, "top_10").select("question_id")
    return ids.select("question_id", F.row_number().over(Window.orderBy(*natural_key(F.col("question_id")))).alias("place"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'beam' WHEN 1 THEN 'longmemeval' WHEN 2 THEN 'locomo' WHEN 3 THEN 'unified' ELSE 'unknown' END AS format FROM documents""")
def run_formats(t: Tables) -> DataFrame:
    """The format of run files by their keys."""
    k = F.col("doc_id") % 5
    run = F.when(k == 0, '{"evaluations": [{"nugget_scores": [1]}]}').when(k == 1, '{"evaluations": [{"question_type": "x"}]}').when(k == 2, '{"evaluations": [{"category": 1}]}').when(k == 3, '{"evaluations": [{"x": 1}]}').otherwise('{"rows": []}')
    return t.documents.select("doc_id", rs.detect_format(run).alias("format"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS verdict FROM documents""")
def yes_no_verdicts(t: Tables) -> DataFrame:
    """Verdicts of replies around each document: on a line of its own, the last word, after a thought, or none."""
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("no, "), "lang", F.lit("\nYes.\n"))).when(k == 1, F.concat(F.lit("yes was said, but "), "source", F.lit(" says no"))).when(k == 2, "<think>no no</think> yes").otherwise(F.col("source"))
    return t.documents.select("doc_id", tx.yes_no(reply).alias("verdict"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'regression' WHEN doc_id % 3 = 1 THEN 'improvement' ELSE 'same' END AS change FROM documents ORDER BY doc_id % 3, doc_id LIMIT 50""")
def regressions_first(t: Tables) -> DataFrame:
    """The first fifty rows of a comparison (the limit is the feature)."""
    k = F.col("doc_id") % 3
    changes = t.documents.select(F.col("doc_id").alias("question_id"), F.when(k == 0, "regression").when(k == 1, "improvement").otherwise("same").alias("change"))
    return rs.regressions_first(changes).limit(50).select(F.col("question_id").alias("doc_id"), "change")


@query("SELECT doc_id, text, lang, source, n_chars, '[\"' || lang || '\",\"' || source || '\"]' AS tags FROM documents")
def report_files(t: Tables) -> DataFrame:
    """JSON lines written and read again, nested cells as JSON."""
    path = fresh(t, "report")
    rows = t.documents.withColumn("tags", F.array("lang", "source"))
    rs.write_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path).withColumn("tags", F.to_json("tags"))


# Logs


LOG = f"""b AS (SELECT conv_id, turn, role, ltrim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') AS said FROM conversations WHERE role IN ('user', 'assistant')),
    l AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS chunk, regexp_extract(said, '^([^ ]+?): +(.+)$', 1) AS name, regexp_extract(said, '^([^ ]+?): +(.+)$', 2) AS rest, role, said FROM b WHERE said <> '')"""


@query(f"WITH {LOG} SELECT session_id, CAST(1682899200 AS BIGINT) AS epoch, chunk, 'message' AS kind, CASE WHEN name <> '' THEN name WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS speaker, md5(CASE WHEN name <> '' THEN rest ELSE said END) AS text_md5 FROM l")
def ingestion_log(t: Tables) -> DataFrame:
    """All conversations written as logs and parsed again; every second chunk is there twice, as a restart leaves it."""
    lines = lg.render(t.conversations).withColumnRenamed("conv_id", "file")
    again = lines.where("line_no > 1 AND floor((line_no - 2) / 2) % 2 = 0")
    head = lines.where(F.col("line").startswith("SESSION"))
    repeated = head.unionByName(again).withColumn("line_no", F.col("line_no") + 1_000_000_000)
    parsed = lg.merge_restarts(lg.ingestion_log(lines.unionByName(repeated)))
    return parsed.select("session_id", "epoch", "chunk", "kind", "speaker", F.md5("text").alias("text_md5"))


@query("""WITH e AS (SELECT 'user ' || user_id AS label, event_id, CAST(floor(value) AS INTEGER) AS done FROM events)
    SELECT label, CAST(arg_max(done, event_id) AS INTEGER) AS done, 1000 AS total, CAST(arg_max(done // 10, event_id) AS INTEGER) AS percent FROM e GROUP BY label""")
def progress_bars(t: Tables) -> DataFrame:
    """The latest bar of each label among those of all events."""
    done = F.floor("value").cast("int")
    bar = F.concat(F.lit("user "), "user_id", F.lit(": "), F.floor(done / 10).cast("string"), F.lit("%|##  | "), done.cast("string"), F.lit("/1000 [00:01]"))
    return lg.progress(t.events.select(F.col("event_id").alias("line_no"), bar.alias("line"))).select("label", "done", "total", "percent")


@query("""WITH e AS (SELECT user_id, arg_max(CAST(floor(value) AS BIGINT), event_id) AS done FROM events GROUP BY user_id)
    SELECT CAST(sum(done) AS BIGINT) AS done, CAST(count(*) * 1000 AS BIGINT) AS total, round(100.0 * sum(done) / (count(*) * 1000), 1) AS percent, round(60.0 * (count(*) * 1000 - sum(done)) / sum(done), 4) AS eta_s FROM e""")
def progress_overall(t: Tables) -> DataFrame:
    """All bars together, and the seconds left."""
    return lg.overall(progress_bars(t), 60.0).withColumn("eta_s", F.round("eta_s", 4))


@query("SELECT event_type AS component, 'm' || (user_id % 3) AS model, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS total_tokens FROM events GROUP BY ALL")
def usage_totals(t: Tables) -> DataFrame:
    """Usage records of all events, appended in two writes and summed."""
    path = fresh(t, "usage")
    n = (F.col("event_id") % 100).alias("total_tokens")
    rows = t.events.select("event_id", F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("component"), F.lit("p").alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.lit("chat").alias("call_type"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), n)
    lg.append_usage(rows.where("event_id % 2 = 0"), path)
    lg.append_usage(rows.where("event_id % 2 = 1"), path)
    return lg.usage(t.spark, path)


# Validation of a model's replies


def replies(t: Tables) -> DataFrame:
    """A reply for each document, with valid and broken facts and triples."""
    fact = lambda i, text, sid, ids, sure: F.struct(F.lit(i).alias("fact_id"), text.alias("fact"), F.lit(sid).alias("source_sentence_id"), tx.strings(ids).alias("source_sentence_ids"), F.lit(sure).alias("confidence"))
    triple = lambda h, r, ta, f, sid: F.struct(h.alias("head"), F.lit(r).alias("relation"), ta.alias("tail"), F.lit(f).alias("source_fact_id"), F.lit(sid).alias("source_sentence_id"), F.array(F.lit("s2")).alias("source_sentence_ids"))
    lang, source = F.col("lang"), F.col("source")
    facts = F.array(fact("f1", F.lit("old"), "s1", ["s1"], 0.5), fact("f1", F.concat(lang, F.lit(" is used")), "s1", ["s2", "x", "s2"], 1.7), fact(" ", lang, "s1", [], 0.5), fact("f2", F.lit("  "), "s1", [], 0.5), fact("f3", source, "zz", [], 0.5), fact("f4", source, "s2", ["s1"], -1.0))
    triples = F.array(triple(source, "in", lang, "f1", "s1"), triple(F.lit(" "), "in", lang, "f1", "s1"), triple(source, "has", lang, "f9", "s1"), triple(lang, "of", source, "", "none"), triple(lang, "by", source, "f4", "s1"))
    reply = F.when(F.col("doc_id") % 4 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(facts.alias("facts"), triples.alias("triples"))))
    return t.documents.select(source.alias("scope"), F.col("doc_id").cast("string").alias("batch_id"), tx.strings(["s1", "s2"]).alias("sids"), reply.alias("reply"), "doc_id")


@query("""WITH d AS (SELECT source AS scope, CAST(doc_id AS VARCHAR) AS batch_id, lang, source FROM documents WHERE doc_id % 4 <> 3)
    SELECT scope, batch_id, 'f1' AS fact_id, lang || ' is used' AS fact, 's1' AS sid, 's1,s2' AS sources, CAST(1 AS DOUBLE) AS confidence FROM d UNION ALL SELECT scope, batch_id, 'f4', source, 's2', 's2,s1', CAST(0 AS DOUBLE) FROM d""")
def fact_validation(t: Tables) -> DataFrame:
    """Facts that are neither blank nor of unknown sentences; the last of equal ids."""
    return un.facts(replies(t).drop("doc_id")).select("scope", "batch_id", "fact_id", "fact", "sid", F.array_join("source_sentence_ids", ",").alias("sources"), "confidence")


@query("""WITH d AS (SELECT source AS scope, CAST(doc_id AS VARCHAR) AS batch_id, lang, source FROM documents WHERE doc_id % 4 <> 3)
    SELECT scope, batch_id, source AS head, 'in' AS relation, lang AS tail, 's1' AS sid, 's1,s2' AS sources, 'f1' AS fact_id, lang || ' is used' AS fact FROM d UNION ALL SELECT scope, batch_id, lang, 'of', source, 's2', 's2', '', '' FROM d""")
def triple_validation(t: Tables) -> DataFrame:
    """Triples with all parts, a known sentence, and a kept fact of the same sentence if they name one."""
    r = replies(t).drop("doc_id")
    found = un.triples(r, un.facts(r))
    return found.select("scope", "batch_id", "head", "relation", "tail", "sid", F.array_join("source_sentence_ids", ",").alias("sources"), "fact_id", "fact")


@query("""WITH d AS (SELECT source AS scope, doc_id, lang FROM documents WHERE doc_id % 4 <> 3)
    SELECT scope, md5('graph_fact:s1,s2:f1:' || lang || ' is used') AS hash, lang || ' is used' AS data, 'in' AS edge_type, 'edge_fact' AS graph_object, 1 AS n_triples FROM d
    UNION ALL SELECT scope, md5('graph_fact:s2,s1:f4:' || scope), scope, '', 'edge_fact', 0 FROM d""")
def fact_memories(t: Tables) -> DataFrame:
    """Valid facts as memories with their triples; every document's sentences s1 and s2 are units of its scope."""
    r = replies(t).drop("doc_id")
    facts = un.facts(r)
    units = t.documents.select(F.col("source").alias("scope")).distinct().select("scope", F.explode(tx.strings(["s1", "s2"])).alias("id"), F.array().cast("array<string>").alias("raw_ids"), F.lit("2024-01-01").alias("created_at"))
    made = me.fact_memories(facts, un.triples(r, facts), units)
    return made.select("scope", "hash", "data", "edge_type", "graph_object", F.size(F.coalesce("triples", F.array().cast(made.schema["triples"].dataType))).alias("n_triples"))


# Sentences and units, step by step


SENTENCES = f"""q AS (SELECT CAST(conv_id AS VARCHAR) AS scope, turn, role, {SPLIT} AS parts, text FROM conversations WHERE role <> 'system' AND trim(text) <> ''),
    v AS (SELECT scope, turn, role, CASE WHEN len(parts) > 0 THEN parts ELSE [text] END AS parts FROM q),
    s AS (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY turn, p) AS i, role AS speaker, parts[p + 1] AS text FROM (SELECT *, unnest(range(len(parts))) AS p FROM v))"""


@query(f"""WITH RECURSIVE {SENTENCES},
    m AS (SELECT scope, i, 1 AS grp, speaker, text FROM s WHERE i = 1
          UNION ALL SELECT s.scope, s.i, CASE WHEN j THEN m.grp ELSE m.grp + 1 END, s.speaker, CASE WHEN j THEN m.text || ' ' || s.text ELSE s.text END
          FROM m JOIN s ON s.scope = m.scope AND s.i = m.i + 1, LATERAL (SELECT m.speaker = s.speaker AND (length(m.text) < 10 OR len(list_filter(regexp_split_to_array(m.text, '{WS}+'), lambda w: w <> '')) < 2 OR NOT regexp_matches(m.text, '{tx.VERB}')) AS j)),
    w AS (SELECT scope, grp, any_value(speaker) AS speaker, arg_max(text, i) AS text FROM m GROUP BY scope, grp),
    k AS (SELECT *, list_filter(range(2, length(text)), lambda c: regexp_matches(substr(text, c - 1, 2), '^[^0-9][,;]$') AND regexp_matches(substr(text, c + 1), '^{WS}+[\\p{{L}}\\p{{N}}_]')) AS cuts,
                 regexp_replace(text, '(?i){WS}+(and|but|or|however|therefore|moreover|meanwhile){WS}+', ' \\1' || chr(1), 'g') AS marked FROM w),
    c AS (SELECT scope, grp, speaker, CASE WHEN length(text) <= 500 THEN [text] WHEN len(cuts) > 0 THEN list_transform(range(len(cuts) + 1), lambda n: substr(text, CASE WHEN n = 0 THEN 1 ELSE cuts[n] + 1 END, CASE WHEN n = len(cuts) THEN length(text) ELSE cuts[n + 1] - 1 END - CASE WHEN n = 0 THEN 0 ELSE cuts[n] END))
                 ELSE string_split(marked, chr(1)) END AS pieces FROM k),
    x AS (SELECT scope, grp, speaker, pieces, unnest(range(len(pieces))) AS n FROM c),
    y AS (SELECT scope, grp, speaker, n, CASE WHEN len(pieces) = 1 THEN pieces[1] ELSE regexp_replace(pieces[n + 1], '^{WS}+|{WS}+$', '', 'g') END AS text FROM x)
    SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY grp, n) - 1 AS INTEGER) AS idx, speaker, text FROM y WHERE text <> ''""", name="sentence_merge")
def sentence_merge(t: Tables) -> DataFrame:
    """Sentences of each conversation, short ones joined with the next of the same speaker, long ones cut."""
    return un.segment(un.raw_sentences(turns(t))).select("scope", "idx", "speaker", "text")


@query(f"""WITH {SENTENCES}, f AS (SELECT scope, count(*) AS n, list(text ORDER BY i)[1:2] AS two, list(speaker ORDER BY i)[1:2] AS who FROM s GROUP BY scope),
    r AS (SELECT s.scope, s.i, CASE WHEN n >= 2 AND i = 1 THEN two[1] || ' ' || two[2] ELSE text END AS text, CASE WHEN n >= 2 AND i = 1 THEN CASE WHEN who[1] = who[2] THEN who[1] ELSE 'mixed' END ELSE speaker END AS speaker,
                 CASE WHEN n >= 2 AND i = 1 THEN 's0,s1' ELSE 's' || (i - 1) END AS sources, NOT (n >= 2 AND i = 1) AS fallback FROM s JOIN f USING (scope) WHERE NOT (n >= 2 AND i = 2))
    SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY i) - 1 AS INTEGER) AS position, text, speaker, sources, CAST(1 AS DOUBLE) AS confidence, fallback FROM r""", name="evidence_units")
def evidence_units(t: Tables) -> DataFrame:
    """Units from replies that merge the first two sentences of each conversation, propose them once more, and propose a gap, unknown ids and a text of its own making."""
    sentences = un.raw_sentences(turns(t))
    first = sentences.where("idx < 2").groupBy("scope", "batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    proposal = lambda ids, text, sure: F.struct(tx.strings(ids).alias("source_sentence_ids"), text.alias("text"), F.lit(sure).alias("confidence"))
    unit = F.array(proposal(["s0", "s1"], F.col("text"), 1.5), proposal(["s1"], F.lit("taken"), 0.5), proposal(["s2", "s4"], F.lit("gap"), 0.5), proposal(["zz"], F.lit("unknown"), 0.5), proposal(["s2"], F.repeat(F.lit("far too long "), 400), 0.5))
    made = first.select("scope", "batch_id", F.to_json(F.struct(unit.alias("units"))).alias("reply"))
    return un.accept_units(sentences, made).select("scope", "position", "text", "speaker", F.array_join("source_sentence_ids", ",").alias("sources"), "confidence", "fallback")


# Contexts


@query("""WITH e AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations WHERE text IS NOT NULL),
    k AS (SELECT *, CAST(floor(length(regexp_replace(line, '[^\\x00-\\x7F]', '', 'g')) / 4.0 + (length(line) - length(regexp_replace(line, '[^\\x00-\\x7F]', '', 'g'))) / 1.5) AS BIGINT) AS tokens FROM e),
    r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM k)
    SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS context_md5, count(*) AS n FROM r WHERE used <= 600 GROUP BY conv_id""")
def synthesized_context(t: Tables) -> DataFrame:
    """The turns of each conversation as lines, up to a budget of 600 tokens."""
    rows = t.conversations.where("text is not null").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), (-F.col("turn")).alias("score"), F.col("text").alias("memory"), F.lit("").alias("created_at"), F.col("role").alias("speaker"))
    n = F.size(F.regexp_extract_all("context", F.lit("(?m)^(user|assistant|system): "), F.lit(1))).cast("long")
    return synthesize(rows, "relevance", 600).select(F.col("query_id").alias("conv_id"), F.md5("context").alias("context_md5"), n.alias("n"))


@query("""SELECT doc_id, '[2024-02-03] ' || CASE WHEN source = 'src1' THEN '' ELSE source || ': ' END || text AS line, '- ' || lang || chr(10) || '- ' || source AS profile FROM documents""")
def rendered_lines(t: Tables) -> DataFrame:
    """Lines of memories with their day and speaker, and facts as a list."""
    who = F.when(F.col("source") == "src1", "").otherwise(F.col("source"))
    return t.documents.select("doc_id", line(F.col("text"), F.lit("2024-02-03T10:00:00"), who).alias("line"), profile(F.array("lang", "source")).alias("profile"))

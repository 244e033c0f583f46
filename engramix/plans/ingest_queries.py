"""Ingestion: sentences, units, dedupe, context windows, chunks, ids, entity index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.functions import dates as da
from engramix.functions import numeric as nm
from engramix.functions import text as tx
from engramix.operators import context as cx
from engramix.operators import memory as me
from engramix.operators import units as un
from engramix.plans.registry import Tables, query
from engramix.plans.retrieval_queries import words
from engramix.sources import datasets as ds
from engramix.streaming import batch as sb

WS = "[ \\t\\n\\r\\f\\v]"
SPLIT = f"""list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(trim(text), '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_split_to_array(s, '\\n+'))), lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')"""


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").cast("string").alias("scope"), F.lit("0").alias("batch_id"), F.col("turn").alias("msg_seq"), "role", F.col("text").alias("content"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))


@query(f"""WITH s AS (SELECT conv_id, turn, {SPLIT} AS parts, text FROM conversations WHERE role <> 'system' AND trim(text) <> ''),
    u AS (SELECT conv_id, turn, CASE WHEN len(parts) > 0 THEN parts ELSE [text] END AS parts FROM s)
    SELECT conv_id, turn, CAST(p AS INTEGER) AS part, parts[p + 1] AS sentence FROM (SELECT *, unnest(range(len(parts))) AS p FROM u)""")
def sentence_split(t: Tables) -> DataFrame:
    spoken = t.conversations.where("role <> 'system' AND trim(text) <> ''")
    return spoken.select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("part", "sentence"))


@query(f"""WITH s AS (SELECT conv_id, turn, {SPLIT} AS parts FROM conversations WHERE role <> 'system' AND trim(text) <> ''),
    u AS (SELECT conv_id, turn, unnest(parts) AS x FROM s)
    SELECT conv_id, turn, count(*) AS n, sum(CASE WHEN len(list_filter(regexp_split_to_array(x, '{WS}+'), lambda w: w <> '')) >= 2 AND regexp_matches(x, '(?i)(is|are|was|were|have|has|had|do|does|did|will|would|can|could|should|may|might|[a-z0-9_](ed|ing)([^a-z0-9_]|$))') THEN 1 ELSE 0 END)::BIGINT AS complete FROM u GROUP BY ALL""")
def sentence_structure(t: Tables) -> DataFrame:
    parts = sentence_split(t)
    return parts.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(F.when(tx.complete(F.col("sentence")), 1).otherwise(0)).cast("long").alias("complete"))


@query(f"""WITH p AS (SELECT a.doc_id, a.text AS src, substr(a.text, 1, CAST(length(a.text) * 0.7 AS BIGINT)) AS out FROM documents a),
    k AS (SELECT *, list_filter(regexp_extract_all(lower(src), '[A-Za-z0-9'']+'), lambda x: length(x) > 1 AND NOT list_contains({words(tx.UNIT_STOPWORDS)}, x)) AS sw,
                 list_filter(regexp_extract_all(lower(out), '[A-Za-z0-9'']+'), lambda x: length(x) > 1 AND NOT list_contains({words(tx.UNIT_STOPWORDS)}, x)) AS ow FROM p)
    SELECT doc_id, length(out) <= greatest(2 * length(src) + 120, 240) AND (len(sw) < 4 OR len(list_filter(sw, lambda x: list_contains(ow, x))) / greatest(1, len(sw)) >= 0.45) AS bound FROM k""")
def source_bound(t: Tables) -> DataFrame:
    return bound(t.documents)


def bound(docs: DataFrame) -> DataFrame:
    d = docs.withColumn("out", F.expr("substring(text, 1, cast(round(length(text) * 0.7, 0) as int))"))
    return d.select("doc_id", tx.source_bound(F.col("out"), F.col("text")).alias("bound"))


@query("SELECT md5(text) AS hash, min(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY md5(text)")
def hash_dedupe(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.md5("text").alias("hash"), F.lit("s").alias("scope"), F.col("doc_id").alias("seq"))
    return me.dedupe_new(d.where("doc_id % 10 <> 0"), d.where("doc_id % 10 = 0")).select("hash", "doc_id")


@query("SELECT source, md5(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def hash_dedupe_scoped(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.md5("text").alias("hash"), F.col("source").alias("scope"), F.col("doc_id").alias("seq"))
    return me.dedupe_new(d, d.limit(0)).select(F.col("scope").alias("source"), "hash", "doc_id")


@query("""SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_lag_lead(t: Tables) -> DataFrame:
    rows = t.conversations.where("role <> 'system'").select("conv_id", "turn", F.col("turn").alias("id"))
    return me.with_neighbours(rows, ["conv_id"], "turn").select("conv_id", "turn", F.col("prev_id").alias("prev_turn"), F.col("next_id").alias("next_turn"))


@query("""SELECT conv_id, turn, coalesce(string_agg(md5(text), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""")
def recent_context(t: Tables) -> DataFrame:
    rows = sb.preceding(t.conversations.select("conv_id", "turn", F.md5("text").alias("digest")), "conv_id", ["turn"], 4, "digest")
    return rows.select("conv_id", "turn", F.array_join("context", ",").alias("context"))


@query("SELECT conv_id, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS BIGINT) AS chunk, turn FROM conversations")
def fixed_chunks(t: Tables) -> DataFrame:
    return ds.chunks(t.conversations, ["conv_id"], ["turn"], 2).select("conv_id", F.col("chunk").cast("long").alias("chunk"), "turn")


@query("""WITH e AS (SELECT conv_id, turn, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a, length(text) AS n FROM conversations),
    k AS (SELECT *, CAST(floor(a / 4.0 + (n - a) / 1.5) AS BIGINT) AS tokens FROM e), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM k)
    SELECT conv_id, turn, tokens, CAST(used AS BIGINT) AS used FROM r WHERE used <= 600""")
def token_budget_pack(t: Tables) -> DataFrame:
    return cx.within_budget(t.conversations, "conv_id", "turn", "text", 600).select("conv_id", "turn", "tokens", "used")


@query("SELECT doc_id, md5(source || chr(31) || text || chr(31) || doc_id) AS id, md5(text) AS md5 FROM documents")
def content_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", nm.content_id(F.col("source"), F.col("text"), F.col("doc_id").cast("string")).alias("id"), F.md5("text").alias("md5"))


_NS = "6ba7b8119dad11d180b400c04fd430c8"


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{_NS}') || encode('entity:' || source || ':' || doc_id)) AS h FROM documents),
    d AS (SELECT *, strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS digit FROM h)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(digit % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM d""")
def entity_uuid5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", nm.uuid5(F.concat_ws(":", F.lit("entity"), "source", F.col("doc_id").cast("string"))).alias("uuid"))


class Fenced:
    """Replies as models give them: in a code fence after some words, and cut off where there are more than three items."""

    def generate(self, payload: str) -> str:
        items = json.loads(payload)["items"]
        made = json.dumps({"facts": [{"fact_id": "f" + x["sentence_id"], "fact": x["text"], "source_sentence_id": x["sentence_id"], "confidence": 0.5} for x in items], "triples": []})
        return made[: len(made) // 2] if len(items) > 3 else f"Here it is:\n```json\n{made}\n```\nDone."


@query("""SELECT CAST(user_id AS VARCHAR) AS scope, CAST(event_id // 1000 AS VARCHAR) AS batch_id, 'fe' || event_id AS fact_id, props AS fact, 'e' || event_id AS sid, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(t: Tables) -> DataFrame:
    """Facts from fenced and cut-off replies: a reply that doesn't parse is asked for again in halves."""
    e = t.events.select(F.col("user_id").cast("string").alias("scope"), F.floor(F.col("event_id") / 1000).cast("string").alias("batch_id"), F.concat(F.lit("e"), "event_id").alias("sid"), F.col("props").alias("text"), F.col("event_id").alias("position"))
    facts = un.facts(un.extract(e, Fenced()))
    return facts.select("scope", "batch_id", "fact_id", "fact", "sid", F.from_json("fact", "k bigint")["k"].alias("k"))


@query("""WITH x AS (SELECT lower(lang) AS name, doc_id, lang, source FROM documents)
    SELECT source AS scope, name, min_by(lang, doc_id) AS data, count(DISTINCT doc_id) AS n FROM x GROUP BY ALL""")
def entity_dedupe(t: Tables) -> DataFrame:
    found = t.documents.select(F.col("source").alias("scope"), F.lit("LANG").alias("type"), F.concat(F.lit(" "), F.col("lang")).alias("name"), F.col("doc_id").cast("string").alias("memory_id"), F.col("doc_id").alias("seq"))
    return me.dedupe_entities(found).select("scope", "name", "data", F.size("memory_ids").cast("long").alias("n"))


@query("""WITH l AS (SELECT label AS entity_id, vec_id FROM embeddings WHERE vec_id % 4 <> 0) SELECT CAST(entity_id AS VARCHAR) AS entity_id, count(*) AS n, string_agg(vec_id, ',' ORDER BY vec_id) AS linked FROM l GROUP BY entity_id""")
def entity_cleanup(t: Tables) -> DataFrame:
    index = t.embeddings.groupBy("label").agg(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")).alias("linked_memory_ids")).select(F.col("label").cast("string").alias("entity_id"), "linked_memory_ids")
    gone = t.embeddings.where("vec_id % 4 = 0").select(F.col("vec_id").cast("string").alias("id"))
    return me.unlink(index, gone).select("entity_id", F.size("linked_memory_ids").cast("long").alias("n"), F.array_join("linked_memory_ids", ",").alias("linked"))


@query("""WITH want AS (SELECT DISTINCT doc_id, 'src' || (doc_id % 20) AS scope FROM (SELECT doc_id * 3 AS doc_id FROM documents))
    SELECT want.doc_id, d.doc_id IS NOT NULL AS found FROM want LEFT JOIN documents d ON d.doc_id = want.doc_id AND d.source = want.scope""")
def scoped_multi_get(t: Tables) -> DataFrame:
    want = t.documents.select((F.col("doc_id") * 3).alias("n")).select(F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" ")).alias("id"), F.concat(F.lit("src"), (F.col("n") % 20).cast("string")).alias("scope"))
    memories = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("scope"), F.col("text").alias("data"))
    return me.materialize_scoped(want, memories).select(F.col("id").cast("long").alias("doc_id"), "found")


@query("""SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS from_spoken, epoch(o_orderdate)::BIGINT AS from_numbered, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders""")
def date_formats(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    spoken = F.concat(F.regexp_replace(F.date_format("d", "h:mm a"), "AM|PM", ""), F.lower(F.date_format("d", "a")), F.date_format("d", " 'on' d MMMM, yyyy"))
    numbered = F.date_format("d", "yyyy/MM/dd '('E')' HH:mm")
    return o.select("o_orderkey", F.unix_timestamp(da.spoken(spoken)).alias("from_spoken"), F.unix_timestamp(da.numbered(numbered)).alias("from_numbered"), da.iso_utc(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"))


@query("""WITH m AS (SELECT source AS user_id, doc_id % 3 AS r FROM documents) SELECT DISTINCT concat_ws('&', CASE WHEN r = 0 THEN 'agent_id=a' || r END, 'user_id=' || user_id) AS scope FROM m""")
def scope_keys(t: Tables) -> DataFrame:
    from engramix.schema import scope_column

    r = F.col("doc_id") % 3
    rows = t.documents.select(F.when(r == 0, F.concat(F.lit("a"), r.cast("string"))).otherwise("").alias("agent_id"), F.lit(None).cast("string").alias("run_id"), F.col("source").alias("user_id"))
    return rows.select(scope_column().alias("scope")).distinct()

"""The memory engine: adding, searching, changing and deleting memories of scopes, as operations on tables."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramix import schema as sc
from engramix.functions import classify as cl
from engramix.functions import numeric as nm
from engramix.functions import text as tx
from engramix.operators import graph as gr
from engramix.operators import retrieval as rt
from engramix.operators import units as un
from engramix.operators.filters import compile_filter
from engramix.providers import Embedder, Extractor, HashedEmbedder, OverlapReranker, Reranker, RuleExtractor, embed, entities, lemmas, logits
from engramix.storage import TableStore, materialize

#: What adding returns.
ADDED = f"id string, memory string, event string, entities array<{sc.ENTITY}>, speaker string, created_at string"


def nearest_entities(existing: DataFrame, new: DataFrame, least: float = 0.95, scoped: bool = False) -> DataFrame:
    """query_id, id, score, linked: the nearest existing entity of each new one, linked if it is near enough."""
    found = rt.vector_topk(existing, new, 1, scoped=scoped)
    return found.select("query_id", "id", "score", (F.col("score") >= least).alias("linked"))


def merge_entities(index: DataFrame, new: DataFrame, least: float = 0.95) -> DataFrame:
    """The entity index with new entities (entity_id, data, entity_type, scope, vector, memory_ids): appended to the nearest of their scope, or added."""
    probes = new.select(F.col("entity_id").alias("query_id"), "scope", "vector")
    known = nearest_entities(index.select(F.col("entity_id").alias("id"), "scope", "vector"), probes, least, scoped=True).where("linked")
    placed = new.join(known.select(F.col("query_id").alias("entity_id"), F.col("id").alias("target")), "entity_id", "left")
    gained = placed.where("target is not null").select(F.col("target").alias("entity_id"), F.explode("memory_ids").alias("m")).groupBy("entity_id").agg(F.array_sort(F.collect_set("m")).alias("more"))
    grown = index.join(gained, "entity_id", "left").withColumn("linked_memory_ids", F.array_distinct(F.concat("linked_memory_ids", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")
    added = placed.where("target is null").select("entity_id", "data", "entity_type", F.col("memory_ids").alias("linked_memory_ids"), "scope", "vector")
    return grown.select(*added.columns).unionByName(added)


def unlink(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The entity index without deleted memories (id); entities linked to nothing go."""
    links = index.select("entity_id", F.posexplode("linked_memory_ids").alias("n", "id")).join(gone.select("id"), "id", "left_anti")
    kept = links.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("linked_memory_ids"))
    return index.drop("linked_memory_ids").join(kept, "entity_id").select(*index.columns)


def dedupe_new(new: DataFrame, seen: DataFrame, across_scopes: bool = False) -> DataFrame:
    """Rows whose text (hash) isn't known and that are the first of their batch (seq) with it."""
    key = ["hash"] if across_scopes else ["scope", "hash"]
    w = Window.partitionBy(*key).orderBy("seq")
    return new.join(seen.select(*key).distinct(), key, "left_anti").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def dedupe_entities(found: DataFrame) -> DataFrame:
    """scope, name, data, entity_type, memory_ids of entities (scope, type, name, memory_id, seq): the first form counts."""
    keyed = found.withColumn("key", F.lower(F.trim("name"))).where("key <> ''")
    order = F.struct("seq", "name")
    return keyed.groupBy("scope", "key").agg(F.min_by(F.trim("name"), order).alias("data"), F.min_by("type", order).alias("entity_type"), F.array_sort(F.collect_set("memory_id")).alias("memory_ids")).withColumnRenamed("key", "name")


def fact_memories(facts: DataFrame, triples: DataFrame, units: DataFrame) -> DataFrame:
    """Facts as memories: each with its triples, sources and the time of its first unit. units: scope, id, raw_ids, created_at."""
    first = units.select("scope", F.col("id").alias("sid"), "created_at")
    told = triples.groupBy("scope", "batch_id", "sid", "fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "head", "relation", "tail"))), lambda x: F.struct(x["head"].alias("head"), x["relation"].alias("relation"), x["tail"].alias("tail"))).alias("triples"))
    rows = facts.join(first, ["scope", "sid"]).join(told, ["scope", "batch_id", "sid", "fact_id"], "left")
    raw = facts.select("scope", "batch_id", "fact_id", F.posexplode("source_sentence_ids").alias("p", "id")).join(units.select("scope", "id", "raw_ids"), ["scope", "id"], "left")
    raw = raw.groupBy("scope", "batch_id", "fact_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("raw_ids", F.array().cast("array<string>")).alias("raw_ids")))), lambda x: x["raw_ids"]))).alias("raw_ids"))
    digest = F.md5(F.concat(F.lit("graph_fact:"), F.array_join("source_sentence_ids", ","), F.lit(":"), F.col("fact_id"), F.lit(":"), F.col("fact")))
    out = rows.join(raw, ["scope", "batch_id", "fact_id"], "left")
    return out.select(F.concat(F.lit("fact-"), digest).alias("id"), "scope", F.col("fact").alias("data"), digest.alias("hash"), F.lit("edge_fact").alias("graph_object"), F.col("source_sentence_ids").alias("unit_ids"), F.coalesce("raw_ids", F.array().cast("array<string>")).alias("raw_ids"), F.coalesce(F.try_element_at("triples", F.lit(1))["relation"], F.lit("")).alias("edge_type"), "triples", "confidence", "created_at", F.col("created_at").alias("valid_at"), F.lit("").alias("invalid_at"), "sid", "fact_id", "batch_id")


def entity_memories(summaries: DataFrame) -> DataFrame:
    """Entity summaries as memories under ids that follow from scope and name. summaries: scope, name, display, summary."""
    return summaries.select(nm.uuid5(F.concat(F.lit("entity:"), F.col("scope"), F.lit(":"), F.col("name"))).alias("id"), "scope", F.concat(F.coalesce("display", "name"), F.lit(":\n"), F.col("summary")).alias("data"), F.lit("entity_node").alias("graph_object"))


def project(memories: DataFrame) -> DataFrame:
    """What a reader sees: the promoted fields, the core, and the rest as metadata."""
    return memories.select("id", F.col("data").alias("memory"), "hash", "created_at", "updated_at", "user_id", "agent_id", "run_id", "actor_id", "role", "speaker", "graph_object", "entities", "prev_id", "next_id", "metadata", "scope")


def materialize_scoped(ids: DataFrame, memories: DataFrame) -> DataFrame:
    """Payloads of many ids (id, scope) in one join: distinct, trimmed, within their scope."""
    wanted = ids.select(F.trim("id").alias("id"), "scope").where("id <> ''").distinct()
    return wanted.join(memories, ["id", "scope"], "left").withColumn("found", F.col("data").isNotNull())


def with_neighbours(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows with the ids before and after them in their batch."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("prev_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))


class MemoryEngine:
    """Memories, graph, entity index and history of all scopes below one folder.

    The work of a call is a few joins over the tables; batches of any size go through
    ``add_batch`` and ``search_batch``, of which ``add`` and ``search`` are the small case.
    """

    def __init__(self, spark: SparkSession, folder: str, options: sc.Options | None = None, embedder: Embedder | None = None, extractor: Extractor | None = None, reranker: Reranker | None = None):
        self.spark, self.options = spark, options or sc.Options()
        self.store = TableStore(spark, folder)
        self.embedder, self.extractor, self.reranker = embedder or HashedEmbedder(self.options.embedding_dims), extractor or RuleExtractor(), reranker or OverlapReranker()

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, {"memories": sc.MEMORIES, "nodes": sc.NODES, "node_links": sc.NODE_LINKS, "edges": sc.EDGES, "entity_index": sc.ENTITY_INDEX, "history": sc.HISTORY, "messages": sc.MESSAGES}[name])

    def add(self, messages, *, user_id=None, agent_id=None, run_id=None, infer: bool = True, memory_type: str | None = None, prompt: str | None = None, metadata: dict | None = None, default_timestamp: str | None = None) -> DataFrame:
        """Messages (text, a dict or a list of dicts) of one scope; returns id, memory, event of the new memories."""
        ids = sc.checked_scope(user_id=user_id, agent_id=agent_id, run_id=run_id)
        if memory_type not in (None, "procedural_memory"):
            raise ValueError("memory_type must be procedural_memory or None")
        listed = [{"role": "user", "content": messages}] if isinstance(messages, str) else [messages] if isinstance(messages, dict) else list(messages)
        if memory_type == "procedural_memory":
            listed, infer = [{"role": "system_summary", "content": (prompt + "\n" if prompt else "") + "\n".join(str(m.get("content") or "") for m in listed)}], False
        now = dt.datetime.fromisoformat(default_timestamp).replace(tzinfo=None) if default_timestamp else dt.datetime.now(dt.UTC).replace(tzinfo=None)
        rows = [(ids.get("user_id"), ids.get("agent_id"), ids.get("run_id"), m.get("name"), i, m.get("role") or "user", m["content"], dt.datetime.fromisoformat(m.get("timestamp") or m["created_at"]).replace(tzinfo=None) if m.get("timestamp") or m.get("created_at") else now) for i, m in enumerate(listed) if isinstance(m.get("content"), str) and m["content"].strip()]
        df = self.spark.createDataFrame(rows, "user_id string, agent_id string, run_id string, actor_id string, msg_seq bigint, role string, content string, ts timestamp")
        return self.add_batch(df, infer=infer, metadata=metadata)

    def add_batch(self, messages: DataFrame, infer: bool = True, metadata: dict | None = None, batch_key: str | None = None) -> DataFrame:
        """Messages of any number of scopes (user_id, agent_id, run_id, actor_id, msg_seq, role, content, ts).

        Ids are new with every call. A batch with a key (letters and digits) counts once: run again after a
        failure it replaces what it had written, and after a success it changes nothing and returns no rows.
        """
        key = batch_key or uuid.uuid4().hex
        with self.store.batch(key) if batch_key else contextlib.nullcontext(True) as new:
            return self._add(messages, infer, metadata, key) if new else self.spark.createDataFrame([], ADDED)

    def _add(self, messages: DataFrame, infer: bool, metadata: dict | None, key: str) -> DataFrame:
        o = self.options
        m = messages.withColumn("scope", sc.scope_column()).where("role <> 'system'")
        batch = F.md5(F.to_json(F.struct("scope", F.lit(key))))
        m = materialize(m.withColumn("batch_id", batch), "messages")
        if infer:
            sentences = un.segment(un.raw_sentences(m)) if o.segmentation_strategy == "nlp" else un.raw_sentences(m)
            rows = un.raw_units(sentences).select("scope", "batch_id", F.col("position").alias("seq"), "text", F.col("speaker").alias("role"), "ts", F.col("source_sentence_ids").alias("raw_ids"), F.col("source_texts").alias("raw_texts"), "confidence")
        else:
            rows = m.select("scope", "batch_id", F.col("msg_seq").cast("int").alias("seq"), F.col("content").alias("text"), "role", "ts", F.array().cast("array<string>").alias("raw_ids"), F.array().cast("array<string>").alias("raw_texts"), F.lit(1.0).alias("confidence"))
        who = m.groupBy("scope").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("user_id", "agent_id", "run_id", "actor_id")))
        rows = rows.withColumn("hash", F.md5("text"))
        known = self.table("memories")
        fresh = dedupe_new(rows, known.select("scope", "hash"), o.dedup_across_scopes) if o.use_dedup else rows
        fresh = fresh.withColumn("id", nm.content_id(F.col("scope"), F.col("text"), F.col("seq").cast("string"), F.col("batch_id")))
        fresh = with_neighbours(fresh, ["scope", "batch_id"], "seq")
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
        named = F.transform(entities(F.col("text")), lambda e: F.struct(e["name"].alias("name"), F.lit(0.6).alias("attention_weight"), e["type"].alias("entity_type")))
        extra = F.create_map(*(F.lit(str(x)) for kv in metadata.items() for x in kv)) if metadata else F.create_map().cast("map<string,string>")
        made = embed(fresh.join(who, "scope"), "text", self.embedder).select(
            "id", "scope", "user_id", "agent_id", "run_id", "actor_id", "role", F.col("text").alias("data"), "hash", lemmas(F.col("text")).alias("text_lemmatized"), stamp.alias("created_at"), stamp.alias("updated_at"), F.col("role").alias("speaker"),
            F.lit(None).cast("string").alias("graph_object"), named.cast(f"array<{sc.ENTITY}>").alias("entities"), F.col("raw_ids").alias("source_raw_sentence_ids"), F.col("raw_texts").alias("source_raw_texts"), "prev_id", "next_id", F.col("confidence").alias("unit_confidence"), "vector", extra.alias("metadata"),
        )
        made = materialize(made, "new-memories")
        units = fresh.select("scope", "batch_id", "seq", "id", "text", "ts", "raw_ids").join(made.select("id"), "id", "left_semi")
        if infer and o.relation_batch_size and o.use_bfs:
            made = self._index_graph(made, units, who)
        self.store.append("memories", made)
        if o.use_entity_store:
            self._index_entities(made.where("graph_object is null"))
        if o.use_history:
            self.store.append("history", made.select(F.col("id").alias("memory_id"), F.lit(None).cast("string").alias("old_memory"), F.col("data").alias("new_memory"), F.lit("ADD").alias("event"), "created_at", "updated_at", "actor_id", "role", F.lit(0).alias("is_deleted")))
        self.store.append("messages", m.select("scope", F.col("msg_seq").cast("bigint").alias("msg_seq"), "role", "content", "ts"))
        return made.where("graph_object is null").select("id", F.col("data").alias("memory"), F.lit("ADD").alias("event"), "entities", "speaker", "created_at")

    def _index_graph(self, made: DataFrame, units: DataFrame, who: DataFrame) -> DataFrame:
        """Facts, entity summaries, nodes, links and edges of new units; returns the memories with those of the graph."""
        replies = materialize(un.extract(units.select("scope", "batch_id", F.col("id").alias("sid"), "text", F.col("seq").alias("position")), self.extractor), "replies")
        facts = un.facts(replies)
        triples = materialize(un.triples(replies, facts), "triples")
        keyed = triples.withColumnRenamed("sid", "sentence_id").withColumnRenamed("n", "seq")
        nodes, links, edges = gr.build_graph(keyed)
        source = made.select("scope", F.col("id"), F.col("source_raw_sentence_ids").alias("raw_ids"), "created_at")
        fact_rows = materialize(fact_memories(facts, triples, source), "facts")
        ends = keyed.where("fact <> ''").select("scope", F.explode(F.array("head", "tail")).alias("display"), "fact", "seq")
        told = gr.summaries(ends.select("scope", gr.node_name(F.col("display")).alias("name"), "fact", "seq"))
        shown = ends.groupBy("scope", gr.node_name(F.col("display")).alias("name")).agg(F.min_by("display", F.struct("seq", "display")).alias("display"))
        summary_rows = entity_memories(told.join(shown, ["scope", "name"], "left"))
        texts = []
        if self.options.index_graph_facts:
            texts.append(fact_rows.select("id", "scope", "data", "graph_object", "created_at", F.col("unit_ids").alias("sources")))
        if self.options.index_entity_summaries:
            texts.append(summary_rows.withColumns({"created_at": F.lit(""), "sources": F.array().cast("array<string>")}).select("id", "scope", "data", "graph_object", "created_at", "sources"))
        for extra in texts:
            rows = embed(extra.join(who, "scope"), "data", self.embedder).withColumns({"hash": F.md5("data"), "text_lemmatized": lemmas(F.col("data")), "updated_at": F.col("created_at"), "role": F.lit("user"), "speaker": F.lit(""), "entities": F.array().cast(f"array<{sc.ENTITY}>"), "source_raw_sentence_ids": F.col("sources"), "source_raw_texts": F.array().cast("array<string>"), "prev_id": F.lit(None).cast("string"), "next_id": F.lit(None).cast("string"), "unit_confidence": F.lit(1.0), "metadata": F.create_map().cast("map<string,string>")})
            # A summary replaces that of the same entity.
            self._drop(rows.select("id"))
            made = made.unionByName(rows.select(*made.columns))
        old = self.table("nodes")
        both = old.select("scope", "name", "attention_weight_sum", "entity_type").unionByName(nodes.select("scope", "name", "attention_weight_sum", "entity_type")).groupBy("scope", "name").agg(F.sum("attention_weight_sum").alias("attention_weight_sum"), F.first("entity_type", ignorenulls=True).alias("entity_type"))
        facts_old = old.select("scope", "name", F.posexplode_outer("summary_facts").alias("p", "fact")).where("fact is not null").select("scope", "name", "fact", (F.col("p") - 1000).alias("seq"))
        facts_all = gr.summaries(facts_old.unionByName(ends.select("scope", gr.node_name(F.col("display")).alias("name"), "fact", F.col("seq"))))
        self.store.write("nodes", both.join(facts_all, ["scope", "name"], "left").select("name", "scope", "attention_weight_sum", "entity_type", "summary", "summary_facts"))
        self.store.append("node_links", links.select("name", "sentence_id", "scope"))
        by_fact = fact_rows.select("scope", "batch_id", "fact_id", F.col("sid").alias("sentence_id"), F.col("id").alias("fm"))
        full = keyed.join(by_fact, ["scope", "batch_id", "fact_id", "sentence_id"], "left")
        self.store.append("edges", full.select(gr.node_name(F.col("head")).alias("head"), gr.node_name(F.col("tail")).alias("tail"), F.col("relation").alias("type"), F.col("sentence_id").alias("source_id"), "scope", F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"), F.col("fact_id").alias("source_fact_id"), F.col("fact").alias("source_fact"), F.col("sentence_id").alias("source_unit_id"), F.col("fm").alias("source_fact_memory_id")))
        return materialize(made, "memories-and-graph")

    def _index_entities(self, made: DataFrame) -> None:
        found = made.select("scope", F.col("id").alias("memory_id"), F.posexplode("entities").alias("seq", "e")).select("scope", "memory_id", "seq", F.col("e.entity_type").alias("type"), F.col("e.name").alias("name"))
        new = embed(dedupe_entities(found), "data", self.embedder).withColumn("entity_id", nm.content_id(F.lit("entity"), F.col("scope"), F.col("name")))
        index = self.table("entity_index")
        self.store.write("entity_index", materialize(merge_entities(index, materialize(new, "new-entities"), self.options.entity_threshold), "entity-index"))

    def _drop(self, gone: DataFrame) -> None:
        known = self.table("memories")
        if self.store.versions("memories"):
            self.store.write("memories", materialize(known.join(gone.select("id"), "id", "left_anti").select(*known.columns), "memories"))

    def get(self, memory_id: str) -> DataFrame:
        return project(self.table("memories").where(F.col("id") == memory_id))

    def get_all(self, filters: dict, top_k: int = 100) -> DataFrame:
        sc.checked_search(None, top_k)
        sc.checked_scope(**{k: filters.get(k) for k in sc.SCOPE_IDS})
        return project(self.table("memories").where(self._condition(filters)).orderBy("created_at", "id").limit(top_k))

    @staticmethod
    def _condition(filters: dict) -> Column:
        core = {c.split()[0] for c in sc.MEMORIES.split(", ")}
        return compile_filter(filters, lambda k: F.col(k) if k in core else F.col("metadata")[k])

    def search(self, query: str, *, filters: dict, top_k: int = 20, threshold: float = 0.1, rerank: bool | None = None) -> DataFrame:
        """The best memories for a question, with rank, score, source and the plan of the question."""
        sc.checked_search(threshold, top_k)
        ids = sc.checked_scope(**{k: filters.get(k) for k in sc.SCOPE_IDS})
        row = self.spark.createDataFrame([("q", query, sc.scope_key(ids))], "query_id string, query string, scope string")
        return self.search_batch(row, top_k, threshold, filters, rerank)

    def search_batch(self, queries: DataFrame, top_k: int = 20, threshold: float = 0.1, filters: dict | None = None, rerank: bool | None = None) -> DataFrame:
        """Questions (query_id, query, scope) against the memories of their scopes."""
        o, k = self.options, top_k
        pool, deep = max(4 * k, 60), max(4 * max(4 * k, 60), 60)
        scopes = queries.select("scope").distinct()
        memories = self.table("memories").join(F.broadcast(scopes) if queries.count() <= rt.QUERY_BLOCK else scopes, "scope", "left_semi")
        rest = {key: v for key, v in (filters or {}).items() if key not in sc.SCOPE_IDS}
        memories = memories.where(self._condition(rest)) if rest else memories
        planned = queries.withColumn("found", entities(F.col("query"))).withColumn("plan", cl.query_plan(F.col("query"), F.col("found")))
        planned = materialize(embed(planned, "query", self.embedder), "questions")
        semantic = rt.vector_topk(memories, planned.select("query_id", "scope", "vector"), deep, scoped=True)
        keyed = memories.select("id", F.col("text_lemmatized").alias("text"))
        raw = rt.bm25_topk(keyed, planned.select("query_id", lemmas(F.col("query")).alias("text")), deep).withColumnRenamed("score", "bm25")
        terms = planned.select("query_id", F.size(tx.raw_tokens(lemmas(F.col("query")))).alias("terms"))
        mid, steep = nm.bm25_parameters(F.col("terms"))
        keyword = raw.join(terms, "query_id").select("query_id", "id", (1 / (1 + F.exp(-steep * (F.col("bm25") - mid)))).alias("bm25"))
        boosts = None
        if o.use_entity_boost and o.use_entity_store:
            named = embed(planned.select("query_id", F.posexplode("found").alias("position", "e")).select("query_id", "position", F.col("e.name").alias("name")), "name", self.embedder)
            index = self.table("entity_index").join(scopes, "scope", "left_semi")
            boosts = rt.entity_boosts(named, index.select("entity_id", "vector", F.col("linked_memory_ids").alias("linked")))
        validated = materialize(rt.fuse(semantic, keyword, boosts, threshold, pool, o.bm25_weight), "validated")
        wanted = planned.select("query_id", "scope", F.explode("found").alias("e")).select("query_id", "scope", F.col("e.name").alias("name"), F.lit(0.6).alias("weight"))
        parts = wanted.select("query_id", "scope", F.explode(F.split("name", " ")).alias("name"), F.lit(0.4).alias("weight"), F.col("name").alias("whole")).where("length(name) > 2 and name <> whole").drop("whole")
        merged = validated.select("query_id", "id", "score").withColumn("source", F.lit("vector+bm25"))
        if o.use_bfs and self.store.versions("edges"):
            merged = self._with_paths(planned, wanted.unionByName(parts), validated, memories, k, pool)
        shown = merged.join(memories.select("id", F.col("data").alias("memory"), "created_at", "entities", "prev_id", "next_id", "user_id", "agent_id", "run_id"), "id")
        shown = shown.join(planned.select("query_id", "query", "plan", F.transform("found", lambda e: F.lower(e["name"])).alias("query_entities")), "query_id").withColumn("time_constraints", F.col("plan.time_constraints"))
        if o.use_entity_match:
            shown = rt.entity_match_boost(shown.withColumn("held", F.col("entities")).withColumn("entities", F.transform("held", lambda e: F.lower(e["name"])))).withColumn("entities", F.col("held")).drop("held")
        shown = rt.adjust(shown)
        if o.use_rerank if rerank is None else rerank:
            shown = rt.rerank(rt.rerank_pool(shown, k).withColumn("logit", logits(self.reranker)(F.col("query"), F.col("memory")))).drop("logit")
        shown = materialize(shown, "candidates")
        if o.linear_rag_enabled and self.store.versions("edges"):
            shown = materialize(self._supplemented(shown, planned, memories, k), "supplemented")
        if o.use_context_window:
            more = rt.neighbours(shown.select("query_id", "id", "score"), memories)
            own = shown.drop("score")
            shown = more.join(own, ["query_id", "id"])
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ordered = shown.withColumn("tokens", tx.content_tokens(F.col("memory"))).withColumn("position", F.row_number().over(w))
        chosen = rt.diversify(ordered, k) if k else ordered.limit(0).select("query_id", "id", "score", F.lit(0).alias("rank"))
        return chosen.join(shown.drop("score", "query_entities", "time_constraints"), ["query_id", "id"]).orderBy("query_id", "rank")

    def _with_paths(self, planned: DataFrame, wanted: DataFrame, validated: DataFrame, memories: DataFrame, k: int, pool: int) -> DataFrame:
        o = self.options
        scopes = planned.select("scope").distinct()
        links, edges = (self.table(n).join(scopes, "scope", "left_semi") for n in ("node_links", "edges"))
        starts = gr.resolve_starts(self.table("nodes").select("scope", "name"), wanted).groupBy("query_id", "scope", "name").agg(F.max("weight").alias("weight"))
        # Each distinct text of a scope is embedded once and compared with that scope's questions.
        texts = edges.select("scope", gr.triple_text(F.col("head"), F.coalesce("type", F.lit("related")), F.col("tail")).alias("id")).distinct()
        told = embed(texts, "id", self.embedder).unionByName(memories.select("scope", "id", "vector").join(links.select(F.col("sentence_id").alias("id")).distinct(), "id", "left_semi").select("scope", "id", "vector"))
        told = rt.near_texts(gr.near_edges(links, edges, starts, o.max_hops), told)
        sims = told.join(planned.select("query_id", F.col("vector").alias("q")), "query_id").select("query_id", F.col("id").alias("text"), nm.cosine(F.col("vector"), F.col("q")).alias("sim"))
        paths = gr.path_search(links, edges, starts, materialize(sims, "sims"), o.max_hops, o.tolerance, o.path_threshold, min(300, max(10 * k, 100)))
        paths = materialize(gr.complete_paths(paths, memories), "paths")
        graph = paths.select("query_id", F.element_at("sentences", -1).alias("id"), "path_score", F.size("path").alias("path_len"), "position")
        merged = rt.merge_routes(graph, validated.select("query_id", "id", "score"), k)
        return rt.with_fallback(merged, validated.select("query_id", "id", "score"), min(k, pool))

    def _supplemented(self, shown: DataFrame, planned: DataFrame, memories: DataFrame, k: int) -> DataFrame:
        """Candidates of questions with weak results, joined by sentences of their seed entities' neighbours."""
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        seeds = rt.seed_entities(shown.withColumn("rank", F.row_number().over(w))).withColumnRenamed("entity", "name")
        starts = seeds.join(planned.select("query_id", "scope"), "query_id")
        near = gr.expand_entities(self.table("nodes"), self.table("edges"), starts).withColumnRenamed("name", "entity").join(planned.select("query_id", "scope"), "query_id")
        linked = near.join(self.table("node_links").withColumnRenamed("name", "entity"), ["scope", "entity"]).select("query_id", "entity", F.col("sentence_id").alias("id"))
        more = rt.supplement(shown.select("query_id", "id", "score"), linked, k, self.options.linear_rag_threshold)
        extra = more.join(shown.select("query_id", "id"), ["query_id", "id"], "left_anti").join(memories.select("id", F.col("data").alias("memory"), "created_at", "entities", "prev_id", "next_id", "user_id", "agent_id", "run_id"), "id")
        extra = extra.withColumn("source", F.lit("linear_rag")).join(planned.select("query_id", "query", "plan"), "query_id")
        return shown.unionByName(extra, allowMissingColumns=True)

    def update(self, memory_id: str, data: str, metadata: dict | None = None, now: str | None = None) -> DataFrame:
        """New text of a memory: its hash, words and vector follow; ids, role and creation stay; the change is recorded."""
        known = self.table("memories")
        old = materialize(known.where(F.col("id") == memory_id), "updated")
        row = old.first()
        if row is None:
            raise KeyError(memory_id)
        stamp = now or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S")
        changed = old.withColumns({"data": F.lit(data), "hash": F.md5(F.lit(data)), "text_lemmatized": lemmas(F.lit(data)), "updated_at": F.lit(stamp)})
        if metadata:
            changed = changed.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: ~k.isin(list(metadata))), F.create_map(*(F.lit(str(x)) for kv in metadata.items() for x in kv))))
        changed = embed(changed.drop("vector"), "data", self.embedder).select(*known.columns)
        self.store.write("memories", materialize(known.where(F.col("id") != memory_id).unionByName(changed), "memories"))
        self.store.append("history", changed.select(F.col("id").alias("memory_id"), F.lit(row["data"]).alias("old_memory"), F.col("data").alias("new_memory"), F.lit("UPDATE").alias("event"), "created_at", "updated_at", "actor_id", "role", F.lit(0).alias("is_deleted")))
        if self.options.use_entity_store and self.store.versions("entity_index"):
            self.store.write("entity_index", materialize(unlink(self.table("entity_index"), old.select("id")), "entity-index"))
            self._index_entities(changed.withColumn("entities", F.transform(entities(F.col("data")), lambda e: F.struct(e["name"].alias("name"), F.lit(0.6).alias("attention_weight"), e["type"].alias("entity_type")))))
        return project(changed)

    def delete(self, memory_id: str) -> int:
        return self._delete(F.col("id") == memory_id)

    def delete_all(self, *, user_id=None, agent_id=None, run_id=None) -> int:
        ids = sc.checked_scope(user_id=user_id, agent_id=agent_id, run_id=run_id)
        return self._delete(compile_filter(ids))

    def _delete(self, condition: Column) -> int:
        """Delete memories with their edges, links and entity entries; returns how many."""
        known = self.table("memories")
        gone = materialize(known.where(condition), "deleted")
        n = gone.count()
        if n:
            self.store.write("memories", materialize(known.join(gone.select("id"), "id", "left_anti").select(*known.columns), "memories"))
            self.store.append("history", gone.select(F.col("id").alias("memory_id"), F.col("data").alias("old_memory"), F.lit(None).cast("string").alias("new_memory"), F.lit("DELETE").alias("event"), "created_at", "updated_at", "actor_id", "role", F.lit(1).alias("is_deleted")))
            if self.store.versions("entity_index"):
                self.store.write("entity_index", materialize(unlink(self.table("entity_index"), gone), "entity-index"))
            if self.store.versions("edges"):
                links, edges = gr.delete_sentences(self.table("node_links"), self.table("edges"), gone)
                self.store.write("node_links", materialize(links, "links"))
                self.store.write("edges", materialize(edges, "edges"))
        return n

    def history(self, memory_id: str) -> DataFrame:
        return self.table("history").where(F.col("memory_id") == memory_id).orderBy("updated_at", "is_deleted")

    def last_messages(self, scope: dict[str, str], n: int = 10) -> DataFrame:
        return self.table("messages").where(F.col("scope") == sc.scope_key(scope)).orderBy(F.desc("ts"), F.desc("msg_seq")).limit(n).orderBy("ts", "msg_seq")

    def graph_stats(self) -> DataFrame:
        return gr.stats(self.table("nodes"), self.table("node_links"), self.table("edges"))

    def reset(self) -> None:
        self.store.reset()

    def chat(self, query: str) -> None:
        raise NotImplementedError("answers are left to the caller's model")

    def health(self) -> str:
        return json.dumps({"status": "ok", "memories": self.table("memories").count()})

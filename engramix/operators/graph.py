"""The property multigraph as tables: building, neighbours, weighted and path search.

nodes(name, scope, attention_weight_sum, entity_type, summary, summary_facts), links(name,
sentence_id, scope), edges(head, tail, type, source_id, scope, ...). Names are in lower
case. All steps join on (scope, name), so no result crosses a scope, and a search takes a
batch of starts: starts(query_id, scope, name, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.storage import materialize

#: Facts of an entity's summary.
SUMMARY_FACTS = 20


def node_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def sentence_entities(triples: DataFrame) -> DataFrame:
    """sentence_id, scope, name, attention_weight, entity_type, display: the strongest mention of each entity of a sentence.

    triples: scope, sentence_id, head, relation, tail, confidence, seq and optionally head_type, tail_type.
    """
    kind = lambda c: F.col(c) if c in triples.columns else F.lit(None).cast("string")
    weight = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.8))))
    ends = triples.select("scope", "sentence_id", "seq", weight.alias("w"), F.explode(F.array(F.struct(F.trim("head").alias("display"), kind("head_type").alias("t")), F.struct(F.trim("tail").alias("display"), kind("tail_type").alias("t")))).alias("e"))
    ends = ends.where("e.display <> ''").select("scope", "sentence_id", "seq", "w", "e.display", "e.t", node_name(F.col("e.display")).alias("name"))
    return ends.groupBy("scope", "sentence_id", "name").agg(F.max("w").alias("attention_weight"), F.min_by("t", F.when(F.col("t").isNotNull(), F.col("seq"))).alias("entity_type"), F.min_by("display", F.struct("seq", "display")).alias("display"), F.min("seq").alias("seq"))


def build_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, edges) of triples; an edge for every triple, never merged."""
    ents = sentence_entities(triples)
    nodes = ents.groupBy("scope", "name").agg(F.sum("attention_weight").alias("attention_weight_sum"), F.min_by("entity_type", F.when(F.coalesce("entity_type", F.lit("")) != "", F.col("seq"))).alias("entity_type"))
    links = ents.select("name", "sentence_id", "scope").distinct()
    head, tail = node_name(F.col("head")), node_name(F.col("tail"))
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.8))))
    edges = triples.where((head != "") & (tail != "")).select(head.alias("head"), tail.alias("tail"), F.trim("relation").alias("type"), F.col("sentence_id").alias("source_id"), "scope", confidence.alias("confidence"))
    return nodes, links, edges


def summaries(facts: DataFrame) -> DataFrame:
    """scope, name, summary, facts: the last distinct facts of each entity, in order. facts: scope, name, fact, seq."""
    once = facts.where(F.trim("fact") != "").groupBy("scope", "name", "fact").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("scope", "name").orderBy(F.desc("seq"), F.desc("fact"))
    last = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SUMMARY_FACTS)
    kept = last.groupBy("scope", "name").agg(F.array_sort(F.collect_list(F.struct("seq", "fact"))).alias("x"))
    facts_col = F.transform("x", lambda x: x["fact"])
    return kept.select("scope", "name", F.array_join(facts_col, "\n").alias("summary"), facts_col.alias("summary_facts"))


def undirected(edges: DataFrame) -> DataFrame:
    """scope, name, neighbour: both directions, each once, without loops."""
    both = edges.select("scope", F.col("head").alias("name"), F.col("tail").alias("neighbour")).unionByName(edges.select("scope", F.col("tail").alias("name"), F.col("head").alias("neighbour")))
    return both.where("name <> neighbour").distinct()


def neighbours(edges: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """query_id, start, name, hop: nodes reached in at most so many hops, the start excluded."""
    pairs = undirected(edges)
    frontier = starts.select("query_id", "scope", F.col("name").alias("start"), "name").distinct()
    seen = frontier.withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        step = frontier.join(pairs, ["scope", "name"]).select("query_id", "scope", "start", F.col("neighbour").alias("name")).distinct()
        frontier = step.join(seen.select("query_id", "scope", "start", "name"), ["query_id", "scope", "start", "name"], "left_anti")
        if hops > 1:
            frontier = materialize(frontier, "frontier")
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(h)))
    return seen.where("hop > 0").select("query_id", "scope", "start", "name", "hop")


def weighted_search(nodes: DataFrame, links: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 2, decay: float = 0.5, most: int = 30, compounding: bool = True) -> DataFrame:
    """query_id, sentence_id, score: sentences near the starts.

    Direct sentences keep the start's weight. A node at hop h weighs decay ** (1 + ... + h) of it
    (or decay ** h without ``compounding``), times aw / (aw + 1).
    """
    direct = starts.join(links, ["scope", "name"]).select("query_id", F.col("name").alias("start"), "sentence_id", F.col("weight").alias("score"))
    near = neighbours(edges, starts, hops).join(starts.select("query_id", "scope", F.col("name").alias("start"), "weight"), ["query_id", "scope", "start"])
    steps = F.col("hop") * (F.col("hop") + 1) / 2 if compounding else F.col("hop")
    aw = F.coalesce("attention_weight_sum", F.lit(0.0))
    boosted = near.join(nodes.select("scope", "name", "attention_weight_sum"), ["scope", "name"], "left").withColumn("score", F.col("weight") * F.pow(F.lit(decay), steps) * F.least(F.lit(1.0), aw / F.greatest(F.lit(1.0), aw + 1)))
    reached = boosted.join(links, ["scope", "name"]).select("query_id", "start", "sentence_id", "score").join(direct, ["query_id", "start", "sentence_id"], "left_anti")
    both = direct.unionByName(reached).groupBy("query_id", "sentence_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "sentence_id")
    return both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("query_id", "sentence_id", "score")


def resolve_starts(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Query entities as nodes: by name, or else by each of its words at 0.8 of the weight."""
    known = nodes.select("scope", "name")
    keyed = wanted.withColumn("name", node_name(F.col("name")))
    exact = keyed.join(known, ["scope", "name"], "left_semi")
    rest = keyed.join(known, ["scope", "name"], "left_anti")
    words = rest.select("query_id", "scope", (F.col("weight") * 0.8).alias("weight"), F.explode(F.split("name", " +")).alias("name")).join(known, ["scope", "name"], "left_semi")
    return exact.select("query_id", "scope", "name", "weight").unionByName(words.select("query_id", "scope", "name", "weight"))


def triple_text(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws(" ", head, relation, tail)


def near_edges(links: DataFrame, edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """query_id, scope, text: the texts that a path search of so many hops can ask for.

    The sentences of the starts, and the triples of all edges that touch a node fewer than ``hops`` steps away.
    """
    begun = starts.select("query_id", "scope", "name").distinct()
    ends = undirected(edges)
    reached = materialize(begun, "reached")
    front = reached
    for _ in range(hops - 1):
        step = front.join(ends, ["scope", "name"]).select("query_id", "scope", F.col("neighbour").alias("name")).distinct()
        front = materialize(step.join(reached, ["query_id", "scope", "name"], "left_anti"), "reached-step")
        reached = materialize(reached.unionByName(front), "reached")
    text = triple_text(F.col("head"), F.coalesce("type", F.lit("related")), F.col("tail")).alias("text")
    told = edges.select("scope", F.col("head").alias("name"), text).unionByName(edges.select("scope", F.col("tail").alias("name"), text))
    of_edges = reached.join(told.distinct(), ["scope", "name"]).select("query_id", "scope", "text")
    of_links = begun.join(links, ["scope", "name"]).select("query_id", "scope", F.col("sentence_id").alias("text"))
    return of_edges.unionByName(of_links).distinct()


def path_search(links: DataFrame, edges: DataFrame, starts: DataFrame, sims: DataFrame, hops: int = 3, tolerance: int = 2, threshold: float = 0.3, most: int = 300) -> DataFrame:
    """query_id, start, path, sentences, path_score, triples: paths whose triples resemble the query.

    sims: query_id, text (a sentence id or the text of a triple), sim; each distinct text is
    compared once. A node is visited once for each start, by the first parent in the order of the
    frontier, then by name, whether or not it is kept. A hop is dropped after more than
    ``tolerance`` low steps in a row. edges may have fact_id, which stands for the sentence.
    """
    source = F.coalesce("source_fact_memory_id", "source_id") if "source_fact_memory_id" in edges.columns else F.col("source_id")
    e = edges.select("scope", "head", "tail", F.coalesce("type", F.lit("related")).alias("type"), source.alias("sid")).where("sid is not null and head <> tail")
    e = e.withColumn("text", triple_text(F.col("head"), F.col("type"), F.col("tail")))
    both = e.select("scope", F.col("head").alias("node"), F.col("tail").alias("next"), "head", "type", "tail", "sid", "text").unionByName(e.select("scope", F.col("tail").alias("node"), F.col("head").alias("next"), "head", "type", "tail", "sid", "text"))
    pairs = undirected(edges).select("scope", F.col("name").alias("node"), F.col("neighbour").alias("next"))
    key = ["query_id", "scope", "start"]
    first = starts.select("query_id", "scope", F.col("name").alias("start"), "weight").distinct()
    hop0 = first.join(links.withColumnRenamed("name", "start"), ["scope", "start"]).join(sims.withColumnRenamed("text", "sentence_id"), ["query_id", "sentence_id"]).where(F.col("sim") >= threshold)
    none = F.array().cast("array<struct<head:string,type:string,tail:string>>")
    found = hop0.select("query_id", "start", F.array("start").alias("path"), F.array("sentence_id").alias("sentences"), (F.col("weight") * F.col("sim")).alias("path_score"), none.alias("triples"), F.lit(0).alias("hop"))
    frontier = first.select(*key, F.col("start").alias("node"), F.array("start").alias("path"), F.array().cast("array<string>").alias("sids"), F.lit(0).alias("tol"), F.array().cast("array<double>").alias("steps"), F.lit(1).alias("pos"))
    visited = first.select(*key, F.col("start").alias("node"))
    for h in range(1, hops + 1):
        step = frontier.join(pairs, ["scope", "node"]).join(visited.select(*key, F.col("node").alias("next")), [*key, "next"], "left_anti")
        parent = Window.partitionBy(*key, "next").orderBy("pos")
        step = materialize(step.withColumn("n", F.row_number().over(parent)).where("n = 1").drop("n"), "path-step")
        visited = materialize(visited.unionByName(step.select(*key, F.col("next").alias("node"))), "path-visited")
        rows = step.join(both, ["scope", "node", "next"]).join(sims, ["query_id", "text"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
        best = rows.groupBy(*key, "next", "sid").agg(F.max("sim").alias("sim"))
        w = Window.partitionBy(*key, "next").orderBy(F.desc("sim"), "sid")
        chosen = best.withColumn("n", F.row_number().over(w)).where(((F.col("sim") >= threshold) | (F.col("n") == 1)) & (F.col("n") <= 5))
        picked = chosen.groupBy(*key, "next").agg(F.max("sim").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("n", "sid"))), lambda x: x["sid"]).alias("picked"))
        told = rows.groupBy(*key, "next").agg(F.array_sort(F.collect_set(F.struct("head", "type", "tail"))).alias("triples"))
        kept = step.join(picked, [*key, "next"]).join(told, [*key, "next"])
        kept = kept.withColumn("tol", F.when(F.col("best") < threshold, F.col("tol") + 1).otherwise(0)).where(F.col("tol") <= tolerance)
        order = Window.partitionBy(*key).orderBy("pos", "next")
        kept = kept.withColumn("new", F.row_number().over(order))
        frontier = materialize(
            kept.select(*key, F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("sids", "picked").alias("sids"), "tol", F.concat("steps", F.array("best")).alias("steps"), F.col("new").alias("pos"), "triples"),
            "path-frontier",
        )
        found = found.unionByName(frontier.select("query_id", "start", "path", F.col("sids").alias("sentences"), F.array_max("steps").alias("path_score"), "triples", F.lit(h).alias("hop")))
        frontier = frontier.drop("triples")
    w = Window.partitionBy("query_id").orderBy(F.desc("path_score"), F.size("path"), F.array_join("path", "\x1f"), F.array_join("sentences", "\x1f"))
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def complete_paths(paths: DataFrame, payloads: DataFrame) -> DataFrame:
    """Paths all of whose sentences are among the payloads (id)."""
    rows = paths.select("query_id", "position", F.explode("sentences").alias("id"))
    known = payloads.select("id").distinct().withColumn("found", F.lit(True))
    whole = rows.join(known, "id", "left").groupBy("query_id", "position").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("whole")).where("whole")
    return paths.join(whole.select("query_id", "position"), ["query_id", "position"], "left_semi")


def expand_entities(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 1, least: float = 0.3) -> DataFrame:
    """query_id, name: neighbours of a query's seeds with a weight, without the seeds."""
    near = neighbours(edges, starts, hops).join(nodes.where(F.col("attention_weight_sum") >= least).select("scope", "name"), ["scope", "name"], "left_semi")
    return near.select("query_id", "name").distinct().join(starts.select("query_id", "name"), ["query_id", "name"], "left_anti")


def core_entities(nodes: DataFrame, least: float = 0.5, most: int = 100) -> DataFrame:
    return nodes.where(F.col("attention_weight_sum") >= least).orderBy(F.desc("attention_weight_sum"), "scope", "name").limit(most)


def relations(edges: DataFrame, name: str) -> DataFrame:
    """Edges out of and into a node, with their direction."""
    name = name.strip().lower()
    out = edges.where(F.col("head") == name).select(F.lit("out").alias("direction"), "type", F.col("tail").alias("other"), "source_id", "scope")
    return out.unionByName(edges.where(F.col("tail") == name).select(F.lit("in").alias("direction"), "type", F.col("head").alias("other"), "source_id", "scope"))


def relation_sentences(edges: DataFrame, head: str, relation: str, tail: str) -> DataFrame:
    """All sentences that state a relation; names in any case."""
    return edges.where((F.col("head") == head.strip().lower()) & (F.col("tail") == tail.strip().lower()) & (F.col("type") == relation.strip())).select("source_id").distinct()


def sentence_triples(edges: DataFrame, sentence: str) -> DataFrame:
    return edges.where(F.col("source_id") == sentence).select("head", "type", "tail")


def stats(nodes: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, indexed sentences, pairs with several edges, sentences of edges."""
    pairs = edges.groupBy("scope", "head", "tail").agg(F.count("*").alias("n"))
    multi = pairs.agg(F.sum("n").cast("long").alias("edges"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("multi_edge_pairs"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(multi).crossJoin(links.agg(F.countDistinct("sentence_id").alias("indexed_sentences"))).crossJoin(edges.agg(F.countDistinct("source_id").alias("edge_sentences")))  # single rows


def delete_sentences(links: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, edges) without those of deleted sentences (id)."""
    ids = gone.select(F.col("id").alias("sentence_id"))
    return links.join(ids, "sentence_id", "left_anti").select(*links.columns), edges.join(ids.withColumnRenamed("sentence_id", "source_id"), "source_id", "left_anti").select(*edges.columns)

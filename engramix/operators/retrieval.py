"""Hybrid retrieval for a batch of queries: vectors, BM25, entities, fusion, routes, reranking, diversity, context.

A batch of queries is a DataFrame with ``query_id``; every step is a join or a window
keyed by it. Query sets are small beside the memories; they are broadcast only where
Spark finds them small enough, and exact vector search goes through the memories in
Arrow batches against blocks of queries of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import numeric as nm
from engramix.functions import text as tx
from engramix.storage import materialize, release, small_batches

_WORDS = re.compile("[a-z0-9]+").findall
#: Queries that meet the memories in one pass; larger sets are cut in blocks.
QUERY_BLOCK = 4096
#: The same for keyword search, where a block also has a column of weights for each query; blocks of one pass.
TERM_BLOCK, TERM_BLOCKS = 256, 16
#: Scores that a task computes at a time, and rows that it passes on at a time.
SCORES, EMITTED = 1 << 20, 1 << 15
#: Parts in which the memories of one set of entities meet its boosts.
LINK_PARTS = 64


def ranked(df: DataFrame, k: int | Column, key: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query with their rank; ties by id. Partial limits are pushed below the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best of each query among what a task has seen; scores alike to nine places go by id."""

    def __init__(self, k: int, queries: int):
        self.k, self.least = k, np.full(queries, -0.5)
        self.held = pd.DataFrame({"q": np.zeros(0, np.int64), "id": [], "score": np.zeros(0)})
        self.new: list[pd.DataFrame] = []
        self.waiting = 0

    def add(self, score: np.ndarray, ids: list) -> None:
        """Scores (memories x queries); below 0: not to be taken."""
        least = self.least
        if len(score) > self.k > 0:
            least = np.maximum(least, np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k] - 1e-8)
        i, q = np.nonzero((score >= least[None, :]) & (score >= 0))
        if len(i):
            self.new.append(pd.DataFrame({"q": q, "id": [ids[x] for x in i.tolist()], "score": score[i, q]}))
            self.waiting += len(i)
        if self.waiting > max(4 * self.k * len(self.least), SCORES // 4):
            self.settle()

    def settle(self) -> None:
        if self.new:
            every = pd.concat([x for x in (self.held, *self.new) if len(x)])
            every["near"] = every["score"].round(9)
            self.held = every.sort_values(["q", "near", "id"], ascending=[True, False, True]).groupby("q").head(self.k).drop(columns="near")
            full = self.held.groupby("q")["score"].agg(["size", "min"])
            full = full[full["size"] >= self.k]
            self.least[full.index] = full["min"] - 1e-8
        self.new, self.waiting = [], 0

    def frames(self, names: list) -> Iterator[pd.DataFrame]:
        self.settle()
        for first in range(0, len(self.held), 10_000):
            part = self.held.iloc[first : first + 10_000]
            yield pd.DataFrame({"query_id": [names[q] for q in part["q"]], "id": part["id"].tolist(), "score": part["score"].to_numpy()})


def vector_topk(memories: DataFrame, queries: DataFrame, k: int, scoped: bool = False, exclude_self: bool = False) -> DataFrame:
    """query_id, id, score, rank: exact cosine of memories (id, scope, vector) and queries (query_id, scope, vector).

    A task keeps the k best of each query over all its memories and passes them on at its
    end, so what moves is k rows for each query and task. Scores are computed for as many
    memories at a time as fit a matrix of bounded size.
    """
    spark = memories.sparkSession
    id_kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((memories, "id"), (queries, "query_id")))
    numbered = queries.count()
    blocks = -(-numbered // QUERY_BLOCK)
    found = None
    for b in range(max(1, blocks)):
        part = queries if blocks <= 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        held = part.select("query_id", "scope", "vector").toPandas()  # one block of the query set
        matrix = np.stack(held["vector"].map(np.asarray)).astype(np.float64) if len(held) else np.zeros((0, 1))
        norm = np.sqrt((matrix**2).sum(axis=1))
        shared = spark.sparkContext.broadcast((held["query_id"].tolist(), held["scope"].tolist(), matrix, norm))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, scopes, q, qn = shared.value
            top = Best(k, len(ids))
            code = {x: i for i, x in enumerate(dict.fromkeys(scopes))}
            wanted = np.array([code[x] for x in scopes], np.int64)
            step = max(1, SCORES // max(1, len(ids)))
            for batch in batches:
                for first in range(0, len(batch) if len(ids) else 0, step):
                    some = batch.iloc[first : first + step]
                    m = np.stack(some["vector"].map(np.asarray)).astype(np.float64)
                    score = np.clip(m @ q.T / (np.sqrt((m**2).sum(axis=1))[:, None] * qn[None, :] + 1e-8), 0, 1)
                    if scoped:
                        score[np.array([code.get(x, -1) for x in some["scope"]], np.int64)[:, None] != wanted[None, :]] = -1
                    own = some["id"].tolist()
                    if exclude_self:
                        place = {x: i for i, x in enumerate(own)}
                        for j, x in enumerate(ids):
                            if x in place:
                                score[place[x], j] = -1
                    top.add(score, own)
            yield from top.frames(ids)

        out = memories.select("id", "scope", "vector").where("vector is not null").mapInPandas(best, f"query_id {query_kind}, id {id_kind}, score double")
        found = out if found is None else found.unionByName(out)
    return ranked(found, k)


def postings(memories: DataFrame, text: str = "text") -> DataFrame:
    """id, term, tf, length of every memory: the keyword index."""
    terms = memories.select("id", tx.raw_tokens(F.col(text)).alias("terms"))
    length = F.size("terms").cast("long")
    return terms.select("id", length.alias("length"), F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(memories: DataFrame, queries: DataFrame, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, bm25: Okapi sums over the distinct query terms.

    All scores of a memory come from its own matched terms, so they leave the task that
    holds it as they are. Only ids that several memories have meet again, to be one.
    """
    wanted = queries.select("query_id", _terms("text")).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("wanted"))
    return _keyword(memories, wanted, None, text, k1, b).withColumnRenamed("score", "bm25")


def bm25_topk(memories: DataFrame, queries: DataFrame, k: int, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score, rank: the k best of ``bm25`` for each query.

    One pass splits the texts and keeps the terms that the queries have; document
    frequencies and scores come from what it wrote. Scores are products of term and query
    matrices of bounded size, and a task passes on its own k best, so common terms don't
    multiply postings by queries.
    """
    found = _keyword(memories, queries.select("query_id", _terms("text")), k, text, k1, b)
    return ranked(found.withColumn("score", F.round("score", 6)), k)


def _terms(text: str) -> Column:
    return F.array_distinct(tx.raw_tokens(F.coalesce(F.col(text), F.lit("")))).alias("wanted")


def _merged(held: DataFrame, repeated: DataFrame) -> DataFrame:
    """Matched terms of the repeated ids: memories of one id and one length are one."""
    again = held.alias("h").join(repeated.alias("r"), F.col("h.id").eqNullSafe(F.col("r.id")), "left_semi")
    each = again.select("id", "length", F.explode(F.arrays_zip("places", "counts")).alias("z")).groupBy("id", "length", "z.places").agg(F.sum("z.counts").cast("int").alias("counts"))
    terms = each.groupBy("id", "length").agg(F.array_sort(F.collect_list(F.struct("places", "counts"))).alias("z"))
    return terms.select("id", "length", F.col("z.places").alias("places"), F.col("z.counts").alias("counts"))


def _keyword(memories: DataFrame, wanted: DataFrame, k: int | None, text: str, k1: float, b: float) -> DataFrame:
    """query_id, id, score: the k best of each task, or without k all above 0, for queries (query_id, wanted terms)."""
    spark = memories.sparkSession
    small_batches(spark)
    id_kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((memories, "id"), (wanted, "query_id")))
    blocks = max(1, -(-wanted.count() // (TERM_BLOCK * TERM_BLOCKS)))
    found = None
    for block in range(blocks):
        part = wanted if blocks <= 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.collect()  # a block of the query set
        vocabulary = sorted({t for r in rows for t in r["wanted"]})
        number = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # of a block of the query set

        def matched(batches: Iterator[pd.DataFrame], number=number) -> Iterator[pd.DataFrame]:
            known = number.value.get
            for batch in batches:
                lengths, places, counts = [], [], []
                for text_ in batch["text"]:
                    words = _WORDS(text_.lower()) if text_ is not None else []
                    lengths.append(len(words) if text_ is not None else None)
                    at, tf = np.unique(np.array([x for x in map(known, words) if x is not None], np.int32), return_counts=True)
                    places.append(at), counts.append(tf.astype(np.int32))
                yield pd.DataFrame({"id": batch["id"], "length": pd.array(lengths, "Int64"), "places": places, "counts": counts})
            release()

        # The texts are split once: frequencies, lengths and scores all come from the terms that the queries have.
        held = materialize(memories.select("id", F.col(text).alias("text")).mapInPandas(matched, f"id {id_kind}, length bigint, places array<int>, counts array<int>"), "matched-terms")
        n, mean = held.agg(F.count("*"), F.avg("length")).first()
        repeated = None
        if k is None:
            ids = materialize(held.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
            if not ids.isEmpty():
                repeated = materialize(_merged(held, ids), "repeated-terms")
                held = held.alias("h").join(ids.alias("r"), F.col("h.id").eqNullSafe(F.col("r.id")), "left_anti")
        df = np.zeros(len(vocabulary))
        every = held if repeated is None else held.unionByName(repeated)
        for r in every.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df")).collect():  # a row for each term of the block
            df[r["place"]] = r["df"]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        groups = []
        place_of = {t: i for i, t in enumerate(vocabulary)}
        for first in range(0, len(rows), TERM_BLOCK):
            some = rows[first : first + TERM_BLOCK]
            own = sorted({place_of[t] for r in some for t in r["wanted"] if df[place_of[t]]})
            local = {p: i for i, p in enumerate(own)}
            weights = np.zeros((len(own), len(some)))
            for j, r in enumerate(some):
                for t in r["wanted"]:
                    if (p := place_of[t]) in local:
                        weights[local[p], j] = idf[p]
            groups.append(([r["query_id"] for r in some], np.array(own, np.int64), weights))
        shared = spark.sparkContext.broadcast((groups, float(mean or 0)))

        def scores(batch: pd.DataFrame, own: np.ndarray, w: np.ndarray, average: float) -> Iterator[tuple[np.ndarray, pd.Series]]:
            """Scores (memories x queries) and ids of as many memories at a time as fit."""
            step = max(1, SCORES // max(1, *w.shape))
            for first in range(0, len(batch) if len(own) else 0, step):
                some = batch.iloc[first : first + step]
                sizes = np.array([len(p) for p in some["places"]])
                flat = np.concatenate(list(some["places"])).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                ok = own[at] == flat
                tf = np.zeros((len(some), len(own)))
                tf[np.repeat(np.arange(len(some)), sizes)[ok], at[ok]] = np.concatenate(list(some["counts"]))[ok] if sizes.sum() else 0
                length = some["length"].to_numpy(float, na_value=np.nan)
                under = tf + (k1 * (1 - b + b * length / average))[:, None]
                under += 1e-300
                tf *= k1 + 1
                tf /= under
                yield tf @ w, some["id"]

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            groups, average = shared.value
            tops = [Best(k, len(names)) for names, _, _ in groups]
            for batch in batches:
                for (_, own, w), top in zip(groups, tops, strict=True):
                    for score, ids in scores(batch, own, w, average):
                        top.add(np.where(score > 0, np.round(score, 6), -1), ids.tolist())
            for (names, _, _), top in zip(groups, tops, strict=True):
                yield from top.frames(names)
            release()

        def whole(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            groups, average = shared.value
            for batch in batches:
                for names, own, w in groups:
                    own_names = pd.Series(names)
                    for score, ids in scores(batch, own, w, average):
                        q, i = np.nonzero(score.T > 0)
                        for first in range(0, len(i), EMITTED):
                            at, of = i[first : first + EMITTED], q[first : first + EMITTED]
                            yield pd.DataFrame({"query_id": own_names.take(of).array, "id": ids.take(at).array, "score": score[at, of]})
            release()

        form = f"query_id {query_kind}, id {id_kind}, score double"
        scored = held.mapInPandas(whole if k is None else best, form)
        if repeated is not None:
            scored = scored.unionByName(repeated.mapInPandas(whole, form).groupBy("query_id", "id").agg(F.sum("score").alias("score")))
        found = scored if found is None else found.unionByName(scored)
    return found


def near_texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, id, vector of the texts (scope, id, vector) that a question's search can ask for (query_id, scope, text)."""
    return wanted.withColumnRenamed("text", "id").join(texts, ["scope", "id"]).select("query_id", "id", "vector")


def entity_boosts(query_entities: DataFrame, entities: DataFrame, weight: float = 0.5, least: float = 0.5, most_entities: int = 8, most_matches: int = 500) -> DataFrame:
    """query_id, id, boost: the best attenuated similarity over the entities that a memory is linked to.

    query_entities: query_id, position, vector; entities: entity_id, vector, linked (ids).
    Memories with the same entities have the same boosts, so the best is taken once for a set
    of entities; each set then meets its memories in parts, row by row.
    """
    chosen = query_entities.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("n") <= most_entities)
    keyed = chosen.select("query_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("n").cast("string")).alias("probe"), "vector")
    met = vector_topk(entities.select(F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("scope"), "vector"), keyed.select(F.col("probe").alias("query_id"), F.lit(None).cast("string").alias("scope"), "vector"), most_matches)
    met = met.where(F.col("score") >= least).join(keyed.select("query_id", F.col("probe")).withColumnRenamed("query_id", "q"), F.col("query_id") == F.col("probe"))
    met = met.select(F.col("q").alias("query_id"), F.col("id").alias("entity_id"), "score")
    links = entities.select("entity_id", F.explode("linked").alias("id"))
    sets = materialize(links.groupBy("id").agg(F.array_sort(F.collect_set("entity_id")).alias("set")), "linked-sets")
    spread = entities.select("entity_id", nm.spread(F.size("linked")).alias("spread"))
    each = sets.select("set").distinct().select("set", F.explode("set").alias("entity_id"))
    best = each.join(met, "entity_id").join(spread, "entity_id").groupBy("set", "query_id").agg(F.max(F.col("score") * weight * F.col("spread")).alias("boost"))
    parts = best.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(LINK_PARTS - 1))))
    return sets.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(LINK_PARTS)).cast("int")).join(parts, ["set", "part"]).select("query_id", "id", "boost")


def fuse(semantic: DataFrame, keyword: DataFrame | None = None, boosts: DataFrame | None = None, threshold: float = 0.1, k: int = 20, bm25_weight: float = 1.0) -> DataFrame:
    """Candidates of the semantic side with their keyword and entity scores, fused and ranked.

    keyword: query_id, id, bm25 (normalised); boosts: query_id, id, boost.
    """
    df = semantic.select("query_id", "id", F.col("score").alias("semantic"))
    df = df.join(keyword.select("query_id", "id", "bm25"), ["query_id", "id"], "left") if keyword is not None else df.withColumn("bm25", F.lit(0.0))
    df = df.join(boosts.select("query_id", "id", "boost"), ["query_id", "id"], "left") if boosts is not None else df.withColumn("boost", F.lit(0.0))
    df = df.withColumn("bm25", F.coalesce(F.col("bm25") * bm25_weight, F.lit(0.0))).withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    scored = df.where(F.col("semantic") >= threshold).withColumn("score", nm.fused(F.col("semantic"), F.col("bm25"), F.lit(0.0), F.col("boost")))
    return ranked(scored, k)


def merge_routes(graph: DataFrame, validated: DataFrame, limit: int) -> DataFrame:
    """Graph candidates and validated candidates of each query as one list.

    graph: query_id, id, path_score, path_len, position; validated: query_id, id, score.
    Backed rows get v + 0.12 g, graph-only rows 0.25 g and only the first of them stay.
    """
    g = graph.withColumn("graph_score", F.least(F.lit(1.0), F.col("path_score") + 0.03 * F.greatest(F.lit(0), F.col("path_len") - 1)))
    best = Window.partitionBy("query_id", "id").orderBy(F.desc("graph_score"), "position")
    g = g.withColumn("first_position", F.min("position").over(Window.partitionBy("query_id", "id"))).withColumn("n", F.row_number().over(best)).where("n = 1")
    v = validated.select("query_id", "id", F.col("score").alias("validated"))
    both = g.select("query_id", "id", "graph_score", F.col("path_len").cast("int").alias("path_len"), "first_position").join(v, ["query_id", "id"], "full_outer")
    backed, graphed = F.col("validated").isNotNull(), F.col("graph_score").isNotNull()
    score = F.when(backed & graphed, F.greatest(F.col("validated"), F.col("validated") + 0.12 * F.col("graph_score"))).when(backed, F.col("validated")).otherwise(0.25 * F.col("graph_score"))
    source = F.when(backed & graphed, "vector+bm25+graph_bfs").when(backed, "vector+bm25").otherwise("graph_bfs")
    both = both.withColumn("score", score).withColumn("source", source).withColumn("alone", ~backed)
    order = Window.partitionBy("query_id", "alone").orderBy("first_position", "id")
    both = both.withColumn("n", F.row_number().over(order)).where(~F.col("alone") | (F.col("n") <= max(2, limit // 5)))
    return both.select("query_id", "id", "score", "source", "graph_score", "validated", "path_len")


def with_fallback(merged: DataFrame, pool: DataFrame, limit: int) -> DataFrame:
    """Fill each query up to the limit with the best rows of the pool that it lacks, at 0.55 of their score."""
    have = merged.groupBy("query_id").agg(F.count("*").alias("have"))
    rest = pool.select("query_id", "id", "score").join(merged.select("query_id", "id"), ["query_id", "id"], "left_anti").join(have, "query_id", "left")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    fill = rest.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit - F.coalesce("have", F.lit(0)))
    return merged.select("query_id", "id", "score", "source").unionByName(fill.select("query_id", "id", (F.col("score") * 0.55).alias("score"), F.lit("fallback").alias("source")))


def adjust(df: DataFrame) -> DataFrame:
    """Scores of (query, memory, created_at, time_constraints, score) by evidence, length and time.

    Where the words are there already (query_tokens, memory_tokens), the texts aren't split again.
    """
    from engramix.functions.classify import time_match

    given = {"query_tokens", "memory_tokens"} <= set(df.columns)
    if not given:
        df = df.withColumns({"query_tokens": tx.content_tokens(F.col("query")), "memory_tokens": tx.content_tokens(F.col("memory"))})
    cover = tx.coverage(F.col("query_tokens"), F.col("memory_tokens"))
    dated = tx.has_date_word(F.col("memory")) | tx.has_date_word(F.coalesce("created_at", F.lit("")))
    cue = F.when(tx.is_temporal(F.col("query")) & dated, 1.0).otherwise(0.0)
    evidence = tx.evidence_score(cover, cue)
    timely = F.when(F.size("time_constraints") == 0, 0.0).when(time_match(F.col("time_constraints"), F.col("memory"), F.col("created_at")), 0.08).otherwise(-0.30)
    s = F.col("score")
    adjusted = F.greatest(F.lit(0.0), s + 0.10 * s * evidence - s * tx.length_penalty(F.col("memory")) + s * timely)
    out = df.withColumns({"query_coverage": cover, "temporal_cue": cue, "evidence_score": evidence, "score": adjusted})
    return out if given else out.drop("query_tokens", "memory_tokens")


def rerank(df: DataFrame, logit: str = "logit") -> DataFrame:
    """Blend scores with a cross-encoder's logit; the share depends on the routes of a row."""
    own = F.when(F.col("source") == "graph_bfs", 0.75).when(F.col("source").contains("vector+bm25"), 0.45).otherwise(0.55)
    return df.withColumn("score", own * F.col("score") + (1 - own) * nm.sigmoid(F.col(logit)))


def rerank_pool(df: DataFrame, limit: int) -> DataFrame:
    """Rows that are reranked: validated ones first, max(3 * limit, 60) for each query."""
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("source").contains("vector"), 0).otherwise(1), F.desc("score"), "id")
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(3 * limit, 60)).drop("n")


def entity_match_boost(df: DataFrame) -> DataFrame:
    """Scores times 1 + 0.1 of the share of query entities that a memory names (both lower-case arrays)."""
    share = F.size(F.array_intersect("query_entities", "entities")) / F.greatest(F.lit(1), F.size("query_entities"))
    return df.withColumn("score", F.col("score") * (1 + 0.1 * share))


def weighted_entity_boost(query_entities: Column, entities: Column, base: float = 0.1) -> Column:
    """Sum of base * weight over the memory's entities (struct name, attention_weight) that the query names, at most 1."""
    met = F.filter(entities, lambda e: F.array_contains(query_entities, F.lower(F.trim(e["name"]))))
    return F.least(F.lit(1.0), F.aggregate(met, F.lit(0.0), lambda s, e: s + base * e["attention_weight"]))


def with_decay(df: DataFrame, now: Column, strategy: str = "exponential") -> DataFrame:
    """raw_score, time_decay, age_days and the decayed score of rows with ``score`` and timestamp ``created_at``."""
    from engramix.functions.dates import age_days

    age = age_days(F.col("created_at"), now)
    factor = nm.decay(age, strategy)
    return df.withColumns({"raw_score": F.col("score"), "time_decay": F.round(factor, 4), "age_days": F.round(age, 1), "score": F.col("score") * factor * nm.freshness(age)})


def blended(df: DataFrame) -> DataFrame:
    """The older blend: 0.7 of the memory's score and 0.3 of the graph's, half of it where only the graph has one."""
    m, g = F.col("memory_score"), F.col("graph_score")
    return df.withColumn("score", F.when(m.isNotNull() & g.isNotNull(), 0.7 * m + 0.3 * g).when(m.isNotNull(), m).otherwise(0.5 * g))


def diversify(df: DataFrame, limit: int, keep: float = 0.82) -> DataFrame:
    """Greedy maximal marginal relevance of each query's pool (query_id, id, score, tokens); rank by choice.

    The pool has max(4 * limit, 60) rows at most, so a group is bounded; choosing is
    sequential by nature. Rows that repeat an id go; what the pool lacks is filled by score.
    """
    once = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "position")
    unique = df.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    size = max(4 * limit, 60)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "position", "id")
    pool = unique.withColumn("n", F.row_number().over(w)).where(F.col("n") <= size)
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("query_id", "id")}

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        tokens = [frozenset(t) for t in group["tokens"]]
        score = group["score"].to_numpy(float)
        top = max(score.max(), 1e-9)
        left, taken, worst = list(range(len(score))), [], np.zeros(len(score))
        while left and len(taken) < limit:
            if len(score) <= limit:
                i = left[0]
            else:
                i = max(left, key=lambda j: (keep * score[j] / top - (1 - keep) * worst[j], -j))
            left.remove(i)
            taken.append(i)
            for j in left:
                union = len(tokens[i] | tokens[j])
                if tokens[i] and tokens[j]:
                    worst[j] = max(worst[j], len(tokens[i] & tokens[j]) / union)
        out = group.iloc[taken]
        return pd.DataFrame({"query_id": out["query_id"], "id": out["id"], "score": out["score"], "rank": range(1, len(taken) + 1)})

    return pool.select("query_id", "id", "score", "tokens", "n").groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank int")


def dedupe_ids(df: DataFrame) -> DataFrame:
    """One row for each query and id, that with the highest score."""
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("score"))
    return df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def context_dedupe(df: DataFrame) -> DataFrame:
    """Each sentence once in the final context.

    df: query_id, rank, id, segments (ids on the path), supports (ids). In rank order a row goes
    if its id is shown already; segments and supports shown before are taken out of it. A group
    is one query's final list, which the limit bounds.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("query_id", "id")}

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        seen, rows = set(), []
        for r in group.sort_values("rank").itertuples():
            if r.id in seen:
                continue
            segments = [s for s in (r.segments if r.segments is not None else []) if s not in seen] or [r.id]
            shown = [s for s in dict.fromkeys(segments)]
            seen.update(shown)
            seen.add(r.id)
            supports = [s for s in dict.fromkeys(r.supports if r.supports is not None else []) if s not in seen]
            seen.update(supports)
            rows.append((r.query_id, r.id, len(rows) + 1, shown, supports))
        return pd.DataFrame(rows, columns=["query_id", "id", "rank", "segments", "supports"])

    return df.select("query_id", "id", "rank", "segments", "supports").groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, id {kinds['id']}, rank int, segments array<string>, supports array<string>")


def context_lines(df: DataFrame, budget: int = 2000) -> DataFrame:
    """query_id, context: numbered lines up to the token budget (a third of a line's length each)."""
    named = F.transform(F.slice(F.array_sort("entities", lambda a, b: F.when(a["attention_weight"] > b["attention_weight"], -1).when(a["attention_weight"] < b["attention_weight"], 1).otherwise(0)), 1, 5), lambda e: F.concat(e["name"], F.lit("("), F.format_number(e["attention_weight"], 2), F.lit(")")))
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.substring("id", 1, 8), F.lit("] ["), F.coalesce("created_at", F.lit("")), F.lit("] ["), F.array_join(named, ", "), F.lit("] "), F.col("memory"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = df.withColumn("line", line).withColumn("used", F.sum(F.floor(F.length("line") / 3)).over(w)).where(F.col("used") <= budget)
    return used.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


def neighbours(results: DataFrame, memories: DataFrame) -> DataFrame:
    """The memories before and after each result, at 0.95 of its score."""
    near = results.join(memories.select("id", "prev_id", "next_id"), "id")
    found = near.select("query_id", F.explode(F.array_compact(F.array("prev_id", "next_id"))).alias("id"), (F.col("score") * 0.95).alias("score"))
    return dedupe_ids(results.select("query_id", "id", "score").unionByName(found))


def supplement(results: DataFrame, neighbours_of: DataFrame, limit: int, threshold: float = 0.3) -> DataFrame:
    """For queries with weak or few results: rows linked to their seed entities' neighbours, scored 0.1.

    neighbours_of: query_id, entity, id (five at most for an entity are taken).
    """
    weak = results.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("n") <= limit)
    weak = weak.groupBy("query_id").agg(F.avg("score").alias("mean"), F.count("*").alias("n")).where((F.col("mean") < threshold) | (F.col("n") < limit // 2)).select("query_id")
    w = Window.partitionBy("query_id", "entity").orderBy("id")
    more = neighbours_of.join(weak, "query_id", "left_semi").withColumn("n", F.row_number().over(w)).where("n <= 5").select("query_id", "id", F.lit(0.1).alias("score")).distinct()
    return dedupe_ids(results.select("query_id", "id", "score").unionByName(more))


def seed_entities(results: DataFrame) -> DataFrame:
    """query_id, entity: names of weight 0.5 at least in the five best results (rank, entities)."""
    e = results.where("rank <= 5").select("query_id", F.explode("entities").alias("e"))
    return e.where("e.attention_weight >= 0.5").select("query_id", F.lower(F.trim("e.name")).alias("entity")).distinct()

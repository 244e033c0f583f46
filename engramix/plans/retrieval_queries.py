"""Retrieval: vectors, keywords, entities, fusion, evidence, routes, diversity, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import classify as cl
from engramix.functions import numeric as nm
from engramix.functions import text as tx
from engramix.operators import retrieval as rt
from engramix.operators.filters import compile_filter
from engramix.plans.registry import Tables, query
from engramix.storage import materialize


def words(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP, DATES, TEMPORAL = words(tx.EVIDENCE_STOPWORDS), words(tx.DATE_WORDS), words(tx.TEMPORAL_TERMS)


def sql_tokens(c: str) -> str:
    """Distinct content words, in DuckDB."""
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP}, x)))"


def sql_raw(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


COSINE = "greatest(0.0, least(1.0, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8)))"
VECTORS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def memory_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope"), F.col("embedding").alias("vector"))


def probes(t: Tables, every: int = 25) -> DataFrame:
    return memory_vectors(t).where(F.col("id") % every == 0).withColumnRenamed("id", "query_id")


def topk_sql(where: str, k: int = 10) -> str:
    return f"""
    WITH {VECTORS},
    s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {COSINE} AS score FROM e a, e b WHERE b.vec_id % 25 = 0 AND a.vec_id <> b.vec_id {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score FROM r WHERE rank <= {k}
    """


def rounded_rank(df: DataFrame, k: int) -> DataFrame:
    """Ranks by the score to nine places, so that sums in another order don't swap ties."""
    return rt.ranked(df.drop("rank").withColumn("score", F.round("score", 9)), k).select("query_id", "id", "rank", "score")


@query(topk_sql(""))
def vector_topk(t: Tables) -> DataFrame:
    return rounded_rank(rt.vector_topk(memory_vectors(t), probes(t), 10, exclude_self=True), 10)


@query(topk_sql("AND a.label = b.label"))
def vector_topk_scoped(t: Tables) -> DataFrame:
    return rounded_rank(rt.vector_topk(memory_vectors(t), probes(t), 10, scoped=True, exclude_self=True), 10)


BM25 = f"""
    d AS (SELECT doc_id AS id, {sql_raw('text')} AS terms FROM documents),
    tot AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d),
    q AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct({sql_raw('text')})) AS term FROM benchmark),
    tf AS (SELECT id, len AS length, term, count(*) AS tf FROM (SELECT id, len(terms) AS len, unnest(terms) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT q.query_id, tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS bm25
            FROM q JOIN tf USING (term) JOIN df USING (term), tot GROUP BY ALL)"""


def doc_memories(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def items(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query(f"""WITH {BM25},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS rank FROM raw)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(bm25, 6) AS score FROM r WHERE rank <= 10""")
def bm25_topk(t: Tables) -> DataFrame:
    return rt.bm25_topk(doc_memories(t), items(t), 10).select("query_id", "id", "rank", "score")


def semantic(t: Tables) -> DataFrame:
    """Coverage of the item's words stands for the semantic score. A text is split into words once, however many lists it is in."""
    pairs = materialize(rt.bm25_topk(doc_memories(t), items(t), 40), "pairs")
    held = doc_memories(t).join(pairs.select("id").distinct(), "id", "left_semi").withColumn("memory_tokens", tx.content_tokens(F.col("text")))
    asked = items(t).withColumnRenamed("text", "query").withColumn("query_tokens", tx.content_tokens(F.col("query")))
    texts = pairs.join(asked, "query_id").join(held, "id")
    return texts.select("query_id", "id", F.round(tx.coverage(F.col("query_tokens"), F.col("memory_tokens")), 6).alias("score"), F.col("score").alias("raw"), "query", "text", "query_tokens", "memory_tokens")


SEMANTIC = f"""{BM25},
    top AS (SELECT query_id, id, round(bm25, 6) AS raw FROM raw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) <= 40),
    sem AS (SELECT top.query_id, top.id, raw, b.text AS query, d.text, {sql_tokens('b.text')} AS qt, {sql_tokens('d.text')} AS mt
            FROM top JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id),
    scored AS (SELECT *, round(len(list_intersect(qt, mt)) / greatest(1, len(qt)), 6) AS score FROM sem)"""


@query(f"WITH {BM25} SELECT query_id, id, round(bm25, 5) AS bm25 FROM raw")
def bm25_scores(t: Tables) -> DataFrame:
    """All scores of all queries."""
    return rt.bm25(doc_memories(t), items(t)).withColumn("bm25", F.round("bm25", 5))


@query(f"""WITH {SEMANTIC},
    parts AS (SELECT query_id, id, score AS semantic, 1 / (1 + exp(-0.1 * (raw - 20))) AS bm25, CAST(CASE WHEN id % 7 = 0 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS boost FROM scored WHERE score >= 0.1),
    f AS (SELECT *, round(least(1.0, (semantic + bm25 + boost) / (1 + CASE WHEN bm25 > 0 THEN 1 ELSE 0 END + CASE WHEN boost > 0 THEN 0.5 ELSE 0 END)), 8) AS score FROM parts)
    SELECT query_id, id, semantic, round(bm25, 5) AS bm25, boost, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def hybrid_fusion(t: Tables) -> DataFrame:
    sem = materialize(semantic(t).select("query_id", "id", "score", "raw"), "semantic")
    keyword = sem.select("query_id", "id", nm.normalized_bm25(F.col("raw"), 20.0, 0.1).alias("bm25"))
    boosts = sem.where("id % 7 = 0").select("query_id", "id", F.lit(0.3).alias("boost"))
    fused = rt.fuse(sem, keyword, boosts, 0.1, 10_000).drop("rank").withColumn("score", F.round("score", 8))
    out = rt.ranked(fused, 10)
    return out.select("query_id", "id", "semantic", F.round("bm25", 5).alias("bm25"), "boost", "score", "rank")


ENTITY = f"""{VECTORS},
    ent AS (SELECT label AS entity_id, list(vec_id ORDER BY vec_id) AS linked, min_by(v, vec_id) AS v FROM e GROUP BY label),
    m AS (SELECT b.vec_id AS query_id, a.entity_id, a.linked, {COSINE} AS score FROM ent a, e b WHERE b.vec_id % 25 = 0),
    x AS (SELECT query_id, unnest(linked) AS id, score * 0.5 / (1 + 0.001 * power(len(linked) - 1, 2)) AS boost FROM m WHERE score >= 0.3)"""


@query(f"WITH {ENTITY} SELECT query_id, id, round(max(boost), 6) AS boost FROM x GROUP BY ALL")
def entity_boost(t: Tables) -> DataFrame:
    entities = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("linked")).select(F.col("label").cast("string").alias("entity_id"), "vector", "linked")
    wanted = probes(t).select("query_id", F.lit(1).alias("position"), "vector")
    return rt.entity_boosts(wanted, entities, least=0.3).withColumn("boost", F.round("boost", 6))


@query(f"""WITH {VECTORS},
    s AS (SELECT b.vec_id AS new_id, a.vec_id AS existing_id, {COSINE} AS score FROM e a, e b WHERE b.vec_id % 10 = 0 AND a.vec_id % 10 <> 0),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY round(score, 9) DESC, existing_id) = 1)
    SELECT new_id, CASE WHEN score >= 0.3 THEN existing_id END AS existing_id, score >= 0.3 AS linked, round(score, 6) AS score FROM t""")
def entity_resolution(t: Tables) -> DataFrame:
    from engramix.operators.memory import nearest_entities

    v = memory_vectors(t)
    found = nearest_entities(v.where("id % 10 <> 0"), v.where("id % 10 = 0").withColumnRenamed("id", "query_id"), 0.3)
    return found.select(F.col("query_id").alias("new_id"), F.when(F.col("linked"), F.col("id")).alias("existing_id"), "linked", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, lang, source, n_chars FROM documents
    WHERE n_chars >= 500 AND n_chars < 5000 AND lang IN ('en', 'fr') AND source <> 'src0' AND (lower(source) LIKE '%src1%' OR n_chars > 3000) AND NOT (lang = 'fr' AND n_chars > 4000)""")
def metadata_filter_dsl(t: Tables) -> DataFrame:
    condition = compile_filter({
        "n_chars": {"gte": 500, "lt": 5000},
        "lang": {"in": ["en", "fr"]},
        "source": {"ne": "src0"},
        "OR": [{"source": {"icontains": "SRC1"}}, {"n_chars": {"gt": 3000}}],
        "NOT": [{"lang": "fr", "n_chars": {"gt": 4000}}],
        "doc_id": "*",
    })
    return t.documents.where(condition).select("doc_id", "lang", "source", "n_chars")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice / 500000 AS raw, greatest(0.0, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate)) / 86400000000.0) AS age FROM orders)
    SELECT o_orderkey, round(age, 1) AS age_days, round(power(0.5, age / 30), 4) AS time_decay, round(raw * power(0.5, age / 30) * CASE WHEN age < 1 THEN 1.2 ELSE 1 END, 8) AS score,
           round(greatest(0.1, 1 - age / 365), 4) AS linear_decay FROM a""")
def time_decay(t: Tables) -> DataFrame:
    now = F.lit("2001-08-02 00:00:00").cast("timestamp")
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") / 500000).alias("score"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    out = rt.with_decay(rows, now)
    linear = rt.with_decay(rows, now, "linear").select("o_orderkey", F.col("time_decay").alias("linear_decay"))
    return out.select("o_orderkey", "age_days", "time_decay", F.round("score", 8).alias("score")).join(linear, "o_orderkey")


@query("""WITH c AS (SELECT o_orderkey, '20' || substr(strftime(o_orderdate, '%Y-%m-%d'), 3) AS created FROM orders)
    SELECT o_orderkey, substr(created, 1, 4) = '2098' AND substr(created, 6, 2) = '05' AS may_2098, substr(created, 1, 4) = '2000' AS in_2000, substr(created, 6, 2) = '12' AS december FROM c""")
def time_constraint(t: Tables) -> DataFrame:
    """Order dates moved to this century, against lists of terms."""
    c = t.orders.select("o_orderkey", F.concat(F.lit("20"), F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), 3, 8)).alias("created"))
    match = lambda *terms: cl.time_match(tx.strings(list(terms)), F.lit("a memory"), F.col("created"))
    return c.select("o_orderkey", match("may", "2098").alias("may_2098"), match("2000").alias("in_2000"), match("december").alias("december"))


@query(f"""SELECT doc_id, CAST(len({sql_tokens('text')}) AS INTEGER) AS n_tokens, md5(array_to_string(list_sort({sql_tokens('text')}), ' ')) AS tokens_md5,
    list_filter({sql_raw('text')}, lambda x: length(x) > 2 AND NOT list_contains({STOP}, x))[1] AS first_token FROM documents""")
def content_tokens(t: Tables) -> DataFrame:
    c = tx.content_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(c).alias("n_tokens"), F.md5(F.array_join(F.array_sort(c), " ")).alias("tokens_md5"), F.try_element_at(tx.listed_tokens(F.col("text"), 3, tx.EVIDENCE_STOPWORDS), F.lit(1)).alias("first_token"))


@query(f"""WITH b AS (SELECT item_id, {sql_tokens('text')} AS tok FROM benchmark)
    SELECT x.item_id AS left_id, y.item_id AS right_id,
           round(len(list_intersect(x.tok, y.tok)) / len(list_distinct(list_concat(x.tok, y.tok))), 6) AS jaccard
    FROM b x, b y WHERE x.item_id < y.item_id AND len(list_intersect(x.tok, y.tok)) >= 2""")
def jaccard_pairs(t: Tables) -> DataFrame:
    """Pairs of items that share two content words, met through their words."""
    b = t.benchmark.select("item_id", tx.content_tokens(F.col("text")).alias("tok"))
    w = b.select("item_id", F.explode("tok").alias("w"))
    met = w.alias("x").join(w.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.item_id") < F.col("y.item_id"))).groupBy(F.col("x.item_id").alias("left_id"), F.col("y.item_id").alias("right_id")).agg(F.count("*").alias("n")).where("n >= 2")
    a, c = b.select(F.col("item_id").alias("left_id"), F.col("tok").alias("lt")), b.select(F.col("item_id").alias("right_id"), F.col("tok").alias("rt"))
    return met.join(a, "left_id").join(c, "right_id").select("left_id", "right_id", F.round(tx.jaccard(F.col("lt"), F.col("rt")), 6).alias("jaccard"))


EVIDENCE = f"""{SEMANTIC},
    ev AS (SELECT query_id, id, round(len(list_intersect(qt, mt)) / greatest(1, len(qt)), 4) AS query_coverage, len(list_intersect(qt, mt)) / greatest(1, len(qt)) AS cov,
           CASE WHEN list_has_any({sql_raw('query')}, {TEMPORAL}) AND (list_has_any({sql_raw('text')}, {DATES}) OR len(list_filter({sql_raw('text')}, lambda x: regexp_matches(x, '^20[0-9]{{2}}$'))) > 0) THEN CAST(1 AS DOUBLE) ELSE 0.0 END AS temporal_cue,
           CASE WHEN length(text) > 1800 THEN least(0.08, (length(text) - 1800) / 10000) ELSE 0.0 END AS pen, score FROM scored)"""


@query(f"""WITH {EVIDENCE}
    SELECT query_id, id, query_coverage, temporal_cue, round(pen, 4) AS length_penalty, round(least(1.0, 0.75 * cov + 0.25 * temporal_cue), 4) AS evidence_score,
           round(greatest(0.0, score + 0.10 * score * least(1.0, 0.75 * cov + 0.25 * temporal_cue) - score * pen), 6) AS score FROM ev""")
def evidence_features(t: Tables) -> DataFrame:
    sem = semantic(t).select("query_id", "id", "query", F.col("text").alias("memory"), "score", "query_tokens", "memory_tokens").withColumns({"created_at": F.lit(""), "time_constraints": F.array().cast("array<string>")})
    out = rt.adjust(sem)
    return out.select("query_id", "id", F.round("query_coverage", 4).alias("query_coverage"), "temporal_cue", F.round(tx.length_penalty(F.col("memory")), 4).alias("length_penalty"), F.round("evidence_score", 4).alias("evidence_score"), F.round("score", 6).alias("score"))


QUESTIONS = [
    "When did Melanie sign up for a pottery class?", "What recipes did Caroline recommend in September?", "What book recommendations has Joanna given to Nate?", "How many times did they meet last week?",
    "Did Evan start lifting weights in March 2023?", "Who went to the concert?", "Where does Nate live?", "Which two hobbies do both share?", "What kind of books does Joanna like?", "What date was the trip?",
    "Is it true or not, yes or no?", "Tell me whether she owns a console", "What does Caroline prefer?", "List several events before June", "Which month did the class start?", "What is the total number of meals?",
    "What activities were planned for next Friday?", "Why was he late yesterday?", "Describe the house", "What did she buy in 2022 after the meeting?", "Has Nate ever visited Rome?", "What health advice was given?",
]


def _cue(pattern: str) -> str:
    return f"regexp_matches(q, '(^|[^a-z0-9_])({pattern})([^a-z0-9_]|$)')"


@query(f"""WITH src AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM (VALUES {', '.join("(" + str(100000 + i) + ", '" + q + "')" for i, q in enumerate(QUESTIONS))}) v(query_id, query)),
    x AS (SELECT CAST(query_id AS BIGINT) AS query_id, lower(query) AS q, {sql_raw('query')} AS tok FROM src),
    y AS (SELECT *, list_filter(tok, lambda x: list_contains({DATES}, x) OR regexp_matches(x, '^20[0-9]{{2}}$')) AS terms,
          {_cue(cl.WHEN_CUE)} AS whenq, {_cue(cl.LIST_CUE)} OR regexp_matches(q, '(^|[^a-z0-9_])what([^a-z0-9_]|[^a-z0-9_].{{0,38}}[^a-z0-9_])({cl.LIST_OBJECT})([^a-z0-9_]|$)') AS listq FROM x),
    z AS (SELECT *, len(terms) > 0 OR whenq AS temporal,
          CASE WHEN {_cue(cl.COUNT_CUE)} THEN 'count' WHEN regexp_matches(q, '^[ \\t\\n]*({cl.YES_NO_CUE})([^a-z0-9_]|$)') OR {_cue('yes or no|whether')} THEN 'yes_no'
               WHEN whenq THEN 'date' WHEN listq THEN 'list' WHEN {_cue('who')} THEN 'person' WHEN {_cue('where')} THEN 'location' ELSE 'span' END AS answer_shape FROM y)
    SELECT query_id, answer_shape, CASE WHEN temporal AND answer_shape IN ('count', 'list') THEN 'temporal_aggregate' WHEN temporal AND {_cue(cl.CHAIN_CUE)} THEN 'temporal_chain'
               WHEN answer_shape IN ('count', 'list') THEN 'aggregate' WHEN list_contains(tok, 'both') THEN 'multi_hop' ELSE 'single_sentence' END AS evidence_mode,
           CAST(len(list_distinct(terms)) AS INTEGER) AS n_constraints, concat_ws(',', {', '.join(f"CASE WHEN {_cue(p)} THEN '{n}' END" for n, p in cl.RELATION_HINTS.items())}) AS relation_hints FROM z""")
def query_plan(t: Tables) -> DataFrame:
    literal = t.spark.createDataFrame([(100000 + i, q) for i, q in enumerate(QUESTIONS)], "query_id bigint, query string")
    src = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).unionByName(literal)
    plan = src.select("query_id", cl.query_plan(F.col("query"), F.array().cast("array<struct<type:string,name:string>>")).alias("p"))
    return plan.select("query_id", "p.answer_shape", "p.evidence_mode", F.size("p.time_constraints").alias("n_constraints"), F.array_join("p.relation_hints", ",").alias("relation_hints"))


GRAPH_SIDE = """g AS (SELECT query_id, id, round(raw / 100, 6) AS path_score, CAST(1 + id % 4 AS INTEGER) AS path_len, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS position FROM scored WHERE id % 2 = 0),
    v AS (SELECT query_id, id, score FROM scored WHERE id % 3 = 0 AND score >= 0.1)"""


@query(f"""WITH {SEMANTIC}, {GRAPH_SIDE},
    gg AS (SELECT *, least(1.0, path_score + 0.03 * greatest(0, path_len - 1)) AS graph_score FROM g),
    j AS (SELECT coalesce(gg.query_id, v.query_id) AS query_id, coalesce(gg.id, v.id) AS id, graph_score, score AS validated, position FROM gg FULL OUTER JOIN v ON gg.query_id = v.query_id AND gg.id = v.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, validated IS NULL ORDER BY position, id) AS n FROM j)
    SELECT query_id, id, round(CASE WHEN validated IS NOT NULL AND graph_score IS NOT NULL THEN validated + 0.12 * graph_score WHEN validated IS NOT NULL THEN validated ELSE 0.25 * graph_score END, 6) AS score,
           CASE WHEN validated IS NOT NULL AND graph_score IS NOT NULL THEN 'vector+bm25+graph_bfs' WHEN validated IS NOT NULL THEN 'vector+bm25' ELSE 'graph_bfs' END AS source FROM k WHERE validated IS NOT NULL OR n <= 4""")
def route_merge(t: Tables) -> DataFrame:
    sem = materialize(semantic(t).select("query_id", "id", "score", "raw"), "semantic")
    w = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
    graph = sem.where("id % 2 = 0").select("query_id", "id", F.round(F.col("raw") / 100, 6).alias("path_score"), (1 + F.col("id") % 4).cast("int").alias("path_len"), F.row_number().over(w).alias("position"))
    validated = sem.where("id % 3 = 0 AND score >= 0.1").select("query_id", "id", "score")
    return rt.merge_routes(graph, validated, 20).select("query_id", "id", F.round("score", 6).alias("score"), "source")


@query(f"""WITH {SEMANTIC}, s AS (SELECT query_id, id, score, CASE id % 3 WHEN 0 THEN 'graph_bfs' WHEN 1 THEN 'vector+bm25+graph_bfs' ELSE 'vector' END AS source, (raw - 40) / 10 AS logit FROM scored),
    w AS (SELECT *, CASE WHEN source = 'graph_bfs' THEN 0.75 WHEN contains(source, 'vector+bm25') THEN 0.45 ELSE 0.55 END AS own FROM s)
    SELECT query_id, id, source, round(own * score + (1 - own) / (1 + exp(-logit)), 6) AS score FROM w""")
def rerank_blend(t: Tables) -> DataFrame:
    source = F.when(F.col("id") % 3 == 0, "graph_bfs").when(F.col("id") % 3 == 1, "vector+bm25+graph_bfs").otherwise("vector")
    s = semantic(t).select("query_id", "id", "score", source.alias("source"), ((F.col("raw") - 40) / 10).alias("logit"))
    return rt.rerank(s).select("query_id", "id", "source", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {SEMANTIC}, pool AS MATERIALIZED (SELECT query_id, id, CAST(score AS DOUBLE) AS score, mt, row_number() OVER w AS n, count(*) OVER (PARTITION BY query_id) AS size, greatest(max(CAST(score AS DOUBLE)) OVER (PARTITION BY query_id), 1e-9) AS top FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
    half AS MATERIALIZED (SELECT query_id, a.id, b.id AS other, len(list_intersect(a.mt, b.mt)) AS k, len(a.mt) + len(b.mt) AS sizes FROM pool a JOIN pool b USING (query_id) WHERE a.n < b.n AND len(a.mt) > 0 AND len(b.mt) > 0),
    jac AS MATERIALIZED (SELECT query_id, id, other, k / CAST(sizes - k AS DOUBLE) AS j FROM half UNION ALL SELECT query_id, other, id, k / CAST(sizes - k AS DOUBLE) FROM half),
    it AS (SELECT query_id, id, score, n, size, top, CAST(0 AS DOUBLE) AS worst, CAST(NULL AS INTEGER) AS taken, 0 AS step FROM pool
           UNION ALL
           SELECT x.query_id, x.id, x.score, x.n, x.size, x.top, CASE WHEN x.taken IS NULL THEN greatest(x.worst, coalesce(j.j, 0)) ELSE x.worst END, CASE WHEN x.taken IS NULL AND x.place = 1 THEN x.step + 1 ELSE x.taken END, x.step + 1
           FROM (SELECT *, row_number() OVER o AS place, first_value(id) OVER o AS chosen FROM it WHERE step < 10
                 WINDOW o AS (PARTITION BY query_id ORDER BY taken IS NOT NULL, CASE WHEN size <= 10 THEN -n ELSE CAST(0.82 AS DOUBLE) * score / top - (1 - CAST(0.82 AS DOUBLE)) * worst END DESC, n)) x
           LEFT JOIN jac j ON j.query_id = x.query_id AND j.id = x.id AND j.other = x.chosen)
    SELECT query_id, id, round(score, 6) AS score, taken AS rank FROM it WHERE step = 10 AND taken IS NOT NULL""")
def mmr_topk(t: Tables) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pool = semantic(t).select("query_id", "id", "score", F.col("memory_tokens").alias("tokens"), F.row_number().over(w).alias("position"))
    return rt.diversify(pool, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {SEMANTIC}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM scored QUALIFY n <= 20),
    f AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, false AS kept, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[]) AS segments, CAST([] AS BIGINT[]) AS supports, 0 AS rank FROM (SELECT DISTINCT query_id FROM r)
          UNION ALL
          SELECT r.query_id, r.n, r.id, NOT list_contains(f.seen, r.id), CASE WHEN list_contains(f.seen, r.id) THEN f.seen ELSE list_concat(f.seen, [r.id, r.id + 1, r.id + 2]) END,
                 list_filter([r.id, r.id + 1], lambda x: NOT list_contains(f.seen, x)), list_filter([r.id + 2], lambda x: NOT list_contains(f.seen, x)), f.rank + CASE WHEN list_contains(f.seen, r.id) THEN 0 ELSE 1 END
          FROM f JOIN r ON r.query_id = f.query_id AND r.n = f.n + 1)
    SELECT query_id, CAST(id AS VARCHAR) AS id, rank, array_to_string(segments, ',') AS segments, array_to_string(supports, ',') AS supports FROM f WHERE kept""")
def context_dedupe(t: Tables) -> DataFrame:
    """Twenty results for each item, each with the next id on its path and the one after as support."""
    top = rt.ranked(semantic(t).select("query_id", "id", "score"), 20).withColumn("id", F.col("id").cast("string"))
    rows = top.select("query_id", "rank", "id", F.array("id", (F.col("id").cast("long") + 1).cast("string")).alias("segments"), F.array((F.col("id").cast("long") + 2).cast("string")).alias("supports"))
    return rt.context_dedupe(rows).select("query_id", "id", "rank", F.array_join("segments", ",").alias("segments"), F.array_join("supports", ",").alias("supports"))


@query(f"""WITH {SEMANTIC}, r AS (SELECT query_id, id, score, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored),
    l AS (SELECT *, concat(rank, '. [', substr(CAST(id AS VARCHAR), 1, 8), '] [2023-01-01] [] ', text) AS line FROM r WHERE rank <= 30),
    u AS (SELECT *, sum(length(line) // 3) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM l)
    SELECT query_id, md5(string_agg(line, chr(10) ORDER BY rank)) AS context_md5 FROM u WHERE used <= 2000 GROUP BY query_id""")
def context_budget(t: Tables) -> DataFrame:
    """Whole memories: the token budget is the only limit."""
    return budgeted(t, F.col("text"))


def budgeted(t: Tables, memory: Column) -> DataFrame:
    top = rt.ranked(semantic(t).select("query_id", "id", "score", "text"), 30)
    rows = top.select("query_id", F.col("rank"), F.col("id").cast("string").alias("id"), F.lit("2023-01-01").alias("created_at"), F.array().cast("array<struct<name:string,attention_weight:double,entity_type:string>>").alias("entities"), memory.alias("memory"))
    return rt.context_lines(rows).select("query_id", F.md5("context").alias("context_md5"))


@query(f"""WITH {SEMANTIC}, u AS (SELECT query_id, id, score FROM scored WHERE id % 2 = 0 UNION ALL SELECT query_id, id, round(score * 0.55, 6) FROM scored WHERE id % 3 = 0)
    SELECT query_id, id, max(score) AS score FROM u GROUP BY ALL""")
def route_union_dedupe(t: Tables) -> DataFrame:
    sem = materialize(semantic(t).select("query_id", "id", "score"), "semantic")
    both = sem.where("id % 2 = 0").unionByName(sem.where("id % 3 = 0").withColumn("score", F.round(F.col("score") * 0.55, 6)))
    return rt.dedupe_ids(both)


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'vector+graph' WHEN 2 THEN '' ELSE 'bm25+vector' END AS s FROM documents)
    SELECT doc_id, CASE WHEN s = '' THEN 'graph' WHEN list_contains(string_split(s, '+'), 'graph') THEN s ELSE s || '+graph' END AS label FROM l""")
def route_labels(t: Tables) -> DataFrame:
    s = F.when(F.col("doc_id") % 4 == 0, "vector").when(F.col("doc_id") % 4 == 1, "vector+graph").when(F.col("doc_id") % 4 == 2, "").otherwise("bm25+vector")
    return t.documents.select("doc_id", tx.add_label(s, "graph").alias("label"))


@query("""SELECT doc_id, CASE WHEN length(c) <= 220 THEN c ELSE rtrim(substr(c, 1, 219)) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM documents)""")
def snippets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("""WITH f AS (SELECT doc_id, n_chars / 20000.0 AS v, CASE WHEN doc_id % 2 = 0 THEN 0.4 ELSE 0.0 END AS b, CASE WHEN doc_id % 3 = 0 THEN 0.2 ELSE 0.0 END AS g, CASE WHEN doc_id % 5 = 0 THEN 0.1 ELSE 0.0 END AS e FROM documents)
    SELECT doc_id, round(least(1.0, (v + b + g + e) / (1 + CASE WHEN b > 0 THEN 1 ELSE 0 END + CASE WHEN g > 0 THEN 0.5 ELSE 0 END + CASE WHEN e > 0 THEN 0.5 ELSE 0 END)), 6) AS score FROM f""")
def multi_route_scores(t: Tables) -> DataFrame:
    on = lambda m, v: F.when(F.col("doc_id") % m == 0, v).otherwise(0.0)
    return t.documents.select("doc_id", F.round(nm.fused(F.col("n_chars") / 20000.0, on(2, 0.4), on(3, 0.2), on(5, 0.1)), 6).alias("score"))

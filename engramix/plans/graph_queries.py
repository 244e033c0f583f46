"""The multigraph of the events: a user -[event_type]-> the number in props; one day is one scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.operators import graph as gr
from engramix.plans.registry import Tables, query
from engramix.storage import materialize

#: Confidence of an event's triple, and the triples themselves, in DuckDB.
T = """t AS (SELECT event_id, CAST(event_id AS VARCHAR) AS sid, strftime(ts, '%Y-%m-%d') AS scope, 'u' || user_id AS head, event_type AS relation, 'k' || json_extract_string(props, '$.k') AS tail,
       round(0.1 + (event_id % 10) / 10.0, 2) AS confidence FROM events),
    ent AS (SELECT scope, sid, head AS name, max(least(1.0, confidence)) AS w FROM t GROUP BY ALL UNION ALL SELECT scope, sid, tail AS name, max(least(1.0, confidence)) AS w FROM t GROUP BY ALL),
    nodes AS (SELECT scope, name, sum(w) AS aw FROM ent GROUP BY ALL),
    links AS (SELECT DISTINCT scope, name, sid FROM ent),
    und AS (SELECT DISTINCT * FROM (SELECT scope, head AS name, tail AS nb FROM t UNION ALL SELECT scope, tail, head FROM t) WHERE name <> nb)"""
#: One start for every scope: the least user of the day.
S = "st AS (SELECT scope, scope AS query_id, min(head) AS name, 0.6 AS weight FROM t GROUP BY scope)"


def triples(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("scope"), F.col("event_id").cast("string").alias("sentence_id"), F.col("event_id").alias("seq"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("head"),
        F.col("event_type").alias("relation"), F.concat(F.lit("K"), k).alias("tail"), F.round(F.lit(0.1) + (F.col("event_id") % 10) / 10.0, 2).alias("confidence"),
    )


def graph(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return gr.build_graph(triples(t))


def starts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("scope").agg(F.min("head").alias("name")).select("scope", F.col("scope").alias("query_id"), "name", F.lit(0.6).alias("weight"))


@query(f"""WITH {T} SELECT scope, name, round(aw, 6) AS attention_weight_sum, (SELECT count(*) FROM links l WHERE l.scope = n.scope AND l.name = n.name) AS n_sentences,
    (SELECT count(*) FROM t WHERE t.scope = n.scope AND t.head = n.name) AS n_out, (SELECT count(*) FROM t WHERE t.scope = n.scope AND t.tail = n.name) AS n_in FROM nodes n""")
def triples_to_graph(t: Tables) -> DataFrame:
    nodes, links, edges = graph(t)
    per = links.groupBy("scope", "name").agg(F.count("*").alias("n_sentences"))
    out = edges.groupBy("scope", F.col("head").alias("name")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy("scope", F.col("tail").alias("name")).agg(F.count("*").alias("n_in"))
    joined = nodes.join(per, ["scope", "name"], "left").join(out, ["scope", "name"], "left").join(into, ["scope", "name"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("scope", "name", F.round("attention_weight_sum", 6).alias("attention_weight_sum"), zero("n_sentences"), zero("n_out"), zero("n_in"))


@query("""WITH f AS (SELECT 'u' || user_id AS name, event_type || ' ' || (event_id % 40) AS fact, min(event_id) AS seq FROM events GROUP BY ALL),
    l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC, fact DESC) <= 20)
    SELECT name, count(*) AS n_facts, string_agg(fact, chr(10) ORDER BY seq, fact) AS summary FROM l GROUP BY name""")
def entity_summary_last20(t: Tables) -> DataFrame:
    facts = t.events.select(F.lit("all").alias("scope"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.concat_ws(" ", "event_type", (F.col("event_id") % 40).cast("string")).alias("fact"), F.col("event_id").alias("seq"))
    return gr.summaries(facts).select("name", F.size("summary_facts").cast("long").alias("n_facts"), "summary")


@query(f"""WITH {T}, {S},
    h1 AS (SELECT DISTINCT st.query_id, st.scope, st.name AS start, nb AS name FROM st JOIN und USING (scope, name)),
    h2 AS (SELECT DISTINCT h1.query_id, h1.scope, h1.start, nb AS name FROM h1 JOIN und USING (scope, name)),
    r AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 AS hop FROM h2 WHERE name <> start)
    SELECT query_id, start, name, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY ALL""")
def graph_neighbors(t: Tables) -> DataFrame:
    _, _, edges = graph(t)
    edges = materialize(edges, "edges")
    return gr.neighbours(edges, starts(edges), 2).select("query_id", "start", "name", "hop")


WEIGHTED = f"""{T}, {S},
    h1 AS (SELECT DISTINCT st.query_id, st.scope, st.name AS start, weight, nb AS name FROM st JOIN und USING (scope, name)),
    h2 AS (SELECT DISTINCT h1.query_id, h1.scope, h1.start, weight, nb AS name FROM h1 JOIN und USING (scope, name)),
    near AS (SELECT query_id, scope, start, weight, name, min(hop) AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 AS hop FROM h2 WHERE name <> start) GROUP BY ALL),
    direct AS (SELECT query_id, sid, weight AS score FROM st JOIN links USING (scope, name)),
    far AS (SELECT query_id, sid, max(weight * power(0.5, hop * (hop + 1) / 2.0) * least(1.0, aw / greatest(1.0, aw + 1))) AS score FROM near JOIN nodes USING (scope, name) JOIN links USING (scope, name) GROUP BY ALL),
    alls AS (SELECT query_id, sid, max(score) AS score FROM (SELECT * FROM direct UNION ALL SELECT * FROM far WHERE (query_id, sid) NOT IN (SELECT (query_id, sid) FROM direct)) GROUP BY ALL)"""


@query(f"""WITH {WEIGHTED} SELECT query_id, sid AS sentence_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, sid) AS n FROM alls) WHERE n <= 30""")
def graph_weighted_bfs(t: Tables) -> DataFrame:
    nodes, links, edges = (materialize(x, "graph") for x in graph(t))
    found = gr.weighted_search(nodes, links, edges, starts(edges), 2, most=1_000_000).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "sentence_id")
    return found.withColumn("n", F.row_number().over(w)).where("n <= 30").select("query_id", "sentence_id", "score")


@query()
def graph_path_bfs(t: Tables) -> DataFrame:
    """Similarities that follow from the event's type and number stand for a model's."""
    nodes, links, edges = (materialize(x, "graph") for x in graph(t))
    begin = starts(edges)
    texts = edges.select("scope", gr.triple_text(F.col("head"), F.col("type"), F.col("tail")).alias("text")).distinct().unionByName(links.select("scope", F.col("sentence_id").alias("text")).distinct())
    sims = texts.select(F.col("scope").alias("query_id"), "text", (F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(100)) / 100).alias("sim"))
    paths = gr.path_search(links, edges, begin, sims, 2, 1, 0.5, 50)
    return paths.select("query_id", "start", F.array_join("path", ">").alias("path"), F.array_join("sentences", ",").alias("sentences"), F.round("path_score", 6).alias("path_score"), "position")


@query(f"""WITH {T}, {S}, h1 AS (SELECT DISTINCT query_id, scope, nb AS name FROM st JOIN und USING (scope, name))
    SELECT query_id, name FROM h1 JOIN nodes USING (scope, name) WHERE round(aw, 6) >= 0.9 AND (query_id, name) NOT IN (SELECT (query_id, name) FROM st)""")
def entity_expansion(t: Tables) -> DataFrame:
    nodes, _, edges = graph(t)
    nodes = nodes.withColumn("attention_weight_sum", F.round("attention_weight_sum", 6))
    return gr.expand_entities(nodes, edges, starts(edges), 1, 0.9)


@query(f"""WITH {T}, p AS (SELECT scope, head, tail, count(*) AS n FROM t GROUP BY ALL)
    SELECT (SELECT count(*) FROM nodes) AS nodes, CAST((SELECT sum(n) FROM p) AS BIGINT) AS edges, (SELECT count(*) FROM p WHERE n > 1) AS multi_edge_pairs,
           (SELECT count(DISTINCT sid) FROM links) AS indexed_sentences, (SELECT count(DISTINCT sid) FROM t) AS edge_sentences""")
def graph_stats(t: Tables) -> DataFrame:
    return gr.stats(*graph(t))


@query("""WITH p AS (SELECT user_id AS path, event_id, value > 20 AS found FROM events)
    SELECT path, count(*) AS n_sentences FROM p GROUP BY path HAVING bool_and(found)""")
def path_all_match(t: Tables) -> DataFrame:
    """Users as paths over their events: those all of whose events are among the payloads."""
    e = t.events
    paths = e.groupBy("user_id").agg(F.collect_list("event_id").alias("sentences")).select(F.lit("q").alias("query_id"), F.col("user_id").alias("position"), "sentences")
    return gr.complete_paths(paths, e.where("value > 20").select(F.col("event_id").alias("id"))).select(F.col("position").alias("path"), F.size("sentences").cast("long").alias("n_sentences"))


@query(f"""WITH {T}, q AS (SELECT scope, 'Q' || head || ' and ' || upper(tail) AS phrase, head, tail FROM t)
    SELECT scope, name, round(max(CAST(w AS DOUBLE)), 6) AS weight FROM (SELECT scope, unnest([head, tail]) AS name, 0.6 AS w FROM q) x WHERE (scope, name) IN (SELECT (scope, name) FROM nodes) GROUP BY ALL""")
def start_resolution(t: Tables) -> DataFrame:
    """Names that are nodes, and phrases that only contain them: the phrase's words weigh 0.8."""
    return resolved(t)


def resolved(t: Tables) -> DataFrame:
    nodes, _, _ = graph(t)
    q = triples(t)
    exact = q.select("scope", F.col("head").alias("name"), F.lit(0.6).alias("weight"))
    phrase = q.select("scope", F.concat_ws(" ", F.lit("with"), "tail").alias("name"), F.lit(0.75).alias("weight"))
    wanted = exact.unionByName(phrase).withColumn("query_id", F.col("scope"))
    return gr.resolve_starts(nodes, wanted).groupBy("scope", "name").agg(F.round(F.max("weight"), 6).alias("weight"))


@query(f"WITH {T} SELECT scope, name, round(aw, 6) AS weight FROM nodes WHERE round(aw, 6) >= 0.5 ORDER BY round(aw, 6) DESC, scope, name LIMIT 100")
def core_entities(t: Tables) -> DataFrame:
    nodes, _, _ = graph(t)
    return gr.core_entities(nodes.withColumn("attention_weight_sum", F.round("attention_weight_sum", 6))).select("scope", "name", F.col("attention_weight_sum").alias("weight"))


@query("""SELECT direction, type, other, count(*) AS n FROM (SELECT 'out' AS direction, event_type AS type, 'k' || json_extract_string(props, '$.k') AS other FROM events WHERE user_id = 7
    UNION ALL SELECT 'in', event_type, 'u' || user_id FROM events WHERE 'k' || json_extract_string(props, '$.k') = 'u7') GROUP BY ALL""")
def entity_relations(t: Tables) -> DataFrame:
    _, _, edges = graph(t)
    return gr.relations(edges, " U7 ").groupBy("direction", "type", "other").agg(F.count("*").alias("n"))


@query(f"""WITH {T}, g AS (SELECT sid FROM t WHERE event_id % 3 = 0)
    SELECT scope, (count(*)) AS edges, (SELECT count(*) FROM links l WHERE l.scope = t.scope AND l.sid NOT IN (SELECT sid FROM g)) AS links FROM t WHERE sid NOT IN (SELECT sid FROM g) GROUP BY scope""")
def cascade_delete(t: Tables) -> DataFrame:
    _, links, edges = graph(t)
    left, kept = gr.delete_sentences(links, edges, t.events.where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id")))
    return kept.groupBy("scope").agg(F.count("*").alias("edges")).join(left.groupBy("scope").agg(F.count("*").alias("links")), "scope")

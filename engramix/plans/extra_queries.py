"""Boosts, blends, supplements, symptoms and signals: the optional routes and the diagnosis cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.functions import classify as cl
from engramix.functions import text as tx
from engramix.operators import retrieval as rt
from engramix.plans.registry import Tables, query
from engramix.plans.retrieval_queries import SEMANTIC, semantic


@query("""WITH d AS (SELECT doc_id, n_chars / 30000.0 AS s, [lang, source] AS e, CASE WHEN doc_id % 2 = 0 THEN ['en', 'src1', 'x'] ELSE ['fr'] END AS q FROM documents)
    SELECT doc_id, round(s * (1 + 0.1 * len(list_intersect(q, e)) / len(q)), 8) AS score FROM d""")
def entity_match_boost(t: Tables) -> DataFrame:
    q = F.when(F.col("doc_id") % 2 == 0, tx.strings(["en", "src1", "x"])).otherwise(tx.strings(["fr"]))
    d = t.documents.select("doc_id", (F.col("n_chars") / 30000.0).alias("score"), F.array("lang", "source").alias("entities"), q.alias("query_entities"))
    return rt.entity_match_boost(d).select("doc_id", F.round("score", 8).alias("score"))


@query("""SELECT doc_id, round(least(1.0, CAST(CASE WHEN lang IN ('en', 'de') THEN 0.1 * 0.9 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN source = 'src0' THEN 0.1 * (doc_id % 10) / 10.0 ELSE 0 END AS DOUBLE)), 8) AS boost FROM documents""")
def weighted_entity_boost(t: Tables) -> DataFrame:
    e = F.array(F.struct(F.concat(F.lit(" "), F.upper("lang")).alias("name"), F.lit(0.9).alias("attention_weight")), F.struct(F.col("source").alias("name"), ((F.col("doc_id") % 10) / 10.0).alias("attention_weight")))
    return t.documents.select("doc_id", F.round(rt.weighted_entity_boost(tx.strings(["en", "de", "src0"]), e), 8).alias("boost"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars / 30000.0 END AS m, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 100) / 100.0 END AS g FROM documents)
    SELECT doc_id, round(CASE WHEN m IS NOT NULL AND g IS NOT NULL THEN 0.7 * m + 0.3 * g WHEN m IS NOT NULL THEN m ELSE 0.5 * g END, 8) AS score FROM b WHERE m IS NOT NULL OR g IS NOT NULL""")
def legacy_blend(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    b = t.documents.select("doc_id", F.when(d % 3 != 0, F.col("n_chars") / 30000.0).alias("memory_score"), F.when(d % 2 == 0, (d % 100) / 100.0).alias("graph_score")).where("memory_score is not null or graph_score is not null")
    return rt.blended(b).select("doc_id", F.round("score", 8).alias("score"))


@query(f"""WITH {SEMANTIC}, best AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM scored),
    few AS (SELECT * FROM best WHERE n <= 10), weak AS (SELECT query_id FROM few GROUP BY query_id HAVING avg(score) < 0.15 OR count(*) < 5),
    nb AS (SELECT query_id, 'src' || (query_id % 20) AS entity, doc_id AS id FROM weak JOIN documents ON source = 'src' || (query_id % 20) QUALIFY row_number() OVER (PARTITION BY query_id, entity ORDER BY doc_id) <= 5),
    u AS (SELECT query_id, id, score FROM few UNION ALL SELECT query_id, id, 0.1 FROM nb)
    SELECT query_id, id, max(CAST(score AS DOUBLE)) AS score FROM u GROUP BY ALL""")
def weak_result_supplement(t: Tables) -> DataFrame:
    few = rt.ranked(semantic(t).select("query_id", "id", "score"), 10)
    entity = F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    near = t.benchmark.select(F.col("item_id").alias("query_id")).withColumn("entity", entity).join(t.documents.select(F.col("source").alias("entity"), F.col("doc_id").alias("id")), "entity")
    return rt.supplement(few, near, 10, 0.15).select("query_id", "id", "score")


@query(f"""WITH {SEMANTIC}, best AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM scored)
    SELECT DISTINCT query_id, lang AS entity FROM best JOIN documents d ON d.doc_id = id WHERE n <= 5 AND id % 10 >= 5""")
def seed_entities(t: Tables) -> DataFrame:
    top = rt.ranked(semantic(t).select("query_id", "id", "score"), 5).join(t.documents.select(F.col("doc_id").alias("id"), "lang"), "id")
    named = F.array(F.struct(F.upper("lang").alias("name"), ((F.col("id") % 10) / 10.0).alias("attention_weight")))
    return rt.seed_entities(top.withColumn("entities", named))


@query(f"""WITH {SEMANTIC}, best AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM scored), r AS (SELECT * FROM best WHERE n <= 3),
    m AS (SELECT doc_id AS id, lag(doc_id) OVER w AS p, lead(doc_id) OVER w AS x FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    u AS (SELECT query_id, id, score FROM r UNION ALL SELECT query_id, p, score * 0.95 FROM r JOIN m USING (id) WHERE p IS NOT NULL UNION ALL SELECT query_id, x, score * 0.95 FROM r JOIN m USING (id) WHERE x IS NOT NULL)
    SELECT query_id, id, round(max(score), 8) AS score FROM u GROUP BY ALL""")
def context_neighbours(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    linked = t.documents.select(F.col("doc_id").alias("id"), F.lag("doc_id").over(w).alias("prev_id"), F.lead("doc_id").over(w).alias("next_id"))
    top = rt.ranked(semantic(t).select("query_id", "id", "score"), 3)
    return rt.neighbours(top, linked).select("query_id", "id", F.round("score", 8).alias("score"))


CASES = """c AS (SELECT l.doc_id, quality = 1 AS o, toxic = 0 AS n, (l.doc_id % 10) / 10.0 AS overlap, (l.doc_id % 7) / 7.0 AS os, (l.doc_id % 5) / 5.0 AS ns, (l.doc_id % 3) / 3.0 AS og, (l.doc_id % 4) / 4.0 AS ng,
      CASE WHEN l.doc_id % 6 = 0 THEN 'Temporal' ELSE 'other' END AS cat, CASE WHEN l.doc_id % 8 = 0 THEN 'not mentioned' ELSE 'yes' END AS oa, CASE WHEN l.doc_id % 9 = 0 THEN 'do not know' ELSE 'no' END AS na, CASE WHEN l.doc_id % 11 = 0 THEN 4000.0 ELSE 10.0 END AS ms FROM labels l),
    y AS (SELECT *, overlap < 0.35 AS topk, ns + 0.15 < os AS dropped, ng > og + 0.2 AS graph, cat = 'Temporal' AS temporal, oa = 'not mentioned' AS olda, na = 'do not know' AS newa, ms > 3000 AS slow,
      CASE WHEN o AND n THEN 'both_correct' WHEN NOT o AND NOT n THEN 'both_wrong' WHEN o THEN 'lost_correct_to_wrong' ELSE 'gained_wrong_to_correct' END AS transition FROM c)"""


@query(f"""WITH {CASES} SELECT doc_id, transition, concat_ws(',', CASE WHEN topk THEN 'topk_changed' END, CASE WHEN dropped THEN 'gt_support_dropped' END, CASE WHEN graph THEN 'graph_ratio_increased' END, CASE WHEN temporal THEN 'temporal_question' END,
      CASE WHEN newa THEN 'new_answer_abstained' END, CASE WHEN olda THEN 'old_answer_abstained' END, CASE WHEN slow THEN 'slow_search' END) AS symptoms,
    CASE WHEN slow THEN 'latency' WHEN transition = 'lost_correct_to_wrong' AND (dropped OR topk) THEN CASE WHEN graph THEN 'bfs_noise_or_graph_reroute' WHEN temporal THEN 'temporal_retrieval_shift' ELSE 'retrieval_shift' END
         WHEN transition = 'lost_correct_to_wrong' AND newa THEN 'generation_abstention' WHEN transition = 'both_wrong' AND dropped THEN 'missing_or_buried_evidence' WHEN transition = 'both_wrong' AND graph THEN 'bfs_noise'
         WHEN transition = 'gained_wrong_to_correct' THEN 'fixed' WHEN transition = 'both_correct' THEN 'stable' ELSE 'judge_or_generation_variance' END AS issue FROM y""")
def symptoms_and_issue(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    share = lambda n: (d % n) / float(n)
    change = cl.transition(F.col("quality") == 1, F.col("toxic") == 0)
    found = cl.symptoms(share(10), share(7), share(5), share(3), share(4), F.when(d % 6 == 0, "Temporal").otherwise("other"), F.when(d % 8 == 0, "not mentioned").otherwise("yes"), F.when(d % 9 == 0, "do not know").otherwise("no"), F.when(d % 11 == 0, 4000.0).otherwise(10.0))
    rows = t.labels.select("doc_id", change.alias("transition"), found.alias("found"))
    return rows.select("doc_id", "transition", F.array_join("found", ",").alias("symptoms"), cl.primary_issue(F.col("found"), F.col("transition")).alias("issue"))


@query("""WITH c AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b, (doc_id % 10) / 10.0 AS sa, (doc_id % 7) / 7.0 AS sb, (doc_id % 4) / 4.0 AS ga, CASE WHEN doc_id % 3 = 0 THEN 'no information' ELSE 'x' END AS ra, CASE WHEN doc_id % 5 = 0 THEN 'not available' ELSE 'x' END AS rb,
      (doc_id % 9) / 9.0 AS ov, doc_id % 2 = 0 AS fact, CASE WHEN doc_id % 6 = 0 THEN 9000.0 ELSE 500.0 END AS la FROM labels)
    SELECT doc_id, concat_ws(',', CASE WHEN a AND ra = 'no information' THEN 'a_correct_but_answer_abstained' END, CASE WHEN b AND rb = 'not available' THEN 'b_correct_but_answer_abstained' END,
      CASE WHEN NOT a AND sa + 0.15 < CASE WHEN b THEN sb ELSE 0 END THEN 'a_gt_support_lower_than_correct_baselines' END, CASE WHEN NOT a AND ga >= 0.3 THEN 'a_graph_heavy_when_wrong' END, CASE WHEN NOT a AND ra = 'no information' THEN 'a_answer_abstained' END,
      CASE WHEN NOT a AND b AND ov < 0.25 THEN 'a_low_topk_overlap_with_b' END, CASE WHEN NOT a AND b AND fact THEN 'b_temporal_fact_context_available' END, CASE WHEN NOT b AND rb = 'not available' THEN 'b_answer_abstained' END,
      CASE WHEN NOT b AND fact THEN 'b_fact_context_not_sufficient' END, CASE WHEN la > 1000 THEN 'a_much_slower_than_b' END) AS signals FROM c""")
def difference_signals(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    share = lambda n: (d % n) / float(n)
    ra, rb = F.when(d % 3 == 0, "no information").otherwise("x"), F.when(d % 5 == 0, "not available").otherwise("x")
    s = cl.difference_signals(["a", "b"], [F.col("quality") == 1, F.col("toxic") == 0], [share(10), share(7)], [share(4), F.lit(0.0)], [ra, rb], [F.lit(1.0), share(9)], [F.lit(False), d % 2 == 0], [F.when(d % 6 == 0, 9000.0).otherwise(500.0), F.lit(100.0)])
    return t.labels.select("doc_id", F.array_join(s, ",").alias("signals"))


@query("""WITH q AS (SELECT doc_id, lang = 'fr' AS backed, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)), ['pottery', 'class', 'que', 'here'])) AS k, contains(lower(text), 'anne') AS named, doc_id % 5 AS path_len FROM documents)
    SELECT doc_id, NOT backed AND (NOT named OR path_len > 2) AS would_block, CASE WHEN backed THEN 'validator_backed' ELSE concat_ws(',', CASE WHEN NOT named THEN 'missing_target_entity' END, CASE WHEN k = -1 THEN 'x' END, CASE WHEN path_len > 2 THEN 'long_path_for_single_sentence_query' END) END AS reasons FROM q""")
def path_gate(t: Tables) -> DataFrame:
    """Reasons against paths; the question has no content words of its own, so coverage is judged by a word that all texts share."""
    plan = F.struct(F.lit("single_sentence").alias("evidence_mode"), F.array(F.struct(F.lit("PERSON").alias("type"), F.lit("Anne").alias("name"))).alias("target_entities"), F.array().cast("array<string>").alias("time_constraints"))
    # The words are a row's own column: an expression would be evaluated again wherever the gate names it.
    d = t.documents.select("doc_id", "lang", "text", F.explode_outer(F.array(tx.content_tokens(F.col("text")))).alias("words"))
    first = F.try_element_at("words", F.lit(1))
    gate = cl.shadow_gate(F.coalesce(first, F.lit("")), plan, F.col("text"), F.array().cast("array<string>"), F.lit(""), (F.col("doc_id") % 5).cast("int"), F.col("lang") == "fr", F.col("words"))
    g = d.select("doc_id", gate.alias("g"))
    kept = F.filter("g.reasons", lambda r: r != "low_query_coverage")
    return g.select("doc_id", (~F.col("g.validator_backed") & (F.size(kept) > 0)).alias("would_block"), F.array_join(kept, ",").alias("reasons"))

"""Evaluation analytics over the tables: labels stand for verdicts, documents for retrieved texts, events for latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import classify as cl
from engramix.functions import numeric as nm
from engramix.functions import text as tx
from engramix.operators import analytics as an
from engramix.sources import checkpoints as ck
from engramix.plans.registry import ORACLE_SQL, Tables, query
from engramix.plans.retrieval_queries import sql_raw, words

LAB = "l AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars, d.text FROM labels l JOIN documents d USING (doc_id))"


def labelled(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id")


@query(f"""WITH {LAB} SELECT coalesce(CASE WHEN lang <> 'de' THEN lang END, 'unknown') AS grp, count(*) AS total, CAST(sum(CASE WHEN quality >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS correct,
    round(100.0 * sum(CASE WHEN quality >= 0.5 THEN 1 ELSE 0 END) / count(*), 4) AS accuracy, round(avg(quality) * 100, 4) AS avg_score FROM l GROUP BY 1""")
def group_metrics(t: Tables) -> DataFrame:
    rows = labelled(t).withColumn("grp", F.when(F.col("lang") != "de", F.col("lang"))).withColumn("score", F.col("quality"))
    return an.group_metrics(rows).withColumns({"accuracy": F.round("accuracy", 4), "avg_score": F.round("avg_score", 4)})


CUTS = f"""{LAB}, c AS (SELECT k.cutoff, lang AS grp, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE quality * CASE WHEN n_chars > 100 * k.cutoff THEN 0.4 ELSE 1.0 END END AS score, doc_id % 13 = 0 AS bad FROM l, (VALUES (10), (20), (50), (200)) k(cutoff))"""


@query(f"""WITH {CUTS} SELECT cutoff, coalesce(grp, 'all') AS grp, count(*) AS total, CAST(sum(CASE WHEN coalesce(score, 0) >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS errors,
    round(100.0 * sum(CASE WHEN coalesce(score, 0) >= 0.5 THEN 1 ELSE 0 END) / count(*), 4) AS accuracy, round(avg(coalesce(score, 0)) * 100, 4) AS avg_score FROM c GROUP BY GROUPING SETS ((cutoff, grp), (cutoff))""")
def cutoff_metrics(t: Tables) -> DataFrame:
    ks = t.spark.createDataFrame([(k,) for k in an.CUTOFFS], "cutoff int")
    score = F.when(F.col("doc_id") % 11 != 0, F.col("quality") * F.when(F.col("n_chars") > 100 * F.col("cutoff"), 0.4).otherwise(1.0))
    judged = F.when(F.col("doc_id") % 13 == 0, "ERROR").otherwise("CORRECT")
    rows = labelled(t).crossJoin(F.broadcast(ks)).select("cutoff", F.col("lang").alias("grp"), score.alias("score"), judged.alias("judgment"), F.lit(None).cast("string").alias("error"))  # four cutoffs
    out = an.cutoff_metrics(rows)
    return out.select("cutoff", F.coalesce("g", F.lit("all")).alias("grp"), "total", "correct", "errors", F.round("accuracy", 4).alias("accuracy"), F.round("avg_score", 4).alias("avg_score"))


@query("""WITH n AS (SELECT l_orderkey AS question_id, CASE WHEN l_discount * 10 >= 0.75 THEN 1.0 WHEN l_discount * 10 >= 0.25 THEN 0.5 ELSE 0.0 END AS s FROM lineitem)
    SELECT question_id, round(avg(s), 6) AS score, count(*) AS n, avg(s) >= 0.5 AS passed FROM n GROUP BY question_id""")
def nugget_scores(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("question_id"), (F.col("l_discount") * 10).alias("score"))
    return an.nugget_scores(rows).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    r AS (SELECT user_id, event_id, p, CAST(rank() OVER (PARTITION BY user_id ORDER BY round(value / 20)) AS BIGINT) AS r FROM e),
    x AS (SELECT a.user_id, sign(a.p - b.p) AS dp, sign(a.r - b.r) AS dr FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_id < b.event_id),
    s AS (SELECT user_id, sum(CASE WHEN dp * dr > 0 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN dp * dr < 0 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN dp = 0 AND dr <> 0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN dr = 0 AND dp <> 0 THEN 1 ELSE 0 END) AS tr FROM x GROUP BY user_id),
    n AS (SELECT user_id, count(*) AS n FROM r GROUP BY user_id)
    SELECT n.user_id AS question_id, n, round(coalesce(CASE WHEN (c + d + tp) * (c + d + tr) > 0 THEN (c - d) / sqrt((c + d + tp) * (c + d + tr)) END, 0.0), 6) AS tau FROM n LEFT JOIN s ON s.user_id = n.user_id""")
def kendall_tau(t: Tables) -> DataFrame:
    """All events of each user, by time and by value."""
    return orders(t)


def orders(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("p", F.row_number().over(w))
    r = e.withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.round(F.col("value") / 20))))
    a = r.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("item"), F.col("p").cast("long").alias("position"))
    b = r.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("item"), F.col("r").cast("long").alias("position"))
    return an.kendall_tau(a, b).withColumn("tau", F.round("tau", 6))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_summary(t: Tables) -> DataFrame:
    return an.latency_summary(t.events, "value", "event_type").withColumn("mean", F.round("mean", 4))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY event_type")
def distribution_summary(t: Tables) -> DataFrame:
    out = an.distribution_summary(t.events, "value", "event_type")
    return out.select("event_type", "n", F.round("mean", 4).alias("mean"), *(F.round(c, 6).alias(c) for c in ("p25", "median", "p75")))


@query("""WITH v AS (SELECT event_type, (event_id % 1000) / 999.0 AS s FROM events), c AS (SELECT event_type, CAST(least(29, floor(s * 30)) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY ALL)
    SELECT event_type, bin, n, round(n * 30 / sum(n) OVER (PARTITION BY event_type), 6) AS density FROM c""")
def similarity_histogram(t: Tables) -> DataFrame:
    return an.histogram(t.events.select("event_type", ((F.col("event_id") % 1000) / 999.0).alias("s")), "s", "event_type").withColumn("density", F.round("density", 6))


def evidence(t: Tables, most: int = max(an.CUTOFFS)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, evidence, results): an item is a question and its own evidence; documents that share its rarer words are results."""
    from engramix.plans.retrieval_queries import doc_memories, items
    from engramix.operators import retrieval as rt

    top = rt.bm25_topk(doc_memories(t), items(t), most)
    results = top.join(doc_memories(t), "id").select(F.col("query_id").alias("question_id"), F.col("rank"), "text", "score")
    questions = t.benchmark.select(F.col("item_id").alias("question_id"), (F.col("item_id") % 4).cast("string").alias("category"))
    return questions, t.benchmark.select(F.col("item_id").alias("question_id"), F.lit("e0").alias("evidence_id"), "text"), results


def _ev() -> str:
    from engramix.plans.retrieval_queries import BM25

    tok = lambda c: f"list_distinct(list_filter({sql_raw(c)}, lambda x: length(x) > 2))"
    return f"""{BM25}, res AS (SELECT query_id AS question_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS rank FROM raw QUALIFY rank <= 200),
    pr AS (SELECT question_id, rank, len(list_intersect({tok('b.text')}, {tok('d.text')})) / len({tok('b.text')}) AS rec FROM res JOIN benchmark b ON b.item_id = question_id JOIN documents d ON d.doc_id = id),
    bst AS (SELECT question_id, max(rec) AS rec, min_by(rank, struct_pack(a := -rec, b := rank)) AS rank FROM pr WHERE rec > 0 GROUP BY question_id),
    rk AS (SELECT item_id AS question_id, CASE WHEN rec >= 0.55 THEN rank END AS rank, round(coalesce(rec, 0), 4) AS recall FROM benchmark LEFT JOIN bst ON bst.question_id = item_id)"""


@query(f"WITH {_ev()} SELECT question_id, 'e0' AS evidence_id, CAST(rank AS INTEGER) AS rank, recall FROM rk")
def evidence_rank(t: Tables) -> DataFrame:
    _, e, r = evidence(t)
    return an.best_match(e, r)


@query(f"""WITH {_ev()}, qq AS (SELECT question_id, CAST(question_id % 4 AS VARCHAR) AS category, k, CASE WHEN rank <= k THEN 1 ELSE 0 END AS h FROM rk, (VALUES (10), (20), (50), (200)) c(k))
    SELECT k, coalesce(category, 'all') AS category, count(*) AS question_total, CAST(sum(h) AS BIGINT) AS question_hits, count(*) AS evidence_total, CAST(sum(h) AS BIGINT) AS evidence_hits, round(sum(h) / count(*), 6) AS question_recall, round(sum(h) / count(*), 6) AS evidence_recall
    FROM qq GROUP BY GROUPING SETS ((k, category), (k))""")
def recall_at_k(t: Tables) -> DataFrame:
    """Of as many results as the largest cutoff."""
    q, e, r = evidence(t)
    out = an.recall_at_k(an.best_match(e, r), q)
    return out.select("k", F.coalesce("category", F.lit("all")).alias("category"), "question_total", "question_hits", "evidence_total", "evidence_hits", F.round("question_recall", 6).alias("question_recall"), F.round("evidence_recall", 6).alias("evidence_recall"))


@query("""WITH r AS (SELECT l_orderkey AS question_id, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INTEGER) END AS rank FROM lineitem),
    p AS (SELECT question_id, count(*) AS n, count(rank) AS f, max(rank) AS max_rank FROM r GROUP BY question_id)
    SELECT question_id, k, coalesce(n = f AND max_rank <= k, false) AS complete, max_rank FROM p, (VALUES (20), (40)) c(k)""")
def all_evidence_within_k(t: Tables) -> DataFrame:
    r = t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int")).alias("rank"))
    return an.all_evidence_within(r, (20, 40))


CAND = """c AS (SELECT l_orderkey AS question_id, l_linenumber AS rank, round(0.3 + l_discount * 4 + l_tax, 4) AS sem, round(l_tax * 9, 4) AS lex, CAST(l_quantity AS INTEGER) % 6 AS shared FROM lineitem)"""


@query(f"""WITH {CAND}, w AS (SELECT *, avg(sem) OVER w AS mu, stddev_pop(sem) OVER w AS sigma, max(sem) OVER w AS top1, coalesce(nth_value(sem, 2) OVER (PARTITION BY question_id ORDER BY sem DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS top2 FROM c WINDOW w AS (PARTITION BY question_id)),
    z AS (SELECT *, mu AS m9, sigma AS s9, top1 - top2 AS margin FROM w),
    r AS (SELECT *, CASE WHEN sem >= 0.60 AND shared >= 1 THEN 'R1' WHEN sem >= 0.54 AND (sem >= m9 + 0.9 * s9 OR (margin >= 0.06 AND (top1 - m9) / greatest(1e-6, s9) >= 0.8)) THEN 'R2' WHEN lex >= 0.60 AND shared >= 3 THEN 'R3' END AS rule FROM z)
    SELECT question_id, min(CASE WHEN rule IS NOT NULL THEN rank END) AS rank, (min(struct_pack(r := rank, u := rule)) FILTER (rule IS NOT NULL)).u AS rule, round(any_value(mu), 7) AS mu, round(any_value(sigma), 7) AS sigma, round(any_value(margin), 7) AS margin FROM r GROUP BY question_id""")
def calibrated_rank(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.lit("e").alias("evidence_id"), F.col("l_linenumber").alias("rank"), F.round(0.3 + F.col("l_discount") * 4 + F.col("l_tax"), 4).alias("sem"), F.round(F.col("l_tax") * 9, 4).alias("lex"), (F.col("l_quantity").cast("int") % 6).alias("shared"))
    return an.calibrated_hits(c).select("question_id", "rank", "rule", *(F.round(n, 7).alias(n) for n in ("mu", "sigma", "margin")))


@query(f"""WITH {CAND} SELECT question_id, rank, (sem >= 0.58 AND shared >= 1) OR (sem >= 0.52 AND lex >= 0.35 AND shared >= 2) OR (lex >= 0.60 AND shared >= 3) OR (lex >= 0.50 AND shared >= 4) AS matched FROM c""")
def event_match(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), F.round(0.3 + F.col("l_discount") * 4 + F.col("l_tax"), 4).alias("sem"), F.round(F.col("l_tax") * 9, 4).alias("lex"), (F.col("l_quantity").cast("int") % 6).alias("shared"))
    return c.select("question_id", "rank", cl.event_match(F.col("sem"), F.col("lex"), F.col("shared")).alias("matched"))


def runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two runs: quality in one, its opposite of toxicity in the other; each lacks some questions."""
    lab = t.labels.select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return lab.where("question_id % 7 <> 0").select("question_id", F.col("a").alias("correct")), lab.where("question_id % 5 <> 0").select("question_id", F.col("b").alias("correct"))


RUNS = """o AS (SELECT doc_id AS question_id, quality = 1 AS correct FROM labels WHERE doc_id % 7 <> 0), n AS (SELECT doc_id AS question_id, toxic = 0 AS correct FROM labels WHERE doc_id % 5 <> 0)"""
TRANS = "CASE WHEN o.correct AND n.correct THEN 'both_correct' WHEN NOT o.correct AND NOT n.correct THEN 'both_wrong' WHEN o.correct THEN 'lost_correct_to_wrong' ELSE 'gained_wrong_to_correct' END"


@query(f"WITH {RUNS} SELECT count(*) FILTER (o.question_id IS NOT NULL AND n.question_id IS NOT NULL) AS aligned, count(*) FILTER (n.question_id IS NULL) AS old_only, count(*) FILTER (o.question_id IS NULL) AS new_only FROM o FULL OUTER JOIN n ON o.question_id = n.question_id")
def run_alignment(t: Tables) -> DataFrame:
    return an.aligned(*runs(t))[1]


@query(f"WITH {RUNS} SELECT question_id, {TRANS} AS transition FROM o JOIN n USING (question_id)")
def run_diff(t: Tables) -> DataFrame:
    both, _ = an.aligned(*runs(t))
    return both.select("question_id", cl.transition(F.col("old_correct"), F.col("new_correct")).alias("transition"))


@query(f"WITH {RUNS} SELECT source AS conversation, {TRANS} AS transition, count(*) AS n FROM o JOIN n USING (question_id) JOIN documents d ON d.doc_id = question_id GROUP BY ALL")
def transition_matrix(t: Tables) -> DataFrame:
    both, _ = an.aligned(*runs(t))
    named = both.join(t.documents.select(F.col("doc_id").alias("question_id"), F.col("source").alias("conversation")), "question_id")
    return named.groupBy("conversation", cl.transition(F.col("old_correct"), F.col("new_correct")).alias("transition")).agg(F.count("*").alias("n"))


SYS = f"""{LAB}, s AS (SELECT doc_id AS question_id, quality = 1 AS a, toxic = 0 AS b, n_chars % 2 = 0 AS c, lang FROM l),
    k AS (SELECT *, concat_ws('_', CASE WHEN NOT a THEN 'a' END, CASE WHEN NOT b THEN 'b' END, CASE WHEN NOT c THEN 'c' END) AS wrong, concat_ws('_', CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN c THEN 'c' END) AS good FROM s),
    f AS (SELECT *, 'a' || CASE WHEN a THEN 'C' ELSE 'W' END || '_b' || CASE WHEN b THEN 'C' ELSE 'W' END || '_c' || CASE WHEN c THEN 'C' ELSE 'W' END AS pattern, CASE WHEN wrong = '' THEN 'all_correct' WHEN good = '' THEN 'all_wrong' ELSE wrong || '_wrong_' || good || '_correct' END AS bucket FROM k)"""


def systems(t: Tables) -> dict[str, DataFrame]:
    s = labelled(t).withColumn("question_id", F.col("doc_id"))
    return {"a": s.select("question_id", (F.col("quality") == 1).alias("correct")), "b": s.select("question_id", (F.col("toxic") == 0).alias("correct")), "c": s.select("question_id", (F.col("n_chars") % 2 == 0).alias("correct"))}


@query(f"WITH {SYS} SELECT question_id, pattern, bucket FROM f")
def three_way_compare(t: Tables) -> DataFrame:
    return an.three_way(systems(t)).select("question_id", "pattern", "bucket")


@query(f"WITH {SYS} SELECT lang AS category, bucket, count(*) AS n FROM f GROUP BY ALL")
def bucket_counts(t: Tables) -> DataFrame:
    named = an.three_way(systems(t)).join(t.documents.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("category")), "question_id")
    return named.groupBy("category", "bucket").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT 'a' AS system, doc_id FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT 'b', doc_id FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT 'c', doc_id FROM labels)
    SELECT system, (SELECT count(DISTINCT doc_id) FROM r) - count(DISTINCT doc_id) AS missing FROM r GROUP BY system""")
def missing_questions(t: Tables) -> DataFrame:
    q = t.labels.select(F.col("doc_id").alias("question_id"))
    return an.missing({"a": q.where("question_id % 2 = 0"), "b": q.where("question_id % 3 = 0"), "c": q})


@query("""SELECT doc_id FROM labels WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'""")
def id_intersection(t: Tables) -> DataFrame:
    both, _ = an.aligned(t.labels.where("doc_id % 2 = 0").select("doc_id"), t.documents.where("lang = 'en'").select("doc_id"), "doc_id")
    return both.distinct()


@query("""SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels""")
def id_difference(t: Tables) -> DataFrame:
    return ck.remaining(t.documents.where("lang = 'en'").select("doc_id"), t.labels, ["doc_id"]).distinct()


HAY = f"""h AS (SELECT b.item_id AS question_id, b.text AS answer, d.text AS retrieved, d.lang AS category FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3),
    w AS (SELECT *, list_filter({sql_raw('answer')}, lambda x: length(x) > 2 AND NOT list_contains({words(tx.FAILURE_STOPWORDS)}, x)) AS ws, trim(regexp_replace(lower(retrieved), '[^a-z0-9]+', ' ', 'g')) AS hay FROM h),
    r AS (SELECT *, len(list_filter(ws, lambda x: contains(hay, x))) / greatest(1, len(ws)) AS ratio FROM w),
    f AS (SELECT question_id, category, round(ratio, 4) AS hit_ratio, CASE WHEN ratio >= 0.8 THEN 'evidence_present_answer_failed' WHEN ratio >= 0.3 THEN 'partial_evidence_or_distractor' ELSE 'evidence_missing_or_low_recall' END AS root FROM r)"""


def failures(t: Tables) -> DataFrame:
    b = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("answer"))
    h = b.join(t.documents.select((F.col("doc_id") / 3).alias("x"), "doc_id", F.col("text").alias("retrieved"), F.col("lang").alias("category")), F.col("doc_id") == F.col("question_id") * 3)
    ratio = cl.failure_hit_ratio(F.col("answer"), F.col("retrieved"))
    return h.select("question_id", "category", F.round(ratio, 4).alias("hit_ratio"), cl.failure_root(ratio).alias("root"))


@query(f"WITH {HAY} SELECT * FROM f")
def failure_classes(t: Tables) -> DataFrame:
    return failures(t)


@query(f"""WITH {HAY}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY root ORDER BY question_id) AS INTEGER) AS n, count(*) OVER (PARTITION BY root) AS total FROM f)
    SELECT root, total, n, question_id, category FROM n WHERE n <= 8""")
def failure_report(t: Tables) -> DataFrame:
    return an.failure_report(failures(t))


@query("""WITH r AS (SELECT doc_id AS question_id, CASE doc_id % 5 WHEN 0 THEN 'The date is wrong' WHEN 1 THEN 'It does not include the item' WHEN 2 THEN 'Not enough information, contradicts' WHEN 3 THEN 'Fine' ELSE 'A different yesterday' END AS reason FROM labels),
    t AS (SELECT question_id, list_filter([CASE WHEN regexp_matches(lower(reason), 'date|time|year|month|day|temporal|week|before|after|yesterday') THEN 'temporal_or_date_wrong' END,
      CASE WHEN contains(lower(reason), 'not include') OR contains(lower(reason), 'missing') THEN 'missing_required_item' END, CASE WHEN contains(lower(reason), 'not enough') THEN 'abstained_or_insufficient_context' END,
      CASE WHEN contains(lower(reason), 'different') OR contains(lower(reason), 'contradict') THEN 'wrong_or_conflicting_fact' END], lambda x: x IS NOT NULL) AS tags FROM r)
    SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag""")
def failure_tag_counts(t: Tables) -> DataFrame:
    texts = ["The date is wrong", "It does not include the item", "Not enough information, contradicts", "Fine", "A different yesterday"]
    reason = F.element_at(tx.strings(texts), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.labels.select(F.explode(cl.failure_tags(reason, F.lit(""))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


VERD = """o AS (SELECT doc_id AS question_id, 'q' || doc_id AS question, CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict FROM labels),
    n AS (SELECT CASE WHEN doc_id % 10 = 0 THEN -doc_id - 1 ELSE doc_id END AS question_id, 'q' || doc_id AS question, CASE WHEN doc_id % 19 = 0 THEN 'error' WHEN toxic = 0 THEN 'correct' ELSE 'incorrect' END AS verdict FROM labels WHERE doc_id % 6 <> 0),
    f AS (SELECT o.question_id, o.verdict AS old_verdict, n.verdict AS new_verdict, CASE WHEN o.verdict = n.verdict THEN 'unchanged' WHEN n.verdict = 'correct' THEN 'improvement' ELSE 'regression' END AS change FROM o JOIN n ON o.question_id = n.question_id OR o.question = n.question)"""


def verdicts(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    q = F.concat(F.lit("q"), d.cast("string")).alias("question")
    old = t.labels.select(d.alias("question_id"), q, F.when(d % 17 == 0, "error").when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("verdict"))
    new = t.labels.where("doc_id % 6 <> 0").select(F.when(d % 10 == 0, -d - 1).otherwise(d).alias("question_id"), q, F.when(d % 19 == 0, "error").when(F.col("toxic") == 0, "correct").otherwise("incorrect").alias("verdict"))
    return old, new


@query(f"WITH {VERD} SELECT * FROM f")
def flip_analysis(t: Tables) -> DataFrame:
    return an.flips(*verdicts(t))


@query(f"""WITH {VERD} SELECT count(*) FILTER (change = 'improvement') AS improvements, count(*) FILTER (change = 'regression') AS regressions, count(*) FILTER (change = 'improvement') - count(*) FILTER (change = 'regression') AS net,
    count(*) FILTER (change = 'unchanged' AND new_verdict = 'correct') AS unchanged_correct, count(*) FILTER (change = 'unchanged' AND new_verdict <> 'correct') AS unchanged_incorrect FROM f""")
def flip_summary(t: Tables) -> DataFrame:
    return an.flip_summary(an.flips(*verdicts(t)))


@query(f"""WITH {LAB}, o AS (SELECT lang AS grp, 100.0 * avg(quality) AS a FROM l WHERE lang <> 'de' GROUP BY lang), n AS (SELECT lang AS grp, 100.0 * avg(1 - toxic) AS a FROM l WHERE lang <> 'fr' GROUP BY lang)
    SELECT grp, round(n.a - o.a, 2) AS accuracy_delta, round(n.a - o.a, 2) AS score_delta FROM o JOIN n USING (grp)""")
def metric_delta(t: Tables) -> DataFrame:
    lab = labelled(t)
    old = an.group_metrics(lab.where("lang <> 'de'").withColumns({"grp": F.col("lang"), "score": F.col("quality")}))
    new = an.group_metrics(lab.where("lang <> 'fr'").withColumns({"grp": F.col("lang"), "score": 1 - F.col("toxic")}))
    return an.metric_delta(old, new)


@query("""WITH a(key, value) AS (VALUES ('top_k', '200'), ('model', '"x"'), ('seed', '42'), ('old', 'true')), b(key, value) AS (VALUES ('top_k', '50'), ('model', '"x"'), ('seed', '42'), ('new', 'null'))
    SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new FROM a FULL OUTER JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def config_diff(t: Tables) -> DataFrame:
    frame = lambda rows: t.spark.createDataFrame(rows, "key string, value string")
    return an.config_diff(frame([("top_k", "200"), ("model", '"x"'), ("seed", "42"), ("old", "true")]), frame([("top_k", "50"), ("model", '"x"'), ("seed", "42"), ("new", "null")]))


@query("""WITH q AS (SELECT conv_id AS conv_idx, turn % 3 + 1 AS s, turn FROM conversations WHERE turn % 2 = 0)
    SELECT q.conv_idx, 'D' || s || ':' || q.turn AS dia_id, '[D' || s || ':' || q.turn || ', said on day ' || s || '] ' || c.role || ': ' || c.text AS evidence FROM q JOIN conversations c ON c.conv_id = q.conv_idx AND c.turn = q.turn""")
def evidence_lookup_join(t: Tables) -> DataFrame:
    from engramix.sources.datasets import evidence_lines

    s = (F.col("turn") % 3 + 1).cast("string")
    turns = t.conversations.select(F.col("conv_id").alias("conv_idx"), F.concat(F.lit("D"), s, F.lit(":"), F.col("turn").cast("string")).alias("dia_id"), F.col("role").alias("speaker"), "text", F.concat(F.lit("day "), s).alias("session_date"), "turn")
    refs = turns.where("turn % 2 = 0").select("conv_idx", "dia_id")
    return refs.join(evidence_lines(turns), ["conv_idx", "dia_id"])


@query("SELECT conv_id, count(*) AS todo FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.turn % 3 = 0) GROUP BY conv_id")
def session_resume_antijoin(t: Tables) -> DataFrame:
    from engramix.sources.checkpoints import remaining

    done = t.conversations.where("turn % 3 = 0").select("conv_id", "turn")
    return remaining(t.conversations, done, ["conv_id", "turn"]).groupBy("conv_id").agg(F.count("*").alias("todo"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 20")
def stratified_sample(t: Tables) -> DataFrame:
    return an.stratified(t.documents, "lang", 20, "doc_id").select("doc_id", "lang")


@query("""SELECT o_orderkey AS id, o_orderpriority AS benchmark, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def run_catalog_list(t: Tables) -> DataFrame:
    from engramix.sources.runs import list_runs

    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("benchmark"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    return list_runs(rows, {"status": "completed", "benchmark": "1-URGENT"}, 50).select("id", "benchmark", "status")


@query("""SELECT l_orderkey AS question_id, k, count(*) AS effective_k, max(round(l_discount, 2)) AS best FROM lineitem, (VALUES (1), (3), (5)) c(k) WHERE l_linenumber <= k GROUP BY ALL""")
def max_similarity_by_k(t: Tables) -> DataFrame:
    r = t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), F.round("l_discount", 2).alias("score"))
    return an.max_similarity_by_k(r, (1, 3, 5))


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'I do not know' WHEN 1 THEN 'It is NOT MENTIONED there' WHEN 2 THEN 'Paris' ELSE 'cannot determine' END AS a FROM events)
    SELECT event_id, regexp_matches(lower(a), 'not specify|not specified|not mentioned|no information|not available|do not know|don''t know|cannot determine') AS abstained FROM e""")
def abstention(t: Tables) -> DataFrame:
    a = F.element_at(tx.strings(["I do not know", "It is NOT MENTIONED there", "Paris", "cannot determine"]), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", tx.abstained(a).alias("abstained"))


@query("""WITH x AS (SELECT event_id, user_id, event_type, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS logistic, round(1 / (1 + 0.001 * power(event_id % 50, 2)), 6) AS spread, CASE WHEN value / 100 >= 0.75 THEN CAST(1 AS DOUBLE) WHEN value / 100 >= 0.25 THEN 0.5 ELSE 0.0 END AS nugget FROM x""")
def score_functions(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(nm.sigmoid((F.col("value") - 50) / 10), 6).alias("logistic"), F.round(nm.spread(F.col("event_id") % 50 + 1), 6).alias("spread"), nm.nugget(F.col("value") / 100).alias("nugget"))


@query("""WITH w AS (SELECT event_id, user_id, ts, strftime(ts, '%Y-%m-%d') AS d FROM events), f AS (SELECT *, CASE WHEN lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) = d THEN 0 ELSE 1 END AS new FROM w)
    SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM f""")
def session_boundaries(t: Tables) -> DataFrame:
    from engramix.streaming.batch import sessions

    return sessions(t.events.withColumn("d", F.date_format("ts", "yyyy-MM-dd")), "user_id", "d", ["ts", "event_id"]).select("event_id", "user_id", "session")


@query("""WITH m AS (SELECT doc_id, source, n_chars, strftime(DATE '2023-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m') AS month FROM documents)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY month, n_chars DESC, doc_id) AS INTEGER) AS position FROM m""")
def hybrid_context_order(t: Tables) -> DataFrame:
    from engramix.operators.context import ordered

    rows = t.documents.select("doc_id", F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string").alias("created_at"))
    return ordered(rows, "hybrid").select("doc_id", "position")

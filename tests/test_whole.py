"""Queries run over whole tables, lists and texts."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from engramix.operators import analytics as an
from engramix.operators import retrieval as rt
from engramix.plans import catalogue
from engramix.storage import BATCH_SETTING

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_source_bound_has_all_documents(spark):
    docs = table(spark, "documents")
    assert docs.where("coalesce(n_chars, 2000) >= 2000").count() > 0
    assert sorted(r["doc_id"] for r in run(spark, "source_bound").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def brute_tau(p, r):
    sign = lambda a, b: (a > b) - (a < b)
    s = [(sign(p[i], p[j]), sign(r[i], r[j])) for i in range(len(p)) for j in range(i)]
    num, x, y = sum(a * b for a, b in s), sum(a != 0 for a, _ in s), sum(b != 0 for _, b in s)
    return num / (x * y) ** 0.5 if x * y else 0.0


def test_kendall_ranks_whole_lists(spark):
    lengths = {r["user_id"]: r["count"] for r in table(spark, "events").groupBy("user_id").count().collect()}
    assert max(lengths.values()) > 8
    assert {r["question_id"]: r["n"] for r in run(spark, "kendall_tau").collect()} == lengths
    rnd = random.Random(5)
    for n, top in ((0, 1), (1, 1), (2, 1), (7, 3), (64, 5), (65, 1000), (200, 30)):
        p, r = ([rnd.randint(-top, top) for _ in range(n)] for _ in "pr")
        assert abs(an.tau_b(np.array(p, "int64"), np.array(r, "int64")) - brute_tau(p, r)) < 1e-12
    n = 60_000  # pairs of such a list could not be joined
    rows = spark.range(n).select(F.lit("q").alias("question_id"), F.col("id").alias("item"), F.col("id").alias("position"))
    assert [tuple(x) for x in an.kendall_tau(rows, rows.withColumn("position", -F.col("position"))).collect()] == [("q", n, -1.0)]


def test_starts_and_scores_of_all_rows(spark):
    day = F.date_format("ts", "yyyy-MM-dd")
    e = table(spark, "events").select(day.alias("scope"), F.concat(F.lit("u"), "user_id").alias("head"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("tail"))
    ends = e.select("scope", "head").union(e.select("scope", "tail")).dropna().distinct()
    assert {tuple(r) for r in run(spark, "start_resolution").select("scope", "name").collect()} == {tuple(r) for r in ends.collect()}
    scored = {r["query_id"] for r in run(spark, "bm25_scores").select("query_id").distinct().collect()}
    assert scored == {r["query_id"] for r in run(spark, "bm25_topk").collect()} and any(q % 10 for q in scored)


def test_evidence_is_met_up_to_the_largest_cutoff(spark, tmp_path):
    # One rare word makes 120 short documents outrank the one that holds the whole evidence.
    words = [f"word{i}" for i in range(12)]
    docs = [(i, "zebra") for i in range(120)] + [(500, " ".join(["zebra", *words]) + " filler" * 2000)]
    docs += [(2000 + i, f"other{i}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(["zebra", *words]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ranks = catalogue.QUERIES["evidence_rank"](spark, str(tmp_path)).collect()
    assert [(r["question_id"], r["rank"] is not None and 50 < r["rank"] <= 200) for r in ranks] == [(1, True)], ranks
    hits = {r["k"]: r["evidence_hits"] for r in catalogue.QUERIES["recall_at_k"](spark, str(tmp_path)).where("category = 'all'").collect()}
    assert hits == {10: 0, 20: 0, 50: 0, 200: 1}


def test_context_holds_whole_memories(spark, tmp_path):
    long, short = "apple pear plum " + "filler " * 300, "apple pear"
    spark.createDataFrame([(1, long), (2, short), (3, "nothing here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "apple pear plum")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalogue.QUERIES["context_budget"](spark, str(tmp_path)).collect()
    lines = [f"{i}. [{d}] [2023-01-01] [] {t}" for i, (d, t) in enumerate([(1, long), (2, short)], 1)]
    assert [r["context_md5"] for r in found] == [hashlib.md5("\n".join(lines).encode()).hexdigest()]


def test_calibration_does_not_depend_on_the_order_of_arrival(spark):
    # The second best is just at mean + 0.9 deviations (0.46 + 0.09), which sums in another order miss.
    group = [(4, 0.59, 0.45, 3), (1, 0.55, 0.09, 0), (5, 0.42, 0.0, 5), (4, 0.31, 0.09, 5), (1, 0.43, 0.45, 4)]
    rows = [(q, "e", *r) for q, way in enumerate(itertools.permutations(group)) for r in way]
    c = spark.createDataFrame(rows, "question_id int, evidence_id string, rank int, sem double, lex double, shared int").coalesce(1)
    found = an.calibrated_hits(c).select("rank", "rule", "mu", "sigma", "margin").collect()
    assert len(found) == 120 and len({tuple(r) for r in found}) == 1 and (found[0]["rank"], found[0]["rule"]) == (1, "R2")


def test_keyword_scores_stay_in_their_task(spark, tmp_path):
    docs = [(1, "apple pear apple"), (2, "pear plum fig"), (3, None), (4, "none"), (5, "fig apple")]
    spark.createDataFrame([(1, "apple fig"), (2, "pear pear")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for again in ([], [(1, "plum apple fig"), (1, "fig"), (5, "fig apple")]):
        spark.createDataFrame(docs + again, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        df = catalogue.QUERIES["bm25_scores"](spark, str(tmp_path))
        db = duckdb.connect()
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert sorted(map(tuple, df.collect())) == sorted(db.execute(catalogue.ORACLE_SQL["bm25_scores"]).fetchall())
        # Only ids that several memories have are shuffled.
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert again or "Exchange" not in plan, plan


def test_keyword_search_takes_texts_in_bounded_batches(spark):
    had = dict(spark.conf.getAll).get(BATCH_SETTING)
    spark.conf.unset(BATCH_SETTING)
    try:
        texts = spark.createDataFrame([(1, "apple")], "id long, text string")
        rt.bm25_topk(texts, texts.withColumnRenamed("id", "query_id"), 1).collect()
        assert 0 < int(spark.conf.get(BATCH_SETTING)) <= 4 << 20
    finally:
        spark.conf.unset(BATCH_SETTING)
        if had:
            spark.conf.set(BATCH_SETTING, had)


def test_boosts_are_not_grouped_pair_by_pair(spark):
    wanted = spark.createDataFrame([(7, 1, [1.0, 0.0]), (7, 2, [0.0, 1.0])], "query_id long, position int, vector array<double>")
    entities = spark.createDataFrame([("a", [1.0, 0.0], [1, 2]), ("b", [0.6, 0.8], [2, 3, 4]), ("c", [-1.0, -1.0], [5])], "entity_id string, vector array<double>, linked array<long>")
    df = rt.entity_boosts(wanted, entities)
    a, b = 0.5 / (1 + 0.001), 0.8 * 0.5 / (1 + 0.004)
    found = {(r["query_id"], r["id"]): r["boost"] for r in df.collect()}
    assert found.keys() == {(7, i) for i in (1, 2, 3, 4)} and all(abs(found[7, i] - x) < 1e-6 for i, x in ((1, a), (2, a), (3, b), (4, b)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[query_id#\d+L?, id#\d+L?\]", plan), plan


def test_gate_splits_a_text_once(spark):
    plan = run(spark, "path_gate")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(text#") == 1, plan

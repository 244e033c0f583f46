"""Evaluation analytics: metrics, recall, rank correlation, diagnosis and comparison of runs, for runs of any size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import classify as cl
from engramix.functions import text as tx

CUTOFFS = (10, 20, 50, 200)


def group_metrics(results: DataFrame, group: str = "grp", score: str = "score", threshold: float = 0.5, scale: float = 100.0) -> DataFrame:
    """grp, total, correct, accuracy (%), avg_score: a missing group is unknown, a missing score 0."""
    s = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    n, good = F.count("*"), F.sum(F.when(s >= threshold, 1).otherwise(0))
    return results.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("grp")).agg(n.alias("total"), good.alias("correct"), (100.0 * good / n).alias("accuracy"), (F.avg(s) * scale).alias("avg_score"))


def cutoff_metrics(results: DataFrame, threshold: float = 0.5, scale: float = 100.0) -> DataFrame:
    """The same for each cutoff, by group and overall (grp null), with errors. results: cutoff, grp, score, judgment, error."""
    s = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    bad = (F.coalesce(F.col("judgment"), F.lit("")) == "ERROR") | F.col("error").isNotNull()
    rows = results.select("cutoff", F.coalesce("grp", F.lit("unknown")).alias("g"), s.alias("s"), bad.alias("bad"))
    n, good = F.count("*"), F.sum(F.when(F.col("s") >= threshold, 1).otherwise(0))
    sets = rows.groupingSets([["cutoff", "g"], ["cutoff"]], "cutoff", "g")
    return sets.agg(n.alias("total"), good.alias("correct"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("errors"), (100.0 * good / n).alias("accuracy"), (F.avg("s") * scale).alias("avg_score"))


def primary_cutoff(metrics: DataFrame) -> DataFrame:
    """The rows of the last cutoff."""
    last = metrics.agg(F.max("cutoff").alias("cutoff"))
    return metrics.join(last, "cutoff", "left_semi")


def nugget_scores(nuggets: DataFrame, clamp: bool = True) -> DataFrame:
    """question_id, score (mean of the nuggets), passed (0.5 at least). nuggets: question_id, score."""
    from engramix.functions.numeric import nugget

    value = nugget(F.col("score")) if clamp else F.col("score")
    return nuggets.groupBy("question_id").agg(F.avg(value).alias("score"), F.count("*").alias("n")).withColumn("passed", F.col("score") >= 0.5)


def score_with_order(scores: DataFrame, taus: DataFrame) -> DataFrame:
    """Scores of ordering questions, averaged with their rank correlation moved to [0, 1]."""
    return scores.join(taus, "question_id", "left").withColumn("score_with_tau", F.when(F.col("tau").isNotNull(), (F.col("score") + (F.col("tau") + 1) / 2) / 2))


def kendall_tau(a: DataFrame, b: DataFrame, key: str = "question_id") -> DataFrame:
    """question_id, n, tau (tau-b) of two orders (key, item, position) over their common items; an item counts at its last position.

    Pairs are counted, not formed: a list of n items takes O(n log² n) time and O(n) memory.
    """
    last = lambda df, name: df.groupBy(key, "item").agg(F.max("position").alias(name))
    both = last(a, "p").join(last(b, "r"), [key, "item"])
    kind = both.schema[key].dataType.simpleString()

    def count(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [keys[0]], "n": [len(rows)], "tau": [tau_b(rows["p"].to_numpy(), rows["r"].to_numpy())]})

    found = both.where(F.col(key).isNotNull()).select(key, "p", "r").groupBy(key).applyInPandas(count, f"`{key}` {kind}, n long, tau double")
    all_keys = a.select(key).unionByName(b.select(key)).distinct()
    return all_keys.join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tau", F.lit(0.0)).alias("tau"))


def _tied(*columns: np.ndarray) -> int:
    """Pairs that are equal in all columns."""
    n = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
    return int((n * (n - 1) // 2).sum())


def _inversions(values: np.ndarray) -> int:
    """Pairs whose first value is larger than the second, counted between neighbouring blocks of doubling width."""
    v = np.unique(values, return_inverse=True)[1].astype(np.int64)
    at, base, total, width = np.arange(len(v)), len(v) + 1, 0, 1
    while width < len(v):
        pair, right = at // (2 * width), at // width % 2 == 1
        left = np.sort(pair[~right] * base + v[~right])
        whose = pair[right] * base
        total += int((np.searchsorted(left, whose + base) - np.searchsorted(left, whose + v[right], "right")).sum())
        width *= 2
    return total


def tau_b(p: np.ndarray, r: np.ndarray) -> float:
    """Kendall's tau-b of two columns of positions, 0.0 where it is not defined."""
    n = len(p)
    pairs, in_p, in_r, in_both = n * (n - 1) // 2, _tied(p), _tied(r), _tied(p, r)
    d = _inversions(r[np.lexsort((r, p))])
    c = pairs - in_p - in_r + in_both - d
    root = math.sqrt((pairs - in_p) * (pairs - in_r))
    return (c - d) / root if root else 0.0


def latency_summary(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Nearest-rank percentiles of latencies."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def distribution_summary(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Linear percentiles of a distribution."""
    return rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *(F.expr(f"percentile({value}, {p})").alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))))


def histogram(rows: DataFrame, value: str, by: str, bins: int = 30) -> DataFrame:
    """Density of values in [0, 1] over equal bins."""
    w = Window.partitionBy(by)
    b = F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int")
    counted = rows.where(F.col(value).between(0, 1)).groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("density", F.col("n") * bins / F.sum("n").over(w))


def best_match(evidence: DataFrame, results: DataFrame, least: float = 0.55) -> DataFrame:
    """question_id, evidence_id, rank, recall: the result that has most of a piece of evidence, the first of equals; rank null below ``least``.

    evidence: question_id, evidence_id, text; results: question_id, rank, text. Only results
    that share a word with the evidence meet it.
    """
    e = evidence.withColumn("own", tx.plain_tokens(F.col("text"))).select("question_id", "evidence_id", "own")
    r = results.withColumn("there", tx.plain_tokens(F.col("text"))).select("question_id", "rank", "there")
    pairs = e.join(r, "question_id").withColumn("recall", F.when(F.size("own") > 0, tx.overlap(F.col("own"), F.col("there")) / F.size("own")).otherwise(0.0)).where("recall > 0")
    best = pairs.groupBy("question_id", "evidence_id").agg(F.max(F.struct("recall", (-F.col("rank")).alias("back"))).alias("x"))
    found = e.join(best, ["question_id", "evidence_id"], "left")
    recall = F.coalesce("x.recall", F.lit(0.0))
    return found.select("question_id", "evidence_id", F.when(recall >= least, -F.col("x.back")).alias("rank"), F.round(recall, 4).alias("recall"))


def recall_at_k(ranks: DataFrame, questions: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """category (null: all), k, question and evidence totals, hits and recalls.

    ranks: question_id, evidence_id, rank (null: not found); questions: question_id, category.
    """
    spark = ranks.sparkSession
    ks = spark.createDataFrame([(k,) for k in cutoffs], "k int")
    rows = questions.select("question_id", "category").join(ranks.select("question_id", "evidence_id", "rank"), "question_id", "left").crossJoin(F.broadcast(ks))  # a few cutoffs
    per = rows.groupBy("question_id", "category", "k").agg(F.count("evidence_id").alias("e"), F.sum(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("h"))
    out = per.groupingSets([["k", "category"], ["k"]], "k", "category").agg(F.count("*").alias("question_total"), F.sum(F.when(F.col("h") > 0, 1).otherwise(0)).alias("question_hits"), F.sum("e").alias("evidence_total"), F.sum("h").alias("evidence_hits"))
    return out.withColumns({"question_recall": F.col("question_hits") / F.col("question_total"), "evidence_recall": F.when(F.col("evidence_total") > 0, F.col("evidence_hits") / F.col("evidence_total")).otherwise(0.0)})


def all_evidence_within(ranks: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """question_id, k, complete, max_rank: whether every piece of evidence is among the first k."""
    ks = ranks.sparkSession.createDataFrame([(k,) for k in cutoffs], "k int")
    per = ranks.groupBy("question_id").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.max("rank").alias("max_rank"))
    whole = (F.col("n") > 0) & (F.col("n") == F.col("found")) & (F.col("max_rank") <= F.col("k"))
    return per.crossJoin(F.broadcast(ks)).select("question_id", "k", F.coalesce(whole, F.lit(False)).alias("complete"), "max_rank")  # a few cutoffs


def calibrated_hits(candidates: DataFrame) -> DataFrame:
    """question_id, evidence_id, rank, rule, mu, sigma, margin: the first candidate that passes a rule.

    candidates: question_id, evidence_id, rank, sem, lex, shared.
    """
    w = Window.partitionBy("question_id", "evidence_id")
    order = w.orderBy(F.desc("sem"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Sums go from the largest down: in the order of arrival their last places would decide candidates that are just at a bound.
    c = candidates.withColumns({"mu": F.avg("sem").over(order), "sigma": F.stddev_pop("sem").over(order), "top1": F.max("sem").over(order), "top2": F.coalesce(F.nth_value("sem", 2).over(order), F.lit(0.0))})
    c = c.withColumn("margin", F.col("top1") - F.col("top2")).withColumn("z", (F.col("top1") - F.col("mu")) / F.greatest(F.lit(1e-6), F.col("sigma")))
    c = c.withColumn("rule", cl.rank_rule(F.col("sem"), F.col("lex"), F.col("shared"), F.col("mu"), F.col("sigma"), F.col("margin"), F.col("z")))
    hit = F.when(F.col("rule").isNotNull(), F.struct("rank", "rule"))
    out = c.groupBy("question_id", "evidence_id").agg(F.min(hit).alias("hit"), F.first("mu").alias("mu"), F.first("sigma").alias("sigma"), F.first("margin").alias("margin"))
    return out.select("question_id", "evidence_id", F.col("hit.rank").alias("rank"), F.col("hit.rule").alias("rule"), "mu", "sigma", "margin")


def aligned(old: DataFrame, new: DataFrame, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(rows of both runs, columns prefixed old_ and new_; one row with aligned, old_only and new_only counts)."""
    pre = lambda df, p: df.select(key, *(F.col(c).alias(p + c) for c in df.columns if c != key))
    both = pre(old, "old_").join(pre(new, "new_"), key)
    tally = old.select(key, F.lit(1).alias("o")).join(new.select(key, F.lit(1).alias("n")), key, "full_outer")
    counts = tally.agg(F.sum(F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), 1).otherwise(0)).alias("aligned"), F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)).alias("old_only"), F.sum(F.when(F.col("o").isNull(), 1).otherwise(0)).alias("new_only"))
    return both, counts


def three_way(systems: dict[str, DataFrame], key: str = "question_id") -> DataFrame:
    """question_id, pattern, bucket and the verdict of each system (question_id, correct), over the common questions."""
    joined = None
    for name, df in systems.items():
        part = df.select(key, F.col("correct").alias(name))
        joined = part if joined is None else joined.join(part, key)
    names = list(systems)
    verdicts = [F.col(n) for n in names]
    return joined.withColumns({"pattern": cl.pattern(names, verdicts), "bucket": cl.bucket(names, verdicts)})


def missing(systems: dict[str, DataFrame], key: str = "question_id") -> DataFrame:
    """system, missing: questions that some system has and this one lacks."""
    rows = None
    for name, df in systems.items():
        part = df.select(key).distinct().withColumn("system", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    have = rows.groupBy("system").agg(F.count("*").alias("own"))
    return have.crossJoin(rows.select(key).distinct().agg(F.count("*").alias("every"))).select("system", (F.col("every") - F.col("own")).alias("missing"))  # a row for each system


def flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """question_id, old_verdict, new_verdict, change: matched by id, else by the question's text. Runs have question_id, question, verdict."""
    n = new.select(F.col("question_id").alias("nid"), F.col("question").alias("nq"), F.col("verdict").alias("nv"))
    by_id = old.join(n, F.col("question_id") == F.col("nid"), "left")
    w = Window.partitionBy("nq").orderBy("nid")
    first = n.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("nq").alias("question"), F.col("nv").alias("tv"))
    joined = by_id.join(first, "question", "left").withColumn("new_verdict", F.coalesce("nv", "tv")).where("new_verdict is not null")
    return joined.select("question_id", F.col("verdict").alias("old_verdict"), "new_verdict", cl.verdict_change(F.col("verdict"), F.col("new_verdict")).alias("change"))


def flip_summary(changes: DataFrame) -> DataFrame:
    """One row: improvements, regressions, net, unchanged by kind (an unchanged error counts as incorrect)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    up, down, same = (F.col("change") == x for x in ("improvement", "regression", "unchanged"))
    return changes.agg(n(up).alias("improvements"), n(down).alias("regressions"), (n(up) - n(down)).alias("net"), n(same & (F.col("new_verdict") == "correct")).alias("unchanged_correct"), n(same & (F.col("new_verdict") != "correct")).alias("unchanged_incorrect"))


def metric_delta(old: DataFrame, new: DataFrame, key: str = "grp", decimals: int = 2) -> DataFrame:
    """Differences of metrics (grp, accuracy, avg_score) of the groups that both runs have."""
    o = old.select(key, F.col("accuracy").alias("oa"), F.col("avg_score").alias("os"))
    return new.join(o, key).select(key, F.round(F.col("accuracy") - F.col("oa"), decimals).alias("accuracy_delta"), F.round(F.col("avg_score") - F.col("os"), decimals).alias("score_delta"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, old, new of settings (key, value as JSON) that differ."""
    joined = a.select("key", F.col("value").alias("old")).join(b.select("key", F.col("value").alias("new")), "key", "full_outer")
    return joined.where(~F.col("old").eqNullSafe(F.col("new")))


def failure_report(failures: DataFrame, examples: int = 8) -> DataFrame:
    """The first examples of each root cause, with its size. failures: question_id, category, root."""
    w = Window.partitionBy("root")
    n = F.row_number().over(w.orderBy("question_id"))
    sizes = failures.groupBy("root").agg(F.count("*").alias("total"))
    return failures.withColumn("n", n).where(F.col("n") <= examples).join(sizes, "root").select("root", "total", "n", "question_id", "category")


def max_similarity_by_k(results: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """question_id, k, effective_k, best: the highest score among the first k results (question_id, rank, score)."""
    ks = results.sparkSession.createDataFrame([(k,) for k in cutoffs], "k int")
    return results.crossJoin(F.broadcast(ks)).where(F.col("rank") <= F.col("k")).groupBy("question_id", "k").agg(F.count("*").alias("effective_k"), F.max("score").alias("best"))  # a few cutoffs


def graph_ratio(routes: Column) -> Column:
    """Share of an array of route names that have the graph in them."""
    return F.when(F.size(routes) == 0, 0.0).otherwise(F.size(F.filter(routes, lambda r: r.contains("graph_bfs"))) / F.size(routes))


def text_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of texts, white space and case aside; 1 if both are empty."""
    flat = lambda c: F.array_distinct(F.transform(c, lambda t: F.regexp_replace(F.lower(F.trim(t)), "[ \\t\\n\\r\\f\\x0B]+", " ")))
    x, y = flat(a), flat(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y))))


def support(answer: Column, texts: Column) -> Column:
    """Share of the answer's words in the joined texts."""
    own = tx.plain_tokens(answer)
    return F.when(F.size(own) == 0, 0.0).otherwise(tx.overlap(own, tx.plain_tokens(F.array_join(texts, "\n"))) / F.size(own))


def bottleneck(timing: Column) -> Column:
    """The slowest stage of a map of milliseconds, the total aside."""
    stages = F.transform(F.filter(F.map_entries(timing), lambda e: e["key"] != "total"), lambda e: F.struct(e["value"].alias("ms"), e["key"].alias("stage")))
    return F.coalesce(F.array_max(stages)["stage"], F.lit(""))


def diagnose(both: DataFrame) -> DataFrame:
    """Transition, symptoms and primary issue of aligned runs.

    both: question_id, category, answer and for old_ and new_: correct, texts (array), routes
    (array), reply, total_ms.
    """
    sup = lambda p: support(F.col("answer"), F.col(p + "texts"))
    out = both.withColumns({
        "overlap": text_overlap(F.col("old_texts"), F.col("new_texts")), "old_support": sup("old_"), "new_support": sup("new_"),
        "old_graph": graph_ratio(F.col("old_routes")), "new_graph": graph_ratio(F.col("new_routes")), "transition": cl.transition(F.col("old_correct"), F.col("new_correct")),
    })
    out = out.withColumn("symptoms", cl.symptoms(F.col("overlap"), F.col("old_support"), F.col("new_support"), F.col("old_graph"), F.col("new_graph"), F.coalesce("category", F.lit("")), F.col("old_reply"), F.col("new_reply"), F.col("new_total_ms")))
    return out.withColumn("issue", cl.primary_issue(F.col("symptoms"), F.col("transition")))


def stratified(rows: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each stratum, chosen by a hash of seed and key."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def natural_key(question_id: Column) -> tuple[Column, Column, Column]:
    """Sort keys of ids like conv3_q12; others come last."""
    number = lambda p: F.regexp_extract(question_id, "conv(\\d+)_q(\\d+)", p)
    return F.when(number(1) == "", 1).otherwise(0), F.nullif(number(1), F.lit("")).cast("int"), F.nullif(number(2), F.lit("")).cast("int")

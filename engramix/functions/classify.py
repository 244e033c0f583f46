"""Rule cascades: intent of a question, transitions, symptoms, buckets, causes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramix.functions import text as tx


def cue(text: Column, pattern: str) -> Column:
    """Whether the pattern stands in the lower-case text between signs that aren't word characters (ASCII)."""
    return F.lower(text).rlike(f"(^|[^a-z0-9_])({pattern})([^a-z0-9_]|$)")


# How questions ask for counts, lists and dates, and what they are about.
COUNT_CUE = "how many|number of|count|total"
YES_NO_CUE = "did|does|do|is|are|was|were|has|have|had|can|could|will|would"
LIST_CUE = "which two|list|both|all|several|multiple"
LIST_OBJECT = "kind|kinds|type|types|things|activities|items|books|meals|recipes|events|recommendations"
WHEN_CUE = "when|what date|which month|which day|which year"
CHAIN_CUE = "before|after|last|next|during|in"
RELATION_HINTS = {
    "recommendation": "recommend|suggest|book|books|recipe|recipes|meal|meals",
    "preference": "favorite|like|likes|liked|prefer|preference|hobby|interest",
    "event": "event|attend|visited|went|meeting|class|trip|concert|plan",
    "health": "health|healthy|workout|exercise|yoga|lifting|weight|weights",
    "ownership": "own|owns|owned|buy|bought|purchase|console",
}


def query_plan(query: Column, entities: Column) -> Column:
    """What a question asks for: answer_shape, evidence_mode, target_entities, time_constraints, relation_hints, must_have_terms.

    ``entities`` is an array of struct(type, name).
    """
    low, terms = F.lower(query), tx.date_terms(query)
    temporal = (F.size(terms) > 0) | cue(query, WHEN_CUE)
    listed = cue(query, LIST_CUE) | low.rlike(f"(^|[^a-z0-9_])what([^a-z0-9_]|[^a-z0-9_].{{0,38}}[^a-z0-9_])({LIST_OBJECT})([^a-z0-9_]|$)")
    shape = (
        F.when(cue(query, COUNT_CUE), "count")
        .when(low.rlike(f"^[ \\t\\n]*({YES_NO_CUE})([^a-z0-9_]|$)") | cue(query, "yes or no|whether"), "yes_no")
        .when(temporal & cue(query, WHEN_CUE), "date")
        .when(listed, "list")
        .when(cue(query, "who"), "person")
        .when(cue(query, "where"), "location")
        .otherwise("span")
    )
    many = shape.isin("count", "list")
    targets = F.filter(entities, lambda e: F.trim(e["name"]) != "")
    mode = (
        F.when(temporal & many, "temporal_aggregate")
        .when(temporal & cue(query, CHAIN_CUE), "temporal_chain")
        .when(many, "aggregate")
        .when((F.size(targets) >= 2) | F.array_contains(tx.raw_tokens(query), "both"), "multi_hop")
        .otherwise("single_sentence")
    )
    hints = F.array_compact(F.array(*(F.when(cue(query, p), name) for name, p in RELATION_HINTS.items())))
    return F.struct(
        shape.alias("answer_shape"), mode.alias("evidence_mode"), F.slice(targets, 1, 8).alias("target_entities"),
        F.slice(terms, 1, 8).alias("time_constraints"), hints.alias("relation_hints"), F.slice(tx.content_tokens(query), 1, 12).alias("must_have_terms"),
    )


def time_match(terms: Column, memory: Column, created_at: Column) -> Column:
    """Whether every term is a word of the memory or its date, the date's year, or the name of its month."""
    created = F.lower(F.coalesce(created_at, F.lit("")))
    hay = F.concat_ws(" ", F.lower(F.coalesce(memory, F.lit(""))), created)
    words = F.split(hay, "[^a-z0-9_]+")
    months = F.create_map(*(F.lit(x) for pair in tx.MONTHS.items() for x in pair))

    def hit(term: Column) -> Column:
        word = F.array_contains(words, term) | F.when(term.rlike("[^a-z0-9_]"), F.contains(hay, term)).otherwise(False)
        year = term.rlike("^20[0-9]{2}$") & created.startswith(term)
        month = created.rlike("^20[0-9]{2}-[0-9]{2}") & F.coalesce(F.try_element_at(months, term) == F.substring(created, 6, 2), F.lit(False))
        return word | year | month

    return F.forall(F.filter(terms, lambda t: F.trim(t) != ""), lambda t: hit(F.lower(t)))


def shadow_gate(query: Column, plan: Column, memory: Column, entities: Column, created_at: Column, path_len: Column, backed: Column, words: Column | None = None) -> Column:
    """Reasons against a graph candidate; it is annotated, never dropped. ``entities`` are its names in lower case.

    ``words``: the memory's content words, where a column has them already.
    """
    words, low = tx.content_tokens(memory) if words is None else words, F.lower(memory)
    names = F.filter(F.transform(plan["target_entities"], lambda e: F.lower(F.trim(e["name"]))), lambda n: (n != "") & ~F.array_contains(tx.strings(tx.TEMPORAL_TERMS), n))

    def met(n: Column) -> Column:
        own = tx.content_tokens(n)
        return F.contains(low, n) | F.array_contains(entities, n) | ((F.size(own) > 0) & (F.size(F.array_except(own, words)) == 0))

    cover = tx.coverage(tx.content_tokens(query), words)
    timely = time_match(plan["time_constraints"], memory, created_at)
    hits = F.size(F.filter(names, met))
    against = F.array_compact(
        F.array(
            F.when((F.size(names) > 0) & (hits == 0), "missing_target_entity"),
            F.when(cover < 0.12, "low_query_coverage"),
            F.when(~timely, "time_mismatch"),
            F.when((path_len > 2) & (plan["evidence_mode"] == "single_sentence"), "long_path_for_single_sentence_query"),
        )
    )
    reasons = F.when(backed, tx.strings(["validator_backed"])).otherwise(against)
    return F.struct(
        backed.alias("validator_backed"), (~backed & (F.size(reasons) > 0)).alias("would_block"), reasons.alias("reasons"), F.round(cover, 4).alias("query_coverage"),
        hits.alias("target_entity_hits"), F.size(names).alias("target_entity_total"), timely.alias("time_compatible"), path_len.alias("path_len"),
    )


def transition(old: Column, new: Column) -> Column:
    """How a verdict changed between two runs."""
    return F.when(old & new, "both_correct").when(~old & ~new, "both_wrong").when(old, "lost_correct_to_wrong").otherwise("gained_wrong_to_correct")


def symptoms(overlap: Column, old_support: Column, new_support: Column, old_graph: Column, new_graph: Column, category: Column, old_answer: Column, new_answer: Column, total_ms: Column) -> Column:
    """What changed between two runs of one question, in a fixed order."""
    markers = tx.ABSTENTIONS[:-1]
    return F.array_compact(
        F.array(
            F.when(overlap < 0.35, "topk_changed"),
            F.when(new_support + 0.15 < old_support, "gt_support_dropped"),
            F.when(new_graph > old_graph + 0.2, "graph_ratio_increased"),
            F.when(F.lower(category).contains("temporal"), "temporal_question"),
            F.when(tx.abstained(new_answer, markers), "new_answer_abstained"),
            F.when(tx.abstained(old_answer, markers), "old_answer_abstained"),
            F.when(F.coalesce(total_ms, F.lit(0.0)) > 3000, "slow_search"),
        )
    )


def primary_issue(found: Column, change: Column) -> Column:
    has = lambda s: F.array_contains(found, s)
    shifted = has("gt_support_dropped") | has("topk_changed")
    lost, wrong = change == "lost_correct_to_wrong", change == "both_wrong"
    return (
        F.when(has("slow_search"), "latency")
        .when(lost & shifted & has("graph_ratio_increased"), "bfs_noise_or_graph_reroute")
        .when(lost & shifted & has("temporal_question"), "temporal_retrieval_shift")
        .when(lost & shifted, "retrieval_shift")
        .when(lost & has("new_answer_abstained"), "generation_abstention")
        .when(wrong & has("gt_support_dropped"), "missing_or_buried_evidence")
        .when(wrong & has("graph_ratio_increased"), "bfs_noise")
        .when(change == "gained_wrong_to_correct", "fixed")
        .when(change == "both_correct", "stable")
        .otherwise("judge_or_generation_variance")
    )


def pattern(names: list[str], correct: list[Column]) -> Column:
    return F.concat_ws("_", *(F.concat(F.lit(n), F.when(c, "C").otherwise("W")) for n, c in zip(names, correct, strict=True)))


def bucket(names: list[str], correct: list[Column]) -> Column:
    """Who of several systems was wrong: all_correct, all_wrong, or <wrong>_wrong_<right>_correct."""
    wrong = F.concat_ws("_", *(F.when(~c, n) for n, c in zip(names, correct, strict=True)))
    right = F.concat_ws("_", *(F.when(c, n) for n, c in zip(names, correct, strict=True)))
    return F.when(wrong == "", "all_correct").when(right == "", "all_wrong").otherwise(F.concat(wrong, F.lit("_wrong_"), right, F.lit("_correct")))


def difference_signals(names: list[str], correct: list[Column], support: list[Column], graph: list[Column], answers: list[Column], overlap: list[Column], fact_context: list[Column], latency: list[Column]) -> Column:
    """Signals that tell a first system from its baselines; ``overlap`` is that of the first with each."""
    own, rest = names[0], range(1, len(names))
    best = F.greatest(F.lit(0.0), *(F.when(correct[i], support[i]).otherwise(0.0) for i in rest))
    found = [F.when(c & tx.abstained(a), f"{n}_correct_but_answer_abstained") for n, c, a in zip(names, correct, answers, strict=True)]
    found += [
        F.when(~correct[0] & (support[0] + 0.15 < best), f"{own}_gt_support_lower_than_correct_baselines"),
        F.when(~correct[0] & (graph[0] >= 0.3), f"{own}_graph_heavy_when_wrong"),
        F.when(~correct[0] & tx.abstained(answers[0]), f"{own}_answer_abstained"),
    ]
    found += [F.when(~correct[0] & correct[i] & (overlap[i] < 0.25), f"{own}_low_topk_overlap_with_{names[i]}") for i in rest]
    found += [F.when(~correct[0] & correct[i] & fact_context[i], f"{names[i]}_temporal_fact_context_available") for i in rest]
    found += [F.when(~correct[i] & tx.abstained(answers[i]), f"{names[i]}_answer_abstained") for i in rest]
    found += [F.when(~correct[i] & fact_context[i], f"{names[i]}_fact_context_not_sufficient") for i in rest]
    found += [F.when(latency[0] > F.greatest(F.lit(1000.0), latency[i] * 5), f"{own}_much_slower_than_{names[i]}") for i in rest]
    return F.array_compact(F.array(*found))


# Words and phrases in a judge's reason that name the kind of a failure.
FAILURE_TAGS = {
    "missing_required_item": ["not include", "does not include", "missing", "no correct item"],
    "abstained_or_insufficient_context": ["not explicitly", "not enough", "do not specify", "cannot determine", "no information"],
    "wrong_or_conflicting_fact": ["different", "incorrect", "not consistent", "not match", "contradict"],
}
FAILURE_TEMPORAL = "date time year month day temporal week before after yesterday tomorrow friday saturday sunday monday tuesday wednesday thursday".split()


def failure_hit_ratio(answer: Column, retrieved: Column) -> Column:
    """Share of the answer's words that occur anywhere in the retrieved text, also within words."""
    words, hay = tx.failure_tokens(answer), tx.normalized(retrieved)
    return F.size(F.filter(words, lambda w: F.contains(hay, w))) / F.greatest(F.lit(1), F.size(words))


def failure_root(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "evidence_present_answer_failed").when(ratio >= 0.3, "partial_evidence_or_distractor").otherwise("evidence_missing_or_low_recall")


def failure_tags(reason: Column, answer: Column) -> Column:
    why, said = tx.normalized(reason), tx.normalized(answer)
    temporal = "|".join(FAILURE_TEMPORAL)
    found = [F.when(why.rlike(temporal) | said.rlike(temporal), "temporal_or_date_wrong")]
    return F.array_compact(F.array(*found, *(F.when(why.rlike("|".join(p)), tag) for tag, p in FAILURE_TAGS.items())))


def event_match(sem: Column, lexical: Column, shared: Column) -> Column:
    """Whether a memory tells the event of a piece of evidence."""
    return F.coalesce(((sem >= 0.58) & (shared >= 1)) | ((sem >= 0.52) & (lexical >= 0.35) & (shared >= 2)), F.lit(False)) | ((lexical >= 0.60) & (shared >= 3)) | ((lexical >= 0.50) & (shared >= 4))


def rank_rule(sem: Column, lexical: Column, shared: Column, mean: Column, deviation: Column, margin: Column, z: Column) -> Column:
    """The rule by which a candidate counts as a hit: R1 absolute, R2 against the other candidates, R3 near copy; else null."""
    stands_out = (sem >= mean + 0.9 * deviation) | ((margin >= 0.06) & (z >= 0.8))
    return F.when((sem >= 0.60) & (shared >= 1), "R1").when((sem >= 0.54) & stands_out, "R2").when((lexical >= 0.60) & (shared >= 3), "R3")


def verdict_change(old: Column, new: Column) -> Column:
    """improvement: to correct; regression: any other change; unchanged."""
    return F.when(old == new, "unchanged").when(new == "correct", "improvement").otherwise("regression")

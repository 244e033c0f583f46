"""Intent, gates, fusion, diversity and context on small cases."""

import pytest
from pyspark.sql import functions as F

from engramix.functions import classify as cl
from engramix.functions import numeric as nm
from engramix.functions import text as tx
from engramix.operators import retrieval as rt
from engramix.operators.filters import compile_filter, is_advanced


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def plan_of(spark, question, *entities):
    e = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(n).alias("name")) for t, n in entities)) if entities else F.array().cast("array<struct<type:string,name:string>>")
    return cl.query_plan(F.lit(question), e)


def test_evidence_features(spark):
    q, m = F.lit("When did Melanie sign up for a pottery class?"), F.lit("[2023-07-02] Melanie signed up for a pottery class.")
    cover = tx.coverage(tx.content_tokens(q), tx.content_tokens(m))
    cue = F.when(tx.is_temporal(q) & (tx.has_date_word(m) | tx.has_date_word(F.lit("2023-07-02"))), 1.0).otherwise(0.0)
    r = one(spark, cover=cover, cue=cue, score=tx.evidence_score(cover, cue))
    assert r["cover"] > 0.5 and r["cue"] == 1.0 and r["score"] > 0.6


def test_plans(spark):
    a = one(spark, p=plan_of(spark, "What recipes did Caroline recommend in September?", ("PERSON", "Caroline")))["p"]
    assert (a["answer_shape"], a["evidence_mode"], a["time_constraints"]) == ("list", "temporal_aggregate", ["september"])
    assert "recommendation" in a["relation_hints"] and "recipes" in a["must_have_terms"]
    b = one(spark, p=plan_of(spark, "What book recommendations has Joanna given to Nate?", ("PERSON", "Joanna"), ("PERSON", "Nate")))["p"]
    assert (b["answer_shape"], b["evidence_mode"]) == ("list", "aggregate") and "recommendation" in b["relation_hints"]


def test_gate(spark):
    none = F.array().cast("array<string>")
    q = "What book recommendations has Joanna given to Nate?"
    plan = plan_of(spark, q, ("PERSON", "Joanna"), ("PERSON", "Nate"))
    g = one(spark, g=cl.shadow_gate(F.lit(q), plan, F.lit("A weather forecast mentioned storms near Chicago."), none, F.lit(""), F.lit(2), F.lit(False)))["g"]
    assert g["would_block"] and {"missing_target_entity", "low_query_coverage"} <= set(g["reasons"])
    backed = one(spark, g=cl.shadow_gate(F.lit(q), plan, F.lit("Evan lifts weights"), none, F.lit(""), F.lit(3), F.lit(True)))["g"]
    assert not backed["would_block"] and backed["reasons"] == ["validator_backed"]


@pytest.mark.parametrize(("memory", "created", "expected"), [("x", "2023-05-24", True), ("x", "2023-08-24", False), ("Maybe we will go", "2023-08-24", False)])
def test_time_constraints(spark, memory, created, expected):
    assert one(spark, t=cl.time_match(tx.strings(["may", "2023"]), F.lit(memory), F.lit(created)))["t"] is expected


def test_diversity(spark):
    rows = [("q", "a", 1.0, ["red", "apple", "pie"], 1), ("q", "b", 0.99, ["red", "apple", "pie"], 2), ("q", "c", 0.86, ["blue", "car"], 3)]
    df = spark.createDataFrame(rows, "query_id string, id string, score double, tokens array<string>, position int")
    assert [r["id"] for r in rt.diversify(df, 2).orderBy("rank").collect()] == ["a", "c"]
    twice = spark.createDataFrame([("q", "a", 1.0, ["x"], 1), ("q", "a", 0.9, ["x"], 2), ("q", "b", 0.8, ["y"], 3)], df.schema)
    assert [r["id"] for r in rt.diversify(twice, 3).orderBy("rank").collect()] == ["a", "b"]
    assert rt.diversify(twice, 3).where("rank > 3").count() == 0


def test_context_dedupe(spark):
    rows = [("q", 1, "s2", ["s1", "s2"], ["s3"]), ("q", 2, "s3", ["s3"], []), ("q", 3, "s4", ["s4"], ["s1"])]
    out = rt.context_dedupe(spark.createDataFrame(rows, "query_id string, rank int, id string, segments array<string>, supports array<string>")).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["s2", "s4"] and out[1]["supports"] == []
    shown = [s for r in out for s in [*r["segments"], *r["supports"]]]
    assert len(shown) == len(set(shown))


def test_labels(spark):
    assert list(one(spark, a=tx.add_label(F.lit("vector"), "graph"), b=tx.add_label(F.lit("vector+graph"), "graph"), c=tx.add_label(F.lit("vector"), ""))) == ["vector+graph", "vector+graph", "vector"]


def test_vector_topk_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, "ab"[i % 2], [float(i), 1.0, float(i * i % 7)]) for i in range(40)], "id long, scope string, vector array<float>")
    q = v.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, rt.vector_topk(v, q, 3, scoped=True).collect()))
    monkeypatch.setattr(rt, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, rt.vector_topk(v, q, 3, scoped=True).collect())) == whole and len(whole) == 24
    assert rt.vector_topk(v, q.limit(0), 3).count() == 0


def test_fallback_fills(spark):
    merged = spark.createDataFrame([("q", "a", 0.9, "vector")], "query_id string, id string, score double, source string")
    pool = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.8), ("q", "c", 0.7), ("q", "d", 0.6)], "query_id string, id string, score double")
    out = {r["id"]: (round(r["score"], 3), r["source"]) for r in rt.with_fallback(merged, pool, 3).collect()}
    assert out == {"a": (0.9, "vector"), "b": (0.44, "fallback"), "c": (0.385, "fallback")}


def test_filters(spark):
    df = spark.createDataFrame([(1, "Ab", 5), (2, "cd", 7), (3, None, 9)], "id long, name string, n long")
    ids = lambda f: [r["id"] for r in df.where(compile_filter(f)).orderBy("id").collect()]
    assert ids({"n": {"gt": 5, "lt": 9}}) == [2] and ids({"name": "*"}) == [1, 2] and ids({"name": {"icontains": "AB"}}) == [1]
    assert ids({"AND": [{"n": {"gt": 4}}, {"n": {"lt": 8}}]}) == [1, 2] and ids({"OR": [{"id": 1}, {"NOT": [{"n": {"nin": [9]}}]}]}) == [1, 3]
    assert ids({"name": {"contains": "b"}, "id": {"in": [1, 2]}}) == [1] and ids({"id": {"ne": 1}, "n": {"gte": 9}}) == [3] and ids({"n": {"lte": 5}}) == [1]
    for bad in ({"n": {"like": 1}}, {"OR": []}):
        with pytest.raises(ValueError, match="operator|conditions"):
            compile_filter(bad)
    assert is_advanced({"n": {"gt": 1}}) and not is_advanced({"n": 1})


def test_texts(spark):
    r = one(
        spark,
        answer=tx.final_answer(F.lit("<think>ANSWER: no</think>so\nANSWER: a; b"), True),
        yes=tx.yes_no(F.lit("<think>no</think>Well, no?\nYes.")), no=tx.yes_no(F.lit("it is no")), none=tx.yes_no(F.lit("maybe")),
        photo=tx.with_photo(F.lit("look"), F.lit("a cat"), F.lit("")), bare=tx.bare_evidence(F.lit("[D1:3, said on x] Ann: I went")), tokens=tx.estimated_tokens(F.lit("abcdéé")),
        parts=tx.sentences(F.lit("One. Two?\nThree")), uuid=nm.uuid5(F.lit("python.org")),
    )
    import uuid

    assert (r["answer"], r["yes"], r["no"], r["none"]) == ("a", True, False, None)
    assert r["photo"].startswith("look [Sharing image") and r["bare"] == "I went" and r["tokens"] == 2 and r["parts"] == ["One.", "Two?", "Three"]
    assert r["uuid"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "python.org"))

"""Scope isolation, parallel edges, summaries and searches of the multigraph."""

from pyspark.sql import functions as F

from engramix.operators import graph as gr

TRIPLES = "scope string, sentence_id string, seq long, head string, relation string, tail string, confidence double"
ROWS = [("a", "s_alice_a", 1, "Alice", "knows", "Bob", 0.9), ("a", "s_bob_a", 2, "Bob", "sees", "Dan", 0.8), ("b", "s_carol_b", 3, "Alice", "knows", "Carol", 0.9)]


def build(spark, rows=ROWS):
    return gr.build_graph(spark.createDataFrame(rows, TRIPLES))


def start(spark, scope, name, weight=1.0):
    return spark.createDataFrame([("q", scope, name, weight)], "query_id string, scope string, name string, weight double")


def test_scopes(spark):
    nodes, links, edges = build(spark)
    near = lambda s: {r["name"] for r in gr.neighbours(edges, start(spark, s, "alice")).collect()}
    assert near("a") == {"bob"} and near("b") == {"carol"}
    assert {r["sentence_id"] for r in links.where("scope = 'a' and name = 'alice'").collect()} == {"s_alice_a"}
    found = {r["sentence_id"]: r["score"] for r in gr.weighted_search(nodes, links, edges, start(spark, "a", "alice"), 1).collect()}
    assert set(found) == {"s_alice_a", "s_bob_a"} and found["s_alice_a"] == 1.0 and "s_carol_b" not in found


def test_parallel_and_reverse_edges(spark):
    nodes, links, edges = build(spark, [("a", "s1", 1, "Alice", "plays", "Piano", 0.9), ("a", "s2", 2, "Alice", "loves", "Piano", 0.9)])
    assert edges.count() == 2
    assert {"s1", "s2"} <= {r["sentence_id"] for r in gr.weighted_search(nodes, links, edges, start(spark, "a", "alice"), 1).collect()}
    texts = [(f"{r['head']} {r['type']} {r['tail']}") for r in edges.collect()]
    sims = spark.createDataFrame([("q", t, 1.0) for t in [*texts, "s1", "s2"]], "query_id string, text string, sim double")
    paths = gr.path_search(links, edges, start(spark, "a", "piano"), sims).collect()
    assert {s for p in paths for s in p["sentences"]} >= {"s1", "s2"}
    assert [p for p in paths if p["path"] == ["piano", "alice"]][0]["path_score"] == 1.0


def test_fact_memory_stands_for_its_sentence_and_survives_on_tolerance(spark):
    _, links, edges = build(spark, [("a", "unit_1", 1, "Alice", "painted", "sunsets", 0.9)])
    edges = edges.withColumn("source_fact_memory_id", F.lit("fact_1"))
    sims = spark.createDataFrame([("q", "Alice painted sunsets", 1.0)], "query_id string, text string, sim double")
    paths = gr.path_search(links.limit(0), edges, start(spark, "a", "alice"), sims).collect()
    assert {s for p in paths for s in p["sentences"]} == {"fact_1"}


def test_low_hops_are_dropped_after_the_tolerance(spark):
    chain = [("a", f"s{i}", i, f"n{i}", "to", f"n{i + 1}", 0.9) for i in range(4)]
    _, links, edges = build(spark, chain)
    sims = spark.createDataFrame([("q", "none", 0.0)], "query_id string, text string, sim double")
    paths = gr.path_search(links, edges, start(spark, "a", "n0"), sims, hops=4, tolerance=2).collect()
    assert sorted(len(p["path"]) for p in paths) == [2, 3]


def test_summaries(spark):
    facts = spark.createDataFrame([("a", "alice", "F1", 1), ("a", "alice", "F2", 2), ("a", "alice", "F1", 3)], "scope string, name string, fact string, seq long")
    r = gr.summaries(facts).first()
    assert r["summary"] == "F1\nF2" and len(r["summary_facts"]) == 2
    many = spark.createDataFrame([("a", "x", f"f{i:02}", i) for i in range(30)], facts.schema)
    assert gr.summaries(many).first()["summary_facts"] == [f"f{i:02}" for i in range(10, 30)]


def test_blank_ends_and_relations(spark):
    _, _, edges = build(spark, [("a", "s1", 1, "Alice", "likes", " ", 0.9), ("a", "s2", 2, "Alice", "Likes", "Tea", None)])
    assert edges.count() == 1
    assert [r["other"] for r in gr.relations(edges, "ALICE").collect()] == ["tea"]
    assert gr.relation_sentences(edges, "alice", "Likes", "TEA").count() == 1 and gr.sentence_triples(edges, "s2").count() == 1


def test_paths_need_all_payloads(spark):
    paths = spark.createDataFrame([("q", 1, ["a", "b"]), ("q", 2, ["a", "c"])], "query_id string, position int, sentences array<string>")
    assert [r["position"] for r in gr.complete_paths(paths, spark.createDataFrame([("a",), ("b",)], "id string")).collect()] == [1]

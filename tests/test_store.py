"""Ids, appends and batches that are run again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from engramix import schema as sc
from engramix.operators.memory import MemoryEngine
from engramix.storage import TableStore
from engramix.streaming import stateful

USER = {"user_id": "u1"}
OFF = dict(use_bfs=False, use_entity_store=False, use_history=True)


def engine(spark, tmp_path, **options):
    return MemoryEngine(spark, f"file:{tmp_path}/m", sc.Options(**(OFF | options)))


def ids(frame):
    return [r["id"] for r in frame.select("id").collect()]


def test_repeated_adds_have_ids_of_their_own(spark, tmp_path):
    e = engine(spark, tmp_path, use_dedup=False)
    made = [i for _ in range(3) for i in ids(e.add("The red kite flew over the lake.", **USER))]
    assert len(made) == len(set(made)) == 3 == e.table("memories").count()
    assert set(made) == set(ids(e.table("memories")))


def test_a_memory_added_again_is_a_new_one(spark, tmp_path):
    e = engine(spark, tmp_path)
    (first,) = ids(e.add("The red kite flew over the lake.", **USER))
    assert ids(e.add("The red kite flew over the lake.", **USER)) == []
    assert e.delete(first) == 1
    (second,) = ids(e.add("The red kite flew over the lake.", **USER))
    assert first != second
    assert [r["event"] for r in e.history(first).collect()] == ["ADD", "DELETE"]
    assert [r["event"] for r in e.history(second).collect()] == ["ADD"]


def test_a_keyed_batch_counts_once(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path, use_bfs=True, use_entity_store=True)
    e.add("Anna met Boris in Oslo. They saw a museum there.", **USER)
    rows = [("u1", None, None, None, i, "user", t, dt.datetime(2024, 1, 2)) for i, t in enumerate(["Clara knows Dmitri from Bergen.", "Eva visited Rome with Anna."])]
    batch = spark.createDataFrame(rows, "user_id string, agent_id string, run_id string, actor_id string, msg_seq bigint, role string, content string, ts timestamp")
    state = lambda: {n: sorted(map(str, e.table(n).drop("vector").collect())) for n in ("memories", "nodes", "node_links", "edges", "messages", "history", "entity_index")}
    before = state()
    append = TableStore.append

    def failing(self, name, df):
        if name == "history":
            raise OSError("lost")
        append(self, name, df)

    monkeypatch.setattr(TableStore, "append", failing)
    with pytest.raises(OSError):
        e.add_batch(batch, batch_key="b1")
    assert state() != before
    monkeypatch.setattr(TableStore, "append", append)
    assert e.add_batch(batch, batch_key="b1").count() > 0
    after = state()
    texts = [r["data"] for r in e.table("memories").where("graph_object is null").collect()]
    assert len(texts) == len(set(texts)) and any("Clara" in t for t in texts)
    assert e.add_batch(batch, batch_key="b1").count() == 0 and state() == after
    other = engine(spark, tmp_path / "other", use_bfs=True, use_entity_store=True)
    other.add("Anna met Boris in Oslo. They saw a museum there.", **USER)
    other.add_batch(batch)
    weights = lambda x: sorted((r["name"], round(r["attention_weight_sum"], 6)) for r in x.table("nodes").collect())
    assert weights(e) == weights(other)
    assert all(e.table(n).count() == other.table(n).count() for n in ("memories", "node_links", "edges", "messages", "history"))


def test_readers_see_an_append_whole_or_not(spark, tmp_path):
    store = TableStore(spark, f"file:{tmp_path}/s")
    store.append("t", spark.range(3))
    store.append("t", spark.range(3, 5))
    (tmp_path / "s" / "t" / "v0" / "_lost-1").mkdir()
    spark.range(9).write.mode("overwrite").parquet(f"file:{tmp_path}/s/t/v0/_lost-1")
    assert sorted(r["id"] for r in store.read("t", "id bigint").collect()) == [0, 1, 2, 3, 4]
    store.write("t", store.read("t", "id bigint").where("id > 3"))
    assert store.versions("t") == [0, 1] and store.read("t", "id bigint").count() == 1


def messages(spark, tmp_path, n=4):
    rows = [("u1", None, None, None, i, "user", f"The kite number {i} flew over the lake.", dt.datetime(2024, 1, 1 + i)) for i in range(n)]
    schema = "user_id string, agent_id string, run_id string, actor_id string, msg_seq bigint, role string, content string, ts timestamp"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_a_stream_resumes_after_a_failure(spark, tmp_path):
    """The second micro-batch fails after its memories are written; the query starts again from its checkpoint."""
    stream, calls = messages(spark, tmp_path), []

    class Failing(MemoryEngine):
        def add_batch(self, *args, **named):
            calls.append(named["batch_key"])
            out = super().add_batch(*args, **named)
            if len(calls) == 2:
                raise OSError("the driver is lost")
            return out

    e = Failing(spark, f"file:{tmp_path}/m", sc.Options(**OFF))
    checkpoint = str(tmp_path / "cp")
    q = stateful.ingest(stream, e, checkpoint).start()
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(120)
    stateful.ingest(stream, e, checkpoint).start().awaitTermination(120)
    assert len(calls) == 5 and calls[1] == calls[2] and len(set(calls)) == 4
    assert e.table("memories").count() == e.table("messages").count() == e.table("history").count() == 4
    assert len(set(ids(e.table("memories")))) == 4


def test_a_stream_stops_and_goes_on(spark, tmp_path):
    """Graceful shutdown: a query that is stopped goes on where it was; nothing is missing or there twice."""
    stream, e, checkpoint = messages(spark, tmp_path), engine(spark, tmp_path), str(tmp_path / "cp")
    q = stateful.ingest(stream, e, checkpoint).start()
    q.stop()
    assert not q.isActive
    stateful.ingest(stream, e, checkpoint).start().awaitTermination(120)
    stateful.ingest(stream, e, checkpoint).start().awaitTermination(120)
    assert sorted(r["content"] for r in e.table("messages").collect()) == [f"The kite number {i} flew over the lake." for i in range(4)]
    assert e.table("memories").groupBy("data").count().where(F.col("count") > 1).isEmpty()

"""Streams over files, run to their end, give what the batch forms give."""

from pyspark.sql import functions as F

from engramix.operators import graph as gr
from engramix.storage import TableStore
from engramix.streaming import batch, stateful

SCHEMA = "scope string, seq long, text string, ts timestamp"


def source(spark, tmp_path, rows, schema=SCHEMA, files=3):
    df = spark.createDataFrame(rows, schema)
    df.repartition(files).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def rows_of(n=20):
    import datetime as dt

    return [("ab"[i % 2], i, f"t{i // 2 % 7}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i if i < 10 else i + 120)) for i in range(n)]


def test_dedupe(spark, tmp_path):
    df, stream = source(spark, tmp_path, rows_of())
    got = run(stateful.dedupe(stream), "deduped", "append", tmp_path)
    assert sorted(map(tuple, got.select("scope", "text").collect())) == sorted(map(tuple, df.select("scope", "text").distinct().collect()))


def test_count_flush(spark, tmp_path):
    df, stream = source(spark, tmp_path, rows_of())
    got = run(stateful.count_flush(stream, 4), "flushed", "append", tmp_path).collect()
    assert {(r["scope"], r["batch"], r["size"]) for r in got} == {(s, n, 4) for s in "ab" for n in (0, 1)}
    assert len({i for r in got for i in r["items"]}) <= 7
    assert batch.count_batches(df, "scope", ["seq"], 4).where("not pending").count() == 16


def test_ring(spark, tmp_path):
    df, stream = source(spark, tmp_path, rows_of())
    got = run(stateful.ring_buffer(stream, 3), "ring", "update", tmp_path)
    expected = {r["scope"]: r["t"] for r in batch.ring(df, "scope", ["seq"], 3).groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("t")).collect()}
    assert all(expected[r["scope"]] in [x["items"] for x in got.where(F.col("scope") == r["scope"]).collect()] for r in got.select("scope").distinct().collect())


def test_sessions(spark, tmp_path):
    _, stream = source(spark, tmp_path, rows_of(), files=1)
    got = run(stateful.session_flush(stream, "ts", "30 minutes", "0 seconds"), "sess", "append", tmp_path).collect()
    assert {(r["scope"], r["n"]) for r in got} <= {("a", 5), ("b", 5)}
    assert run(stateful.windowed_counts(stream, "ts", "10 minutes", "5 minutes", "1 minute", "scope"), "win", "append", tmp_path).count() >= 0


def test_graph_maintenance(spark, tmp_path):
    rows = [("a", f"s{i}", i, f"u{i % 3}", "sees", f"v{i % 2}", 0.5) for i in range(12)]
    schema = "scope string, sentence_id string, seq long, head string, relation string, tail string, confidence double"
    df, stream = source(spark, tmp_path, rows, schema)
    store = TableStore(spark, f"file:{tmp_path}/graph")
    stateful.maintain_graph(stream, store, str(tmp_path / "cp-graph")).start().awaitTermination(120)
    whole = gr.build_graph(df)
    weights = lambda n: sorted((r["name"], round(r["attention_weight_sum"], 6)) for r in n.collect())
    nodes, links, edges = stateful.maintained(store)
    assert weights(nodes) == weights(whole[0]) and links.count() == whole[1].count() and edges.count() == whole[2].count()

"""Structured Streaming forms of ingestion: dedupe, count-triggered flush, sessions, ring buffers, graph maintenance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramix.operators import graph as gr
from engramix.storage import TableStore, materialize


def dedupe(stream: DataFrame, text: str = "text", scoped: bool = True, event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """The first row of each text in its scope. With a horizon, the state of older texts is let go."""
    keyed = stream.withColumn("hash", F.md5(text))
    key = ["scope", "hash"] if scoped else ["hash"]
    if event_time and horizon:
        return keyed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(key)
    return keyed.dropDuplicates(key)


def count_flush(stream: DataFrame, threshold: int, key: str = "scope", order: str = "seq", value: str = "text") -> DataFrame:
    """scope, batch, size, items: values are held for each key and leave in order when there are enough.

    What is held is less than the threshold plus one micro-batch of the key.
    """

    def flush(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = (list(map(tuple, zip(*state.get[:2], strict=True))), state.get[2]) if state.exists else ([], 0)
        for b in batches:
            held += list(zip(b[order].astype("int64").tolist(), b[value].astype(str).tolist(), strict=True))
        held.sort()
        rows = []
        while len(held) >= threshold:
            part, held = held[:threshold], held[threshold:]
            rows.append((k[0], n, len(part), [v for _, v in part]))
            n += 1
        state.update(([s for s, _ in held], [v for _, v in held], n))
        yield pd.DataFrame(rows, columns=["scope", "batch", "size", "items"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(flush, f"scope {kind}, batch bigint, size int, items array<string>", "seqs array<bigint>, vals array<string>, n bigint", "append", GroupStateTimeout.NoTimeout)


def session_flush(stream: DataFrame, event_time: str, gap: str, delay: str, key: str = "scope") -> DataFrame:
    """scope, first, last, n of each session: rows with no gap longer than the given one; it leaves when the watermark has passed it."""
    s = stream.withWatermark(event_time, delay).groupBy(F.col(key).alias("scope"), F.session_window(event_time, gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select("scope", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def ring_buffer(stream: DataFrame, size: int, key: str = "scope", order: str = "seq", value: str = "text") -> DataFrame:
    """scope, items: the last values of a key, again with every change."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held += list(zip(b[order].astype("int64").tolist(), b[value].astype(str).tolist(), strict=True))
            held = sorted(held)[-size:]
        state.update(([s for s, _ in held], [v for _, v in held]))
        yield pd.DataFrame([(k[0], [v for _, v in held])], columns=["scope", "items"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(keep, f"scope {kind}, items array<string>", "seqs array<bigint>, vals array<string>", "update", GroupStateTimeout.NoTimeout)


def maintain_graph(stream: DataFrame, store: TableStore, checkpoint: str):
    """Triples into node weights, links and edges, a micro-batch at a time. A batch that is run again replaces itself."""

    def merge(batch: DataFrame, number: int) -> None:
        nodes, links, edges = gr.build_graph(batch)
        for name, df in (("batch_nodes", nodes), ("batch_links", links), ("batch_edges", edges)):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store.folder}/{name}/batch_id={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def maintained(store: TableStore) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, edges) of all batches so far."""
    read = lambda n: store.spark.read.parquet(f"{store.folder}/{n}")
    nodes = read("batch_nodes").groupBy("scope", "name").agg(F.sum("attention_weight_sum").alias("attention_weight_sum"), F.min_by("entity_type", "batch").alias("entity_type"))
    return nodes, read("batch_links").select("name", "sentence_id", "scope").distinct(), read("batch_edges").drop("batch", "batch_id")


def ingest(stream: DataFrame, engine, checkpoint: str):
    """Messages into a memory engine; progress is the query's own checkpoint.

    A micro-batch counts once: its key follows from the checkpoint and its number, so one that is run again
    replaces what it had written, or does nothing if it had ended.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()

    def add(batch: DataFrame, number: int) -> None:
        engine.add_batch(materialize(batch, "micro-batch"), batch_key=f"{name}b{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def windowed_counts(stream: DataFrame, event_time: str, size: str, slide: str, delay: str, by: str) -> DataFrame:
    """Beyond the reference: counts over sliding windows; rows later than the delay are left out."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, size, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last state of each key of a result that was written with every change."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

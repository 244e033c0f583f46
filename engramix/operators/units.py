"""From messages to sentences, evidence units, facts and triples.

Splitting and validation are expressions; the steps that depend on what was accepted
before them (merging short sentences, taking units in order, halving replies) run on
one batch of messages at a time, which an ``add`` bounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import text as tx
from engramix.providers import Extractor, extract_items

#: Shorter sentences are merged into the next, longer ones are cut; sentences in a call to a model.
SHORTEST, LONGEST, CALL = 10, 500, 24


def raw_sentences(messages: DataFrame) -> DataFrame:
    """scope, batch_id, idx, text, speaker, ts: sentences of the messages that aren't the system's, in order."""
    spoken = messages.where((F.col("role") != "system") & (F.trim("content") != ""))
    parts = spoken.select("scope", "batch_id", "msg_seq", "role", "ts", F.posexplode(tx.sentences(F.col("content"))).alias("part", "text"))
    w = Window.partitionBy("scope", "batch_id").orderBy("msg_seq", "part")
    return parts.withColumn("idx", (F.row_number().over(w) - 1).cast("int")).select("scope", "batch_id", "idx", "text", F.col("role").alias("speaker"), "ts")


def segment(sentences: DataFrame) -> DataFrame:
    """Short or verbless sentences joined with the next of the same speaker, long ones cut.

    Whether a joined text is long enough, has two words and a verb follows from what its sentences have, so that is
    worked out for each sentence first; only the scan that gives a sentence the number of its text sees them in order.
    """
    told = sentences.select("scope", "batch_id", "idx", "text", "speaker", "ts", F.length("text").alias("size"), tx.n_words(F.col("text")).alias("words"), F.col("text").rlike(tx.VERB).alias("verb"))
    kinds = {f.name: f.dataType.simpleString() for f in told.schema}

    def numbered(batch: pd.DataFrame) -> pd.DataFrame:
        rows = batch.sort_values("idx")
        number, size, words, verb, who, out = -1, 0, 0, False, None, []
        for r in rows.itertuples():
            if number >= 0 and who == r.speaker and (size < SHORTEST or words < 2 or not verb):
                size, words, verb = size + 1 + r.size, words + r.words, verb or r.verb
            else:
                number, size, words, verb, who = number + 1, r.size, r.words, r.verb, r.speaker
            out.append(number)
        return rows[["scope", "batch_id", "idx", "text", "speaker", "ts"]].assign(number=out)

    schema = ", ".join(f"{n} {kinds[n]}" for n in ("scope", "batch_id", "idx", "text", "speaker", "ts")) + ", number bigint"
    joined = told.groupBy("scope", "batch_id").applyInPandas(numbered, schema).groupBy("scope", "batch_id", "number").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "speaker", "ts"))).alias("x"))
    whole = joined.select("scope", "batch_id", "number", F.array_join("x.text", " ").alias("text"), F.col("x")[0]["speaker"].alias("speaker"), F.col("x")[0]["ts"].alias("ts"))
    parts = whole.select("scope", "batch_id", "number", "speaker", "ts", F.posexplode(F.when(F.length("text") > LONGEST, tx.clauses(F.col("text"))).otherwise(F.array("text"))).alias("part", "text"))
    w = Window.partitionBy("scope", "batch_id").orderBy("number", "part")
    return parts.select("scope", "batch_id", (F.row_number().over(w) - 1).cast("int").alias("idx"), "text", "speaker", "ts")


UNIT = "scope string, batch_id string, position int, text string, speaker string, ts timestamp, source_sentence_ids array<string>, source_texts array<string>, merge_reason string, confidence double, fallback boolean"


def raw_units(sentences: DataFrame) -> DataFrame:
    """A unit for each sentence."""
    sid = F.concat(F.lit("s"), F.col("idx").cast("string"))
    return sentences.select("scope", F.col("batch_id").cast("string").alias("batch_id"), F.col("idx").alias("position"), "text", "speaker", "ts", F.array(sid).alias("source_sentence_ids"), F.array("text").alias("source_texts"), F.lit("").alias("merge_reason"), F.lit(1.0).alias("confidence"), F.lit(True).alias("fallback"))


PROPOSED = "struct<source_sentence_ids:string,text:string,confidence:string,merge_reason:string>"


def accept_units(sentences: DataFrame, replies: DataFrame) -> DataFrame:
    """Units proposed by a model (scope, batch_id, reply) that are known, unused, contiguous and bound to their sources; every other sentence is a unit of its own.

    Proposals are exploded and validated each for itself; what is left is taken in order, unless a sentence of it is
    taken already (a fold over the short list of valid proposals of a batch).
    """
    key = ["scope", "batch_id"]
    own = sentences.select("scope", F.col("batch_id").cast("string").alias("batch_id"), "idx", "text", "speaker", "ts")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("idx")).alias("place")
    own = own.select("*", F.concat(F.lit("s"), F.col("idx").cast("string")).alias("sid"), place)
    items = F.from_json(F.get_json_object("reply", "$.units"), "array<string>")
    told = replies.select("scope", F.col("batch_id").cast("string").alias("batch_id"), F.posexplode(items).alias("n", "raw")).withColumn("u", F.from_json("raw", PROPOSED))
    raw_ids = F.col("u.source_sentence_ids")
    ids = F.when(F.ltrim(raw_ids).startswith("["), F.from_json(raw_ids, "array<string>")).otherwise(F.array(raw_ids))
    ids = F.filter(F.transform(ids, lambda i: F.trim(i)), lambda i: i.isNotNull() & (i != ""))
    sure = F.coalesce(F.col("u.confidence").try_cast("double"), F.lit(1.0))
    told = told.select(*key, "n", ids.alias("ids"), F.trim(F.coalesce("u.text", F.lit(""))).alias("unit"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("sure"), F.trim(F.coalesce("u.merge_reason", F.lit(""))).alias("reason")).where("unit <> '' and size(ids) > 0")
    met = told.select(*key, "n", "unit", "sure", "reason", F.size("ids").alias("size"), F.posexplode("ids").alias("at", "sid")).join(own, [*key, "sid"])
    made = met.groupBy(*key, "n", "unit", "sure", "reason", "size").agg(F.array_sort(F.collect_list(F.struct("at", "place", "sid", "text", "speaker", "ts"))).alias("x"))
    one_run = F.forall("x", lambda e: e["place"] - e["at"] == F.col("x")[0]["place"])
    made = made.where((F.size("x") == F.col("size")) & one_run).where(tx.source_bound(F.col("unit"), F.array_join("x.text", " ")))
    made = made.select(*key, F.struct("n", F.transform("x", lambda e: e["place"]).alias("places"), "unit", "sure", "reason", F.transform("x", lambda e: e["sid"]).alias("sids"), F.transform("x", lambda e: e["text"]).alias("texts"), F.transform("x", lambda e: e["speaker"]).alias("speakers"), F.col("x")[0]["ts"].alias("ts")).alias("p"))
    listed = made.groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    kind = made.schema["p"].dataType.simpleString()
    taken = F.aggregate("p", F.array().cast(f"array<{kind}>"), lambda done, p: F.when(F.arrays_overlap(F.flatten(F.transform(done, lambda d: d["places"])), p["places"]), done).otherwise(F.concat(done, F.array(p))))
    chosen = listed.select(*key, F.explode(taken).alias("p"))
    speaker = F.when(F.size(F.array_distinct("p.speakers")) == 1, F.col("p.speakers")[0]).otherwise("mixed")
    merged = chosen.select(*key, F.col("p.places")[0].alias("first"), F.col("p.unit").alias("text"), speaker.alias("speaker"), "p.ts", F.col("p.sids").alias("source_sentence_ids"), F.col("p.texts").alias("source_texts"), F.col("p.reason").alias("merge_reason"), F.col("p.sure").alias("confidence"), F.lit(False).alias("fallback"))
    rest = own.join(chosen.select(*key, F.explode("p.places").alias("place")), [*key, "place"], "left_anti")
    alone = rest.select(*key, F.col("place").alias("first"), "text", "speaker", "ts", F.array("sid").alias("source_sentence_ids"), F.array("text").alias("source_texts"), F.lit("").alias("merge_reason"), F.lit(1.0).alias("confidence"), F.lit(True).alias("fallback"))
    w = Window.partitionBy(*key).orderBy("first")
    rows = merged.unionByName(alone).withColumn("position", (F.row_number().over(w) - 1).cast("int"))
    return rows.select(*(c.split()[0] for c in UNIT.split(", ")))


FACT = "struct<fact_id:string,fact:string,source_sentence_id:string,source_sentence_ids:array<string>,confidence:double>"
TRIPLE = "struct<head:string,relation:string,tail:string,source_fact_id:string,source_sentence_id:string,source_sentence_ids:array<string>,confidence:double>"


def extract(units: DataFrame, extractor: Extractor) -> DataFrame:
    """scope, batch_id, sids (new sentence ids), reply (facts and triples): one call for each batch of units (scope, batch_id, sid, text, position)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                found = [{"sentence_id": x["sid"], "text": x["text"]} for x in r.items]
                rows.append((r.scope, r.batch_id, [x["sentence_id"] for x in found], json.dumps(extract_items(extractor, found))))
            yield pd.DataFrame(rows, columns=["scope", "batch_id", "sids", "reply"])

    grouped = units.groupBy("scope", "batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "sid", "text"))), lambda x: F.struct(x["sid"].alias("sid"), x["text"].alias("text"))).alias("items"))
    return grouped.select("scope", "batch_id", "items").mapInPandas(run, "scope string, batch_id string, sids array<string>, reply string")


def _ids(primary, listed, allowed):
    """Known ids, each once, in order, the primary first if it is missing."""
    kept = F.array_distinct(F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda i: F.array_contains(allowed, i)))
    return F.when(F.array_contains(kept, primary), kept).otherwise(F.concat(F.array(primary), kept))


def facts(replies: DataFrame) -> DataFrame:
    """Valid facts: text and id aren't blank and the primary sentence is one of the new ones; the last of equal ids counts.

    replies: scope, batch_id, sids, reply, and optionally context_sids.
    """
    allowed = F.concat("sids", F.coalesce("context_sids", F.array().cast("array<string>"))) if "context_sids" in replies.columns else F.col("sids")
    rows = replies.select("scope", "batch_id", "sids", allowed.alias("allowed"), F.posexplode(F.from_json(F.get_json_object("reply", "$.facts"), f"array<{FACT}>")).alias("n", "f"))
    primary = F.coalesce(F.trim("f.source_sentence_id"), F.try_element_at("f.source_sentence_ids", F.lit(1)))
    rows = rows.withColumn("sid", primary).where((F.trim("f.fact_id") != "") & (F.trim("f.fact") != "") & F.array_contains("sids", F.col("sid")))
    w = Window.partitionBy("scope", "batch_id", F.trim("f.fact_id")).orderBy(F.desc("n"))
    last = rows.withColumn("k", F.row_number().over(w)).where("k = 1")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("f.confidence", F.lit(0.8))))
    return last.select("scope", "batch_id", F.trim("f.fact_id").alias("fact_id"), F.trim("f.fact").alias("fact"), "sid", _ids(F.col("sid"), F.col("f.source_sentence_ids"), F.col("allowed")).alias("source_sentence_ids"), sure.alias("confidence"), "n")


def triples(replies: DataFrame, valid_facts: DataFrame) -> DataFrame:
    """Valid triples with the text of their fact: no blank part, a new primary sentence, and the fact, if named, kept with the same sentence."""
    allowed = F.concat("sids", F.coalesce("context_sids", F.array().cast("array<string>"))) if "context_sids" in replies.columns else F.col("sids")
    rows = replies.select("scope", "batch_id", "sids", allowed.alias("allowed"), F.posexplode(F.from_json(F.get_json_object("reply", "$.triples"), f"array<{TRIPLE}>")).alias("n", "t"))
    first_known = F.try_element_at(F.filter(F.coalesce("t.source_sentence_ids", F.array().cast("array<string>")), lambda i: F.array_contains(F.col("sids"), i)), F.lit(1))
    own = F.trim("t.source_sentence_id")
    rows = rows.withColumn("sid", F.when(F.array_contains("sids", own), own).otherwise(first_known)).where((F.trim("t.head") != "") & (F.trim("t.relation") != "") & (F.trim("t.tail") != "") & F.col("sid").isNotNull())
    rows = rows.withColumn("fact_id", F.coalesce(F.trim("t.source_fact_id"), F.lit("")))
    named = rows.join(valid_facts.select("scope", "batch_id", "fact_id", "sid", "fact"), ["scope", "batch_id", "fact_id", "sid"], "left").where((F.col("fact_id") == "") | F.col("fact").isNotNull())
    return named.select("scope", "batch_id", "n", F.trim("t.head").alias("head"), F.trim("t.relation").alias("relation"), F.trim("t.tail").alias("tail"), "sid", _ids(F.col("sid"), F.col("t.source_sentence_ids"), F.col("allowed")).alias("source_sentence_ids"), F.coalesce("t.confidence", F.lit(0.8)).alias("confidence"), "fact_id", F.coalesce("fact", F.lit("")).alias("fact"))

"""Corpus pipeline: quality filter, near-duplicate removal, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
documents. Decisions join on a key of id and text, so null or repeated ids don't lead
to the loss of other rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix.llm import quality
from engramix.llm.common import materialize
from engramix.llm.decontamination import contamination
from engramix.llm.near_duplicates import near_duplicates
from engramix.llm.packing import pack_documents
from engramix.llm.pii import redact_documents
from engramix.llm.queries import remainder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("_key", F.concat_ws(":", F.lpad(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 20, "0"), F.xxhash64("text").cast("string")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go.

    Null and empty texts are scored by their structure like any other; equal texts have equal scores, so repeated rows stay or go
    together; rows with a null id stay or go by their text; very long texts are scored whole; without labels nobody is
    rejected; an empty table stays empty; columns other than those of documents are dropped.
    """
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    keyed = _keyed(docs)
    rejected = quality.score(keyed, machine, id_col="_key").where(F.col("score") < LEAST_QUALITY).select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(rejected, "_key", "left_anti").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: that with the smallest id.

    Null and empty texts are near nothing and stay; rows that repeat an id and a text count as one, and one of them stays; of
    equal texts under several ids the smallest id stays; a null id sorts before all others; very long texts are compared on
    their full sets; an empty table stays empty; columns other than those of documents are dropped.
    """
    keyed = _keyed(docs)
    groups = materialize(near_duplicates(keyed, width=5, id_col="_key"), "groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_key")).distinct()
    left = keyed.join(gone, "_key", "left_anti")
    # Rows that repeat an id and text have one key; one of them stays. Keys met once aren't shuffled again.
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_key"))
    once = left.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
    return left.join(repeated, "_key", "left_anti").unionByName(once).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go.

    Null and empty texts have no words and stay; repeated rows stay or go together; rows with a null id go by their text;
    items without words or with a null id match nothing; very long texts are searched whole; an empty table stays empty;
    columns other than those of documents are dropped.
    """
    keyed = _keyed(docs)
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key")
    hit = materialize(found.where("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return keyed.join(hit, "_key", "left_anti").select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind.

    No row goes. A null text stays null and an empty one empty; repeated rows stay repeated; n_chars is that of the new text
    (null for null); very long texts are redacted whole; an empty table stays empty; columns other than those of documents
    are dropped.
    """
    redacted = redact_documents(docs.select(*COLUMNS))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left.

    Null and empty texts are one piece with the end id; repeated rows and null ids are packed each; texts longer than a
    sequence are cut; ties in length are assigned by id; an empty table gives no rows; only the id and the text are read.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_redaction),
    ("packing", packing),
]

#: SQL can't express the fitted classifier or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs

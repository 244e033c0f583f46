"""The queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix.llm import language_id, quality
from engramix.llm.decontamination import build_index, contamination, search_near
from engramix.llm.media import media_columns
from engramix.llm.near_duplicates import near_duplicates
from engramix.llm.packing import pack_documents
from engramix.llm.pii import pii_digests
from engramix.llm.token_counts import token_counts
from engramix.llm.token_files import token_files
from engramix.llm.warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op1_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unordered matches, exact ones among them."""
    found = search_near(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    ids, n = F.transform("near", lambda x: x["item_id"]), F.aggregate("near", F.lit(0).cast("long"), lambda acc, x: acc + x["n_matches"])
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("near").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = quality.score(docs, machine)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = archive(table(spark, sf_dir, "pages"))
    return table_.where("is_last").select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, remainder(4) != 2)
    return language_id.identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op1_proximity": op1_proximity,
    "op2_media_columns": op2_media_columns,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_token_files": op8_token_files,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
}

#: Words of the first query: A-Z in lower case, then runs of digits, letters and non-ASCII characters.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Words of the fifth: A-Z in lower case, split at ASCII white space.
_SPACED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT item_id, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 8), lambda p: array_to_string(w[p:p + 9], ' ')) END) AS win FROM i),
        lens AS (SELECT DISTINCT least(n, 10) AS k FROM win),
        dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, lens WHERE len(w) >= k),
        hits AS (SELECT DISTINCT dw.doc_id, dw.k, dw.p, win.item_id FROM dw JOIN win ON least(win.n, 10) = dw.k AND array_to_string(dw.w[dw.p:dw.p + dw.k - 1], ' ') = win.win),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op5_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' ')) END) AS sh FROM d),
        c AS (SELECT list_sort(sh) AS sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY 1),
        x AS (SELECT rep, len(sh) AS n, unnest(sh) AS sh FROM c),
        pair AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.sh = b.sh AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
        link AS (SELECT a, b FROM pair WHERE 100 * k >= 80 * (na + nb - k)),
        both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
        root AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id, s.doc_id = coalesce(root, s.doc_id) AS kept
        FROM s LEFT JOIN c ON c.sh = list_sort(s.sh) LEFT JOIN root ON root.rep = c.rep
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM w
    """,
}

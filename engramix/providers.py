"""Models as pluggable objects with deterministic defaults that need no network.

A provider is a small picklable object; it is called on the executors with batches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dims: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """Signed hashed words, of unit length. Line ends count as spaces."""

    dims: int = 384

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+", text.replace("\n", " ").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, text: str, embedder: Embedder, column: str = "vector") -> DataFrame:
    """The frame with the vectors of its texts; equal texts of a batch are embedded once."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            distinct = list(dict.fromkeys(batch.fillna("")))
            made = dict(zip(distinct, list(embedder.embed_batch(distinct)), strict=True)) if distinct else {}
            yield batch.fillna("").map(made)

    return df.withColumn(column, vectors(F.col(text)))


class Reranker(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


@dataclass(frozen=True)
class OverlapReranker:
    """A logit from the share of the query's words that a text has."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            q, m = (set(re.findall(r"[a-z0-9]+", x.lower())) for x in (query, text))
            out.append(6.0 * len(q & m) / max(1, len(q)) - 3.0)
        return out


def logits(reranker: Reranker) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def predict(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(reranker.predict(list(zip(queries.fillna(""), texts.fillna(""), strict=True))), dtype=float)

    return predict


class Extractor(Protocol):
    def generate(self, payload: str) -> str: ...


@dataclass(frozen=True)
class RuleExtractor:
    """Facts and triples of sentences '<Subject> <verb> <object>', as the JSON that a model would return."""

    def generate(self, payload: str) -> str:
        facts, triples = [], []
        for item in json.loads(payload)["items"]:
            m = re.match(r"^\W*([A-Z]\w+|I|We)\s+(\w+(?:ed|s|t)|am|are)\s+(.{2,120}?)[.!?]*$", item["text"].strip())
            if m:
                fid = f"f{len(facts)}"
                facts.append({"fact_id": fid, "fact": item["text"].strip(), "source_sentence_id": item["sentence_id"], "confidence": 0.8})
                triples.append({"head": m[1], "relation": m[2], "tail": m[3], "source_fact_id": fid, "source_sentence_id": item["sentence_id"], "confidence": 0.8})
        return json.dumps({"facts": facts, "triples": triples})


@dataclass(frozen=True)
class RecordedExtractor:
    """Replies recorded before, by the payload's text; an empty object for others."""

    replies: dict[str, str]

    def generate(self, payload: str) -> str:
        return self.replies.get(payload, "{}")


def parse_reply(reply: str) -> dict | None:
    """The JSON object of a reply: plain, within a code fence, or embedded in other text; None if broken."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", reply, re.S)
    found = re.search(r"\{.*\}", reply, re.S)
    for text in (reply, fenced[1] if fenced else None, found[0] if found else None):
        try:
            value = json.loads(text) if text else None
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def extract_items(extractor: Extractor, items: list[dict], context: list[dict] | None = None) -> dict:
    """Facts and triples of items; a reply that doesn't parse is asked for again in two halves."""
    if not items:
        return {"facts": [], "triples": []}
    value = parse_reply(extractor.generate(json.dumps({"items": items, "context": context or []})))
    if value is not None:
        return {"facts": list(value.get("facts") or []), "triples": list(value.get("triples") or [])}
    if len(items) == 1:
        return {"facts": [], "triples": []}
    half = len(items) // 2
    a, b = extract_items(extractor, items[:half], context), extract_items(extractor, items[half:], context)
    return {k: a[k] + b[k] for k in a}


def entities(text: Column) -> Column:
    """Entities of a text by rule: quoted spans, runs of capitalised words, numbers; struct(type, name), each once."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit('"([^"]{2,60})"'), F.lit(1)), lambda x: F.struct(F.lit("QUOTED").alias("type"), x.alias("name")))
    proper = F.transform(F.regexp_extract_all(text, F.lit("([A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*)"), F.lit(1)), lambda x: F.struct(F.lit("PROPER").alias("type"), x.alias("name")))
    number = F.transform(F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9])([0-9]+)(?![A-Za-z0-9])"), F.lit(1)), lambda x: F.struct(F.lit("NUMBER").alias("type"), x.alias("name")))
    return F.array_distinct(F.concat(quoted, proper, number))


def lemmas(text: Column) -> Column:
    """Words without common endings, for keyword search."""
    from engramix.functions.text import raw_tokens

    return F.array_join(F.transform(raw_tokens(text), lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(ies|ing|ed|es|s)$", "")).otherwise(w)), " ")

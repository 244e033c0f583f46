"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned with follow-the-regularised-leader (proximal, per coordinate) under an
elastic-net penalty, then a temperature is fitted on rows that the learning did not see, so
that the score is a probability. Document frequencies cover every training row; the fit
itself takes a bounded sample of whole texts (``SAMPLE`` rows by hash of the id).

Cases: null texts and texts without a letter are ``und`` with score 0; with no training row
every text is ``und``; ties go to the language first in the alphabet; repeated rows and
null ids are scored like any other; an empty table gives no rows; only the id, the text and,
for training, the language are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.common import arrow_schema, chunks, id_type, lean, record_batch, text_frame

#: Rows of the fit at most, a fifth of which only set the temperature, and distinct n-grams of all of them together.
SAMPLE, FEATURES = 6000, 1 << 24
ORDERS, BITS = (1, 2, 3), 16
#: Characters that a kernel expands to n-grams at a time.
CHARS = 1 << 19
#: Learning rate, its offset, L1 and L2 penalties, passes; features are scaled to a sum near SCALE.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.3, 1.0, 0.3, 1e-3, 2, 30.0


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every character n-gram of the texts, number of n-grams of each). Runs of other signs count as a space each."""
    codes = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes)
    flat = np.where(_letters()[flat], flat, np.uint32(32)).astype(np.uint32)
    out = np.empty((len(flat), len(ORDERS)), np.uint32)
    for k, n in enumerate(ORDERS):
        h = np.full(len(flat), n, np.uint32)
        for j in range(n):
            h[: len(flat) - j] = h[: len(flat) - j] * np.uint32(0x01000193) ^ flat[j:]
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        out[:, k] = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
    # The last places of a text would take in the next one: they repeat the single sign instead.
    ends = np.cumsum(sizes)
    for k, n in enumerate(ORDERS):
        for j in range(1, n):
            out[ends - j, k] = out[ends - j, 0]
    return out.reshape(-1), sizes * len(ORDERS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, the inverse document frequencies included
    bias: np.ndarray
    temperature: float = 1.0
    sparsity: float = 0.0  # share of zeros among the weights of buckets that were seen
    error: float = 0.0  # calibration error on the rows set aside

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        first = 0
        while first < len(texts):
            last, held = first, 0
            while last < len(texts) and (last == first or held + len(texts[last]) <= CHARS):
                held += len(texts[last])
                last += 1
            out[first:last] = self._sums(texts[first:last])
            first = last
        return out

    def _sums(self, texts: list[str]) -> np.ndarray:
        ids, counts = ngrams(texts)
        starts = np.cumsum(counts) - counts
        return np.stack([np.add.reduceat(self.weights[:, k][ids], starts) for k in range(len(self.languages))], 1) / counts[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and probability of each text."""
        known = [bool(self.languages) and any(c.isalpha() for c in t) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if at := [i for i, ok in enumerate(known) if ok]:
            p = softmax(self.logits([texts[i] for i in at]) / self.temperature)
            best = p.argmax(axis=1)
            for i, k, x in zip(at, best.tolist(), p.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = self.languages[k], min(1.0, x)
        return names, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of a text's n-grams, how often each occurs)."""
    ids, count = np.unique(ngrams([text])[0], return_counts=True)
    return ids.astype(np.int64), count


def fit(rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray, aside: np.ndarray) -> Model:
    """Follow the regularised leader over the rows (buckets, counts) not set aside; the others set the temperature."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    z, n = np.zeros((len(idf) + 1, len(names))), np.zeros((len(idf) + 1, len(names)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        held = z[at]
        return np.where(np.abs(held) > L1, -(held - np.sign(held) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7)
    learn = np.flatnonzero(~aside)
    for _ in range(PASSES):
        for i in order.permutation(learn).tolist():
            ids, count = rows[i]
            ids, x = np.r_[ids, len(idf)], np.r_[SCALE * count * idf[ids] / count.sum(), 1.0]  # the last is the bias
            w = weights(ids)
            p = softmax((x[:, None] * w).sum(axis=0)[None])[0]
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = weights(slice(None))
    model = Model(names, (SCALE * w[:-1] * idf[:, None]).astype(np.float32), w[-1])
    seen = np.unique(np.concatenate([rows[i][0] for i in learn])) if len(learn) else np.zeros(0, np.int64)
    model.sparsity = float((w[seen] == 0).mean()) if len(seen) else 1.0
    held = np.flatnonzero(aside) if aside.any() else learn
    logits = np.stack([(model.weights[ids].astype(float) * count[:, None]).sum(axis=0) / count.sum() + model.bias for ids, count in (rows[i] for i in held)])
    model.temperature, model.error = calibrate(logits, y[held])
    return model


def calibrate(logits: np.ndarray, own: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the calibration error with it (ten bins of the score).

    The targets are smoothed as if each row had been seen with one more of every language: rows told apart without a
    mistake, which alone would ask for a temperature of zero, give one that fits their number.
    """
    rows, k = logits.shape
    if k < 2:
        return 1.0, 0.0
    target = np.full((rows, k), 1 / (rows + k))
    target[np.arange(rows), own] += 1 - k / (rows + k)

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((target * (np.log(np.exp(x).sum(axis=1, keepdims=True)) - x)).sum(axis=1).mean())

    low, high, part = np.log(1e-4), np.log(1e4), (5**0.5 - 1) / 2
    for _ in range(80):  # the loss has one minimum in 1 / temperature
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    temperature = float(np.exp((low + high) / 2))
    p = softmax(logits / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == own
    bins = np.minimum((top * 10).astype(int), 9)
    error = sum(abs(float(top[bins == i].mean() - right[bins == i].mean())) * float((bins == i).mean()) for i in range(10) if (bins == i).any())
    return temperature, error


def train(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the eligible rows that have a text and a language."""
    rows = docs.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    totals = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    out = arrow_schema(totals)
    size = 1 << BITS

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for _, texts in chunks(batches):
            for t in texts:
                seen = np.zeros(size, bool)
                seen[ngrams([t.decode("utf-8", "replace")])[0]] = True
                total[:-1] += seen
                total[-1] += 1
        at = np.flatnonzero(total)
        yield record_batch(out, pa.array(at), pa.array(total[at]))

    df = np.zeros(size + 1)
    for r in text_frame(rows, "doc_id", "text").mapInArrow(lean(frequencies), totals).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        df[r["bucket"]] = r["n"]
    if not df[-1]:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = rows.select("doc_id", order.alias("h")).orderBy("h", "doc_id").limit(SAMPLE)
    kind = T.StructType([T.StructField(n, t) for n, t in (("h", T.LongType()), ("lang", T.StringType()), ("buckets", T.BinaryType()), ("counts", T.BinaryType()))])
    made = arrow_schema(kind)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, count = counted(batch.column(0)[i].as_py())
                yield record_batch(made, batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), [ids.astype("<u2").tobytes()], [count.astype("<u4").tobytes()])

    taken = rows.join(F.broadcast(chosen), "doc_id").select("text", "h", "lang").mapInArrow(lean(sampled), kind)
    taken = taken.orderBy("h", F.xxhash64("buckets", "counts"), "lang").limit(SAMPLE)
    # What the driver holds is bounded in rows and in features.
    so_far = F.sum(F.length("buckets") / 2).over(Window.orderBy("h", F.xxhash64("buckets", "counts"), "lang").rowsBetween(Window.unboundedPreceding, 0))
    held = taken.withColumn("so_far", so_far).where(F.col("so_far") <= FEATURES).drop("so_far").toPandas()
    aside = (held["h"].to_numpy() // 7 % 5 == 0) if len(held) > 20 else np.zeros(len(held), bool)
    features = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)) for b, c in zip(held["buckets"], held["counts"], strict=True)]
    return fit(features, held["lang"].tolist(), idf, aside)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text, in one pass over the scan."""
    schema = T.StructType([T.StructField("doc_id", id_type(docs, id_col)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            names, scores = shared.value.predict([t.decode("utf-8", "replace") for t in texts])
            yield record_batch(out, ids, names, scores)

    return text_frame(docs, id_col, text_col).mapInArrow(lean(kernel), schema)

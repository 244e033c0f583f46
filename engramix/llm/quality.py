"""Quality classifier: a factorisation machine.

Inputs are a text's distinct words (hashed), statistics of its structure and its size as
metadata, each statistic as one of a few levels. All pairs of inputs interact through
low-rank factors; the sum over pairs is half of (square of sums - sum of squares), so a
text is scored in time linear in its words.

Cases: null and empty texts have only their structure as input and get a score like any
other; repeated rows and null ids are scored; without labelled rows every score is 0.5; an
empty table gives no rows; only the id, the text and, for training, the label are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.common import arrow_schema, chunks, id_type, lean, record_batch, text_frame

#: Labelled rows of the fit at most, chosen by a hash of the id, and inputs (distinct words, mostly) of all of them together.
SAMPLE, INPUTS = 12_000, 1 << 25
BITS, RANK, LEVELS = 16, 8, 16
#: Learning rate, L2 penalties of weights and factors; passes, and rows seen at least (in 40 passes at most).
RATE, L2, L2V, PASSES, SEEN = 0.08, 1e-5, 1e-4, 4, 48_000

_CLASSES = np.zeros(256, np.int64)
for _c, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:'\"-()?", b"!", b"|", b"#$%&*@~^+=<>[]{}\\/_`"], 1):
    _CLASSES[list(_chars)] = _c
_CLASSES[128:] = 9
STATISTICS = 9 + 6


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = zlib.crc32(word) & ((1 << BITS) - 1)
        return value


def _level(share: float) -> int:
    return min(LEVELS - 1, int(1.5 * np.log2(1 + 1000 * share)))


def inputs(text: bytes, buckets: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(input numbers, values): words share a squared length of 1, each statistic has 1/4."""
    words = text.split()
    distinct = set(words)
    lines = text.split(b"\n")
    counts = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=10)[1:] / max(1, len(text))
    levels = [_level(x) for x in counts.tolist()]
    levels.append(_level(len(distinct) / max(1, len(words))))
    levels.append(_level(len(set(lines)) / len(lines)))
    levels.append(min(LEVELS - 1, int(len(text) / max(1, len(words)))))  # mean length of a word with its space
    levels.append(min(LEVELS - 1, len(words).bit_length()))
    levels.append(min(LEVELS - 1, len(text).bit_length() // 2))
    levels.append(min(LEVELS - 1, int(len(words) / len(lines) / 4)))  # words in a line
    at = (1 << BITS) + np.arange(STATISTICS) * LEVELS + np.array(levels)
    ids = np.r_[np.fromiter(map(buckets.__getitem__, distinct), np.int64, len(distinct)), at]
    ids[: len(distinct)].sort()  # sets of bytes have no fixed order
    return ids, np.r_[np.full(len(distinct), 1 / np.sqrt(max(1, len(distinct)))), np.full(STATISTICS, 0.5)].astype(np.float32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1, linear in the number of inputs."""
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(i) for i, _ in rows])
        ids, x = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        starts = np.cumsum(sizes) - sizes
        vx = self.factors[ids] * x[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        raw = self.bias + np.add.reduceat(self.weights[ids] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss, a row at a time, with a rate of its own for each coordinate."""
    draw = np.random.default_rng(11)
    n = (1 << BITS) + STATISTICS * LEVELS
    w, v = np.zeros(n, np.float32), draw.normal(0, 0.02, (n, RANK)).astype(np.float32)
    gw, gv = np.full(n, 1e-2, np.float32), np.full((n, RANK), 1e-2, np.float32)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    bias = float(np.log(share / (1 - share)))
    for _ in range(max(PASSES, min(40, SEEN // max(1, len(rows))))):
        for i in draw.permutation(len(rows)).tolist():
            ids, x = rows[i]
            vi = v[ids]
            vx = vi * x[:, None]
            s = vx.sum(axis=0)
            raw = bias + float((w[ids] * x).sum()) + 0.5 * float((s * s).sum() - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i]
            dw = g * x + L2 * w[ids]
            dv = g * x[:, None] * (s - vx) + L2V * vi
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w[ids] -= RATE * dw / np.sqrt(gw[ids])
            v[ids] -= RATE * dv / np.sqrt(gv[ids])
            bias -= 0.01 * float(g)
    return Machine(bias, w, v)


def train(docs: DataFrame, labels: DataFrame, eligible: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine from a bounded sample of the labelled rows; ``eligible`` is a condition on the labels' rows."""
    chosen = labels.where(eligible & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h", "doc_id").limit(SAMPLE)
    kind = T.StructType([T.StructField("h", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = arrow_schema(kind)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _ = inputs(batch.column(0)[i].as_py(), buckets)
                yield record_batch(out, batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), [ids.tolist()])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "h", "label").mapInArrow(lean(kernel), kind)
    held = rows.orderBy("h", F.xxhash64("ids"), "label").limit(SAMPLE)
    # What the driver holds is bounded in rows and in inputs.
    so_far = F.sum(F.size("ids")).over(Window.orderBy("h", F.xxhash64("ids"), "label").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("so_far", so_far).where(F.col("so_far") <= INPUTS).drop("so_far").toPandas()
    made = []
    for ids in held["ids"]:
        ids = np.asarray(ids, np.int64)
        n = len(ids) - STATISTICS
        made.append((ids, np.r_[np.full(n, 1 / np.sqrt(max(1, n))), np.full(STATISTICS, 0.5)].astype(np.float32)))
    return fit(made, held["label"].to_numpy(np.float64))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text, in one pass over the scan."""
    schema = T.StructType([T.StructField("doc_id", id_type(docs, id_col)), T.StructField("score", T.DoubleType())])
    out = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # as large for any corpus

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for ids, texts in chunks(batches, 1 << 20):
            if len(buckets) > 200_000:
                buckets.clear()
            yield record_batch(out, ids, pa.array(shared.value.score([inputs(t, buckets) for t in texts])))

    return text_frame(docs, id_col, text_col).mapInArrow(lean(kernel), schema)

"""Packing by cutting-stock column generation.

Every document's ids are cut at multiples of the sequence length; the remainders are
grouped in classes of ``unit`` tokens. A linear program over patterns (how many of
each class share a sequence) is solved on the histogram of classes by column
generation: the simplex multipliers price new patterns with a knapsack dynamic
program. The rounded patterns are then assigned to documents by their rank within
the class. The histogram has at most ``length / unit`` entries whatever the size of
the corpus, so the program runs on the driver; ranks, assignment and offsets are
computed on the executors. Every pattern is a priced column: the
first ones by the multipliers of a program without padding, the others by the
program's own.

Cases: null and empty texts give one piece that holds the end id; repeated rows are
packed each; null ids are kept; an empty table gives no rows; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.common import arrow_schema, chunks, id_type, lean, materialize, record_batch, text_frame
from engramix.llm.encoding import encoder

#: A program is solved when no better one could save a sequence, or is within this share of its lower bound. Patterns that
#: enter for each class at most: a guard against cycling, after which the packing is still whole, only less tight.
GAP, MOST_PIVOTS = 1e-4, 10
#: Patterns of one pricing, and what a pattern must be worth beyond a sequence.
BATCH, EPSILON = 64, 1e-7


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every document cut at multiples of ``length``."""
    schema = T.StructType([T.StructField("doc_id", id_type(docs, id_col))] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")])
    out = arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for ids, texts in chunks(batches, 1 << 20):
            flat, counts = made.encode([t.decode("utf-8", "replace") for t in texts])
            flat = flat.astype("<u4")
            whole = counts + 1
            number = -(-whole // length)
            doc = np.repeat(np.arange(len(texts)), number)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * length
            size = np.minimum(length, whole[doc] - start)
            first = (np.cumsum(counts) - counts)[doc] + start
            crc = []
            for a, n, last in zip(first.tolist(), size.tolist(), (start + size == whole[doc]).tolist(), strict=True):
                crc.append(zlib.crc32(end, zlib.crc32(flat[a : a + n - 1])) if last else zlib.crc32(flat[a : a + n]))
            yield record_batch(out, ids.take(pa.array(doc)), pa.array(start), pa.array(size), crc, pa.array(whole[doc]))

    return text_frame(docs, id_col, text_col).mapInArrow(lean(kernel, "encoder"), schema)


def price(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, list[np.ndarray]]:
    """The value of the most valuable pattern, and the patterns worth more than a sequence: the best with each size in it, best first, at most ``BATCH``.

    Unbounded knapsack by dynamic programming over the room. Sizes ascend. A pattern has a number of a size for each item.
    """
    best = np.zeros(room + 1)
    choice = np.full(room + 1, -1)
    counts = np.searchsorted(sizes, np.arange(room + 1), "right").tolist()
    for w in range(int(sizes[0]), room + 1):
        k = counts[w]
        values = best[w - sizes[:k]] + worth[:k]
        i = int(values.argmax())
        if values[i] > best[w - 1]:
            best[w], choice[w] = values[i], i
        else:
            best[w] = best[w - 1]
    with_each = best[room - sizes] + worth
    found = []
    for i in np.argsort(-with_each, kind="stable")[:BATCH].tolist():
        if with_each[i] <= 1 + EPSILON:
            break
        items, w = [i], room - int(sizes[i])
        while w > 0:
            if choice[w] < 0:
                w -= 1
            else:
                items.append(int(choice[w]))
                w -= int(sizes[choice[w]])
        found.append(np.array(items))
    return float(best[room]), found


def price_even(sizes: list[int], caps: list[int], room: int) -> dict[int, int]:
    """The most valuable pattern (number of a size -> times) if a size is worth its share of a sequence, with at most ``caps`` of each.

    The same dynamic program for the multipliers of a program without padding: the value of a pattern is what it
    fills, so the states are the bits of a number. Of the best patterns it is that with the largest sizes.
    """
    reach, steps, all_ = 1, [], (1 << room + 1) - 1
    for i, size in enumerate(sizes):
        left, n = min(caps[i], room // size), 1
        while left > 0:
            n = min(n, left)
            steps.append((i, n, reach))
            reach |= reach << n * size & all_
            left -= n
            n *= 2
    at = reach.bit_length() - 1
    pattern: dict[int, int] = {}
    for i, n, before in reversed(steps):
        if (taken := at - n * sizes[i]) >= 0 and before >> taken & 1:
            pattern[i] = pattern.get(i, 0) + n
            at = taken
    return pattern


class Program:
    """The linear program over patterns: a basis, its solution, and a lower bound.

    The first columns are priced by the multipliers of a program without padding, on what is left of the demand: each
    takes as much as it can and so ends a size, which makes the basis triangular. ``solve`` then prices with the
    program's own multipliers until no better solution could save a sequence.
    """

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, room: int):
        m = len(sizes)
        self.sizes, self.demand, self.room = sizes, demand, room
        self.columns, self.x = np.zeros((m, m), np.int64), np.zeros(m)
        self.bound = float((demand * sizes).sum()) / room
        self.entered = self.priced = 0
        self.order: list[int] = []  # sizes as they end
        left = {i: float(d) for i, d in enumerate(demand.tolist())}
        while left:
            own = list(left)
            found = price_even([int(sizes[i]) for i in own], [-int(-left[i] // 1) for i in own], room)
            pattern = {own[i]: n for i, n in found.items()}
            ended = min(pattern, key=lambda i: left[i] / pattern[i])
            times = left[ended] / pattern[ended]
            for i, n in pattern.items():
                self.columns[i, ended] = n
                left[i] -= n * times
            self.x[ended] = times
            self.order.append(ended)
            self.priced += 1
            for i in [i for i in pattern if i == ended or left[i] < 1e-9]:
                if i != ended:  # ended by the same pattern: one more column, of no use at first
                    self.columns[i, i] = room // int(sizes[i])
                    self.order.append(i)
                del left[i]

    def total(self) -> float:
        return float(self.x.sum())

    def closed(self) -> bool:
        """Whether the solution is so near to the bound that a better one would not count."""
        return -(-(self.total() - 1e-6) // 1) <= -(-(self.bound - 1e-6) // 1) or self.total() <= self.bound * (1 + GAP)

    def _invert(self) -> np.ndarray:
        """Inverse of the first basis, row by row in the order in which sizes end.

        Sums of rows, no matrix product: a driver's threaded linear algebra can wait for threads that a fork has ended.
        """
        out, done = np.zeros(self.columns.shape), []
        for i in self.order:
            row = np.zeros(len(out))
            row[i] = 1
            for j in (j for j in done if self.columns[i, j]):
                row -= self.columns[i, j] * out[j]
            out[i] = row / self.columns[i, i]
            done.append(i)
        return out

    def enter(self, column: np.ndarray) -> bool:
        """Pivot a column (a count for each size) into the basis."""
        some = np.flatnonzero(column)
        step = (self.inverse[:, some] * column[some]).sum(axis=1)
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            return False
        ratios = self.x[rows] / step[rows]
        out = int(rows[ratios.argmin()])
        theta = max(0.0, float(ratios.min()))
        self.x -= theta * step
        np.maximum(self.x, 0, out=self.x)
        self.x[out] = theta
        row = self.inverse[out] / step[out]
        at, where = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(row)
        self.inverse[np.ix_(at, where)] -= step[at][:, None] * row[where]
        self.inverse[out] = row
        self.columns[:, out] = column
        self.entered += 1
        return True

    def solve(self) -> None:
        """Price and enter columns until the bound is met, or no pattern is worth more than a sequence."""
        m = len(self.sizes)
        if self.closed():
            return
        self.inverse = self._invert()
        while not self.closed() and self.entered < MOST_PIVOTS * m:
            duals = self.inverse.sum(axis=0)
            value, found = price(self.sizes, np.maximum(duals, 0), self.room)
            self.priced += 1
            self.bound = max(self.bound, self.total() / max(value, 1))
            if not found or self.closed():
                return
            pool = np.zeros((len(found), m), np.int64)
            for k, items in enumerate(found):
                np.add.at(pool[k], items, 1)
            before = self.entered
            while len(pool):  # the best of the pool under the multipliers of the moment
                worth = (pool * self.inverse.sum(axis=0)).sum(axis=1)
                k = int(worth.argmax())
                if worth[k] <= 1 + EPSILON or not self.enter(pool[k]):
                    break
                pool = np.delete(pool, k, axis=0)
            if self.entered == before:
                return


def patterns(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern as size -> count, times) that together hold every item of the histogram (size -> items)."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return []
    program = Program(sizes, np.array([histogram[int(s)] for s in sizes], float), room)
    program.solve()
    return rounded(program)


def rounded(program: Program) -> list[tuple[dict[int, int], int]]:
    """Whole times of the program's patterns: rounded down, then, largest fraction first, once more where the items are left."""
    sizes, columns = program.sizes, program.columns
    times = np.floor(program.x + 1e-9).astype(np.int64)
    left = program.demand.astype(np.int64) - (columns * times).sum(axis=1)
    for k in np.flatnonzero(left < 0).tolist():  # by rounding errors only
        for j in np.flatnonzero((columns[k] > 0) & (times > 0)).tolist():
            while left[k] < 0 and times[j] > 0:
                times[j] -= 1
                left += columns[:, j]
    for k in np.argsort(times - program.x, kind="stable").tolist():
        some = np.flatnonzero(columns[:, k])
        n = int((left[some] // columns[some, k]).min())
        if program.x[k] > 1e-9 and n > 0:
            times[k] += 1
            left[some] -= columns[some, k]
    made = [({int(sizes[i]): int(columns[i, k]) for i in np.flatnonzero(columns[:, k])}, int(times[k])) for k in np.flatnonzero(times)]
    # What is left is a few items for each class at most: best fit, largest first.
    while left.any():
        space, pattern = program.room, {}
        while True:
            fits = np.flatnonzero((left > 0) & (sizes <= space))
            if not len(fits):
                break
            i = int(fits[-1])
            n = int(min(left[i], space // sizes[i]))
            pattern[int(sizes[i])] = pattern.get(int(sizes[i]), 0) + n
            left[i] -= n
            space -= n * int(sizes[i])
        made.append((pattern, 1))
    return made


class Slots:
    """Where the item of a class with a given rank goes."""

    def __init__(self, made: list[tuple[dict[int, int], int]]):
        base, rows = 0, []
        filled: dict[int, int] = {}
        for pattern, times in made:
            for size, n in pattern.items():
                rows.append(((size << 44) + filled.get(size, 0), base, n))
                filled[size] = filled.get(size, 0) + n * times
            base += times
        rows.sort()
        self.key, self.base, self.count = (np.array([r[i] for r in rows], np.int64) for i in range(3))

    def sequence(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        key = (size.astype(np.int64) << 44) + rank
        at = np.searchsorted(self.key, key, "right") - 1
        return self.base[at] + (key - self.key[at]) // self.count[at]


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, unit: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    if length % unit:
        raise ValueError("the unit must divide the length")
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = materialize(pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    cut = cut.withColumn("size", F.ceil(F.col("length") / unit).cast("long")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    # Ranks in two levels: a class may hold a third of all pieces, a salt of it holds 1/salts of that.
    counts = materialize(cut.groupBy("size", "salt").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most length / unit rows
    made = patterns(histogram, length // unit)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).drop("n")
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")
    ranked = cut.withColumn("rank", F.row_number().over(within)).join(before, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("rank") - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([cut.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("size", "rank", "sequence_id")])
    out = arrow_schema(schema)
    slots = spark.sparkContext.broadcast(Slots(made))  # bounded by the number of classes, not by the corpus

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        for b in batches:
            size, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            yield record_batch(out, *(b.column(i) for i in range(7)), pa.array(where.sequence(size, rank) if len(size) else np.zeros(0, np.int64)))

    placed = ranked.select(*names, "size", "rank").mapInArrow(lean(assign, "encoder"), schema)
    # A sequence holds at most ``length`` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank")
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*names, "sequence_id", "offset")

"""Token counts by rank-synchronous array merging.

A text becomes pre-tokens that no merge can cross. The distinct pre-tokens of a
batch are held together as ragged numpy arrays of symbol ids; in every round each
sequence's lowest-rank pair is merged in all sequences at once, and in each of them
wherever it stands (from the left, up to the first place where the merge makes a pair
of lower rank, which comes next), until no sequence has a pair left. The surviving symbols are the tokens; a symbol
outside the vocabulary counts as its UTF-8 bytes. Counts of pre-tokens seen before
come from a bounded cache.

Cases: null and empty texts have 0 tokens; repeated rows give repeated rows; an
empty table gives an empty result; columns other than the id and the text are
not read, so their names cannot clash. A null id is carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from engramix.llm.common import arrow_schema, chunks, id_type, kept, lean, record_batch, text_frame

#: Pre-tokens whose counts a worker remembers; the cache is emptied when full.
CACHE_ENTRIES = 1_000_000
_NONE = np.iinfo(np.int64).max


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = blob[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, blob[i : i + n]
            i += n


class MergeCounter:
    """Counts the tokens of a byte-fallback BPE piece model without special tokens."""

    def __init__(self, model: bytes):
        pieces, normal, rank_of = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif k == 3:
                        kind = v
                pieces.append(piece)
                if kind == 4:
                    raise ValueError("models with user-defined pieces aren't supported")
                if kind == 1:
                    normal[piece] = len(pieces) - 1
                    rank_of[piece] = -score
            elif number == 3:
                for k, v in _fields(value):
                    if k == 1 and v != b"identity" or k == 4 and v:
                        raise ValueError("only models without normalisation and without removal of spaces are supported")
        chars = sorted({c for p in normal for c in p})
        symbols = {c: i for i, c in enumerate(chars)}
        for p in normal:
            symbols.setdefault(p, len(symbols))
        self.size = len(symbols)
        #: Tokens that a surviving symbol counts as.
        self.cost = np.ones(self.size + 1, np.int64)
        for c in chars:
            if c not in normal:
                self.cost[symbols[c]] = len(c.encode())
        left, right, merged, order = [], [], [], []
        ranks = {r: i for i, r in enumerate(sorted(set(rank_of.values())))}
        for p in normal:
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(symbols[p]), order.append(ranks[rank_of[p]])
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        by = np.argsort(keys)
        self.keys, self.merged, self.rank = keys[by], np.array(merged, np.int64)[by], np.array(order, np.int64)[by]
        self.symbols = {c: symbols[c] for c in chars}
        #: Characters that stand side by side in a piece.
        self.beside = np.unique(np.array([symbols[a] * self.size + symbols[b] for p in normal for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.spaced = {p[0] for p in normal if "▁" in p[1:]} <= {"▁"} and all(set(p.rstrip("▁")) <= {"▁"} or "▁" not in p.lstrip("▁") for p in normal)
        if not self.spaced:
            raise ValueError("a piece of the model spans a word boundary")
        self.newline_alone = not any("\n" in p and len(p) > 1 for p in normal)
        self.newline_cost = 1
        self.first, self.inner = {}, {}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank _NONE without a merge."""
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.merged[at], -1)

    def count_units(self, units: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        get = self.symbols.get
        total = np.zeros(len(units), np.int64)
        flat: list[int] = []
        cost: list[int] = []
        for unit in units:
            ids = [get(c, -1) for c in unit]
            flat += ids
            cost += [int(self.cost[i]) if i >= 0 else len(c.encode()) for c, i in zip(unit, ids, strict=True)] if min(ids) < 0 else self.cost[ids].tolist()
        if not flat:
            return total
        sym, width, owner = np.array(flat, np.int64), np.array(cost, np.int64), np.repeat(np.arange(len(units)), [len(u) for u in units])
        # No merge crosses two characters that are side by side in no piece: each side is a sequence of its own.
        pair = sym[:-1] * self.size + sym[1:]
        near = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        apart = (owner[1:] != owner[:-1]) | (sym[:-1] < 0) | (sym[1:] < 0) | (self.beside[near] != pair)
        seq = np.r_[0, np.cumsum(apart)]
        rank, into = np.full(len(sym), _NONE), np.full(len(sym), -1)
        same = np.flatnonzero(~apart)
        rank[same], into[same] = self._pairs(sym[same], sym[same + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(seq)])
            done = best == _NONE
            if done.any():
                np.add.at(total, owner[starts[done]], np.add.reduceat(width, starts)[done])
                keep = np.repeat(~done, sizes)
                sym, width, owner, seq, rank, into = sym[keep], width[keep], owner[keep], seq[keep], rank[keep], into[keep]
                best, sizes = best[~done], sizes[~done]
                if not len(sym):
                    break
            sym, width, owner, seq, rank, into = self._round(sym, width, owner, seq, rank, into, np.repeat(best, sizes))
        return total

    def _round(self, sym, width, owner, seq, rank, into, best):
        """Merge every sequence's lowest-rank pair wherever it stands, from the left, up to the first place where that makes a pair of lower rank."""
        hits = np.flatnonzero(rank == best)
        order = np.arange(len(hits))
        begin = np.maximum.accumulate(np.where(np.r_[True, np.diff(hits) != 1], order, 0))
        at = hits[(order - begin) % 2 == 0]  # of places that overlap, every other one
        own, made = seq[at], into[at]
        joined = np.r_[False, (np.diff(at) == 2) & (own[1:] == own[:-1])]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        has_left, has_right = (at > 0) & (seq[before] == own), (at + 2 < len(sym)) & (seq[after] == own)
        left = self._pairs(np.where(joined, np.r_[-1, made[:-1]], np.where(has_left, sym[before], -1)), made)
        right = self._pairs(made, np.where(has_right, sym[after], -1))
        lower = np.minimum(left[0], right[0]) < rank[at]
        if lower.any():
            earlier = np.cumsum(lower) - lower
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            take = earlier == np.repeat(earlier[first], np.diff(np.r_[first, len(own)]))
            at, made, joined, has_left = at[take], made[take], joined[take], has_left[take]
            left, right = (left[0][take], left[1][take]), (right[0][take], right[1][take])
        sym[at], width[at] = made, 1
        rank[at], into[at] = right
        place = np.where(joined, at - 2, at - 1)[has_left]
        rank[place], into[place] = left[0][has_left], left[1][has_left]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        return sym[keep], width[keep], owner[keep], seq[keep], rank[keep], into[keep]

    def _learn(self, cache: dict[str, int], units: set[str], prefix: str) -> None:
        if len(cache) + len(units) > CACHE_ENTRIES:
            cache.clear()
        names = list(units)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            cache.update(zip(part, self.count_units([prefix + x for x in part]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: a mark is put before it and for every space, as the model was built."""
        lines = []
        for text in texts:
            text = text.replace("▁", " ")
            lines.append(text.split("\n") if self.newline_alone else [text])
        # Every word but the first of a later line follows a mark; a run of marks belongs to the word after it.
        marked: list[list[str]] = []
        bare: list[list[str]] = []
        for parts in lines:
            m: list[str] = []
            b: list[str] = []
            for k, line in enumerate(parts):
                words = line.split(" ")
                if k:
                    if words[0]:
                        b.append(words[0])
                    words = words[1:]
                elif len(parts) == 1 and not line:
                    words = []
                if "" in words:
                    words = _runs(words)
                m += words
            marked.append(m), bare.append(b)
        for cache, units, prefix in ((self.first, marked, "▁"), (self.inner, bare, "")):
            if new := {u for x in units for u in x} - cache.keys():
                self._learn(cache, new, prefix)
                if lost := {u for x in units for u in x} - cache.keys():
                    self._learn(cache, lost, prefix)
        out = []
        first, inner = self.first.__getitem__, self.inner.__getitem__
        for parts, m, b in zip(lines, marked, bare, strict=True):
            out.append(sum(map(first, m)) + sum(map(inner, b)) + (len(parts) - 1) * self.newline_cost)
        return out


def _runs(words: list[str]) -> list[str]:
    """Marks that stand before others join the next word: ['', '', 'a'] gives one unit with three marks."""
    out, held = [], ""
    for w in words:
        if w:
            out.append(held + w)
            held = ""
        else:
            held += "▁"
    return out + [held[1:]] if held else out


@lru_cache(2)
def merge_counter(path: str) -> MergeCounter:
    """One counter for each worker process; its cache outlives a task."""
    with open(path, "rb") as f:
        return MergeCounter(f.read())


kept("counter", merge_counter.cache_clear)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text. No shuffle: one pass over the scan."""
    schema = T.StructType([T.StructField("doc_id", id_type(docs, id_col)), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    out = arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(model_path)
        for ids, texts in chunks(batches, 1 << 20):
            n = counter.count([t.decode("utf-8", "replace") for t in texts])
            yield record_batch(out, ids, [len(t) for t in texts], n, [x > limit for x in n])

    return text_frame(docs, id_col, text_col).mapInArrow(lean(kernel, "counter"), schema)

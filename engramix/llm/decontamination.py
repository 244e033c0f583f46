"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment covers a few megabytes of whole training
texts and holds, for every term in them, the ascending list of its positions. Segments
are built where the texts are read and written to the shared folder, so nothing is
shuffled and a lost task rebuilds or rereads its own segments only. A search visits
every segment with the benchmark's phrases, in blocks of bounded size: the list of a
phrase's rarest term (in that segment) is shifted by the term's place in the phrase,
then intersected with the shifted lists of the other terms, rarest first. Unordered
matches take the same windows, with all words of one within a stretch of bounded length.

Cases: a null or empty text has no words and no hits; an item without words, or with a
null id, has no windows; repeated documents and items are each reported or united by
id; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.common import arrow_schema, chunks, file_system, id_type, kept, lean, materialize, record_batch, scratch, text_frame

#: Benchmark text in one block of phrases; a worker holds two blocks at most, and as many segments as HELD while it goes through the blocks.
BLOCK_BYTES, HELD = 1 << 20, 16
#: Places of rarest terms that are looked at together.
NEAR_PLACES = 1 << 20
#: Bytes that separate words; all others, after A-Z are lower-cased, are part of one.
_APART = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters of the text with A-Z in lower case."""
    return text.lower().translate(_APART).split()


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def _planes(values: np.ndarray) -> bytes:
    """32-bit values byte by byte: the high bytes of small values compress to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments: doc_ids, lengths in words, terms, postings per term, positions (as differences)."""
    schema = T.StructType([
        T.StructField("doc_ids", T.ArrayType(id_type(docs, id_col))),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("terms", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
    ])
    out = arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, 2 << 20):
            split = [words(t) for t in texts]
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            numbers = _Numbers()
            flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int32, int(lengths.sum()))
            positions = np.argsort(flat, kind="stable")
            counts = np.bincount(flat, minlength=len(numbers))
            steps = np.diff(positions, prepend=0)
            first = (np.cumsum(counts) - counts)[: len(numbers)]
            if len(first):
                steps[first] = positions[first]
            yield record_batch(out, [ids.to_pylist()], [_planes(lengths)], [b" ".join(numbers)], [_planes(counts)], [_planes(steps)])

    return materialize(text_frame(docs, id_col, text_col).mapInArrow(lean(kernel), schema), "positional-index")


class Segment:
    """One segment, limited to the terms of a block of phrases."""

    def __init__(self, lengths: np.ndarray, terms: list[bytes], counts: np.ndarray, steps: np.ndarray):
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.terms, self.counts = terms, counts
        self.first = np.cumsum(counts) - counts
        total = np.cumsum(steps)
        # Steps restart with every term: take away the sum before it.
        base = np.where(self.first > 0, total[np.maximum(self.first - 1, 0)], 0) if len(terms) else np.zeros(0, np.int64)
        self.positions = total - np.repeat(base, counts)

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts + self.lengths, position, "right")

    def postings(self, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list lengths by query term, list starts, ascending keys term << 32 | position)."""
        of = np.fromiter((numbers.get(t, -1) for t in self.terms), np.int64, len(self.terms))
        known = np.flatnonzero(of >= 0)
        known = known[np.argsort(of[known])]
        size = np.zeros(len(numbers), np.int64)
        size[of[known]] = self.counts[known]
        begin = np.cumsum(size) - size
        n = self.counts[known]
        at = np.repeat(self.first[known] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return size, begin, np.repeat(of[known], n) << 32 | self.positions[at]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the list, place in it) of all elements of lists with these lengths."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


class Phrases:
    """Windows of consecutive item words, and the items they belong to."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.numbers: dict[bytes, int] = _Numbers()
        self.names: list[str] = []
        windows: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for name, text in items:
            ids = [self.numbers[w] for w in words(text)]
            if not ids:
                continue
            k = names.setdefault(name, len(names))
            for i in range(max(1, len(ids) - width + 1)):
                windows.setdefault(tuple(ids[i : i + width]), set()).add(k)
        self.numbers = dict(self.numbers)
        self.names = list(names)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        lengths: dict[int, list[tuple[int, ...]]] = {}
        for w in windows:
            lengths.setdefault(len(w), []).append(w)
        for n, ws in lengths.items():
            owners = [sorted(windows[w]) for w in ws]
            count = np.array([len(o) for o in owners])
            self.by_length[n] = np.array(ws, np.int64), count, np.cumsum(count) - count, np.array([k for o in owners for k in o], np.int64)

    def occurrences(self, segment: Segment) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, start positions, documents, documents by item, items) of all exact matches, for each length."""
        size, begin, keys = segment.postings(self.numbers)
        for n, (windows, count, first, owners) in self.by_length.items():
            for live, order in self._parts(windows, size):
                rarest = windows[live, order[:, 0]]
                which, k = _spread(size[rarest])
                start = (keys[begin[rarest[which]] + k] & 0xFFFFFFFF) - order[which, 0]
                keep = start >= 0
                which, start = which[keep], start[keep]
                for r in range(1, n):
                    if not len(which):
                        break
                    place = order[which, r]
                    wanted = windows[live[which], place] << 32 | (start + place)
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    keep = keys[at] == wanted
                    which, start = which[keep], start[keep]
                if not len(which):
                    continue
                doc = segment.doc(start)
                keep = doc == segment.doc(start + n - 1)
                which, start, doc = live[which[keep]], start[keep], doc[keep]
                whose, j = _spread(count[which])
                yield n, start, doc, doc[whose], owners[first[which[whose]] + j]

    @staticmethod
    def _parts(windows: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows all of whose terms occur, places of their terms by frequency), in parts with at most NEAR_PLACES places of rarest terms, one window at least."""
        live = np.flatnonzero((size[windows] > 0).all(axis=1))
        order = np.argsort(size[windows[live]], axis=1, kind="stable")  # the rarest term first
        ends = np.cumsum(size[windows[live, order[:, 0]]])
        at = 0
        while at < len(live):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + NEAR_PLACES, "right")))
            yield live[at:upto], order[at:upto]
            at = upto

    def near(self, segment: Segment, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, items) of windows all of whose words stand, in any order, within ``slop`` more consecutive words than the window has."""
        size, begin, keys = segment.postings(self.numbers)
        for n, (windows, count, first, owners) in self.by_length.items():
            for live, order in self._parts(windows, size):
                which, doc = self._stretches(segment, size, begin, keys, np.take_along_axis(windows[live], order, axis=1), n + slop)
                which = live[which]
                whose, j = _spread(count[which])
                yield doc[whose], owners[first[which[whose]] + j]

    @staticmethod
    def _stretches(segment: Segment, size: np.ndarray, begin: np.ndarray, keys: np.ndarray, terms: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, document), once each, where ``reach`` consecutive words of the document hold all terms of the window."""
        which, k = _spread(size[terms[:, 0]])
        place = keys[begin[terms[which, 0]] + k] & 0xFFFFFFFF
        doc = segment.doc(place)

        def held(which: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, r: int) -> np.ndarray:
            low = np.maximum(low, segment.starts[doc])
            high = np.minimum(high, segment.starts[doc] + segment.lengths[doc] - 1)
            term = terms[which, r] << 32
            at = np.searchsorted(keys, term | low)
            return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= (term | high))

        for r in range(1, terms.shape[1]):
            keep = held(which, doc, place - reach + 1, place + reach - 1, r)
            which, place, doc = which[keep], place[keep], doc[keep]
        found = [np.zeros((2, 0), np.int64)]
        # Stretches around the place, the most even first; a window is done with a document when one holds it.
        for back in sorted(range(reach), key=lambda b: abs(2 * b - reach)):
            if not len(which):
                break
            full = np.ones(len(which), bool)
            for r in range(1, terms.shape[1]):
                left = np.flatnonzero(full)
                full[left] = held(which[left], doc[left], place[left] - back, place[left] - back + reach - 1, r)
            if full.any():
                new = np.unique(np.stack([which[full], doc[full]]), axis=1)
                found.append(new)
                width = len(segment.lengths)
                keep = ~np.isin(which * width + doc, new[0] * width + new[1])
                which, place, doc = which[keep], place[keep], doc[keep]
        return tuple(np.concatenate(found, axis=1))


@lru_cache(2)
def _phrases(path: str) -> Phrases:
    system, own = file_system(path)
    with system.open_input_stream(own) as f:
        return pickle.loads(f.read())


kept("phrases", _phrases.cache_clear)


def write_phrases(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Write the phrases in blocks of bounded size to the shared folder; returns their paths."""
    rows = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("text")).where("name is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, paths = int(total // BLOCK_BYTES) + 1, []
    base = scratch(items.sparkSession, "phrases")
    system, own = file_system(base)
    system.create_dir(own, recursive=True)
    for b in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b).collect()  # a block of the query set
        made = Phrases(sorted((r["name"], bytes(r["text"])) for r in held), width)
        with system.open_output_stream(f"{own}/{b}") as f:
            f.write(pickle.dumps(made))
        paths.append(f"{base}/{b}")
    return paths


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Segment]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(0).slice(i, 1).flatten()
            lengths, terms, counts, steps = (batch.column(k)[i].as_py() for k in range(1, 5))
            yield ids, Segment(_values(lengths), terms.split(b" ") if terms else [], _values(counts), _values(steps))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.Array, Segment]]]:
    """Segments, HELD at a time: each block of phrases is read once for them."""
    held = []
    for one in _segments(batches):
        held.append(one)
        if len(held) == HELD:
            yield held
            held = []
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, width: int = 10, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Exact phrase matches: doc_id, n_words, n_hit, items (their ids as sorted strings), spans (hit word ranges)."""
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", index.schema["doc_ids"].dataType.elementType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    out = arrow_schema(schema)
    paths = write_phrases(items, width, item_col, item_text)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            edges = [np.zeros(int(segment.lengths.sum()) + 1, np.int64) for _, segment in group]
            items: list[dict[int, set[str]]] = [{} for _ in group]
            for path in paths:
                phrases = _phrases(path)
                for (_, segment), edge, found in zip(group, edges, items, strict=True):
                    for length, start, _, doc, item in phrases.occurrences(segment):
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + length, -1)
                        for d, k in np.unique(np.stack([doc, item]), axis=1).T.tolist():
                            found.setdefault(d, set()).add(phrases.names[k])
            for (ids, segment), edge, found in zip(group, edges, items, strict=True):
                yield told(ids, segment, edge, found)

    def told(ids: pa.Array, segment: Segment, edge: np.ndarray, found: dict[int, set[str]]) -> pa.RecordBatch:
        hit = np.cumsum(edge)[:-1] > 0
        total = np.r_[0, np.cumsum(hit)]
        n_hit = total[segment.starts + segment.lengths] - total[segment.starts]
        spans: list[list[dict]] = [[] for _ in segment.lengths]
        for d in np.flatnonzero(n_hit).tolist():
            own = np.flatnonzero(np.diff(np.r_[0, hit[segment.starts[d] : segment.starts[d] + segment.lengths[d]].astype(np.int8), 0]))
            spans[d] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(own[::2], own[1::2], strict=True)]
        return record_batch(out, ids, pa.array(segment.lengths), pa.array(n_hit), [sorted(found.get(d, ())) for d in range(len(segment.lengths))], spans)

    return index.mapInArrow(lean(kernel, "phrases"), schema)


def search_near(index: DataFrame, items: DataFrame, slop: int = 20, width: int = 10, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Unordered matches: doc_id, n_words, near (item_id and n_matches, by item_id as a string), one row for each document.

    n_matches counts pairs of an item and one of its distinct windows (``width`` words, or the whole of a
    shorter item) whose words all stand within ``slop`` more consecutive words of the document than the
    window has. Every exact match is one, however long the item.
    """
    item = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("n_matches", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", index.schema["doc_ids"].dataType.elementType), T.StructField("n_words", T.LongType()), T.StructField("near", T.ArrayType(item))])
    out = arrow_schema(schema)
    paths = write_phrases(items, width, item_col, item_text)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            items: list[list[dict[str, int]]] = [[{} for _ in segment.lengths] for _, segment in group]
            for path in paths:
                phrases = _phrases(path)
                for (_, segment), found in zip(group, items, strict=True):
                    for doc, k in phrases.near(segment, slop):
                        pairs, n = np.unique(np.stack([doc, k]), axis=1, return_counts=True)
                        for (d, i), m in zip(pairs.T.tolist(), n.tolist(), strict=True):
                            name = phrases.names[i]
                            found[d][name] = found[d].get(name, 0) + m
            for (ids, segment), found in zip(group, items, strict=True):
                near = [[{"item_id": name, "n_matches": m} for name, m in sorted(x.items())] for x in found]
                yield record_batch(out, ids, pa.array(segment.lengths), near)

    return index.mapInArrow(lean(kernel, "phrases"), schema)


def proximity(index: DataFrame, items: DataFrame, slop: int = 20, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_matches of all unordered matches."""
    return search_near(index, items, slop, item_col=item_col, item_text=item_text).select("doc_id", F.explode("near").alias("x")).select("doc_id", "x.item_id", "x.n_matches")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index the documents and search them for the items' windows: one row for each document."""
    return search(build_index(docs, id_col, text_col), items, width).withColumn("contaminated", F.col("n_hit") > 0)

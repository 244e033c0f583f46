"""Token files: ids in the fewest bits that the vocabulary needs, with block offsets.

Layout of a file: magic, then blocks of ``BLOCK`` ids packed most significant bit
first (each block starts at a byte), then a footer: for every block its byte offset,
for every document its id and number of tokens, then the footer's place and the
magic. A reader seeks straight to the blocks that hold a range of tokens and unpacks
them with a few numpy operations.

Documents are dealt out by ranges of their id, so file k holds smaller ids than file
k+1, and each task writes one file to the shared folder under a name of its own
attempt. Only files listed by tasks that succeeded are read.

Cases: null and empty texts hold the end id only; rows that repeat an id stay, next to
each other, ordered by a hash of the text; null ids come first; an empty table gives
no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.common import arrow_schema, chunks, commit_file, file_system, id_type, lean, materialize, record_batch, scratch, text_frame
from engramix.llm.encoding import encoder

MAGIC = b"TOKBITS1"
#: Ids in a block.
BLOCK = 8192
#: Ids that a reader unpacks at a time.
WINDOW = 1 << 20

MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed data."""
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return raw[: count * bits // 8].view(f">u{bits // 8}").astype(np.uint32)
    raw = np.r_[raw, np.zeros(5, np.uint8)]
    at = np.arange(count, dtype=np.int64) * bits
    byte = at >> 3
    held = np.zeros(count, np.uint64)
    for k in range(5):
        held = held << np.uint64(8) | raw[byte + k].astype(np.uint64)
    return (held >> (np.uint64(40 - bits) - (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenWriter:
    """Writes one file; documents are added in order."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.sink.write(MAGIC)
        self.at, self.tokens = len(MAGIC), 0
        self.offsets: list[int] = []
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids.append(doc_ids), self.lengths.append(lengths)
        self.pending.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= BLOCK:
            flat = np.concatenate(self.pending)
            whole = len(flat) // BLOCK * BLOCK
            self._blocks(flat[:whole])
            self.pending, self.held = [flat[whole:]], len(flat) - whole

    def _blocks(self, flat: np.ndarray) -> None:
        for i in range(0, len(flat), BLOCK):
            data = pack(flat[i : i + BLOCK], self.bits)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)

    def close(self, kind: pa.DataType) -> None:
        if self.held:
            self._blocks(np.concatenate(self.pending))
        sink = io.BytesIO()
        table = pa.table({"doc_id": pa.chunked_array(self.ids, kind), "n_tokens": pa.array(np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64), pa.int64())})
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        docs = sink.getvalue()
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(docs)
        self.sink.write(struct.pack("<IIQQQ", self.bits, BLOCK, self.tokens, len(self.offsets), len(docs)) + MAGIC)


class TokenReader:
    """Random access to one file: ``tokens(first, count)`` reads only the blocks it needs."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = struct.calcsize("<IIQQQ") + len(MAGIC)
        foot = self._at(size - tail, tail)
        if foot[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a finished token file")
        self.bits, self.block, self.n_tokens, blocks, docs = struct.unpack("<IIQQQ", foot[: -len(MAGIC)])
        self.end = size - tail - docs - 8 * blocks
        self.offsets = np.frombuffer(self._at(self.end, 8 * blocks), "<u8")
        with pa.ipc.open_stream(self._at(size - tail - docs, docs)) as r:
            table = r.read_all().combine_chunks()
        self.doc_ids, self.lengths = pa.concat_arrays(table.column(0).chunks) if table.num_rows else pa.array([], table.schema[0].type), table.column(1).to_numpy()
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def tokens(self, first: int, count: int) -> np.ndarray:
        if not count:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (first + count - 1) // self.block
        begin, end = int(self.offsets[a]), int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
        data, out = self._at(begin, end - begin), []
        for k in range(a, b + 1):
            n = min(self.block, self.n_tokens - k * self.block)
            part = data[int(self.offsets[k]) - begin :]
            out.append(unpack(part[: (n * self.bits + 7) // 8], self.bits, n))
        flat = np.concatenate(out)
        skip = first - a * self.block
        return flat[skip : skip + count]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the files; returns the manifest (shard, path, n_docs, n_tokens)."""
    kind = arrow_schema(T.StructType([T.StructField("x", id_type(docs, id_col))]))[0].type
    manifest = arrow_schema(MANIFEST)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, n = task.partitionId(), 0
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{shard:06d}-{task.taskAttemptId()}.tok"
        made = encoder(tokenizer)
        with system.open_output_stream(name + ".open") as sink:
            writer = TokenWriter(sink, bit_width(max(made.vocabulary, end_id + 1)))
            for ids, texts in chunks(batches, 1 << 20):
                flat, counts = made.encode([t.decode("utf-8", "replace") for t in texts])
                flat = np.insert(flat, np.cumsum(counts), end_id)
                writer.add(ids, flat, counts + 1)
                n += len(texts)
            writer.close(kind)
        if n:
            commit_file(system, name + ".open", name)
            yield record_batch(manifest, [shard], [folder + name[len(base) :]], [n], [writer.tokens])
        else:
            system.delete_file(name + ".open")

    dealt = text_frame(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialize(dealt.mapInArrow(lean(kernel, "encoder"), MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, id_kind: T.DataType, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids, from the files."""
    fields = [T.StructField("doc_id", id_kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    out = arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, own = file_system(path)
                with system.open_input_file(own) as source:
                    reader = TokenReader(source)
                    first, n = 0, len(reader.lengths)
                    while first < n:
                        last = max(first + 1, int(np.searchsorted(reader.starts, reader.starts[first] + WINDOW)))
                        starts, sizes = reader.starts[first:last], reader.lengths[first:last]
                        crcs, ids = [], []
                        if last == first + 1:  # perhaps longer than a window
                            crc = 0
                            for k in range(0, int(sizes[0]), WINDOW):
                                part = reader.tokens(int(starts[0]) + k, min(WINDOW, int(sizes[0]) - k)).astype("<u4")
                                crc = zlib.crc32(part, crc)
                                ids.append(part)
                            crcs, ids = [crc], [np.concatenate(ids)] if with_ids else []
                        else:
                            flat = reader.tokens(int(starts[0]), int(sizes.sum())).astype("<u4")
                            for s, k in zip((starts - starts[0]).tolist(), sizes.tolist(), strict=True):
                                crcs.append(zlib.crc32(flat[s : s + k]))
                                if with_ids:
                                    ids.append(flat[s : s + k])
                        yield record_batch(out, reader.doc_ids.slice(first, last - first), (starts + base).tolist(), sizes.tolist(), crcs, *([ids] if with_ids else []))
                        first = last

    # One row for each file: the running sum is over as many rows as there are partitions.
    files = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).select("path", "base")
    return files.repartition(max(1, manifest.count())).mapInArrow(lean(kernel, "encoder"), schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and return what is read back from them."""
    folder = scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id, id_col, text_col), id_type(docs, id_col))

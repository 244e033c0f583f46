"""WARC files: pages written as records, read back as a table of chunks.

Equal payloads of at least ``least`` bytes are stored once: the record with the largest
page id is the response, the others are revisits of it. Each task writes one archive of
gzip members to the shared folder under a name of its own attempt; only archives listed
by tasks that succeeded are read. The reader streams an archive and turns each payload
into rows of record id and chunk number that carry the digest so far, so that no record
is ever held as a whole.

Cases: a null page is an empty payload and a response; repeated rows of a largest page
id are responses each; a null page id is written without an id, refers to another page
where its payload is repeated and is never referred to unless all ids of a group are
null; an empty table gives no rows; only the id, the address and the page are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.common import arrow_schema, commit_file, file_system, id_type, lean, materialize, record_batch, scratch

#: Bytes of payload in a row of the table, and bytes read at a time.
CHUNK = 1 << 20
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])
#: Every record of one run has the same date: the output is the same whenever it's made.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to: null for responses, the response's id for revisits.

    Digests are grouped by themselves (with partial sums, so a hot payload is no hot
    task). Only the repeated ones are joined back: they are a written table, so Spark
    sends them to the pages where they are few, without moving a payload, and divides a
    hot key where they are many. Small pages have no digest and take no part.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.unhex(F.sha1("payload")))
    groups = rows.select("page_id", digest.alias("digest")).where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    groups = materialize(groups, "repeated-digests")
    keyed = rows.withColumn("digest", digest)
    large = keyed.where("digest is not null").join(groups, "digest", "left")
    joined = large.unionByName(keyed.where("digest is null").withColumn("last", F.lit(None).cast(groups.schema["last"].dataType)))
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def _record(kind: str, page: str | None, url: str | None, payload: bytes, refers: str | None) -> Iterator[bytes]:
    """A record in pieces, the payload never copied."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    # Line ends can't stand in a header.
    target = " ".join((url or "").split()) or "urn:none"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{target}|{digest}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (len(payload) if kind == 'response' else 0)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Page: {refers}"]
    yield ("\r\n".join(head) + "\r\n\r\n").encode("utf-8") + http
    if kind == "response":
        for i in range(0, len(payload), CHUNK):
            yield memoryview(payload)[i : i + CHUNK]
    yield b"\r\n\r\n"


def write_archives(classified: DataFrame, folder: str) -> DataFrame:
    """Write the archives; returns the manifest (path, n_records)."""
    manifest = arrow_schema(MANIFEST)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name, n = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        with system.open_output_stream(name + ".open", compression=None) as sink:
            for batch in batches:
                ids, urls, payloads, refers = batch.columns
                for i in range(batch.num_rows):
                    page, to = ids[i].as_py(), refers[i].as_py()
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    for piece in _record("response" if to is None else "revisit", None if page is None else str(page), urls[i].as_py(), payloads[i].as_py(), None if to is None else str(to)):
                        sink.write(packer.compress(piece))
                    sink.write(packer.flush())
                    n += 1
        if n:
            commit_file(system, name + ".open", name)
            yield record_batch(manifest, [folder + name[len(base) :]], [n])
        else:
            system.delete_file(name + ".open")

    return materialize(classified.select("page_id", "url", "payload", "refers_to").mapInArrow(lean(kernel), MANIFEST), "warc-manifest")


class _Stream:
    """The bytes of concatenated gzip members, a bounded piece at a time."""

    def __init__(self, source):
        self.source, self.raw, self.held, self.inflate = source, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            piece = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end."""
        while (i := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out, self.held = self.held[: i + len(mark)], self.held[i + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, as they come."""
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line for k, v in [line.split(":", 1)]}


def records(source) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """(headers, bytes of the whole payload, payload in chunks) of each record; the chunks must be read before the next record."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError("a record was expected")
        fields = _fields(head)
        length = int(fields["content-length"])
        http = stream.until(b"\r\n\r\n") or b""
        left = length - len(http)
        whole = int(_fields(http).get("content-length", left))

        def chunks(left: int = left) -> Iterator[bytes]:
            held, size = [], 0
            for piece in stream.pieces(left):
                held.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    flat = b"".join(held)
                    yield flat[:CHUNK]
                    held, size = [flat[CHUNK:]], size - CHUNK
            yield b"".join(held)

        yield fields, whole, chunks()
        b"".join(stream.pieces(4))  # the two line ends after a record


def read_archives(manifest: DataFrame, id_kind: T.DataType, with_data: bool = False) -> DataFrame:
    """The chunk table: page_id, record_id, record_type, refers_to, payload_bytes, chunk, chunk_bytes, digest_so_far, is_last and, if asked for, data.

    A revisit has one empty chunk, with the digest that its header states.
    """
    kinds = [("page_id", id_kind), ("record_id", T.StringType()), ("record_type", T.StringType()), ("refers_to", id_kind), ("payload_bytes", T.LongType()), ("chunk", T.LongType()), ("chunk_bytes", T.LongType()), ("digest_so_far", T.StringType()), ("is_last", T.BooleanType())]
    ids = {"page_id", "refers_to"}
    raw = T.StructType([T.StructField(n, T.StringType() if n in ids else t) for n, t in kinds] + [T.StructField("data", T.BinaryType())] * with_data)
    out = arrow_schema(raw)

    def rows(path: str) -> Iterator[list]:
        system, own = file_system(path)
        with system.open_input_stream(own, compression=None) as source:
            for fields, whole, chunks in records(source):
                digest, k, last = hashlib.sha1(), 0, None
                stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                head = [fields.get("x-page-id"), fields["warc-record-id"].strip("<>"), fields["warc-type"], fields.get("warc-refers-to-page"), whole]
                for data in chunks:
                    if last is not None:
                        yield last
                    digest.update(data)
                    last = [*head, k, len(data), digest.hexdigest(), False, *[data] * with_data]
                    k += 1
                if fields["warc-type"] == "response" and last[7] != stated:
                    raise ValueError(f"the payload of {head[1]} doesn't have the digest stated")
                last[7], last[8] = stated, True
                yield last

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += row[6] if with_data else 1
                    if size >= (8 * CHUNK if with_data else 5000):
                        yield record_batch(out, *map(list, zip(*held, strict=True)))
                        held, size = [], 0
                if held:
                    yield record_batch(out, *map(list, zip(*held, strict=True)))

    table = manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(lean(kernel), raw)
    return table.withColumns({n: F.col(n).cast(t) for n, t in kinds if n in ids})


def archive(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages and return the chunk table read back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(classify(pages, least, id_col, url_col, html_col), folder), id_type(pages, id_col))

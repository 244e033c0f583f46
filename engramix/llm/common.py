"""Helpers shared by the operators: scratch space, Arrow batching, file systems."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes of text that a kernel holds as Python objects at a time.
CHUNK_BYTES = 4 << 20
#: Spark's setting for the bytes of an Arrow batch.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset (tests, single machines) a folder in the warehouse is
    used and set as the checkpoint folder.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table cuts the lineage: a lost executor costs a reread, not a
    recomputation.
    """
    small_batches(df.sparkSession)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}" if folder else scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """The tables of one run in a folder of their own, which goes when the run ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, self.folder)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that goes to a Python worker, unless the session already has a bound of its own.

    Rows alone are no bound: ten thousand whole texts may be hundreds of megabytes.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(CHUNK_BYTES))


def text_frame(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty) as UTF-8 bytes; other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def id_type(df: DataFrame, id_col: str) -> T.DataType:
    return df.schema[id_col].dataType


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts) of at most ``limit`` bytes, or of one longer text, from batches of (doc_id, text as binary)."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        first, held = 0, 0
        lengths = pc.binary_length(texts).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + (n or 0) > limit:
                yield ids.slice(first, i - first), [x or b"" for x in texts.slice(first, i - first).to_pylist()]
                first, held = i, 0
            held += n or 0
        if first < len(lengths):
            yield ids.slice(first), [x or b"" for x in texts.slice(first).to_pylist()]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """Columns (arrays or lists) as a batch of the schema."""
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def release() -> None:
    """Give freed memory back: Python workers outlive their tasks, and an executor's workers share its limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker process keeps between tasks: functions that let it go, by name.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(name: str, forget: Callable[[], None]) -> None:
    """Register something that a worker keeps for later tasks of the same kernel."""
    _KEPT[name] = forget


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, in a worker that holds only what this kernel uses, before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in _KEPT.items():
            if name != uses:
                forget()
        release()
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def file_system(uri: str):
    """(file system, path) of a shared path that any executor can open."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def commit_file(system, temporary: str, final: str) -> None:
    """Give a finished file its name; a reader only sees files that a successful task has listed."""
    system.move(temporary, final)

"""Tables in a shared folder: scratch results that cut lineage, and versioned tables that are swapped as a whole."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where it is unset."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return given.rstrip("/") if given else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: a lost executor costs a reread, and iterative plans stay small."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting for the bytes of an Arrow batch, and its value where a session has none.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that goes to a Python worker, unless the session has a bound of its own: ten thousand texts have none."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class TableStore:
    """Named Parquet tables below a folder.

    A write makes a new version and then points at it; an append makes a folder of its own in
    the latest version, which gets its name when it is complete. So readers see all of a change
    or nothing of it. What is written within ``batch`` is put back if the batch did not end and
    is run again, and is not run again if it did.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._key: str | None = None
        self._pinned: dict[str, int] = {}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _names(self, *parts: str) -> list[str]:
        root = self._path(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def versions(self, name: str) -> list[int]:
        done = [int(n[1:]) for n in self._names(name) if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._path(name, n, "_SUCCESS"))]
        return sorted(done)

    def read(self, name: str, schema: str) -> DataFrame:
        found = self.versions(name)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}/v{found[-1]}")

    def write(self, name: str, df: DataFrame) -> None:
        """The job's own commit makes the version visible; the two latest, and that at the start of a batch, stay for readers."""
        found = self.versions(name)
        n = found[-1] + 1 if found else 0
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{n}")
        for old in found[:-1]:
            if old != self._pinned.get(name):
                self._fs.delete(self._path(name, f"v{old}"), True)

    def append(self, name: str, df: DataFrame) -> None:
        found = self.versions(name)
        if not found:
            self._fs.create(self._path(name, "v0", "_SUCCESS")).close()
        version, part = f"v{found[-1] if found else 0}", f"{self._key or uuid.uuid4().hex}-{uuid.uuid4().hex[:8]}"
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{version}/_{part}")
        self._fs.rename(self._path(name, version, f"_{part}"), self._path(name, version, part))

    @contextlib.contextmanager
    def batch(self, key: str) -> Iterator[bool]:
        """Whether a batch of this key (letters and digits) is still to be done; its changes count only once."""
        begin, done = self._path("_batches", key, "begin"), self._path("_batches", key, "done")
        if self._fs.exists(done):
            yield False
            return
        if self._fs.exists(begin):
            with_lines = self._fs.open(begin)
            text = bytes(with_lines.readAllBytes()).decode()
            with_lines.close()
            self._undo(key, json.loads(text))
        else:
            state = {n: v[-1] for n in self._names() if not n.startswith("_") and (v := self.versions(n))}
            out = self._fs.create(begin)
            out.write(bytearray(json.dumps(state).encode()))
            out.close()
        self._pinned = {n: v[-1] for n in self._names() if not n.startswith("_") and (v := self.versions(n))}
        self._key = key
        try:
            yield True
            self._fs.create(done).close()
        finally:
            self._key, self._pinned = None, {}

    def _undo(self, key: str, state: dict[str, int]) -> None:
        for name in [n for n in self._names() if not n.startswith("_")]:
            for v in self.versions(name):
                if v > state.get(name, -1):
                    self._fs.delete(self._path(name, f"v{v}"), True)
                else:
                    for part in self._names(name, f"v{v}"):
                        if part.lstrip("_").startswith(f"{key}-"):
                            self._fs.delete(self._path(name, f"v{v}", part), True)

    def reset(self) -> None:
        self._fs.delete(self._path(), True)

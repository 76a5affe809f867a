"""What the operators of this subpackage share: the shared scratch folder, remote files, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    root = store.shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """A private folder below the shared root; intermediate tables live here, so a lost executor costs a re-read only."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"

    def sub(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back: computed once, lineage cut."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.sub(name))
        return self.spark.read.schema(schema).parquet(self.sub(name))

    def drop(self, name: str) -> None:
        """Delete an intermediate table that nothing reads any more."""
        jvm, path = self.spark.sparkContext._jvm, self.sub(name)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path (plain, file:, hdfs:, s3: ...), and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


@contextmanager
def written(path: str) -> Iterator[pa.NativeFile]:
    """A file for one task: written beside its place, then renamed, so that attempts never mix."""
    filesystem, place = open_fs(path)
    filesystem.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part) as out:
        yield out
    filesystem.move(part, place)


_HELD: dict = {}


def remembered(kind, make):
    """What all tasks of a Python worker share. Asking for another kind frees it, so that the memories of stages never add up."""
    if kind not in _HELD:
        forget()
        _HELD[kind] = make()
    return _HELD[kind]


def forget() -> None:
    """Free what another stage of this Python worker remembers."""
    if _HELD:
        _HELD.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: Python's garbage, Arrow's pool and, where the C library can, its heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A task's generator that gives freed memory back when it ends, so that the leavings of stages never add up in a Python worker."""

    def to_the_end(*given):
        try:
            yield from run(*given)
        finally:
            give_back()

    return to_the_end


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def rows_out(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def bins(spark: SparkSession, total: int | None, each: int) -> int:
    """Among how many bins ``total`` bytes are dealt so that one holds about ``each``, whatever the input's size; never fewer than the session's shuffle partitions."""
    return max(parallelism(spark), -(-int(total or 0) // each))


def in_bins(rows: DataFrame, n: int) -> DataFrame:
    """Rows by their number ``bin`` below n, each bin a partition of its own: of hashed numbers several would meet in a task."""
    return rows.repartitionById(n, F.col("bin"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def joined_parts(lists: pa.Array) -> list[memoryview]:
    """What each list of binary holds, one after the other, as it lies in their buffer; a null list is empty."""
    values = lists.flatten().cast(pa.large_binary())
    edges = np.frombuffer(values.buffers()[1], "<i8", len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, "<i8")
    data = memoryview(values.buffers()[2] or b"")
    at = edges[np.cumsum([0, *pc.list_value_length(lists).fill_null(0).to_pylist()])].tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def text_slices(batch: pa.RecordBatch, name: str, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of about ``most`` bytes of text each (one row at least), to bound memory."""
    sizes = pc.binary_length(batch.column(name)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: extra columns with clashing names never reach an operator."""
    return df.select(*[F.col(f"`{c}`") for c in columns])

"""What the operators of this subpackage share: tables in the shared folder, row keys, reading."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have, at most, for it to be sent to all executors; beyond it the same join is a shuffle.
BROADCAST_ROWS = 1_000_000
#: Spark's setting that shuffle files go as soon as their query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the rows of an Arrow batch, and as many as batches of whole texts should have: each is held in the JVM and in Python.
ARROW_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, a session in one process gets a temporary one; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="packlens-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/packlens/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """For writes: their shuffles aren't needed after them."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: what follows doesn't repeat the work, and it outlives executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for table in tables:
        for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have ``TEXT_ROWS`` rows at most; a lower setting stays."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, TEXT_ROWS)


def release() -> None:
    """Hands back memory that this Python worker has freed; workers are kept for later tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A task's batches in parts of at most ``rows`` rows; at its end freed memory is handed back."""
    try:
        for whole in batches:
            for at in range(0, len(whole), rows):
                yield whole.slice(at, rows)
    finally:
        whole = None
        release()


def small(df: DataFrame) -> DataFrame:
    """A stashed narrow table, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def whole_text(column: str = "text") -> Column:
    """The text; a null one is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

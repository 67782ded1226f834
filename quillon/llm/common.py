"""What the operators share: reading tables, words, and written tables that cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space; bytes.split() finds the same ones.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b" \t\n\r\x0b\x0c"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only where it is unset, and only
    where driver and executors are one process, as in tests: other executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Removes a query's shuffle files at its end; what staged() wrote needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lost executors recompute nothing before it."""
    conf = df.sparkSession.conf
    path = f"{shared_dir(df.sparkSession)}/quillon/{label}-{uuid.uuid4().hex}"
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._quillon_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch that Python gets; texts of a few thousand characters make it a few megabytes.
BATCH_ROWS, BATCH_BYTES = "1000", str(8 << 20)


def give_back() -> None:
    """Returns a worker's freed memory to the system; workers outlive tasks, and others run beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) in small batches, tidied up at each task's end. The session keeps the batch size."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tasks(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle partitions of the session, the width of what is dealt by key here."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))

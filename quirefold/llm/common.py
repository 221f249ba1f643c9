"""What the operators here share: words, tables and batches. Intermediate tables are those of ``sources.stored``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.files import spread
from quirefold.sources.stored import checkpoint_root, drop, scope, store

__all__ = ["ascii_lower", "checkpoint_root", "drop", "forget", "keeps", "read", "release", "scope", "shuffle_width", "small_batches", "small_tables", "store", "tidy"]

#: A word, for every operator here whose contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(u): ord(low) for u, low in zip(UPPER, LOWER)}


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def release() -> None:
    """Gives memory that a finished task no longer needs back to the machine; Python workers live on between tasks.

    From its first task on a worker takes Arrow's memory from the C library, which gives all of it back.
    """
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.set_memory_pool(pa.system_memory_pool())
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


#: What modules keep in a worker between tasks, by name, and how to drop it.
_kept: dict[str, list] = {}


def keeps(name: str, *drop) -> None:
    _kept[name] = list(drop)


def forget(but: str = "") -> None:
    """Drops what other operators' tasks have left in this worker."""
    for name, drop in _kept.items():
        if name != but:
            for d in drop:
                d()


def tidy(run, but: str = ""):
    """A function over Arrow batches that starts without what others kept, and releases memory at its end."""

    def tidied(batches):
        forget(but)
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


#: Rows of an Arrow batch that holds whole texts; both sides of the pipe hold several batches at a time.
BATCH_ROWS = 300


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of whole texts small enough for the Python workers' share of an executor."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of an Arrow batch that a task gives back; the JVM keeps buffers of the largest it has seen.
BATCH_BYTES = 4 << 20


def small_tables(table):
    """An Arrow table cut into batches of about ``BATCH_BYTES``."""
    import pyarrow as pa

    rows = max(1, int(table.num_rows * BATCH_BYTES / max(table.nbytes, 1)))
    return pa.Table.from_batches(table.to_batches(max_chunksize=rows), table.schema)

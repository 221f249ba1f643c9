"""Tables written between steps, in the folder that every machine can read: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written within open scopes, innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; on one machine, as in tests, a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="quirefold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once and reads it back. Its files go with the scope it is written in, else when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hpath = _file_system(spark, path)
    fs.deleteOnExit(hpath)
    if _scopes:
        _scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    path = getattr(df, "_stored_at", None)
    if path:
        fs, hpath = _file_system(df.sparkSession, path)
        fs.delete(hpath, True)


@contextmanager
def scope():
    """Tables stored inside go at its end; what outlives it is stored outside, by ``keep``, the function it gives."""
    mine: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        _scopes.remove(mine)
        try:
            return store(df, label)
        finally:
            _scopes.append(mine)

    _scopes.append(mine)
    try:
        yield keep
    finally:
        _scopes.remove(mine)
        for spark, path in mine:
            fs, hpath = _file_system(spark, path)
            fs.delete(hpath, True)

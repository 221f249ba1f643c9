"""Documents as a stream. Each document comes as one row, so what works on one document alone needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirefold.functions import text as T
from quirefold.operators import lines


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """(doc_id, text): new text files of a folder, the path as the document's id."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).format("text").load(path)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def stream_lines(docs: DataFrame) -> DataFrame:
    return lines.number_lines(docs)


def stream_chunks(docs: DataFrame, max_lines: int = 20, max_chars: int = 1200) -> DataFrame:
    return lines.pack_chunks(lines.text_lines(docs), max_lines=max_lines, max_chars=max_chars)


def stream_statements(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, statement, fingerprint, junk): lines under the rules of statements."""
    rows = lines.number_lines(docs).select("doc_id", "line_no", T.normalize_text(F.col("text")).alias("statement"))
    return rows.withColumn("fingerprint", T.fingerprint(F.col("statement"))).withColumn("junk", T.is_header_or_junk(F.col("statement")))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table, all there is now and then no more."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

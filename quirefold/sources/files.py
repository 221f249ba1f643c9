"""Files in and out: numbered text, JSON, Markdown, PDF, hashes and manifests. Paths may be any that Spark reads."""

from __future__ import annotations

import importlib
import io
import json
import platform
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.operators.lines import parse_documents

LINES = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("text", T.StringType())])
CHUNKS = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("line_start", T.LongType()), T.StructField("line_end", T.LongType()), T.StructField("text", T.StringType())])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table of fewer input splits than there are cores, dealt out to all of them by key; a larger one as it is.

    So small tables use the whole machine, and what is grouped by the key later needs no further shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of numbered text files, the path as the document's id."""
    return parse_documents(read_texts(spark, path), "path", "text")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON arrays or objects by a fixed schema; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_file(df: DataFrame, path: str) -> None:
    """One JSON array, indented by two, in UTF-8 and ended by a line feed, at a path of the driver's machine; for exports that people
    read. Rows pass one by one, so the driver holds no more than a partition."""
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()
    with file.open("w", encoding="utf-8") as out:
        lead = "["
        for (row,) in rows:
            text = json.dumps(json.loads(row), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            out.write(f"{lead}\n  {text}")
            lead = ","
        out.write("[]\n" if lead == "[" else "\n]\n")


def write_texts(df: DataFrame, path: str, key_col: str, text_col: str) -> None:
    """One folder of text for each value of the key."""
    df.select(F.col(key_col).alias("key"), F.col(text_col).alias("value")).write.mode("overwrite").partitionBy("key").text(path, lineSep="\n")


def line_rows(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "line_no", "text")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks without the lines that they were packed from."""
    return chunks.select("doc_id", "chunk_id", "line_start", "line_end", "text")


#: PDF backends in the order they are tried: module, and how its pages are opened.
PDF_BACKENDS = (("pdfplumber", lambda module, file: module.open(file).pages), ("pypdf", lambda module, file: module.PdfReader(file).pages))


def _pdf_text(data: bytes) -> str:
    """The text of the first backend that finds any; empty if none does."""
    text, found = "", False
    for name, pages in PDF_BACKENDS:
        try:
            module = importlib.import_module(name)
        except ImportError:
            continue
        found = True
        text = "\n".join(t for page in pages(module, io.BytesIO(data)) if (t := page.extract_text() or "").strip())
        if text:
            return text
    if not found:
        raise RuntimeError("reading PDF needs pdfplumber or pypdf on every machine")
    return text


@F.arrow_udf(T.StringType())
def pdf_text(data: pa.Array) -> pa.Array:
    return pa.array([_pdf_text(d) for d in data.to_pylist()], pa.string())


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF files, by whichever backend is there."""
    return spark.read.format("binaryFile").load(path).select("path", pdf_text(F.col("content")).alias("text"))


def sha256_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest(hashes: DataFrame) -> DataFrame:
    """One row: a map of path to hash."""
    return hashes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "sha256")))).alias("sha256"))


def run_metadata(spark: SparkSession, ran: list[str], skipped: list[str], model_id: str = "") -> DataFrame:
    """One row about a run: its steps and its environment."""
    row = [(True, ran, skipped, {"python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "model_id": model_id})]
    return spark.createDataFrame(row, "success boolean, ran_steps array<string>, skipped_steps array<string>, env map<string,string>")

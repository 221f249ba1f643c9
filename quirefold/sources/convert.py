"""Command line: HTML or PDF files to numbered text.

    python -m quirefold.sources.convert --html IN --out OUT
    python -m quirefold.sources.convert --pdf IN --out OUT

IN may be a file, a folder or a pattern; OUT is a folder with the text of each file under its name. With both given, PDF wins.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import cleanup
from quirefold.sources import files, html


def numbered(blocks: DataFrame, config: cleanup.CleanupConfig = cleanup.CleanupConfig()) -> DataFrame:
    """(doc_id, text): the clean lines of (doc_id, pos, line), numbered, each ended."""
    row = F.struct("line_no", F.concat(F.col("line_no").cast("string"), F.lit(". "), "text").alias("x"))
    return cleanup.clean_lines(blocks, config).groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["x"]), "\n"), F.lit("\n")).alias("text"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    return html.page_blocks(files.read_texts(spark, path), "path", "text")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of PDF files; a file without any text fails."""
    texts = files.read_pdfs(spark, path).withColumn("text", F.when(T.strip(F.col("text")) != "", F.col("text")))
    checked = F.coalesce("text", F.raise_error(F.concat(F.lit("no text in "), "path")).cast("string"))
    return texts.select(F.col("path").alias("doc_id"), F.posexplode(T.split_lines(checked)).alias("pos", "line"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--html")
    p.add_argument("--pdf")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    if not (a.html or a.pdf):
        p.error("give --html or --pdf")
    spark = SparkSession.builder.getOrCreate()
    out = numbered(pdf_files(spark, a.pdf) if a.pdf else html_files(spark, a.html))
    files.write_texts(out.withColumn("name", F.regexp_extract("doc_id", r"([^/]+)$", 1)), a.out, "name", "text")


if __name__ == "__main__":
    main()

"""Blocks of a source to clean lines. Relations are (doc_id, pos, line); order is by pos within a document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

LOWER_START = r"^[\p{Ll}\x{aa}\x{ba}]"
BULLET = rf"^(?:-|\*|•|[0-9]+\.){T.SPACE}+"


@dataclass(frozen=True)
class CleanupConfig:
    wrap_width: int = 0
    squeeze_spaces: bool = True
    dehyphenate: bool = True
    drop_page_numbers: bool = True
    drop_boilerplate: bool = True
    #: A line is boilerplate from this many times on, up to this length.
    boilerplate_times: int = 4
    boilerplate_chars: int = 120


def boilerplate_lines(lines: DataFrame, times: int = 4, chars: int = 120) -> DataFrame:
    """(doc_id, line, times) of lines that repeat within a document and look like headers or footers."""
    counted = lines.groupBy("doc_id", "line").agg(F.count("*").alias("times"))
    return counted.where((F.col("times") >= times) & (F.length("line") <= chars) & T.is_footer_like(F.col("line")))


def drop_boilerplate(lines: DataFrame, times: int = 4, chars: int = 120) -> DataFrame:
    # Repetition within one document: the anti-join's right side is small, and a document's lines are spread by line.
    return lines.join(boilerplate_lines(lines, times, chars), ["doc_id", "line"], "left_anti").select("doc_id", "pos", "line")


def dehyphenate(lines: DataFrame) -> DataFrame:
    """Joins a line that ends in a dash with the next one, if that starts in lower case; a joined line joins no further.

    In a run of lines that could each join the next, the first, third, fifth ... do.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.withColumn("next", F.lead("line").over(order))
    rows = rows.withColumn("may", F.coalesce(F.col("line").endswith("-") & F.col("next").rlike(LOWER_START), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(~F.col("may"), 1).otherwise(0)).over(order))
    inside = Window.partitionBy("doc_id", "run", "may").orderBy("pos")
    rows = rows.withColumn("joins", F.col("may") & (F.row_number().over(inside) % 2 == 1))
    rows = rows.withColumn("taken", F.coalesce(F.lag("joins").over(order), F.lit(False)))
    line = F.when(F.col("joins"), F.concat(F.regexp_replace("line", "-$", ""), F.col("next"))).otherwise(F.col("line"))
    return rows.where("not taken").select("doc_id", "pos", line.alias("line"))


def merge_soft_wraps(lines: DataFrame) -> DataFrame:
    """Joins lines into paragraphs: a line goes on if it starts in lower case, is no bullet, and the line before has no final stop."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    line, before = F.col("line"), F.lag("line").over(order)
    starts = before.isNull() | line.rlike(BULLET) | T.strip(before).rlike(r"[.;:!?]$") | ~line.rlike(LOWER_START)
    rows = lines.withColumn("starts", starts)
    rows = rows.withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(order))
    merged = rows.groupBy("doc_id", "paragraph").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("parts"))
    joined = F.array_join(F.col("parts.line"), " ")
    return merged.select("doc_id", "pos", F.when(F.size("parts") > 1, T.strip(joined)).otherwise(joined).alias("line"))


def hard_wrap(line: Column, width: int) -> Column:
    """array of the parts of a line, packed greedily from its words; a longer word has a part of its own."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        fits = F.length(s["cur"]) + 1 + F.length(w) <= width
        return F.struct(
            F.when(s["cur"] == "", w).when(fits, F.concat(s["cur"], F.lit(" "), w)).otherwise(w).alias("cur"),
            F.when((s["cur"] == "") | fits, s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))).alias("out"),
        )

    wrapped = F.aggregate(F.split(line, " ", -1), start, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))
    return F.when(F.length(line) <= width, F.array(line)).otherwise(wrapped)


def wrap_lines(lines: DataFrame, width: int) -> DataFrame:
    if width <= 0:
        return lines
    parts = lines.select("doc_id", "pos", F.posexplode(hard_wrap(F.col("line"), width)).alias("part", "line"))
    return parts.select("doc_id", F.struct("pos", "part").alias("pos"), "line")


def clean_lines(blocks: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """(doc_id, line_no, text) of (doc_id, pos, line): trimmed, without boilerplate and page numbers, joined into paragraphs."""
    lines = blocks.select("doc_id", "pos", T.strip(F.col("line")).alias("line")).where("line <> ''")
    if config.drop_boilerplate:
        lines = drop_boilerplate(lines, config.boilerplate_times, config.boilerplate_chars)
    if config.drop_page_numbers:
        lines = lines.where(~T.is_page_number(F.col("line")))
    if config.squeeze_spaces:
        lines = lines.withColumn("line", T.strip(F.regexp_replace("line", f"{T.SPACE}{{2,}}", " ")))
    if config.dehyphenate:
        lines = dehyphenate(lines)
    lines = wrap_lines(merge_soft_wraps(lines), config.wrap_width)
    kept = lines.withColumn("text", T.strip(F.col("line"))).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return kept.select("doc_id", number.cast("long").alias("line_no"), "text")

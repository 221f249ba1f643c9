"""Numbered lines and chunks. A document is one row until its lines or chunks are exploded, so none of this shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

# The ways a line can carry its number, tried in this order.
NUMBERED = (
    rf"^{T.SPACE}*([0-9]+)\.{T.SPACE}*(.*?){T.SPACE}*$",
    rf"^{T.SPACE}*([0-9]+)\){T.SPACE}*(.*?){T.SPACE}*$",
    rf"^{T.SPACE}*([0-9]+){T.SPACE}*-{T.SPACE}*(.*?){T.SPACE}*$",
    rf"^{T.SPACE}*([0-9]+){T.SPACE}+(.+?){T.SPACE}*$",
)


def exploded(rows: DataFrame, array_col: str, pos: str, value: str) -> DataFrame:
    """The other columns with each element of an array and its place. An outer explode, filtered: of a plain one Spark infers a
    filter on the array's size and evaluates the whole expression behind the array once more for it."""
    others = [c for c in rows.columns if c != array_col]
    return rows.select(*others, F.posexplode_outer(array_col).alias(pos, value)).where(F.col(pos).isNotNull())


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines array<string>): stripped lines that are not blank, in order."""
    lines = F.filter(F.transform(T.split_lines(F.coalesce(F.col(text_col), F.lit(""))), T.strip), lambda x: x != "")
    return docs.select(id_col, lines.alias("lines"))


def number_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, text): lines that are not blank, numbered from 1."""
    rows = exploded(text_lines(docs, id_col, text_col), "lines", "pos", "text")
    return rows.select(id_col, (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def numbered_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) in the canonical form: ``1. first``, ``2. second`` ..., each line ended."""
    numbered = F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return text_lines(docs, id_col, text_col).select(id_col, F.concat(F.array_join(numbered, "\n"), F.lit("\n")).alias("text"))


def parse_numbered(line: Column) -> Column:
    """struct(line_no, text) of a numbered line, null if it has no number."""
    out = F.lit(None).cast("struct<line_no:bigint,text:string>")
    for pattern in reversed(NUMBERED):
        found = F.struct(F.regexp_extract(line, pattern, 1).try_cast("bigint").alias("line_no"), F.regexp_extract(line, pattern, 2).alias("text"))
        out = F.when(line.rlike(pattern), found).otherwise(out)
    return out


def parse_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, raw, line_no, text) of all lines that are not blank; line_no is null where a line cannot be parsed."""
    split = docs.select(id_col, T.split_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("raws"))
    raw = exploded(split, "raws", "pos", "raw").where(T.strip(F.col("raw")) != "")
    return raw.withColumn("p", parse_numbered(F.col("raw"))).select(id_col, "pos", "raw", F.col("p.line_no").alias("line_no"), F.col("p.text").alias("text"))


def numbering_violations(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, rule, message) of lines that cannot be parsed, repeat a number, or break the count of one by one."""
    order = Window.partitionBy(id_col).orderBy("pos")
    same = Window.partitionBy(id_col, "line_no").orderBy("pos")
    rows = parsed.withColumn("before", F.lag("line_no").over(order)).withColumn("nth", F.row_number().over(same))
    n, before = F.col("line_no"), F.col("before")
    rule = F.when(n.isNull(), "unparseable").when(F.col("nth") > 1, "duplicate").when(before.isNotNull() & (n != before + 1), "gap")
    message = (
        F.when(F.col("rule") == "unparseable", F.concat(F.lit("cannot be parsed: "), F.col("raw")))
        .when(F.col("rule") == "duplicate", F.concat(F.lit("repeated line number "), n.cast("string")))
        .otherwise(F.concat(F.lit("expected "), (before + 1).cast("string"), F.lit(", got "), n.cast("string")))
    )
    return rows.withColumn("rule", rule).where("rule is not null").select(id_col, F.col("pos").cast("long").alias("pos"), "rule", message.alias("message"))


def empty_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of documents without any line."""
    return text_lines(docs, id_col, text_col).where(F.size("lines") == 0).select(id_col)


def chunk_starts(lengths: Column, max_lines: int, max_chars: int) -> Column:
    """Places (from 0) of the lines that open a chunk, by a fold over the lines' lengths.

    A line opens a chunk if the one before is full, or if with it the characters (each line and its end) would be too
    many and the chunk holds a line already. Only openings are kept, so the state stays small.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("lines"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, n: Column) -> Column:
        cost = n.cast("long") + 1
        opens = (s["i"] == 0) | (s["lines"] + 1 > max_lines) | ((s["chars"] + cost > max_chars) & (s["lines"] > 0))
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(opens, F.lit(1)).otherwise(s["lines"] + 1).alias("lines"),
            F.when(opens, cost).otherwise(s["chars"] + cost).alias("chars"),
            F.when(opens, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(lengths, start, step, lambda s: s["starts"])


def pack_chunks(lines: DataFrame, id_col: str = "doc_id", lines_col: str = "lines", first_no: int = 1, max_lines: int = 20, max_chars: int = 1200) -> DataFrame:
    """(id, chunk_id, line_start, line_end, text) of documents given as arrays of lines numbered from ``first_no``."""
    if max_lines <= 0 or max_chars <= 0:
        raise ValueError("chunk limits must be above 0")
    shown = F.transform(lines_col, lambda x, i: T.strip_end(F.concat((i + first_no).cast("string"), F.lit(". "), x)))
    rows = lines.select(id_col, shown.alias("shown")).withColumn("starts", chunk_starts(F.transform("shown", F.length), max_lines, max_chars))
    parts = rows.select(id_col, "shown", F.size("shown").alias("n"), "starts", F.posexplode_outer("starts").alias("k", "at")).where(F.col("k").isNotNull())
    end = F.coalesce(F.try_element_at("starts", F.col("k") + 2), F.col("n"))
    return parts.select(
        id_col,
        T.numbered_id("c", F.col("k") + 1).alias("chunk_id"),
        (F.col("at") + first_no).cast("long").alias("line_start"),
        (end + first_no - 1).cast("long").alias("line_end"),
        F.array_join(F.slice("shown", F.col("at") + 1, end - F.col("at")), "\n").alias("text"),
    )

"""Citations and the lines they cite: validators, lookups and snippets.

Lines are (doc_id, line_no, text), chunks (doc_id, chunk_id, line_start, line_end), citations (doc_id, fact_id, ord, chunk_id,
line_start, line_end). Validators return violations, so callers may look at them or fail on the first (`fail_closed`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

BOUNDS_RULES = ("unknown_chunk", "inverted", "start_outside", "end_outside")


class ContractError(ValueError):
    """The first violation of a contract that fails closed."""


def fail_closed(violations: DataFrame, *order: str) -> None:
    """Raises the first violation in the given order, if there is any."""
    found = violations.orderBy(*order).limit(1).collect()
    if found:
        raise ContractError(str(found[0].asDict()))


def trace_meta(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, min_line, max_line, num_lines, num_chunks)."""
    a = lines.groupBy("doc_id").agg(F.min("line_no").alias("min_line"), F.max("line_no").alias("max_line"), F.count("*").alias("num_lines"))
    b = chunks.groupBy("doc_id").agg(F.count("*").alias("num_chunks"))
    return a.join(b, "doc_id", "left").withColumn("num_chunks", F.coalesce("num_chunks", F.lit(0)).cast("long"))


def structure_violations(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, entity, rule): repeated line numbers and chunk ids, inverted chunks, chunks beyond the document's lines."""
    repeated_lines = lines.groupBy("doc_id", F.col("line_no").cast("string").alias("entity")).count().where("count > 1").select("doc_id", "entity", F.lit("duplicate_line").alias("rule"))
    repeated = chunks.groupBy("doc_id", F.col("chunk_id").alias("entity")).count().where("count > 1").select("doc_id", "entity", F.lit("duplicate_chunk").alias("rule"))
    ends = lines.groupBy("doc_id").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    ok = F.col("line_start").between(F.col("lo"), F.col("hi")) & F.col("line_end").between(F.col("lo"), F.col("hi"))
    rule = F.when(F.col("line_start") > F.col("line_end"), "inverted_chunk").when(~F.coalesce(ok, F.lit(False)), "chunk_out_of_range")
    bad = chunks.join(ends, "doc_id", "left").select("doc_id", F.col("chunk_id").alias("entity"), rule.alias("rule")).where("rule is not null")
    return repeated_lines.unionByName(repeated).unionByName(bad)


def citation_violations(citations: DataFrame, chunks: DataFrame, reject_duplicates: bool = False) -> DataFrame:
    """(doc_id, fact_id, ord, rule): the first rule each citation breaks. Repeats within a fact count if asked for."""
    bounds = chunks.select("doc_id", "chunk_id", F.col("line_start").alias("lo"), F.col("line_end").alias("hi"), F.lit(True).alias("known"))
    rows = citations.join(bounds, ["doc_id", "chunk_id"], "left")
    start, end, lo, hi = (F.col(c) for c in ("line_start", "line_end", "lo", "hi"))
    rule = F.when(start.isNull() | end.isNull() | F.col("chunk_id").isNull(), "missing")
    if reject_duplicates:
        nth = F.row_number().over(Window.partitionBy("doc_id", "fact_id", "chunk_id", "line_start", "line_end").orderBy("ord"))
        rows = rows.withColumn("nth", nth)
        rule = rule.when(F.col("nth") > 1, "duplicate")
    rule = rule.when(F.col("known").isNull(), "unknown_chunk").when(start > end, "inverted").when(~start.between(lo, hi), "start_outside").when(~end.between(lo, hi), "end_outside")
    return rows.select("doc_id", "fact_id", "ord", rule.alias("rule")).where("rule is not null")


def unknown_chunks(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations of chunks that are not there."""
    return citations.join(chunks.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")


#: Lines of a span that are exploded together.
SPAN_BLOCK = 4096


def line_numbers(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """``rows`` with each ``line_no`` of their span; by blocks, so that no span becomes one large array."""
    heads = rows.select("*", end.alias("__end"), F.explode(F.when(start <= end, F.sequence(start, end, F.lit(SPAN_BLOCK).cast("long")))).alias("__head"))
    return heads.select(*rows.columns, F.explode(F.sequence("__head", F.least(F.col("__head") + (SPAN_BLOCK - 1), F.col("__end")))).alias("line_no"))


def spans(rows: DataFrame, lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """``rows`` with each ``line_no`` of their span that lies between the document's first line and its last."""
    ends = lines.groupBy("doc_id").agg(F.min("line_no").alias("__lo"), F.max("line_no").alias("__hi"))
    known = rows.select("*", start.alias("__a"), end.alias("__b")).join(ends, "doc_id")
    return line_numbers(known, F.greatest("__a", "__lo"), F.least("__b", "__hi")).drop("__a", "__b", "__lo", "__hi")


def cited_lines(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """Citations with each line they cite: (..., line_no, text). A span is cut to the document, exploded and hash-joined."""
    return spans(citations, lines, F.col("line_start"), F.col("line_end")).join(lines, ["doc_id", "line_no"])


def missing_lines(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, fact_id, ord, line_no) of cited lines that are not there."""
    asked = line_numbers(citations.select("doc_id", "fact_id", "ord", "line_start", "line_end"), F.col("line_start"), F.col("line_end"))
    return asked.join(lines.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti").select("doc_id", "fact_id", "ord", "line_no")


def audit_snippets(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, fact_id, ord, snippet): ``[chunk:start-end]`` and each line as ``0001: text``.

    Lines that are not there are passed over; a caller that must not miss any looks at ``missing_lines`` first.
    """
    row = F.struct("line_no", F.format_string("%04d: %s", F.col("line_no"), F.col("text")).alias("shown"))
    got = cited_lines(citations, lines).groupBy("doc_id", "fact_id", "ord", "chunk_id", "line_start", "line_end").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    head = F.format_string("[%s:%d-%d]", F.col("chunk_id"), F.col("line_start"), F.col("line_end"))
    return got.select("doc_id", "fact_id", "ord", F.concat(head, F.lit("\n"), F.array_join(F.col("rows.shown"), "\n")).alias("snippet"))


def reading_snippets(citations: DataFrame, lines: DataFrame, max_lines: int = 6, max_chars: int = 320) -> DataFrame:
    """(doc_id, fact_id, ord, snippet): the cited text in one line, cut to a length; lines that are missing or blank are passed over."""
    lo, hi = F.least("line_start", "line_end"), F.greatest("line_start", "line_end")
    spans = citations.select("doc_id", "fact_id", "ord", lo.alias("line_start"), F.least(hi, lo + (max_lines - 1)).alias("line_end"))
    found = cited_lines(spans, lines).where(T.strip(F.col("text")) != "").groupBy("doc_id", "fact_id", "ord").agg(F.sort_array(F.collect_list(F.struct("line_no", T.strip(F.col("text")).alias("t")))).alias("rows"))
    whole = F.array_join(F.col("rows.t"), " ")
    cut = F.when(F.length(whole) > max_chars, F.concat(T.strip_end(F.substring(whole, 1, max_chars - 1)), F.lit("…"))).otherwise(whole)
    return spans.select("doc_id", "fact_id", "ord").join(found.select("doc_id", "fact_id", "ord", cut.alias("snippet")), ["doc_id", "fact_id", "ord"], "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def first_citation(chunks: DataFrame) -> DataFrame:
    """A citation of the first two lines, at most, of each document's first chunk."""
    first = chunks.groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "line_start", "line_end"), "chunk_id").alias("c"))
    return first.select("doc_id", F.lit("smoke").alias("fact_id"), F.lit(1).alias("ord"), "c.chunk_id", "c.line_start", F.least(F.col("c.line_start") + 1, F.col("c.line_end")).alias("line_end"))


def citation_index(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a document: its meta and a map of chunk bounds, without line text."""
    bounds = chunks.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_id", F.struct("line_start", "line_end"))))).alias("chunk_bounds"))
    return trace_meta(lines, chunks).join(bounds, "doc_id", "left")

"""Rows for the catalogue's queries: documents' lines crossed with cue phrases, so that each rule has more than one outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import lines as L
from quirefold.plans import sql as S
from quirefold.sources import files

CUES = (
    "Do not combine both drugs together",
    "Known pregnancy in the patient",
    "Seek emergency evaluation today",
    "Pressure of 180 mmhg or greater",
    "Pressure of 180 mm Hg or greater",
    "Clinicians should reassess weekly",
    "It is reasonable to consider a diuretic",
    "Signes nouveaux chez la personne",
    "Table of dose per class",
    "Short one",
    "We start slowly and titrate",
    "• Adults – with the condition, 7,5 or more:",
    "adults with the condition 75 or more",
    "Patients may stop “early” (l’été)",
    "must be repeated daily :",
    "Dosage table: mg and ml",
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.number_lines(documents(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pack_chunks(L.text_lines(documents(spark, sf_dir)))


def pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(lines(spark, sf_dir))


def facts_of(lines: DataFrame) -> DataFrame:
    """Two facts for every line, type and strength by its numbers: its cue with the whole line, and the bare cue."""
    n, d = F.col("line_no"), F.col("doc_id")
    rows = lines.withColumn("bare", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("cue", pick(CUES, d * 7 + n))
    ord_ = n * 2 - 1 + F.col("bare")
    statement = F.when(F.col("bare") == 0, F.concat("cue", F.lit(" "), "text")).otherwise(F.col("cue"))
    some = lambda k, r, head: F.when(n % k == r, F.concat(F.lit(head), n.cast("string")))
    cite = F.struct(F.lit("c0001").alias("chunk_id"), F.greatest(n - 1, F.lit(1)).alias("line_start"), (n + 1).alias("line_end"), F.when(n % 2 == 1, F.lit("q")).alias("quote"))
    return rows.select(
        "doc_id", ord_.cast("int").alias("ord"), T.numbered_id("f", ord_).alias("fact_id"), pick(T.FACT_TYPES, d + n).alias("fact_type"),
        statement.alias("statement"), pick(T.STRENGTHS, d + n * 2).alias("strength"),
        (n % 3 == 0).alias("requires_human_review"), some(4, 1, "s").alias("subject"), some(5, 1, "c").alias("condition"), some(3, 2, "a").alias("action"), some(2, 0, "n").alias("notes"),
        F.lit(None).cast("string").alias("raw"), F.array(cite, F.struct(F.lit("c0001").alias("chunk_id"), F.lit(1).cast("long").alias("line_start"), F.lit(2).cast("long").alias("line_end"), some(7, 3, "r").alias("quote"))).alias("citations"),
    )


FACTS = f"""{S.LINES},
cued as (select *, {S.listed(CUES)}[((doc_id * 7 + line_no) % {len(CUES)} + 1)::int] as cue from lines),
facts as (
  select doc_id, (line_no * 2 - 1 + bare)::int as ord, printf('f%04d', line_no * 2 - 1 + bare) as fact_id, {S.listed(T.FACT_TYPES)}[((doc_id + line_no) % {len(T.FACT_TYPES)} + 1)::int] as fact_type,
    case when bare = 0 then cue || ' ' || text else cue end as statement, {S.listed(T.STRENGTHS)}[((doc_id + line_no * 2) % {len(T.STRENGTHS)} + 1)::int] as strength,
    line_no % 3 = 0 as requires_human_review, case when line_no % 4 = 1 then 's' || line_no end as subject, case when line_no % 5 = 1 then 'c' || line_no end as condition,
    case when line_no % 3 = 2 then 'a' || line_no end as action, case when line_no % 2 = 0 then 'n' || line_no end as notes, null::varchar as raw,
    [{{'chunk_id': 'c0001', 'line_start': greatest(line_no - 1, 1), 'line_end': line_no + 1, 'quote': case when line_no % 2 = 1 then 'q' end}},
     {{'chunk_id': 'c0001', 'line_start': 1, 'line_end': 2, 'quote': case when line_no % 7 = 3 then 'r' || line_no end}}] as citations
  from cued cross join (values (0), (1)) b(bare))"""
RULED = f"""{FACTS},
n1 as (select * replace ({S.normalize('statement')} as statement) from facts),
n2 as (select * replace ({S.fact_type('statement', 'fact_type')} as fact_type) from n1 where not {S.junk('statement')}),
n3 as (select * replace ({S.strength('statement', 'strength', 'fact_type')} as strength) from n2),
ruled as (select * replace ({S.review('strength', 'requires_human_review')} as requires_human_review), {S.fingerprint('statement')} as fp from n3)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three citations of each chunk: a good one, one that strays by the document's number, and one repeated."""
    d = F.col("doc_id")
    c = chunks(spark, sf_dir).select("doc_id", "chunk_id", "line_start", "line_end")
    cite = lambda k, cid, a, b: F.struct(F.lit(k).alias("ord"), cid.alias("cite_id"), a.alias("a"), b.alias("b"))
    start, end, cid = F.col("line_start"), F.col("line_end"), F.col("chunk_id")
    stray = F.when(d % 5 == 0, cite(2, F.lit("c9999"), start, end)).when(d % 5 == 1, cite(2, cid, end + 1, start)).when(d % 5 == 2, cite(2, cid, start - 1, end)).when(d % 5 == 3, cite(2, cid, start, end + 3)).otherwise(cite(2, cid, end, end))
    rows = c.select("doc_id", F.col("chunk_id").alias("fact_id"), F.inline(F.array(cite(1, cid, start, end), stray, cite(3, cid, start, end))))
    return rows.select("doc_id", "fact_id", "ord", F.col("cite_id").alias("chunk_id"), F.col("a").alias("line_start"), F.col("b").alias("line_end"))


CITATIONS = f"""{S.CHUNKS},
citations as (
  select doc_id, chunk_id as fact_id, 1 as ord, chunk_id, line_start, line_end from chunks
  union all select doc_id, chunk_id, 2, case when doc_id % 5 = 0 then 'c9999' else chunk_id end,
    case doc_id % 5 when 1 then line_end + 1 when 2 then line_start - 1 when 4 then line_end else line_start end,
    case doc_id % 5 when 1 then line_start when 3 then line_end + 3 else line_end end from chunks
  union all select doc_id, chunk_id, 3, chunk_id, line_start, line_end from chunks)"""

"""Queries over the reference data model, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import cleanup, extract, facts, lines, render, trace, workflow
from quirefold.plans import samples as P
from quirefold.plans import sql as S
from quirefold.sources import files, html
from quirefold.sources.stored import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else " || chr(10) || ".join(S.q(x) for x in v.split("\n"))
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# Lines and chunks.


@query(f"with {S.LINES} select doc_id, line_no, text from lines")
def lines_numbered(spark, d):
    return P.lines(spark, d)


@query(f"with {S.LINES} select d.doc_id, coalesce(string_agg(line_no || '. ' || l.text, chr(10) order by line_no), '') || chr(10) as text from documents d left join lines l on l.doc_id = d.doc_id group by d.doc_id")
def numbered_text(spark, d):
    return lines.numbered_text(P.documents(spark, d))


FORMATS = [(1, "1. Alpha"), (2, "2) Beta"), (3, "3 - Gamma"), (4, "4 Delta"), (5, "5."), (6, "6. 2. Heading"), (7, "Plain"), (8, "7"), (9, " 12.  wide  "), (10, "13\tTab"), (11, "3.1 Foo"), (12, "8-"), (13, "9)"), (14, "x1. no")]


@query(
    "with v(id, raw) as (values "
    + sql_values([r for r in FORMATS if "\t" not in r[1]])
    + ", (10, '13' || chr(9) || 'Tab')), p as (select id, raw, case "
    + " ".join(f"when regexp_matches(raw, {S.q(p)}) then [regexp_extract(raw, {S.q(p)}, 1), regexp_extract(raw, {S.q(p)}, 2)]" for p in lines.NUMBERED)
    + " end as m from v) select id, m[1]::bigint as line_no, m[2] as text from p"
)
def numbered_format_parse(spark, d):
    rows = values(spark, FORMATS, "id int, raw string").withColumn("p", lines.parse_numbered(F.col("raw")))
    return rows.select("id", "p.line_no", "p.text")


@query(f"""
with {S.LINES}, kept as (select doc_id, line_no - 1 as pos, case when line_no % 5 = 4 then 3 when line_no % 7 = 6 then null else line_no end as n, text from lines where line_no % 11 <> 10),
w as (select *, lag(n) over (partition by doc_id order by pos) as b, row_number() over (partition by doc_id, n order by pos) as nth from kept),
r as (select doc_id, pos, case when n is null then 'unparseable' when nth > 1 then 'duplicate' when b is not null and n <> b + 1 then 'gap' end as rule, n, b from w)
select doc_id, pos::bigint as pos, rule, case rule when 'unparseable' then 'cannot be parsed: raw' when 'duplicate' then 'repeated line number ' || n else 'expected ' || (b + 1) || ', got ' || n end as message
from r where rule is not null""")
def contiguity_violations(spark, d):
    n = F.col("line_no")
    kept = P.lines(spark, d).where(n % 11 != 10)
    number = F.when(n % 5 == 4, F.lit(3)).when(n % 7 == 6, F.lit(None)).otherwise(n)
    return lines.numbering_violations(kept.select("doc_id", (n - 1).alias("pos"), F.lit("raw").alias("raw"), number.cast("long").alias("line_no"), "text"))


@query(f"with recursive {S.CHUNKS} select doc_id, chunk_id, line_start, line_end from chunks")
def chunk_bounds(spark, d):
    return P.chunks(spark, d).drop("text")


@query(f"with recursive {S.CHUNKS} select doc_id, chunk_id, line_start, line_end, text from chunks")
def chunk_text(spark, d):
    return files.chunk_rows(P.chunks(spark, d))


@query(f"with t as (select doc_id, case when doc_id % 5 = 0 then '' when doc_id % 7 = 0 then ' ' || chr(10) || chr(9) || chr(10) when doc_id % 11 = 0 then null else text end as text from documents) select doc_id from t where {S.strip(S.sub('text', T.LINE_END, ' '))} = '' or text is null")
def empty_documents(spark, d):
    """Documents of which some are emptied, blanked or without text by their numbers."""
    n = F.col("doc_id")
    text = F.when(n % 5 == 0, "").when(n % 7 == 0, " \n\t\n").when(n % 11 == 0, F.lit(None)).otherwise(F.col("text"))
    return lines.empty_documents(P.documents(spark, d).withColumn("text", text))


# Citations and the lines that they cite.


@query(f"with recursive {S.CHUNKS}, a as (select doc_id, min(line_no) as min_line, max(line_no) as max_line, count(*) as num_lines from lines group by 1), b as (select doc_id, count(*) as num_chunks from chunks group by 1) select a.*, coalesce(num_chunks, 0)::bigint as num_chunks from a left join b on a.doc_id = b.doc_id")
def trace_meta(spark, d):
    return trace.trace_meta(P.lines(spark, d), P.chunks(spark, d))


@query(f"with recursive {S.CHUNKS}, a as (select doc_id, min(line_no) as min_line, max(line_no) as max_line, count(*) as num_lines from lines group by 1), n as (select doc_id, count(*) as num_chunks from chunks group by 1) select a.*, num_chunks, chunk_id, line_start, line_end from a join n on n.doc_id = a.doc_id join chunks c on c.doc_id = a.doc_id")
def citation_index(spark, d):
    index = trace.citation_index(P.lines(spark, d), P.chunks(spark, d))
    return index.select(*[c for c in index.columns if c != "chunk_bounds"], F.explode("chunk_bounds").alias("chunk_id", "bounds")).select("*", "bounds.line_start", "bounds.line_end").drop("bounds")


@query(f"""
with recursive {S.CHUNKS},
l2 as (select doc_id, line_no from lines union all select doc_id, line_no from lines where line_no % 9 = 1),
c2 as (select doc_id, chunk_id, line_start, case when doc_id % 3 = 0 then line_end + 50 else line_end end as line_end from chunks
  union all select doc_id, chunk_id, line_end, line_start - 1 from chunks where doc_id % 4 = 0),
e as (select doc_id, min(line_no) as lo, max(line_no) as hi from l2 group by 1)
select doc_id, line_no::varchar as entity, 'duplicate_line' as rule from l2 group by 1, 2 having count(*) > 1
union all select doc_id, chunk_id, 'duplicate_chunk' from c2 group by 1, 2 having count(*) > 1
union all select c2.doc_id, chunk_id, case when line_start > line_end then 'inverted_chunk' else 'chunk_out_of_range' end from c2 join e on e.doc_id = c2.doc_id
  where line_start > line_end or not (line_start between lo and hi and line_end between lo and hi)""")
def structure_violations(spark, d):
    n, c = P.lines(spark, d), P.chunks(spark, d).select("doc_id", "chunk_id", "line_start", "line_end")
    more = c.where("doc_id % 4 = 0").select("doc_id", "chunk_id", F.col("line_end").alias("line_start"), (F.col("line_start") - 1).alias("line_end"))
    wide = c.withColumn("line_end", F.when(F.col("doc_id") % 3 == 0, F.col("line_end") + 50).otherwise(F.col("line_end")))
    return trace.structure_violations(n.unionByName(n.where("line_no % 9 = 1")), wide.unionByName(more))


_RULES = "when k.chunk_id is null then 'unknown_chunk' when c.line_start > c.line_end then 'inverted' when c.line_start not between k.line_start and k.line_end then 'start_outside' when c.line_end not between k.line_start and k.line_end then 'end_outside' end"


@query(f"with recursive {P.CITATIONS}, r as (select c.doc_id, fact_id, ord, case {_RULES} as rule from citations c left join chunks k on k.doc_id = c.doc_id and k.chunk_id = c.chunk_id) select * from r where rule is not null")
def citation_bounds_check(spark, d):
    return trace.citation_violations(P.citations(spark, d), P.chunks(spark, d))


@query(f"with recursive {P.CITATIONS}, n as (select *, row_number() over (partition by doc_id, fact_id, chunk_id, line_start, line_end order by ord) as nth from citations), r as (select c.doc_id, fact_id, ord, case when nth > 1 then 'duplicate' {_RULES} as rule from n c left join chunks k on k.doc_id = c.doc_id and k.chunk_id = c.chunk_id) select * from r where rule is not null")
def citation_strict_check(spark, d):
    return trace.citation_violations(P.citations(spark, d), P.chunks(spark, d), reject_duplicates=True)


@query(f"with recursive {P.CITATIONS} select doc_id, fact_id, ord, chunk_id from citations c where not exists (select 1 from chunks k where k.doc_id = c.doc_id and k.chunk_id = c.chunk_id)")
def citation_unknown_chunk(spark, d):
    return trace.unknown_chunks(P.citations(spark, d), P.chunks(spark, d)).select("doc_id", "fact_id", "ord", "chunk_id")


@query(f"with recursive {P.CITATIONS} select c.doc_id, fact_id, ord, l.line_no, l.text from citations c join lines l on l.doc_id = c.doc_id and l.line_no between c.line_start and c.line_end")
def cited_lines(spark, d):
    return trace.cited_lines(P.citations(spark, d), P.lines(spark, d)).select("doc_id", "fact_id", "ord", "line_no", "text")


@query(f"with recursive {P.CITATIONS}, n as (select doc_id, fact_id, ord, unnest(generate_series(line_start, line_end)) as line_no from citations where line_start <= line_end) select n.* from n where not exists (select 1 from lines l where l.doc_id = n.doc_id and l.line_no = n.line_no)")
def missing_lines(spark, d):
    return trace.missing_lines(P.citations(spark, d), P.lines(spark, d))


@query(f"with recursive {P.CITATIONS} select c.doc_id, fact_id, ord, '[' || chunk_id || ':' || line_start || '-' || line_end || ']' || chr(10) || string_agg(printf('%04d', line_no) || ': ' || text, chr(10) order by line_no) as snippet from citations c join lines l on l.doc_id = c.doc_id and l.line_no between c.line_start and c.line_end group by c.doc_id, fact_id, ord, chunk_id, line_start, line_end")
def audit_snippets(spark, d):
    return trace.audit_snippets(P.citations(spark, d), P.lines(spark, d))


@query(f"""with recursive {P.CITATIONS}, s as (select doc_id, fact_id, ord, least(line_start, line_end) as lo, greatest(line_start, line_end) as hi from citations),
t as (select s.doc_id, fact_id, ord, coalesce(string_agg({S.strip('text')}, ' ' order by line_no) filter (where {S.strip('text')} <> ''), '') as x from s left join lines l on l.doc_id = s.doc_id and l.line_no between lo and least(hi, lo + 5) group by s.doc_id, fact_id, ord)
select doc_id, fact_id, ord, case when length(x) > 320 then {S.sub('left(x, 319)', f'{T.SPACE}+$', '')} || '…' else x end as snippet from t""")
def reading_snippets(spark, d):
    return trace.reading_snippets(P.citations(spark, d), P.lines(spark, d))


@query(f"with recursive {S.CHUNKS}, f as (select * from chunks where chunk_id = 'c0001') select f.doc_id, '[c0001:' || line_start || '-' || least(line_start + 1, line_end) || ']' || chr(10) || string_agg(printf('%04d', line_no) || ': ' || l.text, chr(10) order by line_no) as snippet from f join lines l on l.doc_id = f.doc_id and l.line_no between line_start and least(line_start + 1, line_end) group by f.doc_id, line_start, line_end")
def smoke_snippets(spark, d):
    return render.smoke_snippets(P.chunks(spark, d), P.lines(spark, d))


@query(f"""with recursive {S.CHUNKS},
r as (select doc_id, chunk_id, line_start as lo, line_end as hi, unnest([
  {{'k': 1, 'a': (line_start - 2)::varchar, 'b': (line_end + 2)::varchar}}, {{'k': 2, 'a': line_end::varchar, 'b': line_start::varchar}}, {{'k': 3, 'a': (line_end + 1)::varchar, 'b': (line_end + 9)::varchar}},
  {{'k': 4, 'a': 'x', 'b': '1'}}, {{'k': 5, 'a': null, 'b': null}}, {{'k': 6, 'a': line_start::varchar, 'b': null}}]) as c from chunks),
b as (select doc_id, chunk_id, lo, hi, c.k as k, coalesce(c.a, lo::varchar) as a, coalesce(c.b, hi::varchar) as b from r),
n as (select *, try_cast(a as bigint) as x, try_cast(b as bigint) as y from b)
select doc_id, chunk_id, 'q' || k as quote, least(greatest(lo, least(hi, x)), greatest(lo, least(hi, y))) as line_start, greatest(greatest(lo, least(hi, x)), greatest(lo, least(hi, y))) as line_end
from n where x is not null and y is not null and y >= lo and x <= hi""")
def clamp_citations(spark, d):
    s, e = F.col("line_start"), F.col("line_end")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    cases = [(text(s - 2), text(e + 2)), (text(e), text(s)), (text(e + 1), text(e + 9)), (F.lit("x"), F.lit("1")), (none, none), (text(s), none)]
    raw = F.array(*[F.struct(F.lit("c9999").alias("chunk_id"), a.alias("line_start"), b.alias("line_end"), F.lit(f"q{i}").alias("quote")) for i, (a, b) in enumerate(cases, 1)])
    out = P.chunks(spark, d).select("doc_id", extract.clamp_citations(raw, F.col("chunk_id"), s, e).alias("c"))
    return out.select("doc_id", F.inline("c"))


# Text rules.

ODD = ("  Été – “déjà” vu • l’an 7,5 ≥ 3 :", "a b c d:", "::", "•", "œuvre-clé / 50 % (max.)", "x" * 9, "A b c d 1 é", "don't — stop", "\x1c tab\tend \x1f")


def _statements(spark, d):
    odd = P.pick(ODD, F.col("doc_id"))
    rows = P.facts(spark, d).select("doc_id", "ord", "fact_type", "strength", "requires_human_review", "statement")
    return rows.withColumn("statement", F.when(F.col("ord") % 5 == 2, odd).otherwise(F.col("statement")))


def _odd(s: str) -> str:
    out, plain = [], ""
    for c in s:
        if c.isprintable():
            plain += c
        else:
            out += [S.q(plain), f"chr({ord(c)})"]
            plain = ""
    return " || ".join([*out, S.q(plain)])


STATEMENTS = f"{P.FACTS}, st as (select doc_id, ord, fact_type, strength, requires_human_review, case when ord % 5 = 2 then [{', '.join(map(_odd, ODD))}][(doc_id % {len(ODD)} + 1)::int] else statement end as statement from facts)"


@query(f"with {STATEMENTS} select doc_id, ord, {S.normalize('statement')} as text from st")
def normalize_text(spark, d):
    return _statements(spark, d).select("doc_id", "ord", T.normalize_text(F.col("statement")).alias("text"))


@query(f"with {STATEMENTS} select doc_id, ord, array_to_string({S.tokens('statement')}, '|') as tokens, len({S.tokens('statement')})::bigint as n from st")
def tokenize(spark, d):
    t = T.tokenize(F.col("statement"))
    return _statements(spark, d).select("doc_id", "ord", F.array_join(t, "|").alias("tokens"), F.size(t).cast("long").alias("n"))


@query(f"with {STATEMENTS} select doc_id, ord, {S.fingerprint('statement')} as fp from st")
def fingerprint(spark, d):
    return _statements(spark, d).select("doc_id", "ord", T.fingerprint(F.col("statement")).alias("fp"))


@query(f"with {STATEMENTS}, n as (select doc_id, ord, {S.normalize('statement')} as s from st) select doc_id, ord, {S.junk('s')} as junk from n")
def header_junk_filter(spark, d):
    return _statements(spark, d).select("doc_id", "ord", T.is_header_or_junk(T.normalize_text(F.col("statement"))).alias("junk"))


@query(f"with {STATEMENTS} select doc_id, ord, {S.fact_type('statement', 'fact_type')} as fact_type from st")
def fact_type_rules(spark, d):
    return _statements(spark, d).select("doc_id", "ord", T.refine_fact_type(F.col("statement"), F.col("fact_type")).alias("fact_type"))


@query(f"with {STATEMENTS} select doc_id, ord, {S.strength('statement', 'strength', 'fact_type')} as strength from st")
def strength_rules(spark, d):
    return _statements(spark, d).select("doc_id", "ord", T.refine_strength(F.col("statement"), F.col("strength"), F.col("fact_type")).alias("strength"))


@query(f"with {STATEMENTS} select doc_id, ord, {S.review('strength', 'requires_human_review')} as review from st")
def review_flag(spark, d):
    return _statements(spark, d).select("doc_id", "ord", T.needs_review(F.col("strength"), F.col("requires_human_review")).alias("review"))


ALIASES = [(i, x) for i, x in enumerate((*T.TYPE_ALIASES, " Warning ", "FOLLOWUP", "population", "odd", ""), 1)]


@query("with v(id, x) as (values " + sql_values(ALIASES) + ") select id, case lower(trim(x)) " + " ".join(f"when {S.q(k)} then {S.q(v)}" for k, v in T.TYPE_ALIASES.items()) + " else x end as fact_type from v")
def fact_type_aliases(spark, d):
    return values(spark, ALIASES, "id int, x string").select("id", T.alias_fact_type(F.col("x")).alias("fact_type"))


CONDITIONS = [(1, "in001 == true"), (2, " IN02==FALSE "), (3, "in001 = true"), (4, "x in001 == true"), (5, ""), (6, None), (7, "in9  ==  True")]


@query("with v(id, c) as (values " + sql_values(CONDITIONS) + r") select id, case when regexp_matches(c, '(?i)^\s*(in[0-9]+)\s*==\s*(true|false)\s*$') then regexp_extract(c, '(?i)(in[0-9]+)', 1) end as input_id, case when regexp_matches(c, '(?i)^\s*(in[0-9]+)\s*==\s*(true|false)\s*$') then regexp_matches(c, '(?i)true') end as expected from v")
def condition_parse(spark, d):
    rows = values(spark, CONDITIONS, "id int, c string").withColumn("p", T.parse_condition(F.col("c")))
    return rows.select("id", "p.input_id", "p.expected")


# Merging.


def _ruled(spark, d):
    return facts.normalize_facts(P.facts(spark, d)).where("not junk").drop("junk")


@query(f"""with {P.RULED} select doc_id, fact_type, arg_min(fact_id, (-length(statement), fact_id)) as fact_id, arg_min(statement, (-length(statement), fact_id)) as statement,
  case when count(*) = 1 then any_value(strength) else {S.listed(T.STRENGTHS)}[max(list_position({S.listed(T.STRENGTHS)}, strength))] end as strength, bool_or(requires_human_review) as requires_human_review, count(*) - 1 as merged
from ruled group by doc_id, fact_type, fp""")
def exact_dedup(spark, d):
    return facts.merge_exact(_ruled(spark, d)).select("doc_id", "fact_type", "fact_id", "statement", "strength", "requires_human_review", "merged")


@query("with " + P.RULED + " select doc_id, arg_min(fact_id, (-length(statement), fact_id)) as fact_id, " + ", ".join(f"coalesce(arg_min_null({c}, (-length(statement), fact_id)), arg_min({c}, ord) filter (where {c} is not null)) as {c}" for c in ("subject", "condition", "action", "notes")) + " from ruled group by doc_id, fact_type, fp")
def optional_fill(spark, d):
    return facts.merge_exact(_ruled(spark, d)).select("doc_id", "fact_id", "subject", "condition", "action", "notes")


@query(f"""with {P.RULED}, g as (select doc_id, fact_type, fp, arg_min(fact_id, (-length(statement), fact_id)) as fact_id, count(*) as n from ruled group by 1, 2, 3),
c as (select r.doc_id, r.fact_type, r.fp, r.ord, generate_subscripts(r.citations, 1) as nth, unnest(r.citations) as c from ruled r),
s as (select g.doc_id, g.fact_id, c.c.line_start as line_start, c.c.line_end as line_end, arg_min(c.c.quote, (ord, nth)) filter (where c.c.quote is not null) as quote from g join c using (doc_id, fact_type, fp) where g.n > 1 group by 1, 2, 3, 4
  union all select g.doc_id, g.fact_id, c.c.line_start, c.c.line_end, c.c.quote from g join c using (doc_id, fact_type, fp) where g.n = 1)
select doc_id, fact_id, 'c0001' as chunk_id, line_start, line_end, quote from s""")
def merged_citations(spark, d):
    return facts.merge_exact(_ruled(spark, d)).select("doc_id", "fact_id", F.inline("citations"))


@query(f"with {P.RULED}, m as (select doc_id, fact_type, min(ord) as ord, arg_min(statement, (-length(statement), fact_id)) as statement from ruled group by doc_id, fact_type, fp) select x.doc_id, x.fact_type, x.ord as a, y.ord as b from m x join m y on x.doc_id = y.doc_id and x.fact_type = y.fact_type and x.ord < y.ord and least(length(x.statement), length(y.statement)) * (2 - 0.94::double) >= greatest(length(x.statement), length(y.statement)) * 0.94::double")
def fuzzy_pairs_pruned(spark, d):
    return facts.fuzzy_pairs(facts.merge_exact(_ruled(spark, d)))


@query()
def fuzzy_clusters(spark, d):
    return facts.fuzzy_leaders(facts.merge_exact(_ruled(spark, d)))


def _cited_facts(spark, d):
    """Facts that state a part of one line, or of two lines in a row, within a wider citation."""
    n = F.col("line_no")
    ahead = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no"))
    statement = F.when(n % 3 == 0, F.left("text", F.lit(40))).when(n % 3 == 1, F.concat(F.right("text", F.lit(15)), F.lit(" "), F.left(F.coalesce(ahead, F.lit("")), F.lit(15)))).otherwise("nowhere at all")
    cite = F.struct(F.lit("c0001").alias("chunk_id"), F.greatest(n - 2, F.lit(1)).alias("line_start"), (n + 3).alias("line_end"), F.lit(None).cast("string").alias("quote"))
    return P.lines(spark, d).select("doc_id", n.cast("int").alias("ord"), statement.alias("statement"), F.array(cite).alias("citations"))


@query(f"""with {S.LINES}, f as (select doc_id, line_no as ord, greatest(line_no - 2, 1) as ls, line_no + 3 as le, lower({S.normalize("case line_no % 3 when 0 then left(text, 40) when 1 then right(text, 15) || ' ' || left(coalesce(lead(text) over (partition by doc_id order by line_no), ''), 15) else 'nowhere at all' end")}) as s from lines),
n as (select doc_id, line_no, lower({S.normalize('text')}) as t from lines),
w as (select f.doc_id, ord, ls, le, s, a.line_no, k.k, string_agg(b.t, ' ' order by b.line_no) as t, count(*) as c, max(b.line_no) as z
  from f cross join (values (1), (2), (3), (4)) k(k) join n a on a.doc_id = f.doc_id and a.line_no between ls and le join n b on b.doc_id = f.doc_id and b.line_no between a.line_no and least(a.line_no + k.k - 1, le) where s <> '' group by 1, 2, 3, 4, 5, 6, 7),
h as (select doc_id, ord, min([k, line_no, z]) as m from w where c = k and contains(t, s) group by 1, 2)
select f.doc_id, f.ord::int as ord, coalesce(m[2], ls) as line_start, coalesce(m[3], le) as line_end, coalesce(m[2] <> ls or m[3] <> le, false) as moved from f left join h on h.doc_id = f.doc_id and h.ord = f.ord""")
def tighten_citations(spark, d):
    return facts.tighten_citations(_cited_facts(spark, d), P.lines(spark, d)).select("doc_id", "ord", "line_start", "line_end", "moved")


@query(f"with {P.RULED} select doc_id, ord, printf('f%04d', row_number() over (partition by doc_id order by fact_type, lower(statement), fact_id)) as fact_id from ruled")
def reid_facts(spark, d):
    return facts.number_facts(_ruled(spark, d)).select("doc_id", "ord", "fact_id")


@query()
def clean_fact_counts(spark, d):
    """Documents are dealt by their id once, and nothing else is dealt or written: all steps group and join by document."""
    text = lines.number_lines(P.documents(spark, d).repartition("doc_id"))
    return facts.canonical_facts(P.facts_of(text), text)[1]


# Workflows.

_IN = {"population": "fact_type = 'population'", "excluded": "fact_type in ('exclusion', 'contraindication')", "red_flag": "fact_type = 'red_flag'", "review": "requires_human_review"}
BUCKETS = f"""{P.RULED},
small as (select * from ruled),
k as (select doc_id, count(*) as n_all, {", ".join(f"count(*) filter (where {c}) as n_{b}" for b, c in _IN.items())} from small group by 1),
u as (select doc_id, fact_type, fact_id, requires_human_review, generate_subscripts(citations, 1) as nth, unnest(citations) as c from small),
b as ({" union all ".join(f"select doc_id, '{b}' as bucket, c.line_start as ls, c.line_end as le, arg_min_null(c.quote, (fact_id, nth)) as quote from u where {c} group by 1, 2, 3, 4" for b, c in {**_IN, "all": "true"}.items())}),
r as (select b.* from b join k on k.doc_id = b.doc_id where bucket = case when n_review > 0 then 'review' else 'all' end),
p as (select doc_id, bucket, ls, le, quote, row_number() over (partition by doc_id order by ls, le) as place from r)"""


_NODES = " union all ".join(
    [f"select doc_id, '{i}' as node_id, 'decision' as node_type, '{c}' as condition, '{t}' as true_next, '{f}' as false_next, null as text, null::boolean as review from k" for i, c, t, f, _ in workflow.DECISIONS]
    + [f"select doc_id, '{i}', 'action', null, null, null, {S.q(a)}, true from k" for i, a, _ in workflow.ACTIONS]
    + [f"select doc_id, '{i}', 'end', null, null, null, {S.q(x)}, null from k" for i, x in workflow.ENDS]
)


@query(f"with {BUCKETS} {_NODES}")
def workflow_nodes(spark, d):
    n = workflow.workflow_nodes(_ruled(spark, d))
    return n.select("doc_id", "node_id", "node_type", "condition", "true_next", "false_next", F.coalesce("action", "label").alias("text"), F.col("requires_human_review").alias("review"))


@query(
    f"with {BUCKETS} "
    + " union all ".join(f"select doc_id, '{i}' as node_id, 'c0001' as chunk_id, ls as line_start, le as line_end, quote from b where bucket = '{b}'" for i, *_, b in (*workflow.DECISIONS, workflow.ACTIONS[0]))
    + " union all select doc_id, 'a0002', 'c0001', ls, le, quote from p where place <= 8"
)
def workflow_citations(spark, d):
    return workflow.workflow_nodes(_ruled(spark, d)).select("doc_id", "node_id", F.inline("citations"))


@query(f"with {BUCKETS}, n as ({_NODES}) select doc_id, node_id as src, true_next as dst, true as branch from n where node_type = 'decision' union all select doc_id, node_id, false_next, false from n where node_type = 'decision'")
def workflow_edges(spark, d):
    return workflow.workflow_edges(workflow.workflow_nodes(_ruled(spark, d)))


@query(f"with {BUCKETS}, c as (select doc_id, count(*) as n from p group by 1) select k.doc_id, n_all as num_facts, n_population as num_population_facts, n_excluded as num_excl_contra_facts, n_red_flag as num_red_flag_facts, n_review as num_review_facts, coalesce(n, 0)::bigint as review_citations_available, least(coalesce(n, 0), 8)::bigint as review_citations_emitted from k left join c on c.doc_id = k.doc_id")
def workflow_meta(spark, d):
    return workflow.workflow_meta(_ruled(spark, d))


@query(f"with {BUCKETS} select doc_id, 'doc' || doc_id || '__v1' as workflow_id, 'd0001' as start_node_id, array_to_string(list_filter([{', '.join(f'case when n_{b} = 0 then {S.q(t)} end' for b, t in workflow.ABSENT)}], lambda x: x is not null), '|') as warnings from k")
def workflow_warnings(spark, d):
    return workflow.workflow_headers(_ruled(spark, d)).select("doc_id", "workflow_id", "start_node_id", F.array_join("warnings", "|").alias("warnings"))


GRAPHS = [
    (1, "d1", "decision", "d2", "e1"), (1, "d2", "decision", "a1", "e1"), (1, "a1", "action", None, None), (1, "e1", "end", None, None), (1, "e9", "end", None, None),
    (2, "d1", "decision", "d2", "e1"), (2, "d2", "decision", "d1", "e1"), (2, "e1", "end", None, None),
    (3, "d1", "decision", "gone", "e1"), (3, "e1", "end", None, None), (3, "e1", "end", None, None), (3, "d7", "decision", "d8", "d9"),
    (4, "x1", "decision", "e1", "e1"), (4, "e1", "end", None, None),
    (5, "d1", "decision", "e1", "d2"), (5, "e1", "end", None, None), (5, "d2", "decision", "e1", "d3"), (5, "d3", "decision", "d3", "e1"),
]
GRAPH_SQL = "g(doc_id, node_id, node_type, true_next, false_next) as (values " + sql_values(GRAPHS) + "), e as (select doc_id, node_id as src, true_next as dst, true as branch from g where node_type = 'decision' union all select doc_id, node_id, false_next, false from g where node_type = 'decision'), starts as (select distinct doc_id, 'd1' as node_id from g)"
REACH_SQL = GRAPH_SQL + ", seen as (select doc_id, node_id from starts union select e.doc_id, e.dst from seen join e on e.doc_id = seen.doc_id and e.src = seen.node_id), reach as (select distinct doc_id, node_id from seen where exists (select 1 from g where g.doc_id = seen.doc_id and g.node_id = seen.node_id))"


def _graphs(spark):
    nodes = values(spark, GRAPHS, "doc_id int, node_id string, node_type string, true_next string, false_next string")
    return nodes.select("doc_id").distinct().withColumn("start_node_id", F.lit("d1")), nodes


@query(f"with {GRAPH_SQL} select doc_id, src, dst, branch from e where not exists (select 1 from g where g.doc_id = e.doc_id and g.node_id = e.dst)")
def dangling_edges(spark, d):
    return workflow.dangling_edges(_graphs(spark)[1])


@query(f"with recursive {REACH_SQL} select doc_id, node_id from reach")
def reachable(spark, d):
    return workflow.reachable(*_graphs(spark))


@query(f"with recursive {REACH_SQL} select distinct doc_id, node_id from g where not exists (select 1 from reach r where r.doc_id = g.doc_id and r.node_id = g.node_id)")
def unreachable(spark, d):
    return workflow.unreachable(*_graphs(spark))


@query(f"""with recursive {REACH_SQL} select doc_id, 1 as ordinal, 'duplicate_node' as rule, node_id as entity from g group by doc_id, node_id having count(*) > 1
union all select doc_id, 2, 'missing_start', node_id from starts s where not exists (select 1 from g where g.doc_id = s.doc_id and g.node_id = s.node_id)
union all select doc_id, 3, 'dangling_edge', dst from e where not exists (select 1 from g where g.doc_id = e.doc_id and g.node_id = e.dst)
union all select distinct doc_id, 4, 'unreachable_node', node_id from g where not exists (select 1 from reach r where r.doc_id = g.doc_id and r.node_id = g.node_id)""")
def graph_violations(spark, d):
    return workflow.graph_violations(*_graphs(spark))


@query(f"""with recursive {GRAPH_SQL}, n as (select distinct * from g),
c as (select s.doc_id, 1::bigint as step, s.node_id, [s.node_id] as path from starts s join n on n.doc_id = s.doc_id and n.node_id = s.node_id and n.node_type = 'decision'
  union all select c.doc_id, c.step + 1, x.to_id, list_append(c.path, x.to_id) from c join n on n.doc_id = c.doc_id and n.node_id = c.node_id
    left join n t on t.doc_id = n.doc_id and t.node_id = n.true_next and t.node_type = 'decision' left join n f on f.doc_id = n.doc_id and f.node_id = n.false_next and f.node_type = 'decision'
    cross join lateral (select coalesce(t.node_id, f.node_id) as to_id) x where x.to_id is not null and not list_contains(c.path, x.to_id))
select doc_id, step, node_id from c""")
def decision_chain(spark, d):
    heads, nodes = _graphs(spark)
    return workflow.decision_chain(heads, nodes.distinct())


SHAPES = [(1, "d0001", "decision", "in001 == true", "e0001", "e0001", None), (1, "d1", "decision", "", "e0001", None, None), (2, "a0001", "action", None, None, None, ""), (2, "x0001", "end", None, None, None, None), (3, "e0001", "oddity", None, None, None, None), (3, "a0002", "action", None, None, None, "do")]
SHAPE_INPUTS = [(1, "in001", "a", "bool"), (1, "in1", "", "date"), (2, "in002", None, "choice")]


@query(f"""with n(doc_id, node_id, node_type, condition, true_next, false_next, action) as (values {sql_values(SHAPES)}), i(doc_id, input_id, name, type) as (values {sql_values(SHAPE_INPUTS)})
select doc_id, node_id as entity, 'node_type' as rule from n where node_type not in ('decision', 'action', 'end')
union all select doc_id, node_id, 'node_id' from n where node_type in ('decision', 'action', 'end') and not regexp_full_match(node_id, left(node_type, 1) || '[0-9]{{4}}')
union all select doc_id, node_id, 'condition' from n where node_type = 'decision' and coalesce(condition, '') = ''
union all select doc_id, node_id, 'next' from n where node_type = 'decision' and (coalesce(true_next, '') = '' or coalesce(false_next, '') = '')
union all select doc_id, node_id, 'action' from n where node_type = 'action' and coalesce(action, '') = ''
union all select doc_id, input_id, 'input_id' from i where not regexp_full_match(input_id, 'in[0-9]{{3}}')
union all select doc_id, input_id, 'name' from i where coalesce(name, '') = ''
union all select doc_id, input_id, 'type' from i where type not in ('bool', 'int', 'float', 'str', 'choice')""")
def workflow_shapes(spark, d):
    nodes = values(spark, SHAPES, "doc_id int, node_id string, node_type string, condition string, true_next string, false_next string, action string")
    return workflow.shape_violations(nodes, values(spark, SHAPE_INPUTS, "doc_id int, input_id string, name string, type string"))


@query(f"with {BUCKETS}, n as ({_NODES}), e as (select doc_id, node_id, true as branch, true_next as next_id from n where node_type = 'decision' union all select doc_id, node_id, false, false_next from n where node_type = 'decision') select e.doc_id, e.node_id, branch, next_id, n.node_type as next_type, case when n.node_type = 'decision' then 'Continue to next step.' else n.text end as says from e join n on n.doc_id = e.doc_id and n.node_id = e.next_id")
def next_steps(spark, d):
    return workflow.next_steps(workflow.workflow_nodes(_ruled(spark, d)))


_NAMES = "i(input_id, name, description) as (values " + ", ".join(f"({S.q(i)}, {S.q(n)}, {S.q(x)})" for i, n, _, x in workflow.INPUTS) + ")"


@query(
    f"with {BUCKETS}, n as ({_NODES}), {_NAMES} select doc_id, node_id, input_id, case when contains(lower(name), 'population') or contains(lower(name), 'eligible') then 'Eligibility' when contains(lower(name), 'exclusion') or contains(lower(name), 'contra') then 'Exclusions / Contraindications'"
    " when contains(lower(name), 'red') or contains(lower(name), 'flag') or contains(lower(name), 'urgent') then 'Red Flags / Escalation' else 'Gate 1' end as title, ends_with(condition, 'true') as expected from n join i on starts_with(condition, input_id || ' ')"
)
def gate_titles(spark, d):
    rows = _ruled(spark, d)
    return workflow.conditions(workflow.workflow_nodes(rows), workflow.workflow_inputs(rows)).select("doc_id", "node_id", "input_id", T.gate_title(F.col("name"), F.lit(1)).alias("title"), "expected")


def _reports(spark, d):
    rows = store(_ruled(spark, d), "ruled")
    return workflow.workflow_headers(rows), workflow.workflow_inputs(rows), store(workflow.workflow_nodes(rows), "nodes"), P.lines(spark, d)


_NL = "chr(10)"
_CITED = (
    "c as (select doc_id, node_id, ls, le, row_number() over (partition by doc_id, node_id order by ls, le) as ord from ("
    + " union all ".join(f"select doc_id, '{i}' as node_id, ls, le from b where bucket = '{k}'" for i, *_, k in (*workflow.DECISIONS, workflow.ACTIONS[0]))
    + " union all select doc_id, 'a0002', ls, le from p where place <= 8))"
)


@query(f"""with {BUCKETS}, n as ({_NODES}), {_NAMES}, {_CITED}, cn as (select doc_id, node_id, count(*) as n from c group by 1, 2),
sn as (select c.doc_id, node_id, ord, ls, le, string_agg(printf('%04d', line_no) || ': ' || text, {_NL} order by line_no) as t from c join lines l on l.doc_id = c.doc_id and l.line_no between ls and le where ord <= {render.SNIPPETS} group by 1, 2, 3, 4, 5),
bl as (select doc_id, node_id, string_agg('**[' || ord || ']** `c0001:' || ls || '-' || le || '`' || {_NL} || {_NL} || '```text' || {_NL} || '[c0001:' || ls || '-' || le || ']' || {_NL} || t || {_NL} || '```' || {_NL}, {_NL} order by ord) as blocks from sn group by 1, 2),
ct as (select n.*, case when cn.n is null then '_No citations._' else '_Citations: ' || cn.n || '_' || {_NL} || {_NL} || blocks || case when cn.n > {render.SNIPPETS} then {_NL} || '_Showing first {render.SNIPPETS} citations (deterministic cap). Full citations remain in JSON._' || {_NL} else '' end end as cited
  from n left join cn on cn.doc_id = n.doc_id and cn.node_id = n.node_id left join bl on bl.doc_id = n.doc_id and bl.node_id = n.node_id),
parts as (select doc_id, string_agg('### `' || node_id || '` (' || node_type || ')' || {_NL} || {_NL} || case node_type when 'decision' then '- condition: `' || condition || '`' || {_NL} || '- true_next: `' || true_next || '`' || {_NL} || '- false_next: `' || false_next || '`' || {_NL} || {_NL} || cited
  when 'action' then '- action: ' || text || {_NL} || '- requires_human_review: `True`' || {_NL} || {_NL} || cited else '- label: ' || text || {_NL} || {_NL} || '_No citations._' end || {_NL}, {_NL} order by node_id) as body from ct group by 1),
w as (select doc_id, array_to_string(list_filter([{', '.join(f"case when n_{k} = 0 then '- ' || {S.q(t)} end" for k, t in workflow.ABSENT)}], lambda x: x is not null), {_NL}) as w from k),
ins as (select string_agg('- **' || input_id || '** `' || name || '` (bool): ' || description, {_NL} order by input_id) as ins from i)
select w.doc_id, '# Workflow Audit Preview — `doc' || w.doc_id || '__v1`' || {_NL} || {_NL} || '- guideline_id: `doc' || w.doc_id || '`' || {_NL} || '- start_node_id: `d0001`' || {_NL} || '- requires_human_review: `True`' || {_NL} || {_NL}
  || case when w <> '' then '## Warnings' || {_NL} || {_NL} || w || {_NL} || {_NL} else '' end || '## Inputs' || {_NL} || {_NL} || ins || {_NL} || {_NL} || '## Nodes' || {_NL} || {_NL} || body as markdown
from w join parts on parts.doc_id = w.doc_id cross join ins""")
def audit_markdown(spark, d):
    return render.audit_markdown(*_reports(spark, d))


@query()
def reading_markdown(spark, d):
    return render.reading_markdown(*_reports(spark, d))


# Sources and cleanup.


def _blocks(spark, d):
    """Lines with page numbers, footers, word breaks and bullets among them."""
    n = F.col("line_no")
    line = F.when(n % 9 == 4, P.pick(("12", "Page 3", "3 / 9", "1234", "see page x"), F.col("doc_id"))).when(n % 9 == 2, "copyright of nobody").when(n % 9 == 6, F.concat(F.left("text", F.lit(12)), F.lit("-"))).when(n % 9 == 7, F.lower("text")).when(n % 9 == 8, F.concat(F.lit("- "), "text")).when(n % 9 == 5, F.concat(F.lower("text"), F.lit(" -"))).otherwise(F.col("text"))
    return P.lines(spark, d).select("doc_id", n.alias("pos"), T.strip(line).alias("line"))


BLOCKS = f"""{S.LINES}, blocks as (select doc_id, line_no as pos, {S.strip("case line_no % 9 when 4 then ['12', 'Page 3', '3 / 9', '1234', 'see page x'][(doc_id % 5 + 1)::int] when 2 then 'copyright of nobody' when 6 then left(text, 12) || '-' when 7 then lower(text) when 8 then '- ' || text when 5 then lower(text) || ' -' else text end")} as line from lines)"""
_BOILER = f"select doc_id, line, count(*) as times from blocks group by 1, 2 having count(*) >= 4 and length(line) <= 120 and {S.footer_like('line')}"
DEHYPHENATED = f"""a1 as (select *, lead(line) over w as nx, coalesce(ends_with(line, '-') and regexp_matches(lead(line) over w, {S.q(cleanup.LOWER_START)}), false) as may from blocks window w as (partition by doc_id order by pos)),
a2 as (select *, sum(case when may then 0 else 1 end) over (partition by doc_id order by pos) as run from a1),
a3 as (select *, may and row_number() over (partition by doc_id, run, may order by pos) % 2 = 1 as joins from a2),
a4 as (select *, coalesce(lag(joins) over (partition by doc_id order by pos), false) as taken from a3),
dehyphenated as (select doc_id, pos, case when joins then left(line, length(line) - 1) || nx else line end as line from a4 where not taken)"""


@query(f"with {BLOCKS} {_BOILER}")
def boilerplate_lines(spark, d):
    return cleanup.boilerplate_lines(_blocks(spark, d))


@query(f"with {BLOCKS} select doc_id, pos, line, {S.page_number('line')} as page_number from blocks")
def page_number_lines(spark, d):
    return _blocks(spark, d).withColumn("page_number", T.is_page_number(F.col("line")))


@query(f"with {BLOCKS}, {DEHYPHENATED} select doc_id, pos, line from dehyphenated")
def dehyphenate(spark, d):
    return cleanup.dehyphenate(_blocks(spark, d))


_MERGED = f"""m1 as (select *, lag(line) over (partition by doc_id order by pos) as b from X),
m2 as (select *, case when b is null or regexp_matches(line, {S.q(cleanup.BULLET)}) or regexp_matches({S.strip('b')}, '[.;:!?]$') or not regexp_matches(line, {S.q(cleanup.LOWER_START)}) then 1 else 0 end as s from m1),
m3 as (select *, sum(s) over (partition by doc_id order by pos) as g from m2),
merged as (select doc_id, min(pos) as pos, case when count(*) > 1 then {S.strip("string_agg(line, ' ' order by pos)")} else any_value(line) end as line from m3 group by doc_id, g)"""


@query(f"with {BLOCKS}, {_MERGED.replace('from X', 'from blocks')} select doc_id, pos, line from merged")
def soft_wrap_merge(spark, d):
    return cleanup.merge_soft_wraps(_blocks(spark, d))


@query(f"""with {BLOCKS.replace('blocks as', 'blocks0 as')}, boiler as ({_BOILER.replace('from blocks', 'from blocks0')}),
blocks as (select doc_id, pos, {S.strip(S.sub('line', f'{T.SPACE}{{2,}}', ' '))} as line from blocks0 b where line <> '' and not exists (select 1 from boiler x where x.doc_id = b.doc_id and x.line = b.line) and not {S.page_number('line')}),
{DEHYPHENATED}, {_MERGED.replace('from X', 'from dehyphenated')} select doc_id, row_number() over (partition by doc_id order by pos) as line_no, {S.strip('line')} as text from merged where {S.strip('line')} <> ''""")
def clean_lines(spark, d):
    return cleanup.clean_lines(_blocks(spark, d))


@query(f"""with recursive {S.LINES}, w as (select doc_id, line_no, text, string_split(text, ' ') as a from lines),
r as (select doc_id, line_no, a, 1 as i, a[1] as cur, 1 as part from w where length(text) > 40
  union all select doc_id, line_no, a, i + 1, case when cur = '' then a[i + 1] when length(cur) + 1 + length(a[i + 1]) <= 40 then cur || ' ' || a[i + 1] else a[i + 1] end, part + case when cur = '' or length(cur) + 1 + length(a[i + 1]) <= 40 then 0 else 1 end from r where i < len(a))
select doc_id, line_no, (part - 1)::int as part, arg_max(cur, i) as line from r group by doc_id, line_no, part having arg_max(cur, i) <> ''
union all select doc_id, line_no, 0, text from w where length(text) <= 40""")
def hard_wrap(spark, d):
    return P.lines(spark, d).select("doc_id", "line_no", F.posexplode(cleanup.hard_wrap(F.col("text"), 40)).alias("part", "line"))


@query()
def html_blocks(spark, d):
    return html.page_blocks(spark.read.parquet(f"{d}/pages.parquet"))


@query()
def page_lines(spark, d):
    return cleanup.clean_lines(html.page_blocks(spark.read.parquet(f"{d}/pages.parquet")))


@query("select doc_id, sha256(text) as sha256 from documents where text is not null")
def artifact_hash(spark, d):
    return P.documents(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("select doc_id::varchar as path, sha256(text) as sha256 from documents where text is not null")
def hash_manifest(spark, d):
    hashes = P.documents(spark, d).where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    return files.manifest(hashes).select(F.explode("sha256").alias("path", "sha256"))


# Extraction.


def rule_extractor():
    """An extractor without a model: every line with a cue word is a fact."""
    import json
    import re

    def extract(prompt: str) -> str:
        found = [(int(m[1]), m[2]) for m in re.finditer(r"(?m)^(\d+)\. (.*(?:tion|the|ung|que).*)$", prompt)]
        out = [{"fact_id": f"f{i:04d}", "fact_type": "warning" if n % 2 else "other", "statement": t, "citations": [{"line_start": n, "line_end": n + 2}]} for i, (n, t) in enumerate(found, 1)]
        text = json.dumps({"extracted_facts": out})
        return text if len(out) % 2 or not out else text[:-2] + ', {"fact_type": "ot'

    return extract


@query(
    f"""with recursive {S.CHUNKS}, f as (select l.doc_id, l.line_no, l.text, c.chunk_id, c.line_end as le, row_number() over (partition by l.doc_id order by l.line_no) as ord
  from lines l join chunks c on c.doc_id = l.doc_id and l.line_no between c.line_start and c.line_end where regexp_matches(l.text, 'tion|the|ung|que'))
select doc_id, ord::int as ord, printf('f%04d', ord) as fact_id, case when line_no % 2 = 1 then 'red_flag' else 'other' end as fact_type, text as statement, 'unclear' as strength, chunk_id, line_no as line_start, least(line_no + 2, le) as line_end from f"""
)
def extracted_facts(spark, d):
    got = extract.facts_of(extract.run_extractor(P.chunks(spark, d), rule_extractor, pause=0.0))
    return got.select("doc_id", "ord", "fact_id", "fact_type", "statement", "strength", F.inline("citations")).drop("quote")


_WHOLE = """'{"extracted_facts": [' || f || ', ' || f || ', ' || f || ']}'"""


@query(f"""with w as (select doc_id, '{{"fact_type": "other", "statement": "s' || doc_id || ' {{\\"x\\"}}]"}}' as f from documents), t as (select doc_id, f, {_WHOLE} as whole, doc_id % 90 as cut from w),
n as (select *, case when cut = 0 then 3 else floor((length(whole) - cut - length('{{"extracted_facts": [') + 2) / (length(f) + 2)) end::int as n from t)
select doc_id, case when n > 0 then '{{"extracted_facts": [' || array_to_string(list_transform(range(n), lambda i: f), ', ') || ']}}' end as json, case when cut = 0 then 'whole' when n > 0 then 'recovered' else 'invalid' end as how from n""")
def json_recover(spark, d):
    """Output cut off at a place that the document's number gives."""
    fact = F.format_string('{"fact_type": "other", "statement": "s%d {\\"x\\"}]"}', F.col("doc_id"))
    whole = F.concat(F.lit('{"extracted_facts": ['), F.array_join(F.array_repeat(fact, 3), ", "), F.lit("]}"))
    cut = F.substring(whole, F.lit(1), F.length(whole) - (F.col("doc_id") % 90).cast("int"))
    return P.documents(spark, d).select("doc_id", extract.parse_output(cut).alias("p")).select("doc_id", "p.json", "p.how")


@query("""with f as (select event_id as id, event_id % 7 as a, event_id % 5 as b, event_id % 3 as c, json_keys(props) as k from events),
r as (select id, unnest([
  {'rule': 'unknown_key', 'detail': array_to_string(list_sort(list_filter(k, lambda x: x <> 'k')), ',')},
  {'rule': 'fact_id', 'detail': case when a = 0 then 'f' || (id % 1000) end}, {'rule': 'fact_type', 'detail': case when b = 0 then 'oddity' end},
  {'rule': 'strength', 'detail': case when c = 0 then 'strong' end}, {'rule': 'statement', 'detail': case when a = 1 then '-' end},
  {'rule': 'citations', 'detail': case when b = 1 then '-' end}, {'rule': 'unknown_citation_key', 'detail': case when b = 2 then 'page' end}]) as x from f)
select id, x.rule as rule, case when x.detail = '-' then '' else x.detail end as detail from r where coalesce(x.detail, '') <> ''""")
def schema_forbid_extra(spark, d):
    """Facts whose keys and faults come from the events: other keys than ``k`` are unknown ones."""
    n = F.col("event_id")
    body = F.from_json("props", "map<string,string>")
    given = F.map_from_entries(
        F.array(
            *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in {
                "fact_id": F.when(n % 7 == 0, F.concat(F.lit("f"), (n % 1000).cast("string"))).otherwise("f0001"), "fact_type": F.when(n % 5 == 0, "oddity").otherwise("Warning"),
                "strength": F.when(n % 3 == 0, "strong").otherwise("may"), "statement": F.when(n % 7 == 1, "").otherwise("x"),
            }.items()]
        )
    )
    cites = F.when(n % 5 == 1, "[]").when(n % 5 == 2, '[{"chunk_id": "c1", "page": 3}]').otherwise('[{"chunk_id": "c0001", "line_start": 1, "line_end": 2}]')
    extra = F.map_filter(body, lambda k, _: k != "k")
    whole = F.to_json(F.map_concat(given, extra))
    text = F.concat(F.regexp_replace(whole, r"\}$", ""), F.lit(',"citations":'), cites, F.lit("}"))
    rows = files.spread(spark.read.parquet(f"{d}/events.parquet")).select("event_id", text.alias("json"))
    return extract.schema_violations(rows.withColumnRenamed("event_id", "id"), "id", "json")


@query("select event_id, len(list_filter(json_keys(props), lambda k: k not in ('k', 'page')))::bigint as unknown from events")
def unknown_props(spark, d):
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.size(F.array_except(keys, F.array(F.lit("k"), F.lit("page")))).cast("long").alias("unknown"))

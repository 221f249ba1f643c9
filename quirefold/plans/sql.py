"""DuckDB text of the same rules, made from the same lists and patterns."""

from __future__ import annotations

from quirefold.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{T.SPACE}+|{T.SPACE}+$", "")


def squeeze(x: str) -> str:
    return sub(x, f"{T.SPACE}+", " ")


def normalize(x: str) -> str:
    t = sub(f"replace({sub(strip(x), T.DASH, '-')}, '•', '- ')", T.DROPPED, "")
    return strip(f"regexp_replace({strip(squeeze(t))}, ':$', '')")


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), {q(T.NO_TOKEN)}), lambda x: x <> '')"


def items(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def fingerprint(x: str) -> str:
    return f"array_to_string(list_sort(list_filter({tokens(x)}, lambda x: x not in {items(T.STOP_WORDS)} and (length(x) >= 2 or regexp_matches(x, '^[0-9]+$')))), ' ')"


def any_of(x: str, cues) -> str:
    return "(" + " or ".join(f"contains({x}, {q(c)})" for c in cues) + ")"


def page_number(x: str) -> str:
    return f"regexp_full_match(lower({strip(x)}), {q(rf'[0-9]{{1,3}}|page{T.SPACE}*[0-9]{{1,3}}|[0-9]{{1,3}}{T.SPACE}*/{T.SPACE}*[0-9]{{1,3}}')})"


def footer_like(x: str) -> str:
    return f"({any_of(f'lower({x})', T.FOOTER_MARKS)} or {page_number(x)})"


def junk(x: str) -> str:
    t = tokens(x)
    return f"(length({x}) < 10 or len({t}) = 0 or (len(list_filter({t}, lambda x: x in {items(T.HEADER_WORDS)})) >= 2 and len({t}) <= 10) or coalesce(({t})[1] in {items(T.CAPTION_WORDS)}, false))"


def fact_type(x: str, current: str) -> str:
    s = f"lower({x})"
    has = lambda r: any_of(s, T.TYPE_CUES[r])
    dose = rf"(?:^|[^\p{{L}}\p{{N}}_])[0-9]{{2,3}}{T.SPACE}*(?:mmhg|mg|g|ml)(?:$|[^\p{{L}}\p{{N}}_])"
    return (
        f"case when {has('contraindication')} then 'contraindication' when {has('exclusion')} then 'exclusion' when {has('red_flag')} then 'red_flag'"
        f" when (regexp_matches({s}, {q(dose)}) or {has('threshold')}) and {current} in ('other', 'follow_up', 'diagnostic') then 'threshold'"
        f" when {has('follow_up')} and {current} = 'other' then 'follow_up' when {has('action')} and {current} = 'other' then 'action'"
        f" when {has('onset')} and {current} = 'population' then 'follow_up' else {current} end"
    )


def strength(x: str, current: str, kind: str) -> str:
    s = f"lower({x})"
    has = lambda r: any_of(s, T.STRENGTH_CUES[r])
    return (
        f"case when {has('must')} then 'must' when {has('should')} then 'should' when {has('option')} then case when {has('weighing')} then 'consider' else 'may' end"
        f" when {kind} in ('exclusion', 'contraindication') then 'must' when {current} = 'must' then 'unclear' else {current} end"
    )


def review(x: str, current: str) -> str:
    return f"({x} in ('may', 'consider', 'unclear') or {current})"


LINES = f"""
raw_lines as (
  select doc_id, unnest(a) as t, generate_subscripts(a, 1) as pos
  from (select doc_id, string_split_regex(coalesce(text, ''), {q(T.LINE_END)}) as a from documents)),
lines as (
  select doc_id, row_number() over (partition by doc_id order by pos) as line_no, text
  from (select doc_id, pos, {strip('t')} as text from raw_lines) where text <> '')"""
CHUNKS = f"""{LINES},
shown as (select doc_id, line_no, line_no || '. ' || text as shown, length(line_no || '. ' || text) + 1 as cost from lines),
walk as (
  select doc_id, line_no, shown, 1 as chunk, 1 as n, cost as chars from shown where line_no = 1
  union all
  select s.doc_id, s.line_no, s.shown,
    w.chunk + case when w.n + 1 > 20 or w.chars + s.cost > 1200 then 1 else 0 end,
    case when w.n + 1 > 20 or w.chars + s.cost > 1200 then 1 else w.n + 1 end,
    case when w.n + 1 > 20 or w.chars + s.cost > 1200 then s.cost else w.chars + s.cost end
  from walk w join shown s on s.doc_id = w.doc_id and s.line_no = w.line_no + 1),
chunks as (
  select doc_id, printf('c%04d', chunk) as chunk_id, min(line_no)::bigint as line_start, max(line_no)::bigint as line_end, string_agg(shown, chr(10) order by line_no) as text
  from walk group by doc_id, chunk)"""

"""Facts: normalisation, exact and fuzzy merging, tightening of citations, numbering.

A fact is (doc_id, ord, fact_id, fact_type, statement, strength, requires_human_review, subject, condition, action, notes, raw,
citations array<struct<chunk_id, line_start, line_end, quote>>); ``ord`` is the order in which facts were met.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quirefold.functions import text as T
from quirefold.operators import trace

OPTIONAL = ("subject", "condition", "action", "notes", "raw")
CITATION = "struct<chunk_id:string,line_start:bigint,line_end:bigint,quote:string>"
FACT_SCHEMA = (
    "doc_id long, ord int, fact_id string, fact_type string, statement string, strength string, requires_human_review boolean,"
    f" subject string, condition string, action string, notes string, raw string, citations array<{CITATION}>"
)


@dataclass(frozen=True)
class NormalizeConfig:
    min_chars: int = 10
    fuzzy_threshold: float = 0.94
    #: Comparisons for each document and fact type.
    max_fuzzy_comparisons: int = 8000
    tighten_window: int = 4


def normalize_facts(facts: DataFrame, config: NormalizeConfig = NormalizeConfig(), *more: str) -> DataFrame:
    """Facts with their statement, type, strength and review flag by the rules, and ``junk``: whether the fact is to go. ``more``
    may name ``low`` and ``tokens``, those of the statement."""
    rows = T.once(facts, statement=T.normalize_text(F.col("statement")))
    rows = T.once(rows, low=F.lower("statement"), tokens=T.tokenize(F.col("statement")))
    low, statement = F.col("low"), F.col("statement")
    rows = T.once(rows, junk=T.is_header_or_junk(statement, config.min_chars, F.col("tokens")), fact_type=T.refine_fact_type(statement, F.col("fact_type"), low))
    rows = T.once(rows, strength=T.refine_strength(statement, F.col("strength"), F.col("fact_type"), low))
    rows = rows.withColumn("requires_human_review", T.needs_review(F.col("strength"), F.col("requires_human_review")))
    return rows.select(*facts.columns, "junk", *more)


def ordered_citations(lists: Column) -> Column:
    """Of an array of citation arrays in order: all citations by span, those with a quote first, then as they came."""
    place = lambda c, i: F.struct(c["chunk_id"], c["line_start"], c["line_end"], c["quote"].isNull(), i, c["quote"])
    names = ("chunk_id", "line_start", "line_end", "bare", "nth", "quote")
    return F.array_sort(F.transform(F.flatten(lists), place)).cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, ("string", "bigint", "bigint", "boolean", "int", "string"))) + ">>")


def first_of_spans(ordered: str) -> Column:
    """Of a column of ``ordered_citations``: the first citation of each span."""
    span = lambda c: F.struct(c["chunk_id"], c["line_start"], c["line_end"])
    new = F.filter(ordered, lambda c, i: (i == 0) | ~span(c).eqNullSafe(span(F.get(ordered, i - 1))))
    return F.transform(new, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["line_start"].alias("line_start"), c["line_end"].alias("line_end"), c["quote"].alias("quote")))


def merge_groups(facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One fact of each group: the longest statement's, then the smallest id's; the strongest strength, any review flag, all
    citations, and for each optional field the representative's or else the first in ``order``. Groups of one stay as they are.
    ``merged``: facts that went into it, less one. All but the citations, which gather in the group's row, are partial aggregates;
    a group is of one document, so its row holds no more than the document cites."""
    rep_key = F.struct(-F.length("statement"), F.col("fact_id"))
    names = [c for c in facts.columns if c not in (*keys, order)]
    rep = F.min_by(F.struct(*names), rep_key)
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"first_{c}") for c in OPTIONAL if c in names]
    grouped = facts.groupBy(*keys).agg(
        rep.alias("rep"),
        F.min(order).alias(order),
        F.count("*").alias("n"),
        F.max_by("strength", T.strength_rank(F.col("strength"))).alias("strongest"),
        F.bool_or("requires_human_review").alias("any_review"),
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("citations").alias("c")))).alias("lists"),
        *first,
    )
    many = F.col("n") > 1
    grouped = grouped.withColumn("cites", F.when(many, ordered_citations(F.col("lists.c")))).drop("lists")

    def out(c: str) -> Column:
        value = F.col(f"rep.{c}")
        if c == "strength":
            value = F.when(many, F.col("strongest")).otherwise(value)
        elif c == "requires_human_review":
            value = F.col("any_review")
        elif c == "citations":
            value = F.when(many, first_of_spans("cites")).otherwise(value)
        elif c in OPTIONAL:
            value = F.coalesce(value, F.col(f"first_{c}"))
        return value.alias(c)

    return grouped.select(*keys, order, *[out(c) for c in names], (F.col("n") - 1).alias("merged"))


def merge_exact(facts: DataFrame) -> DataFrame:
    """Facts of one type whose statements have one fingerprint are one."""
    keyed = facts.withColumn("fingerprint", T.fingerprint(F.col("statement")))
    return merge_groups(keyed, ["doc_id", "fact_type", "fingerprint"], "ord").drop("fingerprint")


def _letter_counts(low: list[str]) -> np.ndarray:
    """How often each statement has the signs of each of 128 buckets."""
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32) % 128
    size = np.array([len(s) for s in low], np.int64)
    return np.bincount(np.repeat(np.arange(len(low)), size) * 128 + code, minlength=len(low) * 128).reshape(len(low), 128)


def _leaders(low: list[str], threshold: float, cap: int) -> tuple[list[int], int]:
    """Leader clustering: the first of those that wait leads all that are like it, and they wait no longer.

    The place of each one's leader, and how many leaders could not look at all that waited, as ``cap`` comparisons were made.
    Signs that two statements share bound their likeness from above, so few pairs are compared in full.
    """
    if len(low) < 2:
        return list(range(len(low))), 0
    counts, size = None, [len(s) for s in low]
    leader, waiting, short = list(range(len(low))), list(range(len(low))), 0
    while len(waiting) > 1 and cap:
        head, rest = waiting[0], waiting[1:]
        looked = rest[:cap]
        cap -= len(looked)
        short += len(looked) < len(rest)
        # Most pairs differ too much in length already; signs are counted only where one does not.
        n = size[head]
        near = [i for i in looked if not n + size[i] or 2.0 * min(n, size[i]) / (n + size[i]) >= threshold]
        if near and counts is None:
            counts = _letter_counts(low)
        for i in near:
            total = n + size[i]
            if total and 2.0 * int(np.minimum(counts[head], counts[i]).sum()) / total < threshold:
                continue
            m = SequenceMatcher(None, low[head], low[i])
            if m.quick_ratio() >= threshold and m.ratio() >= threshold:
                leader[i] = head
        waiting = [i for i in rest if leader[i] == i]
    return leader, short + (0 if cap else max(0, len(waiting) - 1))


def fuzzy_leaders(facts: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """(doc_id, fact_type, ord, leader, place, capped): the ord of each fact's leader, its place in order, and how many scans the
    comparison limit cut short. The limit bounds the work of one document and type.

    Groups are small and many, so they are sorted together and read as one stream a task, not called one by one.
    """
    rows = facts.select("doc_id", "fact_type", "ord", F.lower("statement").alias("low"))
    dealt = rows.repartition("doc_id", "fact_type").sortWithinPartitions("doc_id", "fact_type", "low", "ord")
    columns = ["doc_id", "fact_type", "ord", "leader", "place", "capped"]

    def close(key, low, ords) -> list[tuple]:
        leader, capped = _leaders(low, config.fuzzy_threshold, config.max_fuzzy_comparisons)
        return [(*key, o, ords[k], place, capped) for place, (o, k) in enumerate(zip(ords, leader))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, low, ords = None, [], []
        for pdf in batches:
            out = []
            for d, t, o, s in zip(*(pdf[c].tolist() for c in ("doc_id", "fact_type", "ord", "low"))):
                if (d, t) != key:
                    out += close(key, low, ords)
                    key, low, ords = (d, t), [], []
                low.append(s)
                ords.append(o)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(close(key, low, ords) if ords else [], columns=columns)

    return dealt.mapInPandas(run, "doc_id long, fact_type string, ord int, leader int, place int, capped int")


def fuzzy_pairs(facts: DataFrame, threshold: float = 0.94) -> DataFrame:
    """(doc_id, fact_type, a, b): pairs of facts of one type whose lengths leave the ratio open: the candidates of the fuzzy pass.

    Lengths are dealt to steps within which the ratio stays open, so a fact meets those of its own step and its neighbours' only.
    """
    step = F.floor(F.log(F.greatest(F.length("statement"), F.lit(1)).cast("double")) / F.log(F.lit((2 - threshold) / threshold))).cast("int")
    side = lambda name, size, s: facts.select("doc_id", "fact_type", F.col("ord").alias(name), F.length("statement").alias(size), s.alias("step"))
    left, right = side("a", "la", step), side("b", "lb", F.explode(F.array(step - 1, step, step + 1)))
    least, most = F.least("la", "lb"), F.greatest("la", "lb")
    return left.join(right, ["doc_id", "fact_type", "step"]).where((F.col("a") < F.col("b")) & (least * (2 - threshold) >= most * threshold)).select("doc_id", "fact_type", "a", "b")


def merge_fuzzy(facts: DataFrame, config: NormalizeConfig = NormalizeConfig(), led: DataFrame | None = None) -> DataFrame:
    """Facts of one leader are one. ``led``: their ``fuzzy_leaders``, if known. ``capped`` is that of the document and type."""
    rows = facts.drop("merged").join(fuzzy_leaders(facts, config) if led is None else led, ["doc_id", "fact_type", "ord"])
    # Within a group the order is that of the statements; the merged fact keeps the leader's ord.
    merged = merge_groups(rows.drop("ord"), ["doc_id", "fact_type", "leader"], "place")
    return merged.withColumnRenamed("leader", "ord").drop("place")


def tighten_citations(facts: DataFrame, lines: DataFrame, max_window: int = 4) -> DataFrame:
    """(doc_id, ord, nth, chunk_id, line_start, line_end, quote, moved) of every citation of every fact, its span shrunk.

    The new span is the smallest run of up to ``max_window`` lines present in the old one whose normalised text holds the
    normalised statement, the leftmost of them; with none the span stays.
    """
    cited = facts.select("doc_id", "ord", T.normalize_text(F.col("statement")).alias("statement"), F.posexplode("citations").alias("nth", "c"))
    cited = cited.select("doc_id", "ord", "nth", F.lower("statement").alias("wanted"), "c.*")
    asked = cited.where("wanted <> ''").select("doc_id", "ord", "nth", "wanted", F.least("line_start", "line_end").alias("lo"), F.greatest("line_start", "line_end").alias("hi"))
    spans = trace.spans(asked, lines, F.col("lo"), F.col("hi")).drop("lo", "hi")
    clean = lines.select("doc_id", "line_no", F.lower(T.normalize_text(F.col("text"))).alias("line"))
    present = spans.join(clean, ["doc_id", "line_no"])
    order = Window.partitionBy("doc_id", "ord", "nth").orderBy("line_no")
    tries = []
    for width in range(1, max(2, max_window) + 1):
        ahead = order.rowsBetween(0, width - 1)
        block = F.array_join(F.collect_list("line").over(ahead), " ")
        whole = F.count("*").over(ahead) == width
        tries.append(F.when(whole & F.contains(block, F.col("wanted")), F.struct(F.lit(width).alias("w"), F.col("line_no").alias("start"), F.max("line_no").over(ahead).alias("end"))))
    found = present.select("doc_id", "ord", "nth", F.array_min(F.array_compact(F.array(*tries))).alias("s"))
    best = found.groupBy("doc_id", "ord", "nth").agg(F.min("s").alias("s"))
    out = cited.join(best, ["doc_id", "ord", "nth"], "left")
    start, end = F.coalesce("s.start", "line_start"), F.coalesce("s.end", "line_end")
    moved = (start != F.col("line_start")) | (end != F.col("line_end"))
    return out.select("doc_id", "ord", F.col("nth").cast("int").alias("nth"), "chunk_id", start.alias("line_start"), end.alias("line_end"), "quote", moved.alias("moved"))


def number_facts(facts: DataFrame, by_statement: bool = True) -> DataFrame:
    """New ids f0001 ... by type, lower-cased statement and old id, or in the order met."""
    order = ["fact_type", F.lower("statement"), "fact_id"] if by_statement else ["ord"]
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return facts.withColumn("fact_id", T.numbered_id("f", n))


def exact_facts(facts: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """Facts by the rules, merged exactly; of those to go (``junk``) one for each document and type, without citations."""
    ruled = normalize_facts(facts, config, "tokens")
    keyed = ruled.withColumn("fingerprint", F.when(~F.col("junk"), T.fingerprint(F.col("statement"), F.col("tokens")))).drop("tokens")
    return merge_groups(keyed.withColumn("citations", F.when(~F.col("junk"), F.col("citations"))), ["doc_id", "junk", "fact_type", "fingerprint"], "ord").drop("fingerprint")


class _Spans:
    """Where statements stand in a document's lines: the rule of ``tighten_citations``, over the lines joined by spaces."""

    def __init__(self, numbers: list[int], lines: list[str], window: int):
        self.numbers, self.text, self.window = numbers, " ".join(lines), max(2, window)
        self.ends = (np.cumsum([len(x) + 1 for x in lines], dtype=np.int64) - 1).tolist()
        self.starts = [0, *(e + 1 for e in self.ends)]

    def tight(self, wanted: str, start: int | None, end: int | None) -> tuple[int | None, int | None, bool]:
        """The span's new start and end, and whether it moved."""
        given = [x for x in (start, end) if x is not None]
        if not wanted or not given:
            return start, end, False
        a, b = bisect_left(self.numbers, min(given)), bisect_right(self.numbers, max(given))
        # A run of lines that holds the statement is a part of the whole span.
        if a >= b or self.text.find(wanted, self.starts[a], self.ends[b - 1]) < 0:
            return start, end, False
        for width in range(1, min(self.window, b - a) + 1):
            for i in range(a, b - width + 1):
                if self.text.find(wanted, self.starts[i], self.ends[i + width - 1]) >= 0:
                    s, e = self.numbers[i], self.numbers[i + width - 1]
                    return s, e, (start is not None and s != start) or (end is not None and e != end)
        return start, end, False


def _judge(kinds: list[str], ords: list[int], ids: list[str], low: list[str], sizes: list[int], cites: list[list[tuple]], spans: _Spans | None, config: NormalizeConfig, led: bool = True) -> dict:
    """Of one document's facts, a row of ``JUDGED``: each one's leader, place and capped scans, and the tightened spans of what it is
    merged into (left out without ``led``); how many went into others; how many citations moved; what was capped."""
    first = lambda x: (x is not None, x)
    order = sorted(range(len(low)), key=lambda i: (first(kinds[i]), first(low[i]), ords[i]))
    out, gone, moved, caps = [], 0, 0, []
    for kind, group in groupby(order, key=lambda i: kinds[i]):
        at = list(group)
        leader, capped = _leaders([low[i] for i in at], config.fuzzy_threshold, config.max_fuzzy_comparisons)
        members: dict[int, list[int]] = {}
        for i, k in zip(at, leader):
            members.setdefault(k, []).append(i)
        gone += len(at) - len(members)
        if capped:
            caps.append({"fact_type": kind, "capped": capped})
        tight: dict[int, list[tuple] | None] = {}
        for k, own in members.items():
            if spans is None:
                tight[k] = None
                continue
            rep = own[0] if len(own) == 1 else min(own, key=lambda i: (-sizes[i], first(ids[i])))
            # Many citations are one of each span, in the order of ``first_of_spans``; those of a fact by itself stay.
            said = cites[rep] if len(own) == 1 else sorted({c for i in own for c in cites[i]}, key=lambda c: tuple(map(first, c)))
            # The statement is normalised already, so only one more closing colon can go.
            wanted = low[rep][:-1].strip(" ") if low[rep].endswith(":") else low[rep]
            found = [spans.tight(wanted, a, b) for _, a, b in said]
            moved += sum(m for *_, m in found)
            tight[k] = [{"line_start": a, "line_end": b} for a, b, _ in found]
        if led:
            out += [{"fact_type": kind, "ord": ords[i], "leader": ords[at[k]], "place": place, "capped": capped, "spans": tight[k]} for place, (i, k) in enumerate(zip(at, leader))]
    return {"led": out, "fuzzy_merges": gone, "tightened": moved, "caps": caps}


JUDGED = pa.struct([
    ("led", pa.list_(pa.struct([("fact_type", pa.string()), ("ord", pa.int32()), ("leader", pa.int32()), ("place", pa.int32()), ("capped", pa.int32()), ("spans", pa.list_(pa.struct([("line_start", pa.int64()), ("line_end", pa.int64())])))]))),
    ("fuzzy_merges", pa.int64()), ("tightened", pa.int64()), ("caps", pa.list_(pa.struct([("fact_type", pa.string()), ("capped", pa.int32())]))),
])


def judged_facts(exact: DataFrame, lines: DataFrame | None = None, config: NormalizeConfig = NormalizeConfig(), led: bool = True) -> DataFrame:
    """(doc_id, dropped, exact_merges, led, fuzzy_merges, tightened, caps) of each document of ``exact_facts``: their leaders and the
    tightened spans, found while the document is one row with its lines. Without ``led`` that column is empty.

    All that is grouped and joined has doc_id for a key, so tables dealt by it are not dealt again, and lines meet each citation
    without a copy of theirs for each.
    """
    junk, merged = F.col("junk"), F.col("merged")
    fact = F.struct("fact_type", "ord", "fact_id", F.lower("statement").alias("low"), F.length("statement").alias("size"), "citations")
    rows = exact.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(junk, merged + 1)), F.lit(0)).alias("dropped"),
        F.coalesce(F.sum(F.when(~junk, merged)), F.lit(0)).alias("exact_merges"),
        F.collect_list(F.when(~junk, fact)).alias("facts"),
    )
    if lines is None:
        rows = rows.withColumn("lines", F.lit(None).cast("array<struct<line_no:bigint,line:string>>"))
    else:
        line = F.struct(F.col("line_no").cast("long").alias("line_no"), F.lower(T.normalize_text(F.col("text"))).alias("line"))
        of_lines = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
        rows = rows.join(of_lines, "doc_id", "left")
    tighten = lines is not None

    @F.arrow_udf(from_arrow_type(JUDGED))
    def judge(facts: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        flat = facts.flatten()
        kinds, ords, ids, low, sizes = (flat.field(k).to_pylist() for k in range(5))
        cited = flat.field(5)
        chunk, start, end = (cited.flatten().field(k).to_pylist() for k in range(3))
        size = pc.fill_null(pc.list_value_length(cited), 0).to_pylist()
        numbers, said = (text.flatten().field(k).to_pylist() for k in range(2))
        cites, at = [], 0
        for n in size:
            cites.append(list(zip(chunk[at : at + n], start[at : at + n], end[at : at + n])))
            at += n
        a = z = 0
        for n, m in zip(pc.list_value_length(facts).to_pylist(), pc.fill_null(pc.list_value_length(text), 0).to_pylist()):
            spans = _Spans(numbers[z : z + m], said[z : z + m], config.tighten_window) if tighten else None
            b, z = a + n, z + m
            out.append(_judge(kinds[a:b], ords[a:b], ids[a:b], low[a:b], sizes[a:b], cites[a:b], spans, config, led))
            a = b
        return pa.array(out, JUDGED)

    return rows.select("doc_id", "dropped", "exact_merges", judge("facts", "lines").alias("j")).select("doc_id", "dropped", "exact_merges", "j.*")


#: What ``judged_facts`` reads of a fact, and the rules before it.
JUDGED_BY = ("doc_id", "ord", "fact_id", "fact_type", "statement", "strength", "requires_human_review", "citations")


def canonical_facts(facts: DataFrame, lines: DataFrame | None = None, config: NormalizeConfig = NormalizeConfig(), keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The clean facts, and (doc_id, dropped, exact_merges, fuzzy_merges, tightened, warnings) of each document.

    ``keep`` may write a step's table (name, how to make it) and read it again; both results and the steps after share it. Without it
    nothing is written, and each result is computed by itself.
    """
    if keep is None:
        exact = exact_facts(facts, config)
        judged, ends = judged_facts(exact, lines, config), judged_facts(exact_facts(facts.select(*JUDGED_BY), config), lines, config, led=False)
    else:
        exact = keep("facts_exact", lambda: exact_facts(facts, config))
        ends = judged = keep("facts_judged", lambda: judged_facts(exact, lines, config))
    merged = merge_fuzzy(exact.where("not junk").drop("junk"), config, judged.select("doc_id", F.inline("led")))
    if lines is not None:
        tight = lambda c, s: F.struct(c["chunk_id"].alias("chunk_id"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), c["quote"].alias("quote"))
        merged = merged.withColumn("citations", F.zip_with("citations", "spans", tight))
    clean = number_facts(merged.select(*facts.columns))
    counts = ends.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("dropped", "exact_merges", "fuzzy_merges", "tightened")], "caps")
    say = lambda c, head, tail: F.when(F.col(c) > 0, F.concat(F.lit(head), F.col(c).cast("string"), F.lit(tail)))
    capped = F.flatten(F.transform("caps", lambda x: F.array_repeat(F.concat(F.lit("Step6: fuzzy scan capped for "), x["fact_type"], F.lit("; remaining kept as-is.")), x["capped"])))
    # The wording of warnings.
    before = F.array_compact(F.array(say("dropped", "Step6: dropped ", " header/junk facts deterministically."), say("exact_merges", "Step6: merged ", " duplicates by canonical fingerprint.")))
    after = F.array_compact(F.array(say("fuzzy_merges", "Step6: merged ", " near-duplicates by fuzzy matching."), say("tightened", "Step6: tightened ", " citation spans using exact statement matching.")))
    return clean, counts.withColumn("warnings", T.join_warnings(before, capped, after)).drop("caps")

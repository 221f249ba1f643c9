"""Operators on self-written cases."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quirefold.operators import cleanup, extract, facts, lines, trace, workflow
from quirefold.sources import html


def test_numbered_lines_and_violations(spark):
    df = spark.createDataFrame([(1, "1. Alpha\n2) Beta\n\n3 - Gamma\n4 Delta"), (2, "1. a\n2. b\n2. c"), (3, "1. a\nPlain\n4. c"), (4, "10. a\n11. b")], "doc_id long, text string")
    parsed = lines.parse_documents(df)
    assert [(r.line_no, r.text) for r in parsed.where("doc_id = 1").orderBy("pos").collect()] == [(1, "Alpha"), (2, "Beta"), (3, "Gamma"), (4, "Delta")]
    bad = lines.numbering_violations(parsed)
    assert sorted((r.doc_id, r.rule) for r in bad.collect()) == [(2, "duplicate"), (3, "unparseable")]
    with pytest.raises(trace.ContractError):
        trace.fail_closed(bad, "doc_id", "pos")
    trace.fail_closed(bad.where("doc_id = 1"), "pos")


def chunk(texts, first=1):
    out, cur, chars = [], [], 0
    for n, t in enumerate(texts, first):
        cost = len(f"{n}. {t}".rstrip()) + 1
        if cur and (len(cur) + 1 > 20 or chars + cost > 1200):
            out.append((cur[0], cur[-1]))
            cur, chars = [], 0
        cur.append(n)
        chars += cost
    return out + ([(cur[0], cur[-1])] if cur else [])


def test_chunks(spark):
    rng = random.Random(1)
    docs = [["x"] * 45, ["a", "b" * 3000, "c"], ["y" * 396] * 3 + ["z"], [], *[["w" * rng.choice([1, 5, 300, 1195, 1196, 1197]) for _ in range(rng.randint(1, 60))] for _ in range(25)]]
    got = {}
    for r in lines.pack_chunks(spark.createDataFrame(list(enumerate(docs)), "doc_id int, lines array<string>")).orderBy("doc_id", "line_start").collect():
        got.setdefault(r.doc_id, []).append((r.line_start, r.line_end))
    assert got == {i: chunk(d) for i, d in enumerate(docs) if d}
    with pytest.raises(ValueError):
        lines.pack_chunks(spark.createDataFrame([(1, ["a"])], "doc_id int, lines array<string>"), max_lines=0)


#: Lines, the same with word breaks joined, and with paragraphs joined.
CLEANUPS = [
    (["recom-", "mendation"], ["recommendation"], ["recom- mendation"]),
    (["recom-", "Mendation"], ["recom-", "Mendation"], ["recom-", "Mendation"]),
    (["a-", "b-", "c-", "d"], ["ab-", "cd"], ["a- b- c- d"]),
    (["x-", "y-", "z"], ["xy-", "z"], ["x- y- z"]),
    (["last-"], ["last-"], ["last-"]),
    (["n-", "é fin"], ["né fin"], ["n- é fin"]),
    (["alpha", "beta"], ["alpha", "beta"], ["alpha beta"]),
    (["alpha.", "beta"], ["alpha.", "beta"], ["alpha.", "beta"]),
    (["alpha", "- beta"], ["alpha", "- beta"], ["alpha", "- beta"]),
    (["- item", "goes on"], ["- item", "goes on"], ["- item goes on"]),
    (["End:", "then"], ["End:", "then"], ["End:", "then"]),
    (["one", "2. two", "three", "Four", "five"], ["one", "2. two", "three", "Four", "five"], ["one", "2. two three", "Four five"]),
]


def _lists(out, n):
    got = {}
    for r in out.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    return [got[i] for i in range(n)]


def test_line_cleanup_cases(spark):
    df = spark.createDataFrame([(d, i, x) for d, (ls, _, _) in enumerate(CLEANUPS) for i, x in enumerate(ls)], "doc_id int, pos int, line string")
    assert _lists(cleanup.dehyphenate(df), len(CLEANUPS)) == [j for _, j, _ in CLEANUPS]
    assert _lists(cleanup.merge_soft_wraps(df), len(CLEANUPS)) == [p for _, _, p in CLEANUPS]


def test_line_cleanup_properties(spark):
    rng = random.Random(2)
    docs = [[rng.choice(["alpha", "beta-", "Gamma-", "delta.", "- item", "2. two", "x-", "é fin", "End:"]) for _ in range(rng.randint(1, 12))] for _ in range(120)]
    df = spark.createDataFrame([(d, i, x) for d, ls in enumerate(docs) for i, x in enumerate(ls)], "doc_id int, pos int, line string")
    for before, joined, merged in zip(docs, _lists(cleanup.dehyphenate(df), len(docs)), _lists(cleanup.merge_soft_wraps(df), len(docs))):
        # Nothing but a dash goes where lines are joined, and nothing but a line end becomes a space.
        assert "".join(joined).replace("-", "") == "".join(before).replace("-", "")
        assert " ".join(merged) == " ".join(before)
        # A paragraph starts where its line may not go on: after a stop, at a bullet, or without lower case.
        starts = [x for x, b in zip(before[1:], before) if b[-1] in ".:" or x[:2] in ("- ", "2.") or not x[0].islower()]
        assert len(merged) == len(starts) + 1


def test_boilerplate_and_wrap(spark):
    rows = [(1, i, "copyright x") for i in range(4)] + [(1, 9, "Text."), (2, 0, "copyright x"), (3, 0, "same"), (3, 1, "same"), (3, 2, "same"), (3, 3, "same")]
    out = cleanup.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, pos int, line string"))
    assert sorted((r.doc_id, r.line) for r in out.collect()) == [(1, "Text."), (2, "copyright x")] + [(3, "same")] * 4
    w = spark.createDataFrame([("aa bb cccccccccc d",), ("short",), ("",)], "s string").select(cleanup.hard_wrap(F.col("s"), 6).alias("w")).collect()
    assert [r.w for r in w] == [["aa bb", "cccccccccc", "d"], ["short"], [""]]


def test_html_blocks():
    assert html.blocks_of("<nav>no</nav><h1>T &amp; u</h1><p>one <b>two</b><p>three<ul><li>x<li><p>y</p></ul><script>no</script>") == ["T & u", "one two", "three", "x", "y", "y"]
    assert html.blocks_of("<div>a</div><div>b\n c</div>") == ["a", "b", "c"]
    assert html.blocks_of(None) == []


def test_truncated_json():
    fact = '{"statement": "a } ] \\" b", "n": {"k": [1]}}'
    whole = '{"extracted_facts": [' + fact + ", " + fact + "]}"
    for cut in range(len(whole) + 1):
        got, how = extract.parse_strict(whole[:cut])
        if got is not None:
            assert len(json.loads(got).get("extracted_facts", [1])) in (1, 2)
    assert extract.parse_strict(whole) [1] == "whole"
    assert extract.parse_strict("noise " + whole + " noise")[1] == "span"
    assert extract.parse_strict(whole[:-30])[1] == "recovered"
    assert extract.parse_strict('{ "extracted_facts":[{"a":1},{')[1] == "invalid"
    assert extract.parse_strict(" ")[1] == "empty"


def fact(ord_, kind, statement, **more):
    base = {"doc_id": 1, "ord": ord_, "fact_id": f"f{ord_:04d}", "fact_type": kind, "statement": statement, "strength": "should", "requires_human_review": False, "subject": None, "condition": None, "action": None, "notes": None, "raw": None, "citations": [("c0001", ord_, ord_ + 2, None)]}
    return tuple((base | more).values())


def test_merging_and_tightening(spark):
    rows = [
        fact(1, "other", "The patient recovers very quickly at home", citations=[("c0001", 1, 3, None), ("c0001", 5, 6, None)]),
        fact(2, "other", "very quickly the patient recovers at home", subject="s", strength="must", citations=[("c0001", 1, 3, "q")]),
        fact(3, "action", "The patient recovers very quickly at home"),
        fact(4, "other", "An unrelated remark about something else here"),
        fact(5, "other", "An unrelated remark about something else hera"),
        fact(6, "other", "Table of dose per class"),
    ]
    df = spark.createDataFrame(rows, facts.FACT_SCHEMA)
    text = spark.createDataFrame([(1, n, t) for n, t in enumerate(["x", "The patient recovers", "very quickly at home today", "An unrelated remark about something else here", "y", "z"], 1)], "doc_id long, line_no long, text string")
    clean, counts = facts.canonical_facts(df, text)
    got = {r.fact_id: r for r in clean.collect()}
    assert [got[k].fact_type for k in sorted(got)] == ["action", "other", "other"]
    one = next(r for r in got.values() if r.subject == "s")
    assert one.strength == "should" and one.statement.startswith("The patient")
    assert [(c.line_start, c.line_end, c.quote) for c in one.citations] == [(2, 3, "q"), (5, 6, None)]
    c = counts.first()
    assert (c.dropped, c.exact_merges, c.fuzzy_merges) == (1, 1, 1) and len(c.warnings) == 4


def test_fuzzy_leaders_against_loops(spark):
    rng = random.Random(3)
    base = ["alpha beta gamma delta epsilon", "one two three four five six seven"]
    texts = ["".join(c if rng.random() > 0.03 else rng.choice("abcxyz") for c in rng.choice(base)) for _ in range(30)]
    df = spark.createDataFrame([fact(i, "other", t) for i, t in enumerate(texts)], facts.FACT_SCHEMA)
    order = sorted(range(30), key=lambda i: (texts[i].lower(), i))
    want, used = {}, set()
    for k, i in enumerate(order):
        if i in used:
            continue
        want[i] = i
        for j in order[k + 1 :]:
            if j not in used and SequenceMatcher(None, texts[i].lower(), texts[j].lower()).ratio() >= 0.94:
                used.add(j)
                want[j] = i
    assert {r.ord: r.leader for r in facts.fuzzy_leaders(df).collect()} == want


def test_workflow_of_no_red_flags(spark):
    df = spark.createDataFrame([fact(1, "population", "Adults of any age"), fact(2, "exclusion", "Known pregnancy", requires_human_review=True)], facts.FACT_SCHEMA)
    nodes, heads = workflow.workflow_nodes(df), workflow.workflow_headers(df)
    assert nodes.count() == 7
    assert len(heads.first().warnings) == 1
    assert workflow.graph_violations(heads, nodes).count() == 0
    assert [r.node_id for r in workflow.decision_chain(heads, nodes).orderBy("step").collect()] == ["d0001", "d0002", "d0003"]


def _tangled(rng, docs=6):
    """Facts and lines in which statements stand within lines, over lines, nowhere, twice; with odd spans, near copies and junk."""
    words = ["alpha", "beta", "Gamma", "delta:", "épsilon", "•", "zeta", "eta", "theta,", "iota"]
    texts, rows = [], []
    for d in range(docs):
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        texts += [(d, n, t) for n, t in enumerate(own, 1)]
        for k in range(1, rng.randint(2, 40)):
            at = rng.randrange(len(own))
            said = " ".join(own[at : at + rng.randint(1, 5)])
            said = said[rng.randrange(3) :] if rng.random() < 0.7 else said + rng.choice([" kappa", "::", "x", " lambda mu nu"])
            spans = [(rng.choice(["c0001", "c0002"]), rng.randint(-1, len(own) + 2), rng.randint(-1, len(own) + 2), rng.choice([None, "q"])) for _ in range(rng.randint(0, 3))]
            rows.append((d, *fact(k, rng.choice(["other", "action", "threshold"]), said, citations=spans, strength=rng.choice(["must", "may"]))[1:]))
    return rows, texts


def test_canonical_facts_against_single_steps(spark):
    rows, texts = _tangled(random.Random(11))
    df, text = spark.createDataFrame(rows, facts.FACT_SCHEMA), spark.createDataFrame(texts, "doc_id long, line_no long, text string")
    config = facts.NormalizeConfig(fuzzy_threshold=0.8)
    ruled = facts.normalize_facts(df, config)
    merged = facts.merge_fuzzy(facts.merge_exact(ruled.where("not junk").drop("junk")), config)
    tight = facts.tighten_citations(merged, text).collect()
    clean, counts = facts.canonical_facts(df, text, config)
    counts = {r.doc_id: r for r in counts.collect()}
    want = {(r.doc_id, r.ord): r for r in merged.collect()}
    for r in want.values():
        r_cites = sorted((t.nth, t.chunk_id, t.line_start, t.line_end, t.quote) for t in tight if (t.doc_id, t.ord) == (r.doc_id, r.ord))
        want[r.doc_id, r.ord] = (r.fact_type, r.statement, r.strength, [c[1:] for c in r_cites])
    got = {(r.doc_id, r.ord): (r.fact_type, r.statement, r.strength, [tuple(c) for c in r.citations]) for r in clean.collect()}
    assert got == want
    assert {d: c.tightened for d, c in counts.items()} == {d: sum(t.moved for t in tight if t.doc_id == d) for d in counts}
    assert sum(c.tightened for c in counts.values()) > 20 and sum(c.fuzzy_merges for c in counts.values()) > 5
    junk = dict(ruled.where("junk").groupBy("doc_id").count().collect())
    for d, c in counts.items():
        assert c.dropped == junk.get(d, 0)
        assert c.dropped + c.exact_merges + c.fuzzy_merges + sum(k[0] == d for k in want) == sum(r[0] == d for r in rows)


def test_clean_fact_counts_deals_documents_only(spark, small):
    """Neither facts nor cited lines are shuffled, and no table is written: that took more than four times the input on disk."""
    from quirefold.plans import catalog

    df = catalog.QUERIES["clean_fact_counts"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
    assert dealt and not [x for x in dealt if "hashpartitioning(doc_id#" not in x or "REPARTITION_BY_" not in x]
    assert all(x.endswith("documents.parquet") or "/documents.parquet/" in x for x in df.inputFiles())

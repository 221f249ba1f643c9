"""Queries that must take whole tables, lines and chunks, against plain Python."""

from quirefold.plans import catalog
from quirefold.plans import samples as P


def wrapped(text, width=40):
    if len(text) <= width:
        return [text]
    out, cur = [], ""
    for w in text.split(" "):
        if cur and len(cur) + 1 + len(w) > width:
            out.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}" if cur else w
    return [*out, cur] if cur else out


def table(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_line_is_wrapped(spark, tmp_path):
    d = table(spark, tmp_path, ["\n".join(f"line {i} of this text goes on and on until it has to be wrapped somewhere" + " x" * i for i in range(1, 9)), "a\nb\nc\nd " + "e" * 50 + " f"])
    got = {(r.doc_id, r.line_no, r.part): r.line for r in catalog.QUERIES["hard_wrap"](spark, d).collect()}
    want = {(r.doc_id, r.line_no, k): x for r in P.lines(spark, d).collect() for k, x in enumerate(wrapped(r.text))}
    assert got == want and max(n for _, n, _ in got) == 8


def test_reports_show_citations_of_later_lines(spark, tmp_path):
    d = table(spark, tmp_path, ["\n".join(f"Line {i} tells of the {i}th thing at some length" for i in range(1, 161))])
    cited = {}
    for n in catalog._reports(spark, d)[2].where("citations is not null").collect():
        cited[n.node_id] = [(c.line_start, c.line_end) for c in n.citations]
    audit = catalog.QUERIES["audit_markdown"](spark, d).first().markdown
    for node, spans in cited.items():
        part = audit.split(f"### `{node}`")[1].split("### `")[0]
        assert f"_Citations: {len(spans)}_" in part and ("_Showing first 12 citations" in part) == (len(spans) > 12)
        assert all(f"[c0001:{a}-{b}]" in part for a, b in spans[:12])
    assert max(map(len, cited.values())) > 12 and any(a > 100 for spans in cited.values() for a, _ in spans)
    reading = catalog.QUERIES["reading_markdown"](spark, d).first().markdown
    assert all(f"c0001:{a}-{b}" in reading for spans in cited.values() for a, b in spans)


def test_every_cue_line_is_a_fact(spark, tmp_path):
    texts = [[f"The question {i} of document {d} is what becomes of a statement of more than sixty characters" for i in range(n)] for d, n in enumerate((1, 4, 20, 47))]
    facts = catalog.QUERIES["extracted_facts"](spark, table(spark, tmp_path, ["\n".join(t) for t in texts])).collect()
    assert sorted((r.doc_id, r.ord, r.statement) for r in facts) == [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t, 1)]

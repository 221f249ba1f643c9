"""Extraction in steps, strict schemas, round trips, tolerant names, sinks and backends, and limits that are reached."""

import json
import sys
import types
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from test_operators import fact

from quirefold.functions import text as T
from quirefold.operators import extract, facts, model, render, trace, workflow
from quirefold.plans import pipeline, selftest
from quirefold.sources import files

GOOD = {"fact_id": "f0001", "fact_type": "Warning", "statement": "x", "citations": [{"chunk_id": "c0001", "line_start": 2, "line_end": 9}]}


def output(*changed, **top):
    return json.dumps({"extracted_facts": [GOOD | c for c in changed or ({},)], **top})


@pytest.mark.parametrize(
    "text,verdict",
    [
        (output(), "ok"), (output(more=1), "unknown key more"), (output({"odd": 1}), "unknown key"), (output({"fact_id": "f1"}), "fact_id"), (output({"fact_type": "odd"}), "fact_type"),
        (output({"strength": "strong"}), "strength"), (output({"statement": ""}), "statement"), (output({"citations": [{"page": 1}]}), "unknown citation key page"), (output({"citations": "x"}), "citations"),
        (output({"citations": []}), "more"), (output({"citations": [{"line_start": 50, "line_end": 60}]}), "more"), (output({"citations": [{"line_start": "x"}]}), "more"), ('{"extracted_facts"', "more"), ("[]", "no object"), ('{"extracted_facts": []}', "ok"),
    ],
)
def test_judge(text, verdict):
    assert extract.judge(text, 1, 5) == verdict


def test_output_grows_in_steps():
    whole, asked = output(), []

    def extractor(prompt):
        asked.append(prompt)
        done = len(prompt) - len("P") - 1
        return whole[1 + done : 1 + done + 20]

    assert extract.grow_output(extractor, "P", 1, 5) == whole
    assert asked[0] == "P{" and asked[1] == "P" + whole[:21]
    n = []
    with pytest.raises(ValueError, match="bound"):
        extract.grow_output(lambda p: n.append(1) or " ", "P", 1, 5)
    assert len(n) == 8  # 256 tokens a time while fewer than 1800 were asked for
    with pytest.raises(ValueError, match="fact_id"):
        extract.grow_output(lambda p: output({"fact_id": "x"})[1:], "P", 1, 5)


def test_attempts():
    said = iter([ValueError("a"), ValueError("b"), "fine"])

    def ask():
        x = next(said)
        if isinstance(x, ValueError):
            raise x
        return x

    assert extract.attempted(ask, pause=0) == "fine"
    said = iter([ValueError(str(i)) for i in range(9)])
    with pytest.raises(ValueError, match="2"):
        extract.attempted(ask, pause=0)


def test_violations_of_outputs(spark):
    rows = [(1, "c0001", 1, 5, output()), (2, "c0001", 1, 5, output({}, {"odd": 1}, more=2)), (3, "c0001", 1, 5, output({"citations": [{"line_start": 50, "line_end": 60}]}, {"fact_type": "odd"}))]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id string, line_start long, line_end long, output string")
    got = {(r.doc_id, r.nth, r.rule, r.detail) for r in extract.output_violations(df).collect()}
    assert got == {(2, None, "unknown_key", "more"), (2, 1, "unknown_key", "odd"), (3, 0, "citations", ""), (3, 1, "fact_type", "odd")}
    raw = extract.facts_of(df.where("doc_id = 1").withColumn("output", F.lit(output({"raw": {"k": [1, 2]}})))).first()
    assert raw.raw == '{"k":[1,2]}' and raw.citations[0].line_end == 5


def test_broken_outputs_fail_the_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one line\nand another")], "doc_id long, text string")
    for k, text in enumerate((output({"odd": 1}), output({"citations": [{"line_start": 50, "line_end": 60}]}), output({"fact_id": "f1"}))):
        with pytest.raises(trace.ContractError):
            pipeline.run_all(spark, docs, f"{tmp_path}/{k}", lambda t=text: lambda prompt: t, pause=0.0)


def test_round_trip_and_self_test(spark):
    good = spark.createDataFrame([fact(1, "other", "A statement", raw='{"k": 1}')], facts.FACT_SCHEMA)
    assert extract.round_trip_violations(good).count() == 0
    bad = spark.createDataFrame([fact(1, "odd", "", fact_id="f1", citations=[])], facts.FACT_SCHEMA)
    assert {r.rule for r in extract.round_trip_violations(bad).collect()} == {"fact_id", "fact_type", "statement", "citations"}
    chunks = spark.createDataFrame([(1, "c0001", 1, 3, "t")], "doc_id long, chunk_id string, line_start long, line_end long, text string")
    selftest.contract_self_test(chunks)
    head, inputs, nodes = selftest.sample_workflow(selftest.sample_facts(chunks))
    with pytest.raises(trace.ContractError):
        selftest.check_workflow(head, inputs, nodes.where("node_id <> 'e0001'"), chunks)
    text = workflow.workflow_json(head, inputs, nodes).first().json
    assert set(json.loads(text)) == {"workflow_id", "guideline_id", "inputs", "nodes", "start_node_id", "requires_human_review", "warnings"}
    obj = json.loads(text)
    obj["nodes"][0]["odd"], obj["inputs"][0]["unit"], obj["extra"] = 1, "x", 2
    rows = spark.createDataFrame([(1, json.dumps(obj)), (2, "no json"), (3, '{"nodes": []}'), (4, text)], "doc_id long, json string")
    got = {(r.doc_id, r.entity, r.rule, r.detail) for r in workflow.key_violations(rows).collect()}
    assert got == {(1, "workflow", "unknown_key", "extra"), (1, "in001", "unknown_key", "unit"), (1, obj["nodes"][0]["node_id"], "unknown_key", "odd"), (2, "workflow", "unreadable", ""), (3, "workflow", "no_nodes", "")}


def test_tolerant_names(spark):
    df = spark.createDataFrame([(1, "d1", "decision", None, "c", "t"), (1, None, "", "do it", None, None)], "doc_id long, id string, kind string, text string, condition string, true_next string")
    a, b = workflow.tolerant_nodes(df).orderBy("node_id").collect()
    assert (a.node_id, a.node_type, a.condition, a.false_next, a.action) == ("d1", "decision", "c", None, None)
    assert (b.node_id, b.node_type, b.action, b.label, b.citations) == ("unknown", "unknown", "do it", "do it", None)


def test_maps_warnings_and_citation_marks(spark):
    row = spark.range(1).select(
        T.merge_meta(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"),
        T.join_warnings(F.array(F.lit("x")), F.lit(None).cast("array<string>"), F.array(F.lit("y"))).alias("w"),
        T.format_citation(F.lit("c0001"), F.lit(1), F.lit(None).cast("int")).alias("c"), T.markdown_escape(F.lit(" a\nb ")).alias("e"),
    ).first()
    assert row.m == {"a": "1", "b": "3"} and row.w == ["x", "y"] and row.c == "`c0001:1-?`" and row.e == "a b"


def test_json_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "x\ny", [1, 2])], "n long, t string, a array<long>").coalesce(1)
    files.write_json_file(df, f"{tmp_path}/deep/er.json")
    text = (tmp_path / "deep/er.json").read_text(encoding="utf-8")
    assert text == json.dumps([{"n": 1, "t": "é", "a": None}, {"n": 2, "t": "x\ny", "a": [1, 2]}], indent=2, ensure_ascii=False) + "\n"
    files.write_json_file(df.limit(0), f"{tmp_path}/none.json")
    assert (tmp_path / "none.json").read_text() == "[]\n"


def test_pdf_backends_in_turn(monkeypatch):
    page = lambda t: types.SimpleNamespace(extract_text=lambda: t)
    plumber, reader = types.ModuleType("pdfplumber"), types.ModuleType("pypdf")
    plumber.open = lambda f: types.SimpleNamespace(pages=[page(None), page(" ")])
    reader.PdfReader = lambda f: types.SimpleNamespace(pages=[page("one\ntwo"), page(""), page("three")])
    monkeypatch.setitem(sys.modules, "pdfplumber", plumber)
    monkeypatch.setitem(sys.modules, "pypdf", reader)
    assert files._pdf_text(b"") == "one\ntwo\nthree"
    plumber.open = lambda f: types.SimpleNamespace(pages=[page("first")])
    assert files._pdf_text(b"") == "first"
    monkeypatch.setitem(sys.modules, "pdfplumber", None)
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError):
        files._pdf_text(b"")


def test_model_adapter(tmp_path):
    seeds, given = [], {}

    class Ids(list):
        shape = (1, 2)

        def to(self, device):
            return self

        def __getitem__(self, i):
            return Ids(list.__getitem__(self, i)) if isinstance(i, slice) else list.__getitem__(self, i)

    class Tokenizer:
        pad_token_id, eos_token_id, eos_token, pad_token = None, 7, "</s>", None

        def __call__(self, prompt, return_tensors):
            return {"input_ids": Ids([1, 2])}

        def decode(self, ids, skip_special_tokens):
            return f"  {list(ids)} "

    class Model:
        device = "cpu"

        def eval(self):
            return self

        def generate(self, **how):
            given.update(how)
            return [Ids([1, 2, 8, 9])]

    class Quiet:
        __enter__ = __exit__ = lambda *a: None

    torch = types.SimpleNamespace(cuda=types.SimpleNamespace(is_available=lambda: False), manual_seed=seeds.append, float16=16, float32=32, no_grad=Quiet)
    hub = types.SimpleNamespace(AutoTokenizer=types.SimpleNamespace(from_pretrained=lambda *a, **k: Tokenizer()), AutoModelForCausalLM=types.SimpleNamespace(from_pretrained=lambda *a, **k: Model()))
    m = model.CausalModel("any", seed=3, libraries=(torch, hub))
    assert m("prompt") == "[8, 9]" and seeds == [3, 3] and m.tokenizer.pad_token == "</s>"
    assert given["max_new_tokens"] == 256 and "temperature" not in given
    m("prompt", model.Generation(do_sample=True, temperature=0.5))
    assert given["temperature"] == 0.5
    with pytest.raises(ValueError):
        m(" ")
    assert model.model_id(f"{tmp_path}/none") == model.DEFAULT_MODEL
    (tmp_path / "id.txt").write_text(" some/model\n")
    assert model.model_id(f"{tmp_path}/id.txt") == "some/model"


def test_limits_that_are_reached(spark):
    texts = [f"statement number {i // 2} of a long row of them, all of one kind and {'even' if i % 2 else 'odd'}" for i in range(24)]
    df = spark.createDataFrame([fact(i, "other", t) for i, t in enumerate(texts)] + [fact(90, "action", "Start the treatment now")], facts.FACT_SCHEMA)
    ruled = facts.normalize_facts(df).where("not junk").drop("junk")
    for cap in (1, 5, 40, 277, 8000):
        low = sorted((r.statement.lower(), r.ord) for r in ruled.where("fact_type = 'other'").collect())
        left, free, leads, short = cap, list(low), {}, 0
        while free:
            head = free.pop(0)
            leads[head[1]] = head[1]
            tried = free[:left]
            left, short = left - len(tried), short + (len(tried) < len(free))
            taken = [x for x in tried if SequenceMatcher(None, head[0], x[0]).ratio() >= 0.94]
            leads.update({x[1]: head[1] for x in taken})
            free = [x for x in free if x not in taken]
        got = facts.fuzzy_leaders(ruled, facts.NormalizeConfig(max_fuzzy_comparisons=cap)).where("fact_type = 'other'").collect()
        assert {r.ord: r.leader for r in got} == leads and {r.capped for r in got} == {short}
    warnings = facts.canonical_facts(df, None, facts.NormalizeConfig(max_fuzzy_comparisons=5))[1].first().warnings
    assert "Step6: fuzzy scan capped for other; remaining kept as-is." in warnings


def test_spans_of_any_length(spark):
    text = spark.createDataFrame([(1, n, f"line {n}") for n in range(1, 11)], "doc_id long, line_no long, text string")
    cites = spark.createDataFrame([(1, "f1", 1, "c1", 8, 10**12), (1, "f2", 1, "c1", 5, 4), (1, "f3", 1, "c1", -9, 2)], "doc_id long, fact_id string, ord int, chunk_id string, line_start long, line_end long")
    assert sorted((r.fact_id, r.line_no) for r in trace.cited_lines(cites, text).collect()) == [("f1", 8), ("f1", 9), ("f1", 10), ("f3", 1), ("f3", 2)]
    long = cites.where("fact_id = 'f1'").withColumn("line_end", F.lit(10_000).cast("long"))
    assert trace.missing_lines(long, text).count() == 9990


def test_reading_report_whole(spark):
    df = spark.createDataFrame([fact(1, "population", "Adults of any age", citations=[("c0001", 1, 2, None)]), fact(2, "exclusion", "Known pregnancy", citations=[("c0001", 3, 3, None)])], facts.FACT_SCHEMA)
    text = spark.createDataFrame([(1, n, t) for n, t in enumerate(["Adults", "of any age", "Pregnancy known"], 1)], "doc_id long, line_no long, text string")
    got = render.reading_markdown(workflow.workflow_headers(df), workflow.workflow_inputs(df), workflow.workflow_nodes(df), text).first().markdown.split("\n")
    first = got.index("## 1. Eligibility")
    assert got[first + 1 : first + 7] == ["**Guideline text:** Adults of any age", "", "- ✅ If **YES** → Continue to next step.", "- ❌ If **NO**  → Not applicable (outside population)", "", "**Evidence:** `c0001:1-2`"]
    third = got.index("## 3. Red Flags / Escalation")
    assert got[third + 1] == "**Guideline text:** True if any guideline red flag is present." and got[third + 6] == "**Evidence:** *(none found in this run)*"
    assert [x for x in got if x.startswith("## ")] == ["## How to read this", "## 1. Eligibility", "## 2. Exclusions / Contraindications", "## 3. Red Flags / Escalation", "## Inputs (engine IDs)", "## Decision chain (engine)", "## Actions (engine)", "## End states (engine)"]

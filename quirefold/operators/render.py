"""Reports in Markdown: one text a document, put together from arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import trace, workflow

SNIPPETS = 12


def _lines(*parts) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _tick(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _truth(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def node_citations(nodes: DataFrame) -> DataFrame:
    """(doc_id, fact_id, ord, chunk_id, line_start, line_end): a node's citations, the node as the citing fact."""
    return nodes.select("doc_id", F.col("node_id").alias("fact_id"), F.posexplode("citations").alias("nth", "c")).select("doc_id", "fact_id", (F.col("nth") + 1).alias("ord"), "c.chunk_id", "c.line_start", "c.line_end")


def audit_markdown(headers: DataFrame, inputs: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, markdown): the workflow with every node and the lines that it cites."""
    nodes = workflow.tolerant_nodes(nodes)
    cites = node_citations(nodes)
    shown = trace.audit_snippets(cites.where(F.col("ord") <= SNIPPETS), lines)
    block = _lines(F.concat(F.lit("**["), F.col("ord").cast("string"), F.lit("]** "), T.format_citation(F.col("chunk_id"), F.col("line_start"), F.col("line_end"))), "", "```text", F.col("snippet"), "```", "")
    blocks = cites.join(shown, ["doc_id", "fact_id", "ord"]).groupBy("doc_id", F.col("fact_id").alias("node_id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"])).alias("blocks"))
    n = F.coalesce(F.size("citations"), F.lit(0))
    more = F.when(n > SNIPPETS, _lines(f"_Showing first {SNIPPETS} citations (deterministic cap). Full citations remain in JSON._", "")).otherwise(F.array().cast("array<string>"))
    cited = F.when(n > 0, F.array_join(F.concat(_lines(F.concat(F.lit("_Citations: "), n.cast("string"), F.lit("_")), ""), F.coalesce("blocks", F.array().cast("array<string>")), more), "\n")).otherwise("_No citations._")
    text = lambda c: T.markdown_escape(F.coalesce(F.col(c), F.lit("")))
    body = (
        F.when(F.col("node_type") == "decision", _lines(F.concat(F.lit("- condition: "), _tick(text("condition"))), F.concat(F.lit("- true_next: "), _tick(F.col("true_next"))), F.concat(F.lit("- false_next: "), _tick(F.col("false_next"))), "", cited))
        .when(F.col("node_type") == "action", _lines(F.concat(F.lit("- action: "), text("action")), F.concat(F.lit("- requires_human_review: "), _tick(_truth(F.col("requires_human_review")))), "", cited))
        .when(F.col("node_type") == "end", _lines(F.concat(F.lit("- label: "), text("label")), "", "_No citations._"))
        .otherwise(_lines("_Unknown node type._"))
    )
    head = _lines(F.concat(F.lit("### "), _tick(F.col("node_id")), F.lit(" ("), F.col("node_type"), F.lit(")")), "")
    rows = nodes.join(blocks, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.concat(head, body, _lines("")).alias("part"))
    node_part = rows.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "part"))), lambda x: x["part"])).alias("node_lines"))
    one = F.concat(F.lit("- **"), F.col("input_id"), F.lit("** "), _tick(F.col("name")), F.lit(" ("), F.col("type"), F.lit("): "), T.markdown_escape(F.coalesce("description", F.lit(""))))
    input_part = inputs.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("input_id", one.alias("x")))), lambda r: r["x"]).alias("input_lines"))
    doc = headers.join(input_part, "doc_id", "left").join(node_part, "doc_id", "left")
    none = F.array().cast("array<string>")
    warned = F.when(F.size("warnings") > 0, F.concat(_lines("## Warnings", ""), F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), _lines(""))).otherwise(none)
    top = _lines(F.concat(F.lit("# Workflow Audit Preview — "), _tick(F.col("workflow_id"))), "", F.concat(F.lit("- guideline_id: "), _tick(F.col("guideline_id"))), F.concat(F.lit("- start_node_id: "), _tick(F.col("start_node_id"))), F.concat(F.lit("- requires_human_review: "), _tick(_truth(F.col("requires_human_review")))), "")
    whole = F.concat(top, warned, _lines("## Inputs", ""), F.coalesce("input_lines", none), _lines("", "## Nodes", ""), F.coalesce("node_lines", none))
    return doc.select("doc_id", F.array_join(whole, "\n").alias("markdown"))


def reading_markdown(headers: DataFrame, inputs: DataFrame, nodes: DataFrame, lines: DataFrame, title: str = "Protocol") -> DataFrame:
    """(doc_id, markdown): the questions of the decision chain in order with what follows from each answer, then the engine's view."""
    none = F.array().cast("array<string>")
    nodes = workflow.tolerant_nodes(nodes)
    chain = workflow.decision_chain(headers, nodes)
    steps = workflow.next_steps(nodes)
    says = steps.groupBy("doc_id", "node_id").agg(F.max_by("says", F.when(F.col("branch"), 1)).alias("if_true"), F.max_by("says", F.when(~F.col("branch"), 1)).alias("if_false"))
    first = trace.reading_snippets(node_citations(nodes).where("ord = 1"), lines).select("doc_id", F.col("fact_id").alias("node_id"), "snippet")
    parsed = T.parse_condition(F.col("condition"))
    rows = (
        chain.join(nodes, ["doc_id", "node_id"]).withColumn("p", parsed).withColumn("input_id", F.col("p.input_id"))
        .join(inputs.select("doc_id", "input_id", "name", "description"), ["doc_id", "input_id"], "left")
        .join(says, ["doc_id", "node_id"], "left").join(first, ["doc_id", "node_id"], "left")
    )
    name = F.coalesce("name", "input_id")
    about = T.strip(F.coalesce("description", F.lit("")))
    known = F.col("p").isNotNull()
    title_ = F.when(known, T.gate_title(name, F.col("step"))).otherwise(F.concat(F.lit("Step "), F.col("step").cast("string")))
    question = F.when(known, F.when(F.size("citations") > 0, F.col("snippet")).when(about != "", about).otherwise(F.concat(F.lit("Is "), _tick(name), F.lit(" true?")))).otherwise("Does this condition apply?")
    direct = ~known | F.col("p.expected")
    yes, no = F.when(direct, F.col("if_true")).otherwise(F.col("if_false")), F.when(direct, F.col("if_false")).otherwise(F.col("if_true"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: T.format_citation(x["chunk_id"], x["line_start"], x["line_end"])), ", ")
    evidence = F.when(F.size("citations") > 0, shown("citations")).otherwise("*(none found in this run)*")
    gate = _lines(
        F.concat(F.lit("## "), F.col("step").cast("string"), F.lit(". "), title_), F.concat(F.lit("**Guideline text:** "), question), "",
        F.concat(F.lit("- ✅ If **YES** → "), F.coalesce(yes, F.lit("Continue."))), F.concat(F.lit("- ❌ If **NO**  → "), F.coalesce(no, F.lit("Continue."))), "",
        F.concat(F.lit("**Evidence:** "), evidence), "",
    )
    engine = F.concat(F.lit("- "), _tick(F.col("node_id")), F.lit(": condition="), _tick(F.coalesce("condition", F.lit(""))), F.lit(" true_next="), _tick(F.coalesce("true_next", F.lit(""))), F.lit(" false_next="), _tick(F.coalesce("false_next", F.lit(""))))
    gates = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("step", gate.alias("g"), engine.alias("e")))).alias("gates"))
    act = F.concat(F.array(F.concat(F.lit("- "), _tick(F.col("node_id")), F.lit(": "), F.coalesce("action", F.lit("Action.")))), F.when(F.size("citations") > 0, F.array(F.concat(F.lit("  - Evidence: "), shown("citations")))).otherwise(none))
    end = F.array(F.concat(F.lit("- "), _tick(F.col("node_id")), F.lit(": "), F.coalesce("label", F.lit("End."))))
    order = Window.partitionBy("doc_id").orderBy("node_id")
    placed = nodes.withColumn("place", F.row_number().over(order))
    lists = placed.groupBy("doc_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("node_type") == "action", F.struct("place", act.alias("x"))))), lambda r: r["x"])).alias("actions"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("node_type") == "end", F.struct("place", end.alias("x"))))), lambda r: r["x"])).alias("ends"),
    )
    one = F.rtrim(F.concat(F.lit("- "), _tick(F.col("input_id")), F.lit(" "), _tick(F.col("name")), F.lit(" ("), F.col("type"), F.lit("): "), F.coalesce("description", F.lit(""))))
    input_part = inputs.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("input_id", one.alias("x")))), lambda r: r["x"]).alias("input_lines"))
    doc = headers.join(gates, "doc_id", "left").join(lists, "doc_id", "left").join(input_part, "doc_id", "left")
    top = _lines(
        F.concat(F.lit(f"# {title} — Human Summary ("), _tick(F.col("workflow_id")), F.lit(")")), "", F.concat(F.lit("**Guideline:** "), _tick(F.col("guideline_id"))), F.concat(F.lit("**Human review required:** "), _tick(_truth(F.col("requires_human_review")))), "",
        "## How to read this",
        "Answer each question in order. The question text is pulled directly from the guideline whenever possible. Citations show exactly where it came from.", "",
    )
    has = F.coalesce(F.size("gates"), F.lit(0)) > 0
    body = F.when(has, F.flatten(F.transform("gates", lambda g: g["g"]))).otherwise(_lines("*(No decision chain detected in workflow.)*"))
    section = lambda head, c: F.when(F.size(c) > 0, F.concat(_lines(head), c, _lines(""))).otherwise(none)
    tail = F.concat(
        _lines("---", "# Appendix — Engine View (for audit/debug)", "", F.concat(F.lit("- start_node_id: "), _tick(F.col("start_node_id"))), "", "## Inputs (engine IDs)"),
        F.coalesce("input_lines", _lines("- (No inputs found)")), _lines("", "## Decision chain (engine)"), F.when(has, F.transform("gates", lambda g: g["e"])).otherwise(_lines("- (None)")), _lines(""),
        section("## Actions (engine)", F.coalesce("actions", none)), section("## End states (engine)", F.coalesce("ends", none)),
    )
    return doc.select("doc_id", F.array_join(F.concat(top, body, tail), "\n").alias("markdown"))


def smoke_snippets(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, snippet) of each document's first citation."""
    return trace.audit_snippets(trace.first_citation(chunks), lines).select("doc_id", "snippet")

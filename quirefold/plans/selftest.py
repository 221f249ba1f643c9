"""A small extraction and a small workflow through every contract, before a run spends anything on a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators import extract, trace, workflow
from quirefold.operators.facts import CITATION


def sample_facts(chunks: DataFrame) -> DataFrame:
    """One fact of one document, that cites the first line of its first chunk."""
    first = chunks.orderBy("doc_id", "line_start").limit(1)
    cite = F.array(F.struct("chunk_id", "line_start", F.col("line_start").alias("line_end"), F.lit(None).cast("string").alias("quote"))).cast(f"array<{CITATION}>")
    known = {"doc_id": F.col("doc_id"), "ord": F.lit(1), "fact_id": F.lit("f0001"), "fact_type": F.lit("other"), "statement": F.lit("A sample statement for the self-test."), "strength": F.lit("unclear"), "requires_human_review": F.lit(True), "citations": cite}
    return first.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in ("doc_id", "ord", *extract.FACT_KEYS)])


def sample_workflow(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header, inputs and nodes: one decision, one action, one end."""
    base = facts.select("doc_id", "citations")
    text = lambda x: F.lit(x).cast("string")
    keys = ("node_id", "node_type", "condition", "true_next", "false_next", "action", "label")
    rows = (("d0001", "decision", "in001 == true", "a0001", "e0001", None, None), ("a0001", "action", None, None, None, "A sample action.", None), ("e0001", "end", None, None, None, None, "Stop"))
    node = [F.struct(*[text(v).alias(k) for k, v in zip(keys, r)], F.lit(True if r[1] == "action" else None).cast("boolean").alias("requires_human_review"), (F.lit(None).cast(f"array<{CITATION}>") if r[1] == "end" else F.col("citations")).alias("citations")) for r in rows]
    head = base.select("doc_id", F.lit("wf0001").alias("workflow_id"), F.lit("sample").alias("guideline_id"), F.lit("d0001").alias("start_node_id"), F.lit(True).alias("requires_human_review"), F.array(F.lit("A sample.")).alias("warnings"))
    inputs = base.select("doc_id", F.lit("in001").alias("input_id"), F.lit("sample_flag").alias("name"), F.lit("bool").alias("type"), F.lit("A sample input.").alias("description"))
    return head, inputs, base.select("doc_id", F.inline(F.array(*node)))


def cited(rows: DataFrame, key: str) -> DataFrame:
    """(doc_id, fact_id, ord, chunk_id, line_start, line_end) of the citations of facts or nodes."""
    return rows.select("doc_id", F.col(key).alias("fact_id"), F.posexplode("citations").alias("ord", "c")).select("doc_id", "fact_id", "ord", "c.chunk_id", "c.line_start", "c.line_end")


def contract_self_test(chunks: DataFrame) -> None:
    """Raises the first contract that the samples break, so that a broken contract is not laid at a model's door."""
    facts = sample_facts(chunks)
    head, inputs, nodes = sample_workflow(facts)
    check_facts(facts, chunks)
    check_workflow(head, inputs, nodes, chunks)


def check_facts(facts: DataFrame, chunks: DataFrame, repeats: bool = True) -> None:
    trace.fail_closed(extract.round_trip_violations(facts), "fact", "rule")
    trace.fail_closed(trace.citation_violations(cited(facts, "fact_id"), chunks, reject_duplicates=repeats), "doc_id", "fact_id", "ord")


def check_workflow(head: DataFrame, inputs: DataFrame, nodes: DataFrame, chunks: DataFrame) -> None:
    trace.fail_closed(workflow.shape_violations(nodes, inputs), "doc_id", "entity", "rule")
    trace.fail_closed(workflow.graph_violations(head, nodes), "doc_id", "ordinal", "entity")
    trace.fail_closed(workflow.key_violations(workflow.workflow_json(head, inputs, nodes)), "doc_id", "entity", "rule")
    trace.fail_closed(trace.citation_violations(cited(nodes, "node_id"), chunks), "doc_id", "fact_id", "ord")

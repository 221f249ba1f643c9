"""The whole run, step by step: documents to lines, chunks, facts, workflows and reports, each step's table written once.

A step whose table is there already is not run again if the run is to be resumed. Every step reads what the one before wrote,
so lineage ends at each table and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import extract, facts, lines, render, trace, workflow
from quirefold.plans import selftest
from quirefold.sources import files


@dataclass
class Run:
    """Where the tables are, which steps ran and which were there."""

    spark: SparkSession
    out: str
    resume: bool = True
    ran: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    def exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self.resume and self.exists(name):
            self.skipped.append(name)
        else:
            make().write.mode("overwrite").parquet(f"{self.out}/{name}")
            self.ran.append(name)
        if not self.exists(name):
            raise trace.ContractError(f"step {name} left no table")
        return self.spark.read.parquet(f"{self.out}/{name}")


def extraction_rows(outputs: DataFrame, clean: DataFrame, counts: DataFrame, model: str, max_lines: int, max_chars: int) -> DataFrame:
    """(doc_id, guideline_id, model_id, chunking, num_facts, warnings, meta): one row about each document's extraction."""
    chunking = F.create_map(F.lit("hard_limit_lines"), F.lit(str(max_lines)), F.lit("soft_limit_chars"), F.lit(str(max_chars)), F.lit("num_chunks"), F.col("chunks").cast("string"))
    base = outputs.groupBy("doc_id").agg(F.count("*").alias("chunks")).join(clean.groupBy("doc_id").agg(F.count("*").alias("num_facts")), "doc_id", "left").join(counts, "doc_id", "left")
    step = F.create_map(F.lit("step6"), F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("dropped", "exact_merges", "fuzzy_merges")])))
    before = F.create_map(F.lit("extractor"), F.lit(model))
    return base.select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("guideline_id"), F.lit(model).alias("model_id"), chunking.alias("chunking"),
        F.coalesce("num_facts", F.lit(0)).alias("num_facts"), T.join_warnings(F.array().cast("array<string>"), F.col("warnings")).alias("warnings"), T.merge_meta(before, step).alias("meta"),
    )


def run_all(spark: SparkSession, docs: DataFrame, out: str, load_extractor, resume: bool = True, title: str = "Protocol", config: facts.NormalizeConfig = facts.NormalizeConfig(), model: str = "rules", max_lines: int = 20, max_chars: int = 1200, stepwise: bool = False, pause: float = extract.PAUSE) -> Run:
    """Runs every step over (doc_id, text) and writes the hash manifest and the run's metadata. Broken contracts fail the run.

    ``load_extractor`` makes the extractor in a worker, ``model`` names it; for a language model, ``operators.model.loader`` and
    ``stepwise``.
    """
    run = Run(spark, out.rstrip("/"), resume)
    blank = lines.empty_documents(docs).limit(1).collect()
    if blank:
        raise trace.ContractError(f"document {blank[0][0]} has no lines")
    text = run.step("lines", lambda: lines.number_lines(docs))
    chunks = run.step("chunks", lambda: lines.pack_chunks(lines.text_lines(docs), max_lines=max_lines, max_chars=max_chars))
    trace.fail_closed(trace.structure_violations(text, chunks), "doc_id", "entity")
    selftest.contract_self_test(chunks)
    run.step("citation_index", lambda: trace.citation_index(text, chunks))
    run.step("smoke_snippets", lambda: render.smoke_snippets(chunks, text))
    if not extract.smoke_test(load_extractor):
        raise trace.ContractError("the extractor gives no JSON")
    outputs = run.step("outputs", lambda: extract.run_extractor(chunks, load_extractor, stepwise, pause))
    trace.fail_closed(extract.failed_outputs(outputs), "doc_id", "chunk_id")
    trace.fail_closed(extract.output_violations(outputs), "doc_id", "chunk_id", "nth")
    raw = run.step("facts", lambda: extract.facts_of(outputs))
    selftest.check_facts(raw, chunks)
    clean, counts = facts.canonical_facts(raw, text, config, keep=run.step)
    clean = run.step("clean_facts", lambda: clean)
    counts = run.step("clean_counts", lambda: counts)
    selftest.check_facts(clean, chunks, repeats=False)
    run.step("extractions", lambda: extraction_rows(outputs, clean, counts, model, max_lines, max_chars))
    heads = run.step("workflows", lambda: workflow.workflow_headers(clean))
    inputs = run.step("workflow_inputs", lambda: workflow.workflow_inputs(clean))
    nodes = run.step("workflow_nodes", lambda: workflow.workflow_nodes(clean))
    run.step("workflow_meta", lambda: workflow.workflow_meta(clean))
    selftest.check_workflow(heads, inputs, nodes, chunks)
    # The reports pass over lines that are not there, so none may be missing.
    trace.fail_closed(trace.missing_lines(selftest.cited(nodes, "node_id"), text), "doc_id", "fact_id", "line_no")
    run.step("audit", lambda: render.audit_markdown(heads, inputs, nodes, text))
    run.step("summary", lambda: render.reading_markdown(heads, inputs, nodes, text, title))
    hashes = files.sha256_files(spark, f"{run.out}/*/part-*")
    files.manifest(hashes).write.mode("overwrite").json(f"{run.out}/manifest")
    files.run_metadata(spark, run.ran, run.skipped, model).write.mode("overwrite").json(f"{run.out}/run_metadata")
    return run

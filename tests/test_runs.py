"""The whole run with a rule extractor, its resumption and failures; documents as a stream; files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quirefold.operators import trace
from quirefold.plans.catalog import rule_extractor
from quirefold.plans.pipeline import run_all
from quirefold.sources import files
from quirefold.streaming import documents

TEXT = "\n".join(f"The question of item {i} is what the nation does with it, number {i * 7}." for i in range(30))


def test_run_resume_and_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT.replace("item", "thing") + "\nplain")], "doc_id long, text string")
    first = run_all(spark, docs, str(tmp_path / "out"), rule_extractor)
    assert "summary" in first.ran and not first.skipped
    again = run_all(spark, docs, str(tmp_path / "out"), rule_extractor)
    assert again.skipped == first.ran and not again.ran
    table = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    chunks, clean = table("chunks"), table("clean_facts")
    cites = clean.select("doc_id", "fact_id", F.posexplode("citations").alias("ord", "c")).select("doc_id", "fact_id", "ord", "c.*")
    assert trace.citation_violations(cites, chunks).count() == 0 and cites.count() > 0
    assert table("workflow_nodes").count() == 14
    for name, head in (("audit", "# Workflow Audit Preview — `doc1__v1`"), ("summary", "# Protocol — Human Summary (`doc1__v1`)")):
        assert table(name).where("doc_id = 1").first().markdown.startswith(head)
    manifest = json.loads(next((tmp_path / "out/manifest").glob("part-*")).read_text())["sha256"]
    path, digest = next((p, d) for p, d in manifest.items() if "/chunks/" in p)
    assert hashlib.sha256(open(path.removeprefix("file:"), "rb").read()).hexdigest() == digest


def test_broken_contracts_fail_the_run(spark, tmp_path):
    with pytest.raises(trace.ContractError):
        run_all(spark, spark.createDataFrame([(1, " \n")], "doc_id long, text string"), str(tmp_path / "a"), rule_extractor)
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    with pytest.raises(trace.ContractError):
        run_all(spark, docs, str(tmp_path / "b"), lambda: lambda prompt: "no json")


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(TEXT)
    docs = documents.read_stream(spark, str(tmp_path / "in"))
    for name, df in (("chunks", documents.stream_chunks(docs)), ("statements", documents.stream_statements(docs))):
        documents.write_stream(df, f"{tmp_path}/{name}", f"{tmp_path}/c-{name}").awaitTermination()
    assert [(r.line_start, r.line_end) for r in spark.read.parquet(f"{tmp_path}/chunks").orderBy("line_start").collect()][0][0] == 1
    assert spark.read.parquet(f"{tmp_path}/statements").count() == 30


def test_files(spark, tmp_path):
    (tmp_path / "n.txt").write_text("1. a\n2. b\n")
    assert [(r.line_no, r.text) for r in files.read_numbered(spark, f"{tmp_path}/n.txt").orderBy("pos").collect()] == [(1, "a"), (2, "b")]
    (tmp_path / "l.json").write_text('[{"line_no": 1, "text": "é"}]')
    assert files.read_json(spark, f"{tmp_path}/l.json", files.LINES).first().text == "é"
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        files.read_json(spark, f"{tmp_path}/bad.json", files.LINES).collect()
    files.write_texts(spark.createDataFrame([("k", "line\nmore")], "id string, body string"), f"{tmp_path}/md", "id", "body")
    assert next((tmp_path / "md/key=k").glob("part-*")).read_text() == "line\nmore\n"
    got = files.sha256_files(spark, f"{tmp_path}/n.txt").first()
    assert got.sha256 == hashlib.sha256(b"1. a\n2. b\n").hexdigest()


def test_convert_html(spark, tmp_path):
    from quirefold.sources import convert

    (tmp_path / "a.html").write_text("<nav>x</nav><h1>Title</h1><p>one line that goes</p><p>on here.</p><p>12</p><li>two</li>")
    convert.main(["--html", f"{tmp_path}/a.html", "--out", f"{tmp_path}/out"])
    assert next((tmp_path / "out/key=a.html").glob("part-*")).read_text().rstrip("\n").split("\n") == ["1. Title one line that goes on here.", "2. two"]
    with pytest.raises(SystemExit):
        convert.main(["--out", f"{tmp_path}/out"])

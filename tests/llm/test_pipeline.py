"""The pipeline, stage by stage, against brute force on each stage's own input."""

import collections
import hashlib

import corpus_pipeline
import test_words_and_passages as brute
from pyspark.sql import functions as F

from quirefold.llm import decontam, langid


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "", "en", "s", 0), (10_002, None, None, None, None), (10_003, "## 12", "en", "s", 5)], docs.schema)
    now, names = docs.unionByName(extra), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard", "substring_dedup", "benchmark_decontamination", "bpe_codec"]
    key = lambda r: (r.doc_id, r.text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        now = corpus_pipeline.store(stage(spark, now, small), "test-stage")
        after = now.collect()
        assert now.columns == docs.columns
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {10_001, 10_002, 10_003}
        elif name == "ngram_jaccard":
            want = brute.brute_jaccard([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in want})
        elif name == "substring_dedup":
            want = {d: (kept if gone else None) for d, _, gone, kept in brute.brute_substring([(r.doc_id, r.text) for r in before], 35)}
            assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text if want[r.doc_id] is None else want[r.doc_id] for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            items = [" ".join(brute.WORD.findall(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            held = {r.doc_id for r in before if any(x in " ".join(brute.WORD.findall(r.text)) for x in items)}
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == held
        assert collections.Counter(map(key, after)).most_common(1)[0][1] == 1
    last = corpus_pipeline.STAGES[-1][1](spark, now, small)
    for r in last.join(now, "doc_id").limit(20).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert last.count() == now.count()


def test_run_and_empty_input(spark, small, tmp_path):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and out.columns[:4] == ["doc_id", "ids", "n_tokens", "ids_sha256"]
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_alike_and_with_other_columns(spark, small):
    row = (1, "One document that says the same thing twice over and over again", "en", "s", 63, "x", 1)
    df = spark.createDataFrame([row, row, (2, *row[1:])], "doc_id long, text string, lang string, source string, n_chars long, key string, component long")
    assert [r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, df, small).collect()] == [1]
    assert corpus_pipeline.substring_dedup(spark, df, small).columns == df.columns
    assert corpus_pipeline.language_id(spark, df, small).count() == 3
    assert corpus_pipeline.benchmark_decontamination(spark, df, small).select(F.count("*")).first()[0] == 3
    assert langid.identify_documents(df).count() == 3 and decontam.find_leaks(df, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0

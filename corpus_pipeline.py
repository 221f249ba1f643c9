"""The corpus pipeline: documents in, tokenised clean documents out.

Each stage is one operator of quirefold.llm whose decisions take effect; a stage's result is written as Parquet in the shared
folder and read again as the next one's documents. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bloom, bpe, decontam, jaccard, langid, substring
from quirefold.llm.common import drop, read, scope, small_batches, store


def _key():
    """A row's name: a hash of id and text, as the operators give it."""
    return F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), F.col("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language cannot be told, go.

    Null and empty texts have no letters and go; null ``lang`` and ``source`` say nothing; every other row stays as it is, equal rows
    each on their own. An empty table gives an empty one.
    """
    rejected = store(langid.identify_documents(docs).where("not accepted").select("key").distinct(), "pipeline-rejected")
    return bloom.drop_keys(docs, _key(), rejected, "key")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id.

    A null id counts as larger than any other; of equal rows one stays; of rows of one id and other texts in one group that of the
    smallest key (a hash of id and text). Texts without words have no near copies and stay, long ones are compared whole.
    """
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document that loses nothing keeps its text as it is.

    One that loses words keeps the others joined by one space, maybe none at all, and ``n_chars``, if there is such a column, is that of
    what is left. Null texts stay null. Equal rows repeat each other. Columns of any name pass through.
    """
    done = substring.removed(docs)
    lost = F.col("n_removed") > 0
    changed = {"text": F.when(lost, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the same or other numbers and names, go.

    Null and empty texts, on either side, match nothing; equal rows go or stay together; an empty benchmark lets all stay.
    """
    leaks = store(decontam.find_leaks(docs, read(spark, sf_dir, "benchmark")).select("key").distinct(), "pipeline-leaks")
    return bloom.drop_keys(docs, _key(), leaks, "key")


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row left; a null text has no tokens, equal rows are coded each."""
    small_batches(spark)
    path = bpe.default_path()
    return bpe.digest(bpe.round_trip(docs, path), keep=("ids",))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_codec", bpe_codec),
]
#: SQL cannot express the language model, the templates or the merges; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stored for itself, and its input, go when its result is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope() as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

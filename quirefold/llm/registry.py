"""All queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("knn", "bpe", "tokencount", "urlfilter", "chat", "htmlmain", "substring", "jaccard", "langid", "decontam")


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in MODULES for k, f in import_module(f"quirefold.llm.{m}").QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {k: s for m in MODULES for k, s in import_module(f"quirefold.llm.{m}").ORACLE_SQL.items()}
    return sql if corpus_pipeline.ORACLE_SQL is None else sql | {"pipeline": corpus_pipeline.ORACLE_SQL}

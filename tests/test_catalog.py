"""Every query of the catalogue against its SQL, on the smallest tables; those without SQL run and have a fixed shape."""

import pytest

from quirefold.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(name, same_rows):
    same_rows(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(name, spark, small):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry_names_and_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "chunk_id", "line_start", "line_end"]

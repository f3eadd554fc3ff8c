"""Every registered query of the library against its SQL."""

import pytest
from conftest import as_set

from tarnkit.plans import answer_queries, library_queries, operation_queries, review_queries, search_queries, storage_queries, text_queries

QUERIES, SQL = {}, {}
for module in (text_queries, search_queries, operation_queries, review_queries, library_queries, answer_queries, storage_queries):
    QUERIES |= module.R.queries
    SQL |= module.R.sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = as_set(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(SQL[name])
    assert got == as_set([c[0] for c in want.description], want.fetchall())


def test_entry_needs_no_corpus_operators(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "document_id", "chunk_index", "score", "rank"]

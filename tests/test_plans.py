"""Plans are what they should be at scale."""

import re

import pytest

from tarnkit.plans import answer_queries as A
from tarnkit.plans import library_queries as Y
from tarnkit.plans import operation_queries as O
from tarnkit.plans import review_queries as V
from tarnkit.plans import search_queries as Q
from tarnkit.plans import text_queries as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [O.users_with_bans, O.images_near_hits, O.frames_near_hits, O.chunk_time_ranges, O.hits_with_times, V.in_use])
def test_joins_have_keys(spark, sf_dir, query):
    assert not re.search("NestedLoop|Cartesian", plan(query(spark, sf_dir)))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(V.purged_log(spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text) and "props" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("query", [T.chunk_documents, T.clean_documents, T.bigram_counts, T.refusals])
def test_text_work_needs_neither_python_nor_shuffle(spark, sf_dir, query):
    assert not re.search("Python|Arrow|Exchange", plan(query(spark, sf_dir)))


def test_nth_recent_failure_keeps_few_rows_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(O.fiftieth_failure(spark, sf_dir))


def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


@pytest.mark.parametrize("query", [Q.vector_search_all, Q.vector_search_partition, Q.vector_search_stored])
def test_vectors_stay_where_they_lie(spark, sf_dir, query):
    text = plan(query(spark, sf_dir))
    below = text[text.index("MapInArrow") :]  # what searches reads the scan itself, and only each task's best rows are shuffled
    assert "Exchange" in text and "Scan parquet" in below and not re.search("NestedLoop|Cartesian", text)
    assert "Exchange" not in below.replace("BroadcastExchange", "")


def test_text_search_is_dealt_by_a_salted_grid(spark, sf_dir):
    unbroadcast(spark)
    try:
        text = plan(Q.text_search_top(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(area#\d+, cell#\d+, q_cell#\d+", text) and not re.search("NestedLoop|Cartesian", text)


def test_an_owners_search_reads_its_folders_alone(spark, sf_dir):
    assert re.search(r"PartitionFilters: \[[^\]]*owner", plan(Y.chunks_of_owner(spark, sf_dir)))


def test_progress_numbers_rows_within_ranges(spark, sf_dir):
    assert "range_" in plan(V.import_progress(spark, sf_dir)) and not re.search(r"Window \[row_number\(\)[^\n]*\], \[source#\d+\],", plan(V.import_progress(spark, sf_dir)))


def test_refused_answers_are_judged_before_the_join(spark, sf_dir):
    unbroadcast(spark)
    try:
        text = plan(A.answers_refused(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "repeat(" not in text[: text.index("Exchange")] and not re.search(r"answer#\d+", text)


def test_time_ranges_cut_each_text_once(spark, sf_dir):
    text = plan(O.chunk_time_ranges(spark, sf_dir))
    assert "regexp_extract_all" not in text and "documents.parquet" not in text

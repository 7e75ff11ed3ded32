"""Registered queries against their SQL in DuckDB on the smallest tables, and the entry points."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from textward.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "conversations", "benchmark")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize(
    "name",
    ["token_df_by_class", "match_tokens", "letter_runs", "doc_check", "gate_decisions", "policy_outcomes", "audit_log", "invalid_requests",
     "label_vote_repair", "stratified_split", "threshold_sweep", "tfidf_weights", "word_tfidf_weights", "retrieval_topk", "gated_qa", "lexicon_variations", "lexicon_violations",
     "near_dup_groups", "oversized_batches", "service_responses", "category_flags", "augmented_text", "augmented_corpus", "seed_sql"],
)
def test_against_sql(spark, duck, name):
    result = duck.execute(oracle.SQL[name])
    names = [x[0] for x in result.description]
    columns = sorted(names)
    want = Counter(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert Counter(repr(list(r)) for r in df.select(*columns).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 1
    assert set(oracle.SQL) <= set(queries.QUERIES) and set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_what_it_needs(spark):
    plan = queries.match_exact(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "BroadcastHashJoin" in plan

import hashlib

import corpus_pipeline as P
from textward.llm import queries


def test_stages(spark, tmp_path):
    words = "the dog of that man and his other cat went over all this land with some of our old friends".split()
    pick = lambda i, n: " ".join(words[int(hashlib.md5(f"{i}.{k}".encode()).hexdigest(), 16) % len(words)] for k in range(n))
    key = hashlib.sha1(b"x").hexdigest()
    rows = [(i, pick(i, 60) + ".", "en", "a" if i % 3 else "b", 1) for i in range(150)]
    rows += [(200, rows[7][1], "en", "a", 1), (201, f'{pick(9999, 50)} token = "{key}"', "en", "a", 1), (202, None, "en", "a", None), (203, "12 34", None, "b", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in P.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path)).cache()
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "simhash_dedup":
            assert 200 not in {r["doc_id"] for r in docs.collect()}
        if name == "secret_scan":
            text = docs.where("doc_id = 201").first()["text"]
            assert key not in text and "[SECRET]" in text
    assert counts[0] == 152 and counts[1] == counts[2] <= 151 and 0 < counts[3] <= counts[2]
    assert P.run(spark, str(tmp_path)).count() == counts[4]
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "mixing", "packing"]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_sql_agrees(spark, tmp_path):
    """DuckDB over the small tables, for the operators that SQL can express."""
    import os
    from collections import Counter

    import duckdb
    import pytest

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql)
        columns = sorted(x[0] for x in want.description)
        order = [[x[0] for x in want.description].index(c) for c in columns]
        rows = Counter(repr([r[i] for i in order]) for r in want.fetchall())
        df = queries.QUERIES[name](spark, d)
        assert sorted(df.columns) == columns
        assert Counter(repr(list(r)) for r in df.select(*columns).collect()) == rows, name


def test_mixing_stage_keeps_its_share_with_a_rare_source(spark):
    rows = [(i, "word " * (60 + i % 50), "en", "a" if i % 2 else "b", None) for i in range(2000)] + [(5000, "word " * 60, "en", "stray", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert P.mix(spark, docs, "").count() > 0.6 * len(rows)

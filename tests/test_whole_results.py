"""Queries keep whole results where a repository is larger than any fixed limit, and repeated queries and documents are worked on once."""
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
import __spark_entry__ as entry  # noqa: E402
from check import rows_of  # noqa: E402
from faultlens.operators import blockmax, context, ranking  # noqa: E402
from faultlens.sources import index_store  # noqa: E402


@pytest.fixture(scope="module")
def one_brand(tmp_path_factory):
    """Parts of a single brand: 8,000 source files and over 120 texts."""
    d = str(tmp_path_factory.mktemp("parts"))
    duckdb.execute(f"""COPY (SELECT i AS p_partkey, 'hot bolt' AS p_name, 'Brand#1' AS p_brand, ['LARGE', 'SMALL'][1 + i // 7 % 2] AS p_type,
        CAST(i // 11 % 50 AS INTEGER) AS p_size, 1.0 AS p_retailprice FROM range(20000) r(i)) TO '{d}/part.parquet' (FORMAT parquet)""")
    return d


@pytest.mark.parametrize("name", ["lite_units", "text_profiles"])
def test_large_repository_equals_sql(spark, one_brand, name):
    df = entry.queries()[name](spark, one_brand)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{one_brand}/part.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_file_docs_shuffles_digests_of_documents(spark):
    files = spark.createDataFrame([(1, "r", 1, "a/X.java"), (1, "r", 2, "a/Y.java"), (1, "r", 3, "a/Z.java"), (2, "r", 4, "b/Z.java")],
                                  "case_id long, repo string, pos long, file string")
    entries = spark.createDataFrame([("r", 1, "m1", "a/X.java"), ("r", 2, "m2", "a/Y.java"), ("r", 3, "m3", "a/Z.java")], "repo string, ord long, module string, file string")
    docs = spark.createDataFrame([("r", "m1", 1, " same text"), ("r", "m2", 1, "same text "), ("r", "m3", 1, "other text")], "repo string, module string, ord long, text string")
    out = context.file_docs(files, entries, docs, 4)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "## a/X.java\nsame"), (1, 3, "## a/Z.java\nothe"), (2, 4, "## b/Z.java\nothe")]
    keys = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate(keys=[case_id" in line or "SortAggregate(key=[case_id" in line]
    assert keys and all("digest" in line and "doc#" not in line for line in keys)


def test_equal_queries_are_searched_once(spark, tmp_path, monkeypatch):
    units = spark.createDataFrame([(f"u{i}", f"r{i % 2}", "symbol", f"n{i}", f"q{i}", f"f{i}", "hot bolt" if i % 3 else "cold ring", "h") for i in range(12)],
                                  "uid string, repo string, kind string, name string, qualified_name string, file string, text string, repo_head string")
    index_store.write_index(units, str(tmp_path / "index"))
    queries = spark.range(50).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, "hot bolt").otherwise("ring").alias("query"))
    seen, plan = [], blockmax.plan
    monkeypatch.setattr(blockmax, "plan", lambda index, asked, *a: seen.append(asked.count()) or plan(index, asked, *a))
    got = blockmax.keyword_search(index_store.read_index(spark, str(tmp_path / "index"), queries), queries, 3)
    rows = got.groupBy("qid").agg(F.sort_array(F.collect_list("uid")).alias("u")).collect()
    assert seen == [2] and len(rows) == 50
    assert {tuple(r.u) for r in rows if r.qid % 2} == {("u0", "u3", "u6")}


def test_substrings_are_made_of_distinct_segments(spark):
    tokens = spark.createDataFrame([(1, "carton.user"), (1, "carton.bot"), (2, "car.t"), (3, "a.b")], "case_id int, token string")
    words = spark.createDataFrame([("a", "art.en"), ("a", "car.de"), ("b", "car.txt"), ("b", "n.u")], "repo string, entry string")
    cands = spark.createDataFrame([(c, r, p) for c in (1, 2, 3) for p, r in enumerate("ab")], "case_id int, repo string, pos int")
    out = ranking.prefix_overlap(tokens, words, cands)
    assert sorted((r.case_id, r.repo, int(r.score)) for r in out.collect()) == [(1, "a", 2), (1, "b", 2), (2, "a", 1), (2, "b", 1), (3, "a", 0), (3, "b", 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Aggregate [token" in line and "seg" in line]
    assert any("Aggregate [part" in line for line in plan)

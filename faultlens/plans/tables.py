"""The given tables, and the triage views derived from them, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import text as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cat(*parts) -> F.Column:
    """Concatenate columns and literals; a str starting with '=' is a literal."""
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else T.col(p).cast("string")
                      for p in parts])


# --- units: one index row per document -------------------------------------------------------------

def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("uid"), F.col("source").alias("repo"),
        F.when(F.col("lang") == "en", F.lit("symbol")).otherwise(F.lit("doc")).alias("kind"),
        cat("=Doc", "doc_id").alias("name"),
        cat("source", "=.", "lang", "=.Doc", "doc_id").alias("qualified_name"),
        cat("=app/src/main/java/", "source", "=/", "lang", "=/Doc", "doc_id", "=.java").alias("file"),
        F.col("text"))


UNITS_SQL = """units AS (
  SELECT doc_id AS uid, source AS repo, CASE WHEN lang = 'en' THEN 'symbol' ELSE 'doc' END AS kind,
         'Doc' || doc_id AS name, source || '.' || lang || '.Doc' || doc_id AS qualified_name,
         'app/src/main/java/' || source || '/' || lang || '/Doc' || doc_id || '.java' AS file, text
  FROM documents)"""


def sql_terms(expr: str) -> str:
    """Index terms of a text in SQL."""
    return rf"regexp_extract_all(lower(translate({expr}, '{T.FOLD_FROM}', '{T.FOLD_TO}')), '[\p{{L}}\p{{N}}]+')"


def sql_split(expr: str) -> str:
    """Sub-words of one ASCII token in SQL, without lookahead."""
    out = expr
    for pattern in ("([A-Z]+)([A-Z][a-z])", "([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        out = rf"regexp_replace({out}, '{pattern}', '\1 \2', 'g')"
    return f"string_split(lower({out}), ' ')"


def sql_query_terms(expr: str) -> str:
    """Distinct search terms of a text in SQL."""
    words = rf"list_distinct(regexp_extract_all(translate({expr}, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\p{{L}}\p{{N}}]+'))"
    subs = (f"CASE WHEN regexp_full_match(w, '[A-Za-z0-9]+') THEN list_filter({sql_split('w')}, "
            "lambda p: length(p) >= 2 AND NOT regexp_full_match(p, '[0-9]+')) ELSE [] END")
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_concat([lower(w)], {subs}))))"


def sql_bm25(prefix: str = "", units: str = "units", qterms: str = "qterms") -> str:
    """CTEs that score `qterms`(qid, term) over `units`: {prefix}scored(qid, uid, score)."""
    p = prefix
    terms = sql_terms("concat_ws(' ', name, qualified_name, text)")
    return f"""{p}toks AS (SELECT uid, {terms} AS terms FROM {units}),
{p}tok AS (SELECT uid, len(terms) AS len, unnest(terms) AS term FROM {p}toks),
{p}tf AS (SELECT uid, len, term, count(*) AS tf FROM {p}tok GROUP BY ALL),
{p}corpus AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM {p}toks),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}idf AS (SELECT term, avg_len, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0
             THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM {p}df, {p}corpus),
{p}scored AS (SELECT q.qid, t.uid,
             round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
           FROM {qterms} q JOIN {p}idf USING (term) JOIN {p}tf t USING (term) GROUP BY q.qid, t.uid)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


# catalog order: sources by name
CATALOG_SQL = "catalog AS (SELECT DISTINCT source AS repo FROM documents)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()

"""Registered queries: tokenizing, the inverted index, keyword search and owner ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import text as T
from faultlens.operators import lexical, ranking
from faultlens.plans import tables as D

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


IDENT_SQL = "p_type || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || p_size"


def identifiers(spark, d):
    p = D.load(spark, d, "part")
    name = F.concat("p_type", F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"),
                    F.col("p_size").cast("string"))
    return p.select("p_partkey", name.alias("ident"))


@query("split_identifiers", f"""
WITH i AS (SELECT p_partkey, {IDENT_SQL} AS ident FROM part),
w AS (SELECT p_partkey, unnest(regexp_extract_all(ident, '[A-Za-z0-9]+')) AS w FROM i),
s AS (SELECT DISTINCT p_partkey, unnest({D.sql_split('w')}) AS sub FROM w)
SELECT p_partkey, string_agg(sub, ' ' ORDER BY sub) AS parts, count(*) AS n_parts FROM s GROUP BY 1""")
def split_identifiers(spark, d):
    parts = T.split_identifier(F.col("ident"))
    return identifiers(spark, d).select("p_partkey", F.array_join(F.array_sort(parts), " ").alias("parts"),
                                        F.size(parts).cast("long").alias("n_parts"))


@query("unit_identity", f"""
WITH {D.UNITS_SQL}
SELECT uid AS doc_id, sha1(repo || chr(0) || kind || chr(0) || qualified_name || chr(0) || text) AS unit_id FROM units""")
def unit_identity(spark, d):
    u = D.units(spark, d)
    uid = T.unit_uid(F.col("repo"), F.col("kind"), F.col("qualified_name"), F.col("name"), F.col("text"))
    return u.select(F.col("uid").alias("doc_id"), uid.alias("unit_id"))


@query("inverted_index", f"""
WITH {D.UNITS_SQL}, {D.sql_bm25(qterms="(SELECT 0 AS qid, '' AS term)")}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf, max(len) AS longest FROM tf GROUP BY term""")
def inverted_index(spark, d):
    ix = lexical.build_index(D.units(spark, d))
    return ix.postings.where(F.col("term") != lexical.ALL_DOCS).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.max("len").cast("long").alias("longest"))


QTERMS = f"qterms AS (SELECT item_id AS qid, unnest({D.sql_query_terms('text')}) AS term FROM benchmark)"


def sql_search(k: int, where: str = "true", cols: str = "qid, uid, repo, round(score, 6) AS score, rank") -> str:
    return f"""WITH {D.UNITS_SQL}, {QTERMS}, {D.sql_bm25()},
r AS (SELECT s.qid, s.uid, u.repo, u.kind, u.file, score,
        row_number() OVER (PARTITION BY s.qid ORDER BY score, s.uid) AS rank
      FROM scored s JOIN units u USING (uid) WHERE {where})
SELECT {cols} FROM r WHERE rank <= {k}"""


@query("keyword_search", sql_search(20))
def keyword_search(spark, d):
    hits = lexical.search(D.units(spark, d), D.queries(spark, d), 20)
    return hits.select("qid", "uid", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("keyword_search_filtered", sql_search(10, "u.repo IN ('src1', 'src2', 'src3') AND u.kind = 'symbol'"))
def keyword_search_filtered(spark, d):
    hits = lexical.search(D.units(spark, d), D.queries(spark, d), 10, repos=["src1", "src2", "src3"], kinds=["symbol"])
    return hits.select("qid", "uid", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SCOPE_SQL = "scopes AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS repo_name FROM benchmark)"


def scoped_queries(spark, d):
    return D.queries(spark, d).withColumn("repo_name", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")))


def sql_scoped(k: int, final: str, kind: str = "symbol") -> str:
    return f"""WITH {D.UNITS_SQL}, {QTERMS}, {SCOPE_SQL}, {D.sql_bm25()},
r AS (SELECT s.qid, s.uid, u.file, score, row_number() OVER (PARTITION BY s.qid ORDER BY score, s.uid) AS rank
      FROM scored s JOIN units u USING (uid) JOIN scopes c ON c.qid = s.qid AND c.repo_name = u.repo
      WHERE u.kind = '{kind}'),
hits AS (SELECT * FROM r WHERE rank <= {k}),
files AS (SELECT qid, file, row_number() OVER (PARTITION BY qid ORDER BY min(rank), file) AS rank
          FROM hits GROUP BY qid, file)
{final}"""


@query("nearest_symbols", sql_scoped(5, "SELECT qid, uid, rank FROM hits"))
def nearest_symbols(spark, d):
    hits = lexical.nearest_symbols(D.units(spark, d), scoped_queries(spark, d), 5)
    return hits.select("qid", "uid", F.col("rank").cast("long").alias("rank"))


@query("locate_files", sql_scoped(20, "SELECT qid, file, rank FROM files"))
def locate_files(spark, d):
    return lexical.locate_files(D.units(spark, d), scoped_queries(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("locate_files_top5", sql_scoped(20, "SELECT qid, file, rank FROM files WHERE rank <= 5"))
def locate_files_top5(spark, d):
    return lexical.locate_files(D.units(spark, d), scoped_queries(spark, d), top=5).withColumn(
        "rank", F.col("rank").cast("long"))


@query("symbols_exist", f"""
WITH {D.UNITS_SQL}, names AS (SELECT DISTINCT 'src' || (p_partkey % 20) AS repo, 'Doc' || p_partkey AS name FROM part)
SELECT repo, name, EXISTS (SELECT 1 FROM units u WHERE u.kind = 'symbol' AND u.repo = n.repo
       AND (u.name = n.name OR u.qualified_name = n.name)) AS "exists" FROM names n""")
def symbols_exist(spark, d):
    names = D.load(spark, d, "part").select(
        F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string")).alias("repo"),
        F.concat(F.lit("Doc"), F.col("p_partkey").cast("string")).alias("name")).distinct()
    return lexical.symbols_exist(D.units(spark, d), names)


TOKENS_SQL = f"tokens AS (SELECT DISTINCT item_id AS case_id, unnest({D.sql_query_terms('text')}) AS token FROM benchmark)"


def case_tokens(spark, d):
    return D.load(spark, d, "benchmark").select(
        F.col("item_id").alias("case_id"), F.explode(T.query_terms(F.col("text"))).alias("token"))


MEMBER_SQL = f"""WITH {D.UNITS_SQL}, {TOKENS_SQL}, {D.CATALOG_SQL},
qterms AS (SELECT token AS qid, unnest({D.sql_query_terms('token')}) AS term FROM (SELECT DISTINCT token FROM tokens)),
{D.sql_bm25()},
r AS (SELECT s.qid AS token, u.repo, row_number() OVER (PARTITION BY s.qid ORDER BY score, s.uid) AS rn
      FROM scored s JOIN units u USING (uid)),
votes AS (SELECT t.case_id, h.repo, count(DISTINCT t.token) AS n FROM tokens t
          JOIN (SELECT DISTINCT token, repo FROM r WHERE rn <= 20) h USING (token) GROUP BY 1, 2),
cases AS (SELECT item_id AS case_id FROM benchmark),
ranked AS (SELECT case_id, repo, CAST(coalesce(n, 0) AS DOUBLE) AS score,
             row_number() OVER (PARTITION BY case_id ORDER BY coalesce(n, 0) DESC, repo) AS rank
           FROM cases CROSS JOIN catalog LEFT JOIN votes USING (case_id, repo))"""


def owner_ranking_of(spark, d):
    cases = D.load(spark, d, "benchmark").select(F.col("item_id").alias("case_id"))
    cands = ranking.candidates(cases, D.catalog(spark, d))
    return ranking.membership(D.units(spark, d), case_tokens(spark, d), cands)


@query("owner_ranking", MEMBER_SQL + " SELECT case_id, repo, score, rank FROM ranked")
def owner_ranking(spark, d):
    return owner_ranking_of(spark, d).select("case_id", "repo", "score", F.col("rank").cast("long").alias("rank"))


HELD_SQL = f"""WITH {D.UNITS_SQL}, {TOKENS_SQL}, {D.CATALOG_SQL},
own AS (SELECT item_id AS case_id, repo FROM benchmark, catalog WHERE repo <> 'src' || (item_id % 20)),
qterms AS (SELECT token AS qid, unnest({D.sql_query_terms('token')}) AS term FROM (SELECT DISTINCT token FROM tokens)),
{D.sql_bm25()},
r AS (SELECT t.case_id, t.token, u.repo, row_number() OVER (PARTITION BY t.case_id, t.token ORDER BY score, s.uid) AS rn
      FROM tokens t JOIN scored s ON s.qid = t.token JOIN units u USING (uid) JOIN own o ON o.case_id = t.case_id AND o.repo = u.repo),
votes AS (SELECT case_id, repo, count(DISTINCT token) AS n FROM r WHERE rn <= 20 GROUP BY 1, 2)
SELECT case_id, repo, CAST(coalesce(n, 0) AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY case_id ORDER BY coalesce(n, 0) DESC, repo) AS rank
FROM own LEFT JOIN votes USING (case_id, repo)"""


@query("owner_ranking_held_out", HELD_SQL)
def owner_ranking_held_out(spark, d):
    """Each case brings its own catalog: the fleet without one repo, which must not use up places among the hits."""
    cases = D.load(spark, d, "benchmark").select(F.col("item_id").alias("case_id"))
    own = cases.join(D.catalog(spark, d), F.col("repo") != D.cat("=src", F.col("case_id") % 20))
    out = ranking.membership(D.units(spark, d), case_tokens(spark, d), ranking.candidates(cases, D.catalog(spark, d), own))
    return out.select("case_id", "repo", "score", F.col("rank").cast("long").alias("rank"))


@query("owner_decision", MEMBER_SQL + """,
d AS (SELECT case_id, max(repo) FILTER (WHERE rank = 1) AS top1, max(score) FILTER (WHERE rank = 1) AS top1_score,
        coalesce(max(score) FILTER (WHERE rank = 2), 0) AS runner FROM ranked GROUP BY 1)
SELECT case_id, CASE WHEN top1_score - runner >= 1 AND top1_score >= 1 THEN top1 END AS predicted,
       top1_score - runner AS margin, top1_score FROM d""")
def owner_decision(spark, d):
    return ranking.decide(owner_ranking_of(spark, d), 1.0, 1.0)


ANCHOR_SQL = f"""WITH {D.UNITS_SQL}, {SCOPE_SQL}, {TOKENS_SQL},
asked AS (SELECT DISTINCT repo_name, token, repo_name || '#' || token AS qid FROM tokens JOIN scopes ON qid = case_id),
qterms AS (SELECT qid, unnest({D.sql_query_terms('token')}) AS term FROM asked),
{D.sql_bm25()},
r AS (SELECT s.qid, u.file, row_number() OVER (PARTITION BY s.qid ORDER BY score, s.uid) AS rn
      FROM scored s JOIN units u USING (uid) JOIN asked a ON a.qid = s.qid AND a.repo_name = u.repo WHERE u.kind = 'symbol'),
n AS (SELECT qid, count(DISTINCT file) AS n_files FROM r WHERE rn <= 11 GROUP BY 1 HAVING count(DISTINCT file) <= 10),
f AS (SELECT t.case_id AS qid, t.token AS anchor, n_files,
        row_number() OVER (PARTITION BY t.case_id ORDER BY n_files, t.token) AS rank
      FROM tokens t JOIN scopes c ON c.qid = t.case_id JOIN n ON n.qid = c.repo_name || '#' || t.token)
"""


def anchors_of(spark, d):
    toks = case_tokens(spark, d).select(F.col("case_id").alias("qid"), F.col("token").alias("anchor"))
    scoped = scoped_queries(spark, d).select("qid", "repo_name")
    return toks.join(scoped, "qid").withColumn("pos", F.col("anchor"))


@query("rare_anchors", ANCHOR_SQL + "SELECT qid, anchor, n_files, rank FROM f WHERE rank <= 6")
def rare_anchors(spark, d):
    return lexical.rare_anchors(D.units(spark, d), anchors_of(spark, d)).select(
        "qid", "anchor", "n_files", F.col("rank").cast("long").alias("rank"))


@query("prefix_overlap_ranking", f"""
WITH tokens AS (SELECT DISTINCT conv_id AS case_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) || '.' || role AS token FROM conversations),
dict AS (SELECT DISTINCT source AS repo, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) || '.' || lang AS entry FROM documents),
{D.CATALOG_SQL}, t AS (SELECT DISTINCT token FROM tokens),
begins AS (SELECT DISTINCT repo, substr(entry, 1, CAST(i AS INTEGER)) AS token FROM (SELECT repo, entry, unnest(range(1, length(entry) + 1)) AS i FROM dict)),
spots AS (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM t),
parts AS (SELECT DISTINCT token, substr(token, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS seg FROM (SELECT token, i, unnest(range(1, length(token) - i + 2)) AS n FROM spots)),
pairs AS (SELECT token, repo FROM t JOIN begins USING (token)
    UNION SELECT token, repo FROM parts JOIN (SELECT DISTINCT repo, split_part(entry, '.', 1) AS seg FROM dict) USING (seg)
    UNION SELECT token, repo FROM t JOIN dict ON starts_with(token, entry || '.') AND split_part(token, '.', 1) = split_part(entry, '.', 1)),
votes AS (SELECT case_id, repo, count(DISTINCT token) AS n FROM tokens JOIN pairs USING (token) GROUP BY 1, 2)
SELECT case_id, repo, CAST(coalesce(n, 0) AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY case_id ORDER BY coalesce(n, 0) DESC, repo) AS rank
FROM (SELECT DISTINCT conv_id AS case_id FROM conversations) CROSS JOIN catalog LEFT JOIN votes USING (case_id, repo)""")
def prefix_overlap_ranking(spark, d):
    word = F.explode(T.matches(F.col("text"), "[A-Za-z]+")).alias("word")
    turns = D.load(spark, d, "conversations")
    tokens = turns.select(F.col("conv_id").alias("case_id"), "role", word).select("case_id", F.concat("word", F.lit("."), "role").alias("token")).distinct()
    dictionary = D.load(spark, d, "documents").select(F.col("source").alias("repo"), "lang", word).select(
        "repo", F.concat(F.lower("word"), F.lit("."), "lang").alias("entry")).distinct()
    cands = ranking.candidates(turns.select(F.col("conv_id").alias("case_id")).distinct(), D.catalog(spark, d))
    out = ranking.prefix_overlap(tokens, dictionary, cands)
    return out.select("case_id", "repo", "score", F.col("rank").cast("long").alias("rank"))

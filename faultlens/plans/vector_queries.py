"""Registered queries: vector search, fusion, and scorecards over vector rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import metrics
from faultlens.functions import text as T
from faultlens.operators import fusion, grading, lexical, ranking, vectors
from faultlens.plans import tables as D
from faultlens.plans.lexical_queries import SCOPE_SQL, owner_ranking_of, scoped_queries
from faultlens.session import cut

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def vec_units(spark, d):
    e = D.load(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("uid"), F.concat(F.lit("repo"), F.col("label").cast("string")).alias("repo"),
                    F.lit("symbol").alias("kind"), F.concat(F.lit("src/V"), F.col("vec_id").cast("string"), F.lit(".java")).alias("file"),
                    F.col("embedding").alias("vec"))


def vec_cases(spark, d):
    return D.load(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vec"))


def sql_near(k: int, extra: str = "true", name: str = "near") -> str:
    return f"""{name}_pairs AS (SELECT q.vec_id AS case_id, u.vec_id AS uid, 'repo' || u.label AS repo,
   round(list_cosine_similarity(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings u WHERE q.vec_id <> u.vec_id AND {extra}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, uid) AS rank FROM {name}_pairs)
  WHERE rank <= {k})"""


@query("vector_search", f"WITH {sql_near(20)} SELECT case_id, uid, repo, round(score, 6) AS score, rank FROM near")
def vector_search(spark, d):
    hits = vectors.case_hits(vec_units(spark, d), vec_cases(spark, d), 20, skip_self=True)
    return hits.select("case_id", "uid", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_search_filtered", f"""WITH {sql_near(10, "u.label IN (1, 4)")}
SELECT case_id, uid, repo, round(score, 6) AS score, rank FROM near""")
def vector_search_filtered(spark, d):
    q = vec_cases(spark, d).select(F.col("case_id").alias("qid"), "vec")
    hits = vectors.vector_search(vec_units(spark, d), q, 10, repos=["repo1", "repo4"], skip_self=True)
    return hits.select(F.col("qid").alias("case_id"), "uid", "repo", F.round("score", 6).alias("score"),
                       F.col("rank").cast("long").alias("rank"))


@query("vector_dim_check", """
SELECT min(len(embedding)) = max(len(embedding)) AS ok, CAST(max(len(embedding)) AS INTEGER) AS index_dim,
       CAST(max(len(embedding)) AS INTEGER) AS query_dim FROM embeddings""")
def vector_dim_check(spark, d):
    return vectors.require_dim(vec_units(spark, d), vec_cases(spark, d))


def sql_vec_ranking(k: int, name: str) -> str:
    return f"""{sql_near(k, name=name + "_near")},
{name} AS (SELECT c.case_id, r.repo, greatest(0.0, coalesce(max(score), 0.0)) AS score,
    row_number() OVER (PARTITION BY c.case_id ORDER BY greatest(0.0, coalesce(max(score), 0.0)) DESC, r.repo) AS rank
  FROM (SELECT vec_id AS case_id FROM embeddings) c CROSS JOIN (SELECT DISTINCT 'repo' || label AS repo FROM embeddings) r
  LEFT JOIN {name}_near n ON n.case_id = c.case_id AND n.repo = r.repo GROUP BY c.case_id, r.repo)"""


def vec_hits(spark, d, k: int):
    """The k best hits of each case, and its candidates."""
    units, cases = vec_units(spark, d), vec_cases(spark, d)
    cands = ranking.candidates(cases, units.select("repo").distinct())
    return vectors.case_hits(units, cases, k, skip_self=True, cands=cands), cands


def ranked(hits, cands, k: int):
    """The ranking by the first k hits of each case: hits of a search for more hold them."""
    return cut(ranking.vector_ranking(hits.where(F.col("rank") <= k), cands))


def vec_ranking(spark, d, k: int):
    return ranked(*vec_hits(spark, d, k), k)


@query("vector_owner_ranking", f"WITH {sql_vec_ranking(50, 'r')} SELECT case_id, repo, round(score, 6) AS score, rank FROM r")
def vector_owner_ranking(spark, d):
    return vec_ranking(spark, d, V.VECTOR_TOP_K).select(
        "case_id", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_ranking_held_out", f"""WITH {sql_near(50, "u.label <> q.label")}
SELECT c.case_id, r.repo, round(greatest(0.0, coalesce(max(score), 0.0)), 6) AS score,
  row_number() OVER (PARTITION BY c.case_id ORDER BY greatest(0.0, coalesce(max(score), 0.0)) DESC, r.repo) AS rank
FROM (SELECT vec_id AS case_id, 'repo' || label AS owner FROM embeddings) c JOIN (SELECT DISTINCT 'repo' || label AS repo FROM embeddings) r ON r.repo <> c.owner
LEFT JOIN near n ON n.case_id = c.case_id AND n.repo = r.repo GROUP BY c.case_id, r.repo""")
def vector_ranking_held_out(spark, d):
    """Each case's own catalog is the fleet without its owner."""
    units, cases = vec_units(spark, d), vec_cases(spark, d)
    fleet = units.select("repo").distinct()
    owners = units.select(F.col("uid").alias("case_id"), F.col("repo").alias("_owner"))
    own = owners.join(fleet, F.col("repo") != F.col("_owner")).select("case_id", "repo")
    cands = ranking.candidates(cases, fleet, own)
    out = ranking.vector_ranking(vectors.case_hits(units, cases, V.VECTOR_TOP_K, skip_self=True, cands=cands), cands)
    return out.select("case_id", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


ARMS_SQL = f"""{sql_vec_ranking(50, 'a1')}, {sql_vec_ranking(10, 'a2')},
arms AS (SELECT 'semantic' AS arm, * FROM a1 UNION ALL SELECT 'semantic_narrow' AS arm, * FROM a2),
recs AS (SELECT arm, case_id, list(repo ORDER BY rank) AS ranked_names, max(score) FILTER (WHERE rank = 1) AS top1_score,
    coalesce(max(score) FILTER (WHERE rank = 2), 0.0) AS runner, max(repo) FILTER (WHERE rank = 1) AS top1
  FROM arms GROUP BY arm, case_id),
dec AS (SELECT *, top1_score - runner AS margin,
    CASE WHEN round(top1_score - runner, 9) >= 0.05 AND top1_score >= 0 THEN top1 END AS predicted FROM recs),
lab AS (SELECT vec_id AS case_id, 'repo' || label AS owning_repo, coalesce(toxic, 0) = 0 AS answerable,
    CASE WHEN toxic = 1 THEN 'not_a_defect' END AS negative_class,
    CASE quality WHEN 1 THEN 'crash' WHEN 0 THEN 'functional' END AS bug_kind
  FROM embeddings LEFT JOIN labels ON doc_id = vec_id),
graded AS (SELECT arm, case_id, owning_repo, predicted, top1 AS ranked_top1,
    CAST(coalesce(list_position(ranked_names, owning_repo), 0) AS INTEGER) AS oracle_rank, top1 = owning_repo AS recall_1,
    predicted IS NOT NULL AS answered, coalesce(predicted = owning_repo, false) AS correct, answerable,
    margin, top1_score, negative_class, bug_kind FROM dec JOIN lab USING (case_id))"""


def vec_labels(spark, d):
    e = D.load(spark, d, "embeddings").join(
        D.load(spark, d, "labels"), F.col("doc_id") == F.col("vec_id"), "left")
    return e.select(F.col("vec_id").alias("case_id"), F.concat(F.lit("repo"), F.col("label").cast("string")).alias("owning_repo"),
                    (F.coalesce("toxic", F.lit(0)) == 0).alias("is_answerable"),
                    F.when(F.col("toxic") == 1, F.lit("not_a_defect")).alias("negative_class"),
                    F.when(F.col("quality") == 1, F.lit("crash")).when(F.col("quality") == 0, F.lit("functional")).alias("bug_kind"))


def vec_records(spark, d):
    margin, score = V.TAU_SEMANTIC
    hits, cands = vec_hits(spark, d, 50)
    arms = {"semantic": ranked(hits, cands, 50), "semantic_narrow": ranked(hits, cands, 10)}
    return ranking.run_arms({arm: (rows, margin - 5e-10, score) for arm, rows in arms.items()})


def vec_graded(spark, d):
    return grading.per_case(vec_records(spark, d), vec_labels(spark, d))


@query("match_records", f"""WITH {ARMS_SQL}
SELECT arm, case_id, array_to_string(ranked_names, ',') AS ranked, predicted, round(margin, 6) AS margin,
       round(top1_score, 6) AS top1_score FROM dec""")
def match_records(spark, d):
    return vec_records(spark, d).select("arm", "case_id", F.array_join("ranked_names", ",").alias("ranked"), "predicted",
                                        F.round("margin", 6).alias("margin"), F.round("top1_score", 6).alias("top1_score"))


@query("graded_predictions", f"""WITH {ARMS_SQL}
SELECT arm, case_id, owning_repo, predicted, ranked_top1, oracle_rank, recall_1, answered, correct, answerable FROM graded""")
def graded_predictions(spark, d):
    return vec_graded(spark, d).select("arm", "case_id", "owning_repo", "predicted", "ranked_top1", "oracle_rank", "recall_1",
                                       "answered", "correct", "answerable")


def sql_wilson(k: str, n: str) -> tuple[str, str]:
    center = f"(({k})::DOUBLE / ({n}) + 3.8416 / (2 * ({n}))) / (1 + 3.8416 / ({n}))"
    half = (f"1.96 * sqrt((({k})::DOUBLE / ({n})) * (1 - ({k})::DOUBLE / ({n})) / ({n}) + 3.8416 / (4.0 * ({n}) * ({n})))"
            f" / (1 + 3.8416 / ({n}))")
    return (f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE greatest(0.0, {center} - {half}) END",
            f"CASE WHEN ({n}) = 0 THEN 1.0 ELSE least(1.0, {center} + {half}) END")


def sql_card() -> str:
    na = "count(*) FILTER (WHERE answerable)"
    cols = [f"count(*) AS n, {na} AS n_answerable"]
    for k in (1, 3, 5):
        hits = f"count(*) FILTER (WHERE answerable AND oracle_rank BETWEEN 1 AND {k})"
        lo, hi = sql_wilson(hits, na)
        cols += [f"round(coalesce({hits}::DOUBLE / nullif({na}, 0), 0), 6) AS recall_{k}",
                 f"round({lo}, 6) AS recall_{k}_lo, round({hi}, 6) AS recall_{k}_hi"]
    phi = ("avg(CASE WHEN answered AND answerable AND correct THEN 1.0 WHEN answered THEN -{c} "
           "WHEN answerable THEN 0.0 ELSE 1.0 END::DOUBLE)")
    cols += [
        f"round(coalesce(sum(1.0::DOUBLE / oracle_rank) FILTER (WHERE answerable AND oracle_rank > 0) / nullif({na}, 0), 0), 6) AS mrr",
        "round(coalesce(avg(oracle_rank) FILTER (WHERE answerable AND oracle_rank > 0), 0), 6) AS mean_rank",
        "round(avg(answered::INT), 6) AS coverage",
        "round(coalesce(avg(correct::INT) FILTER (WHERE answered), 0), 6) AS selective_accuracy",
        "round(coalesce(1 - avg(correct::INT) FILTER (WHERE answered), 0), 6) AS selective_risk",
        *[f"round({phi.format(c=c)}, 6) AS phi_{grading.tag(c)}" for c in (0.5, 1.0, 2.0)],
        "round(avg((NOT answered)::INT) FILTER (WHERE NOT answerable), 6) AS abstention_recall",
        "count(*) FILTER (WHERE NOT answerable) AS n_unanswerable"]
    return ", ".join(cols)


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("scorecard", f"""WITH {ARMS_SQL}
SELECT arm, NULL::VARCHAR AS bug_kind, {sql_card()} FROM graded GROUP BY arm UNION ALL
SELECT arm, bug_kind, {sql_card()} FROM graded WHERE bug_kind IS NOT NULL GROUP BY arm, bug_kind""")
def scorecard(spark, d):
    return rounded(grading.scorecard(vec_graded(spark, d)))


@query("abstain_by_class", f"""WITH {ARMS_SQL}
SELECT arm, negative_class, count(*) AS n, count(*) FILTER (WHERE NOT answered) AS abstained,
       round(avg((NOT answered)::INT), 6) AS abstain_rate FROM graded WHERE negative_class IS NOT NULL GROUP BY 1, 2""")
def abstain_by_class(spark, d):
    return rounded(grading.abstain_by_class(vec_graded(spark, d)))


CARD_NAMES = ["recall_1", "recall_3", "recall_5", "mrr", "coverage", "selective_accuracy", "phi_1_0"]


@query("card_comparison", f"""WITH {ARMS_SQL},
c AS (SELECT arm, {sql_card()} FROM graded GROUP BY arm),
l AS (UNPIVOT (SELECT arm, {', '.join(CARD_NAMES)} FROM c) ON {', '.join(CARD_NAMES)} INTO NAME metric VALUE value),
j AS (SELECT metric, a.value AS cur, b.value AS prev, a.value - b.value AS delta
      FROM (SELECT * FROM l WHERE arm = 'semantic') a FULL JOIN (SELECT * FROM l WHERE arm = 'semantic_narrow') b USING (metric))
SELECT metric, cur, prev, round(delta, 6) AS delta, (SELECT CASE
   WHEN bool_or(delta < -1e-9) THEN 'regressed' WHEN bool_or(delta > 1e-9) THEN 'improved' ELSE 'flat' END
   FROM j WHERE metric IN ('recall_1', 'as_run_5', 'resolved_rate_strict')) AS verdict FROM j""")
def card_comparison(spark, d):
    card = rounded(grading.scorecard(vec_graded(spark, d))).where(F.col("bug_kind").isNull())
    long = grading.long_card(card, CARD_NAMES, ["arm"])
    return rounded(grading.compare_cards(long.where("arm = 'semantic'"), long.where("arm = 'semantic_narrow'")))


@query("recall_per_case", f"""WITH {sql_near(20)},
r AS (SELECT case_id, list(repo ORDER BY rank) AS ranked FROM near GROUP BY 1),
g AS (SELECT vec_id AS case_id, ['repo' || label, 'repo' || ((label + 1) % 10)] AS gold FROM embeddings)
SELECT case_id, round(len(list_filter(gold, lambda x: list_contains(ranked[1:1], x))) / 2.0::DOUBLE, 6) AS recall_1,
  round(len(list_filter(gold, lambda x: list_contains(ranked[1:5], x))) / 2.0::DOUBLE, 6) AS recall_5,
  CAST(coalesce(list_position(ranked, gold[1]), 0) AS INTEGER) AS owner_rank FROM r JOIN g USING (case_id)""")
def recall_per_case(spark, d):
    hits = vectors.case_hits(vec_units(spark, d), vec_cases(spark, d), 20, skip_self=True)
    ranked = hits.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "repo"))).alias("r")).select(
        "case_id", F.transform("r", lambda x: x["repo"]).alias("ranked"))
    label = F.col("label")
    gold = D.load(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.array(
        F.concat(F.lit("repo"), label.cast("string")), F.concat(F.lit("repo"), ((label + 1) % 10).cast("string"))).alias("gold"))
    return rounded(ranked.join(gold, "case_id").select(
        "case_id", metrics.recall_at_k(F.col("ranked"), F.col("gold"), 1).alias("recall_1"),
        metrics.recall_at_k(F.col("ranked"), F.col("gold"), 5).alias("recall_5"),
        metrics.rank_of(F.col("ranked"), F.get("gold", F.lit(0))).alias("owner_rank")))


# hybrid search: all documents, asked by all benchmark texts; those without a vector only miss the vector lane
HYBRID_SQL = f"""{D.UNITS_SQL.replace('units AS', 'all_units AS')},
units AS (SELECT a.*, e.embedding::DOUBLE[] AS vec FROM all_units a LEFT JOIN embeddings e ON e.vec_id = a.uid),
asked AS (SELECT item_id AS qid, text, e.embedding::DOUBLE[] AS qvec FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id),
qterms AS (SELECT qid, unnest({D.sql_query_terms('text')}) AS term FROM asked),
{D.sql_bm25()}, {SCOPE_SQL}"""


def hybrid_units(spark, d):
    e = D.load(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vec"))
    return D.units(spark, d).join(e, "uid", "left")


def hybrid_queries(spark, d):
    e = D.load(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return D.queries(spark, d).join(e, "qid", "left")


def sql_hybrid(k: int, where: str = "true", p: str = "") -> str:
    """CTEs {p}top(qid, uid, score, matched_via, rank)."""
    return f"""{p}kw AS (SELECT * FROM (SELECT s.qid, s.uid, row_number() OVER (PARTITION BY s.qid ORDER BY s.score, s.uid) AS rank
    FROM scored s JOIN units u USING (uid) WHERE {where}) WHERE rank <= {2 * k}),
{p}vs AS (SELECT * FROM (SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY
    round(list_cosine_similarity(qvec, vec), 9) DESC, uid) AS rank FROM asked, units u WHERE vec IS NOT NULL AND qvec IS NOT NULL AND {where}) WHERE rank <= {2 * k}),
{p}lanes AS (SELECT qid, uid, 'keyword' AS lane, 0 AS tier, rank FROM {p}kw UNION ALL SELECT qid, uid, 'semantic', 1, rank FROM {p}vs),
{p}fused AS (SELECT qid, uid, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(tier * 1000 + rank) AS seen,
    string_agg(lane, '+' ORDER BY lane) AS matched_via FROM {p}lanes GROUP BY 1, 2),
{p}top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, uid) AS rank FROM {p}fused)
    WHERE rank <= {k})"""


@query("hybrid_search", f"""WITH {HYBRID_SQL}, {sql_hybrid(10)}
SELECT qid, uid, u.repo, u.kind, u.file, substr(u.text, 1, 400) AS snippet, round_even(score, 5) AS score, matched_via, rank
FROM top JOIN units u USING (uid)""")
def hybrid_search(spark, d):
    out = fusion.hybrid_search(hybrid_units(spark, d), hybrid_queries(spark, d), 10, snippet=400)
    return out.select("qid", "uid", "repo", "kind", "file", "snippet", "score", "matched_via",
                      F.col("rank").cast("long").alias("rank"))


@query("rank_fusion", f"""WITH {HYBRID_SQL}, {sql_hybrid(15)} SELECT qid, uid, round(score, 9) AS score, rank FROM top""")
def rank_fusion(spark, d):
    units, asked = hybrid_units(spark, d), hybrid_queries(spark, d)
    words = lexical.search(units, asked.select("qid", "query"), 30)
    near = vectors.vector_search(units, asked, 30)
    out = fusion.rrf([words, near], ["qid"], "uid", 15)
    return out.select("qid", "uid", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("related_units", f"""WITH {HYBRID_SQL}, {sql_hybrid(11, "u.kind = 'symbol'", 's')}, {sql_hybrid(11, "u.kind = 'doc'", 'd')},
n AS (SELECT qid, (SELECT count(*) FROM stop t WHERE t.qid = a.qid) AS ns, (SELECT count(*) FROM dtop t WHERE t.qid = a.qid) AS nd FROM asked a),
m AS (SELECT qid, ns, nd, CASE WHEN least(nd, 5) < 5 THEN least(ns, 11 - least(nd, 5)) ELSE least(ns, 6) END AS ts FROM n),
q AS (SELECT qid, ts, CASE WHEN ts < 6 THEN least(nd, 11 - ts) ELSE least(nd, 5) END AS td FROM m),
b AS (SELECT t.qid, uid, 'symbol' AS kind, 2 * rank AS o FROM stop t JOIN q ON q.qid = t.qid AND rank <= ts UNION ALL
      SELECT t.qid, uid, 'doc', 2 * rank + 1 FROM dtop t JOIN q ON q.qid = t.qid AND rank <= td)
SELECT qid, uid, kind, pos FROM (SELECT qid, uid, kind, row_number() OVER (PARTITION BY qid ORDER BY o) AS pos FROM b) WHERE pos <= 11""")
def related_units(spark, d):
    return fusion.related_units(hybrid_units(spark, d), hybrid_queries(spark, d), 11).withColumn("pos", F.col("pos").cast("long"))


def sql_vec_files(k: int) -> str:
    return f"""vf_hits AS (SELECT * FROM (SELECT a.qid, u.uid, u.file, row_number() OVER (PARTITION BY a.qid ORDER BY
    round(list_cosine_similarity(qvec, vec), 9) DESC, uid) AS rank
  FROM asked a JOIN scopes c USING (qid) JOIN units u ON u.repo = c.repo_name WHERE u.kind = 'symbol' AND vec IS NOT NULL AND qvec IS NOT NULL) WHERE rank <= {k}),
vf AS (SELECT qid, file, row_number() OVER (PARTITION BY qid ORDER BY min(rank), file) AS rank FROM vf_hits GROUP BY qid, file)"""


@query("vector_locate_files", f"WITH {HYBRID_SQL}, {sql_vec_files(20)} SELECT qid, file, rank FROM vf")
def vector_locate_files(spark, d):
    asked = hybrid_queries(spark, d).join(scoped_queries(spark, d).select("qid", "repo_name"), "qid")
    return fusion.locate_by_vector(hybrid_units(spark, d), asked).withColumn("rank", F.col("rank").cast("long"))


# code tokens of a query: the document named by its id, as extracted signals would carry it
CASCADE_SQL = f"""WITH {HYBRID_SQL.split('qterms AS')[0]} {SCOPE_SQL},
tiers AS (SELECT qid, 0 AS tier, text AS query FROM asked UNION ALL
          SELECT qid, 1, 'Doc' || qid || ' en ' || repo_name FROM asked JOIN scopes USING (qid)),
qterms AS (SELECT qid * 10 + tier AS qid, unnest({D.sql_query_terms('query')}) AS term FROM tiers), {D.sql_bm25()},
kh AS (SELECT * FROM (SELECT s.qid, u.file, row_number() OVER (PARTITION BY s.qid ORDER BY score, s.uid) AS rank
   FROM scored s JOIN units u USING (uid) JOIN scopes c ON c.qid = s.qid // 10 AND c.repo_name = u.repo WHERE u.kind = 'symbol')
   WHERE rank <= 20),
kf AS (SELECT qid, file, row_number() OVER (PARTITION BY qid ORDER BY min(rank), file) AS rank FROM kh GROUP BY qid, file),
{sql_vec_files(20)},
allf AS (SELECT qid // 10 AS qid, file, qid % 10 AS tier, rank FROM kf UNION ALL SELECT qid, file, 1000, rank FROM vf),
fz AS (SELECT qid, file, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(tier * 1000000 + rank) AS seen FROM allf GROUP BY 1, 2),
cf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, file) AS rank FROM fz)
"""


def cascade_queries(spark, d):
    asked = hybrid_queries(spark, d).join(scoped_queries(spark, d).select("qid", "repo_name"), "qid")
    none = F.array().cast("array<string>")
    sig = F.struct(F.array("repo_name").alias("packages"),
                   F.array(F.concat(F.lit("Doc"), F.col("qid").cast("string"))).alias("classes"),
                   F.array(F.lit("en")).alias("methods"), none.alias("symbols"), none.alias("libraries"), none.alias("errors"))
    return asked.withColumn("signals", sig)


@query("cascade_locate", CASCADE_SQL + "SELECT qid, file, round(score, 9) AS score, rank FROM cf WHERE rank <= 20")
def cascade_locate(spark, d):
    out = fusion.cascade(hybrid_units(spark, d), cascade_queries(spark, d), vector_tier=True)
    return out.select("qid", "file", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("rewritten_queries", f"""WITH {SCOPE_SQL}
SELECT qid, CASE WHEN EXISTS (SELECT 1 FROM embeddings WHERE vec_id = qid) THEN 'Doc' || qid || ' en ' || repo_name ELSE text END AS query
FROM scopes JOIN benchmark ON item_id = qid""")
def rewritten_queries(spark, d):
    coded = cascade_queries(spark, d).select("qid", "signals")
    return fusion.rewrite_queries(D.queries(spark, d).join(coded, "qid", "left").select("qid", "query", "signals"))


ORDER_SQL = "ord AS (SELECT case_id, repo, CAST(-rank AS BIGINT) AS pos FROM r WHERE rank % 2 = 0)"


def outside_order(r):
    return r.where(F.col("rank") % 2 == 0).select("case_id", "repo", (-F.col("rank")).alias("pos"))


@query("grounded_reorder", f"""WITH {sql_vec_ranking(50, 'r')}, {ORDER_SQL}
SELECT case_id, repo, row_number() OVER (PARTITION BY case_id ORDER BY o.pos IS NULL, o.pos, r.rank) AS rank
FROM r LEFT JOIN ord o USING (case_id, repo)""")
def grounded_reorder(spark, d):
    r = vec_ranking(spark, d, 50)
    out = fusion.ground_order(r.select("case_id", "repo", "rank"), outside_order(r), ["case_id"], "repo")
    return out.select("case_id", "repo", F.col("rank").cast("long").alias("rank"))


@query("reply_order_reorder", f"""WITH {sql_vec_ranking(50, 'r')}, {ORDER_SQL},
j AS (SELECT r.case_id, r.repo, r.rank, row_number() OVER (PARTITION BY r.case_id ORDER BY o.pos IS NULL, o.pos, r.rank) AS p
   FROM (SELECT * FROM r WHERE rank <= 5) r LEFT JOIN ord o USING (case_id, repo)),
s AS (SELECT r.case_id, r.repo, r.rank AS old, CASE WHEN p IS NULL THEN 0.0 ELSE 6.0 - p END AS score FROM r LEFT JOIN j USING (case_id, repo))
SELECT case_id, repo, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, old) AS rank FROM s""")
def reply_order_reorder(spark, d):
    r = vec_ranking(spark, d, 50)
    said = outside_order(r).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", "repo"))).alias("s"))
    replies = said.select("case_id", F.array_join(F.transform("s", lambda x: F.upper(x["repo"])), ", ").alias("reply"))
    order = fusion.parse_order(r.where(F.col("rank") <= 5).select("case_id", "repo"), replies, ["case_id"], "repo")
    return fusion.judge_repos(r, order).select("case_id", "repo", "score", F.col("rank").cast("long").alias("rank"))


@query("hash_embeddings", """
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS tok FROM documents),
b AS (SELECT doc_id, strpos('0123456789abcdef', right(sha1(tok), 1)) - 1 AS bucket, count(*) AS n FROM t WHERE tok <> '' GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS w FROM b""")
def hash_embeddings(spark, d):
    docs = lexical.spread(D.load(spark, d, "documents"))
    return vectors.embed(docs, "text", 16).select("doc_id", F.posexplode("vec").alias("bucket", "w")).where(F.col("w") > 0).select(
        "doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("w", 6).alias("w"))


@query("split_arms", f"""WITH {HYBRID_SQL}, {sql_vec_files(5)},
rk AS (SELECT qid, string_agg(file, ',' ORDER BY rank) AS locations FROM vf GROUP BY 1),
nearest AS (SELECT * FROM (SELECT qid, repo, round(list_cosine_similarity(qvec, vec), 9) AS score,
   row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qvec, vec), 9) DESC, uid) AS rn FROM asked, units) WHERE rn <= 50),
lists AS (SELECT qid AS case_id, string_agg(repo, ',' ORDER BY rank) AS ranked FROM (
   SELECT qid, repo, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, repo) AS rank FROM nearest GROUP BY qid, repo) GROUP BY 1)
SELECT case_id, ranked, coalesce(locations, '') AS locations FROM lists LEFT JOIN rk ON qid = case_id""")
def split_arms(spark, d):
    units, asked = hybrid_units(spark, d), cascade_queries(spark, d)
    hits = vectors.vector_search(units, asked.select("qid", "vec"), V.VECTOR_TOP_K)
    best = hits.groupBy(F.col("qid").alias("case_id"), "repo").agg(F.max("score").alias("score")).withColumn("pos", F.lit(0))
    files = lexical.files_of(vectors.vector_search(units, asked, 5, kinds=["symbol"], scope="repo_name"))
    out = fusion.split_index(ranking.rank_scores(best), files.withColumnRenamed("qid", "case_id"))
    return out.select("case_id", F.array_join("ranked", ",").alias("ranked"), F.array_join("locations", ",").alias("locations"))

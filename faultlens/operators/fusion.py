"""Rank fusion, hybrid search, quota merge, cascade and grounded reorder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultlens import fixed_values as V
from faultlens.functions import text as T
from faultlens.operators import lexical, vectors


def rrf(lists: list[DataFrame], by: list[str], item: str, k: int | None = None, k0: int = V.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (by..., item, rank from 1): (by..., item, score, rank).

    Ties keep first-seen order: the earliest list, then the rank in it.
    """
    rows = [df.select(*by, item, F.lit(i).alias("_list"), "rank") for i, df in enumerate(lists)]
    return rrf_tiers(reduce(DataFrame.unionByName, rows), by, item, "_list", k, k0)


def rrf_tiers(rows: DataFrame, by: list[str], item: str, tier: str, k: int | None = None,
              k0: int = V.RRF_K) -> DataFrame:
    """rrf over one frame whose `tier` column numbers the lists."""
    fused = rows.groupBy(*by, item).agg(
        F.round(F.sum(F.lit(1.0) / (k0 + F.col("rank"))), 12).alias("score"),
        F.min(F.struct(F.col(tier), F.col("rank"))).alias("_seen"))
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("_seen"), F.col(item))
    out = fused.withColumn("rank", F.row_number().over(w)).drop("_seen")
    return out.where(F.col("rank") <= k) if k else out


def hybrid_search(units: DataFrame, queries: DataFrame, k: int = 20, repos: list[str] | None = None,
                  kinds: list[str] | None = None, scope: str | None = None, snippet: int | None = None) -> DataFrame:
    """2k keyword hits and 2k vector hits fused to k: adds matched_via and the text as a snippet, cut to `snippet` characters.

    queries is (qid, query, vec); units carry text and vec.
    """
    words = lexical.search(units, queries.select("qid", "query", *([scope] if scope else [])), 2 * k, repos=repos,
                           kinds=kinds, scope=scope)
    near = vectors.vector_search(units, queries, 2 * k, repos, kinds, scope)
    lanes = words.select("qid", "uid", F.lit("keyword").alias("lane"), F.lit(0).alias("tier"), "rank").unionByName(
        near.select("qid", "uid", F.lit("semantic").alias("lane"), F.lit(1).alias("tier"), "rank"))
    fused = rrf_tiers(lanes, ["qid"], "uid", "tier", k)
    via = lanes.groupBy("qid", "uid").agg(F.array_join(F.sort_array(F.collect_set("lane")), "+").alias("matched_via"))
    show = units.select("uid", "repo", "kind", "name", "qualified_name", "file", T.first_chars(F.col("text"), snippet).alias("snippet"))
    return (fused.join(via, ["qid", "uid"]).join(show, "uid")
            .withColumn("score", F.bround("score", 5)))


def merge_quota(symbols: DataFrame, docs: DataFrame, k: int = 20, symbol_ratio: float = 0.5) -> DataFrame:
    """Symbol and doc hits of each query in quota shares, short sides backfilled, symbol first.

    Both inputs are (qid, uid, rank).
    """
    n_doc = int(k * (1.0 - symbol_ratio))
    n_sym = k - n_doc
    both = symbols.select("qid", "uid", "rank", F.lit(0).alias("side")).unionByName(
        docs.select("qid", "uid", "rank", F.lit(1).alias("side")))
    per = W.partitionBy("qid")
    have_sym = F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(per)
    have_doc = F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).over(per)
    took_doc, took_sym = F.least(have_doc, F.lit(n_doc)), F.least(have_sym, F.lit(n_sym))
    sym_share = F.when(took_doc < n_doc, F.least(have_sym, n_sym + n_doc - took_doc)).otherwise(took_sym)
    doc_share = F.when(sym_share < n_sym, F.least(have_doc, n_doc + n_sym - sym_share)).otherwise(took_doc)
    share = F.when(F.col("side") == 0, sym_share).otherwise(doc_share)
    kept = both.withColumn("_share", share).where(F.col("rank") <= F.col("_share"))
    w = per.orderBy(2 * F.col("rank") + F.col("side"))
    return (kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
            .select("qid", "uid", F.when(F.col("side") == 0, F.lit("symbol")).otherwise(F.lit("doc")).alias("kind"), "pos"))


def related_units(units: DataFrame, queries: DataFrame, k: int = 20, symbol_ratio: float = 0.5) -> DataFrame:
    """Hybrid search per kind, merged by quota."""
    sym = hybrid_search(units, queries, k, kinds=["symbol"])
    doc = hybrid_search(units, queries, k, kinds=["doc"])
    return merge_quota(sym, doc, k, symbol_ratio)


def locate_by_vector(units: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Vector file localization in the query's repo: symbol hits, files in rank order."""
    hits = vectors.vector_search(units, queries, k, kinds=["symbol"], scope="repo_name")
    return lexical.files_of(hits)


def rewrite_queries(queries: DataFrame) -> DataFrame:
    """The code tokens of a query as its text, its prose where it has none; queries is (qid, query, signals)."""
    code = F.nullif(T.code_query(F.col("signals")), F.lit(""))
    return queries.withColumn("query", F.coalesce(code, F.col("query"))).drop("signals")


def cascade(units: DataFrame, queries: DataFrame, anchors: DataFrame | None = None, k: int = 20,
            vector_tier: bool = False) -> DataFrame:
    """Prose floor, code tokens, rare literals and an optional vector tier fused per query.

    queries is (qid, repo_name, query, signals[, vec]). All keyword tiers run as one search over
    (query, tier) ids; empty tiers add nothing. anchors is rare_anchors output with repo_name.
    """
    code = T.code_query(F.col("signals"))
    tiers = queries.select("qid", "repo_name", "query", F.lit(0).alias("tier")).unionByName(
        queries.where(code != "").select("qid", "repo_name", code.alias("query"), F.lit(1).alias("tier")))
    if anchors is not None:
        tiers = tiers.unionByName(anchors.select(
            "qid", "repo_name", F.col("anchor").alias("query"), (F.col("rank") + 1).alias("tier")))
    keyed = tiers.withColumn("key", F.struct("qid", "tier"))
    asked = keyed.select(F.to_json("key").alias("qid"), "repo_name", "query")
    hits = lexical.search(units, asked, 20, kinds=["symbol"], scope="repo_name")
    files = lexical.files_of(hits)
    names = keyed.select(F.to_json("key").alias("key_json"), F.col("key.qid").alias("qid"), "tier")
    ranked = files.withColumnRenamed("qid", "key_json").join(names, "key_json").select("qid", "file", "tier", "rank")
    if vector_tier:
        near = locate_by_vector(units, queries.select("qid", "repo_name", "vec"))
        ranked = ranked.unionByName(near.select("qid", "file", F.lit(1000).alias("tier"), "rank"))
    return rrf_tiers(ranked, ["qid"], "file", "tier", k)


def ground_order(pool: DataFrame, order: DataFrame, by: list[str], item: str) -> DataFrame:
    """Reorder a pool (by..., item, rank) by an outside order (by..., item, pos).

    Only pool members stay; members the order leaves out follow in pool order.
    """
    first = order.groupBy(*by, item).agg(F.min("pos").alias("_pos"))
    w = W.partitionBy(*by).orderBy(F.col("_pos").isNull(), F.col("_pos"), F.col("rank"))
    return (pool.join(first, [*by, item], "left").withColumn("new_rank", F.row_number().over(w))
            .drop("_pos", "rank").withColumnRenamed("new_rank", "rank"))


def parse_order(pool: DataFrame, replies: DataFrame, by: list[str], item: str) -> DataFrame:
    """Order (by..., item, pos) named by a free-text reply(by..., reply): comma or newline parts that
    equal a member, case-insensitively; a reply that names none orders members by first mention."""
    parts = replies.select(*by, F.posexplode(F.split(F.regexp_replace("reply", "\n", ","), ",")).alias("pos", "part"))
    said = parts.select(*by, "pos", F.lower(F.trim("part")).alias("_low"))
    members = pool.withColumn("_low", F.lower(item))
    exact = members.join(said, [*by, "_low"]).select(*by, item, "pos")
    silent = replies.join(exact.select(*by).distinct(), by, "left_anti")
    mention = members.join(silent, by).select(
        *by, item, F.instr(F.lower("reply"), F.col("_low")).alias("pos")).where(F.col("pos") > 0)
    return exact.unionByName(mention)


def judge_repos(base: DataFrame, order: DataFrame, top: int = 5) -> DataFrame:
    """Outside order of the first `top` repos of a ranking, as a score ladder; the others score 0."""
    pool = base.where(F.col("rank") <= top).select("case_id", "repo", "rank")
    ladder = ground_order(pool, order, ["case_id"], "repo")
    size = W.partitionBy("case_id")
    scores = ladder.withColumn("score", (F.count("*").over(size) - F.col("rank") + 1).cast("double"))
    alone = F.count("*").over(size) <= 1
    rows = base.select("case_id", "repo", "rank", F.col("score").alias("base_score")).join(
        scores.select("case_id", "repo", "score", alone.alias("alone")), ["case_id", "repo"], "left")
    w = size.orderBy(F.col("score").desc(), F.col("old_rank"))
    return (rows.withColumn("alone", F.coalesce(F.max("alone").over(size), F.lit(True)))
            .withColumn("score", F.when(F.col("alone"), F.col("base_score")).otherwise(F.coalesce("score", F.lit(0.0))))
            .withColumnRenamed("rank", "old_rank").withColumn("rank", F.row_number().over(w))
            .select("case_id", "repo", "score", "rank"))


def split_index(ranking: DataFrame, files: DataFrame) -> DataFrame:
    """One row per case from two independent arms: the ranked repos and the located files."""
    repos = ranking.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "repo"))).alias("r"))
    found = files.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "file"))).alias("f"))
    return repos.join(found, "case_id", "left").select(
        "case_id", F.transform("r", lambda x: x["repo"]).alias("ranked"),
        F.coalesce(F.transform("f", lambda x: x["file"]), F.array().cast("array<string>")).alias("locations"))

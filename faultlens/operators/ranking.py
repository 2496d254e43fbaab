"""Repository ranking: membership, overlap, vector, routing, prior and prose rankers, and decisions.

Every ranker returns (case_id, repo, score, rank) over the whole candidate catalog of a case; ties
follow catalog order, then name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultlens import fixed_values as V
from faultlens.functions import text as T
from faultlens.operators import lexical
from faultlens.session import cut, join_sized


def candidates(cases: DataFrame, catalog: DataFrame, case_catalog: DataFrame | None = None) -> DataFrame:
    """(case_id, repo, pos): a case's own catalog when it has one, else the global one.

    catalog is (repo[, pos]) and is a dimension (the fleet); case_catalog is (case_id, repo[, pos]).
    """
    whole = _positioned(catalog, [])
    if case_catalog is None:
        return _spread(cases.select("case_id"), whole)
    own = _positioned(case_catalog, ["case_id"])
    rest = cases.select("case_id").join(own.select("case_id").distinct(), "case_id", "left_anti")
    return _spread(rest, whole).unionByName(own.join(cases.select("case_id"), "case_id", "left_semi"))


def _positioned(catalog: DataFrame, by: list[str]) -> DataFrame:
    if "pos" in catalog.columns:
        return catalog.select(*by, "repo", "pos")
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("repo")
    return catalog.select(*by, "repo").distinct().withColumn("pos", F.row_number().over(w))


def _spread(cases: DataFrame, whole: DataFrame) -> DataFrame:
    """Every case with every fleet repo: the fleet travels as one array row, then explodes per case."""
    fleet = whole.agg(F.sort_array(F.collect_list(F.struct("pos", "repo"))).alias("fleet")).withColumn("one", F.lit(1))
    each = cases.withColumn("one", F.lit(1)).join(F.broadcast(fleet), "one")
    return each.select("case_id", F.explode("fleet").alias("f")).select("case_id", "f.repo", "f.pos")


def rank_scores(scored: DataFrame) -> DataFrame:
    """Rank (case_id, repo, pos, score) best first; stable by catalog position."""
    w = W.partitionBy("case_id").orderBy(F.col("score").desc(), F.col("pos"), F.col("repo"))
    return scored.withColumn("rank", F.row_number().over(w))


def fill_catalog(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """Catalog rows with their score, 0 where nothing matched."""
    got = cands.join(scores, ["case_id", "repo"], "left")
    return got.withColumn("score", F.coalesce("score", F.lit(0.0)))


def catalogs_of(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, cat) and (cat, repo): cases whose candidates are the same repos share a catalog, so that each is searched once."""
    sums = cands.groupBy("case_id").agg(F.struct(
        F.count("repo").alias("n"), F.bit_xor(F.xxhash64("repo")).alias("x"), F.sum(F.xxhash64(F.lit(1), "repo").cast("decimal(20,0)")).alias("s")).alias("_c"))
    of = cut(sums.select("case_id", F.xxhash64("_c").alias("cat")))
    one = of.groupBy("cat").agg(F.min("case_id").alias("case_id"))
    return of, cut(cands.join(one, "case_id").select("cat", "repo").distinct())


def membership(units: DataFrame, tokens: DataFrame, cands: DataFrame, k: int = V.TOKEN_TOP_K) -> DataFrame:
    """Distinct signal tokens whose best-k hits among the case's candidates include the repo; tokens is (case_id, token)."""
    of, catalogs = catalogs_of(cands)
    asked = tokens.select("case_id", "token").distinct().join(of, "case_id")
    hits = lexical.token_hits(units, asked, k, catalogs).select("token", "cat", "repo").distinct()
    votes = join_sized(hits, asked, ["token", "cat"])
    scores = votes.groupBy("case_id", "repo").agg(
        F.count("*").cast("double").alias("score"), F.array_sort(F.collect_list("token")).alias("evidence"))
    return rank_scores(fill_catalog(cands, scores))


def prefix_overlap(tokens: DataFrame, dictionary: DataFrame, cands: DataFrame) -> DataFrame:
    """Signal tokens that overlap a repo's dictionary; dictionary is (repo, entry).

    A token counts when it equals an entry, extends it past a dot, is a prefix of it, or contains its
    first segment. Each test is an equi-join: dotted prefixes of the token, prefixes of the entry,
    and the first segment found by fixed-length substrings of the token. Words are taken apart once, whatever repos and
    tokens share them: prefixes are those of distinct entries, and a segment holds no dot, so only substrings of the tokens' distinct segments are met.
    """
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # substrings outgrow the words they are made from
    toks = tokens.select("case_id", "token").distinct()
    asked = toks.select("token").distinct()
    parts = F.split("token", r"\.")
    dotted = asked.select("token", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("entry"))
    heads = dictionary.select("entry").distinct().repartition(tasks).select("entry", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("entry")), lambda i: F.substring(F.col("entry"), F.lit(1), i))).alias("token"))
    met = dotted.unionByName(heads.join(asked, "token").select("token", "entry"))
    whole = met.join(dictionary.select("repo", "entry"), "entry").select("token", "repo")
    firsts = dictionary.select("repo", F.substring_index("entry", ".", 1).alias("seg")).distinct()
    sizes = firsts.select(F.length("seg").alias("size")).distinct()
    pieces = asked.select("token", F.explode(F.array_distinct(parts)).alias("part"))
    fitting = F.filter("sizes", lambda n: n <= F.length("part"))
    grams = (pieces.select("part").distinct().repartition(tasks).withColumn("one", F.lit(1))
             .join(F.broadcast(sizes.agg(F.collect_set("size").alias("sizes")).withColumn("one", F.lit(1))), "one")
             .select("part", F.explode(F.array_distinct(F.flatten(F.transform(fitting, lambda n: F.transform(
                 F.sequence(F.lit(1), F.length("part") - n + 1), lambda i: F.substring(F.col("part"), i, n)))))).alias("seg")))
    holds = grams.join(firsts, "seg").select("part", "repo").distinct().join(pieces, "part").select("token", "repo")
    pairs = whole.unionByName(holds).distinct()
    votes = join_sized(pairs, toks, ["token"])
    scores = votes.groupBy("case_id", "repo").agg(
        F.count("*").cast("double").alias("score"), F.array_sort(F.collect_list("token")).alias("evidence"))
    return rank_scores(fill_catalog(cands, scores))


def vector_ranking(hits: DataFrame, cands: DataFrame) -> DataFrame:
    """Best cosine per repo over vector hits(case_id, repo, score), floored at 0; hits are searched among the case's candidates."""
    best = hits.groupBy("case_id", "repo").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))
    return rank_scores(fill_catalog(cands, best))


def base_rank_terms(base: DataFrame) -> DataFrame:
    """1/(60+i) with i from 0 over the nonzero rows of a ranking."""
    w = W.partitionBy("case_id").orderBy("rank")
    return (base.where(F.col("score") > 0).withColumn("i", F.row_number().over(w) - 1)
            .select("case_id", "repo", (F.lit(1.0) / (V.RRF_K + F.col("i"))).alias("term")))


def routing_fusion(base: DataFrame, routed: DataFrame) -> DataFrame:
    """Base rank term plus a flat bonus for routed repos; base covers the whole catalog.

    routed is distinct (case_id, repo); repos outside the catalog are ignored.
    """
    terms = base_rank_terms(base).withColumnRenamed("term", "fts")
    bonus = routed.select("case_id", "repo").distinct().withColumn("route", F.lit(V.ROUTING_WEIGHT / V.RRF_K))
    rows = base.select("case_id", "repo", "pos").join(terms, ["case_id", "repo"], "left").join(
        bonus, ["case_id", "repo"], "left")
    evidence = F.filter(F.array(F.when(F.col("fts").isNotNull(), F.lit("fts")),
                                F.when(F.col("route").isNotNull(), F.lit("route"))), lambda x: x.isNotNull())
    score = F.coalesce("fts", F.lit(0.0)) + F.coalesce("route", F.lit(0.0))
    return rank_scores(rows.select("case_id", "repo", "pos", score.alias("score"), evidence.alias("evidence")))


def route_tokens(tokens: DataFrame, routes: DataFrame, sonames: DataFrame) -> DataFrame:
    """Distinct (case_id, repo) of the longest namespace prefix and of exact sonames.

    tokens is (case_id, family, token); routes is (prefix, repo); sonames is (soname, repo).
    """
    names = tokens.where(F.col("family").isin("packages", "classes")).select("case_id", "token").distinct()
    parts = F.split("token", r"\.")
    prefixes = names.select("case_id", "token", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("prefix"))
    found = join_sized(prefixes, routes, ["prefix"])
    by_name = (found.groupBy("case_id", "token").agg(F.max_by("repo", F.length("prefix")).alias("repo"))
               .select("case_id", "repo"))
    libs = tokens.where(F.col("family") == "libraries").select("case_id", F.col("token").alias("soname"))
    by_soname = join_sized(libs, sonames, ["soname"]).select("case_id", "repo")
    return by_name.unionByName(by_soname).distinct()


def component_prior(base: DataFrame, cases: DataFrame, weights: DataFrame,
                    weight: float = V.COMPONENT_WEIGHT) -> DataFrame:
    """Base rank term plus affinity weight; weights is (component, repo, w) or (case_id, repo, w)."""
    if "case_id" in weights.columns:
        boost = weights.select("case_id", "repo", "w")
    else:
        boost = join_sized(cases.select("case_id", "component"), weights, ["component"]).select("case_id", "repo", "w")
    rows = base.select("case_id", "repo", "pos").join(base_rank_terms(base), ["case_id", "repo"], "left").join(
        boost, ["case_id", "repo"], "left")
    score = F.coalesce("term", F.lit(0.0)) + F.lit(weight) * F.coalesce("w", F.lit(0.0))
    return rank_scores(rows.select("case_id", "repo", "pos", score.alias("score")))


def affinity_counts(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, repo, n) over answerable, non-negative cases with a component."""
    rows = cases.join(labels, "case_id").withColumn("component", F.trim("component"))
    usable = ((F.col("component") != "") & (F.coalesce("owning_repo", F.lit("")) != "")
              & ~F.col("owning_repo").isin(*V.NEGATIVE_OWNERS) & F.coalesce("is_answerable", F.lit(True)))
    return (rows.where(usable).groupBy("component", F.col("owning_repo").alias("repo"))
            .agg(F.count("*").alias("n")))


def affinity_weights(counts: DataFrame) -> DataFrame:
    """Counts normalised to 1 per component."""
    total = counts.groupBy("component").agg(F.sum("n").alias("total"))
    return (counts.join(total, "component").where((F.col("n") > 0) & (F.col("total") > 0))
            .select("component", "repo", (F.col("n") / F.col("total")).alias("w")))


def affinity_leave_one_out(counts: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, repo, w): weights without the case's own unit; cases is (case_id, component, owner).

    Only (component, owner) pairs are expanded, so equal cases share one computation.
    """
    pairs = cases.select("component", "owner").distinct()
    left = pairs.join(counts, "component").withColumn(
        "n", F.col("n") - F.when(F.col("repo") == F.col("owner"), 1).otherwise(0)).where(F.col("n") > 0)
    total = left.groupBy("component", "owner").agg(F.sum("n").alias("total"))
    loo = left.join(total, ["component", "owner"]).select(
        "component", "owner", "repo", (F.col("n") / F.col("total")).alias("w"))
    return join_sized(cases.select("case_id", "component", "owner"), cut(loo), ["component", "owner"]).select(
        "case_id", "repo", "w")


def prose_ranking(profile_hits: DataFrame, cands: DataFrame, log_ranking: DataFrame | None = None) -> DataFrame:
    """Best profile cosine per repo plus a rank-decayed bonus from a log ranking."""
    scored = vector_ranking(profile_hits, cands).drop("rank")
    if log_ranking is not None:
        w = W.partitionBy("case_id").orderBy("rank")
        bonus = (log_ranking.where(F.col("score") > 0).withColumn("i", F.row_number().over(w))
                 .select("case_id", "repo", (F.lit(V.LOG_WEIGHT) / F.col("i")).alias("bonus")))
        scored = scored.join(bonus, ["case_id", "repo"], "left").withColumn(
            "score", F.col("score") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")
    return rank_scores(scored)


def dispatch(is_prose: DataFrame, prose: DataFrame, fault: DataFrame, fault_scale: float = 1.0) -> DataFrame:
    """Rows of the prose ranking for prose cases, else of the fault ranking on the prose score scale.

    is_prose is (case_id, is_prose).
    """
    keep = ["case_id", "repo", "pos", "score", "rank"]
    flags = is_prose.select("case_id", "is_prose")
    left = prose.select(*keep).join(flags.where("is_prose"), "case_id", "left_semi")
    right = fault.select(*keep).join(flags.where("NOT is_prose"), "case_id", "left_semi")
    return left.unionByName(right.withColumn("score", F.col("score") * fault_scale))


def decide(ranking: DataFrame, tau_margin: float | Column, tau_score: float | Column,
           by: list[str] | None = None) -> DataFrame:
    """Top-1 or abstain per case: margin to the runner-up and top score against the thresholds."""
    by = by or ["case_id"]
    first = F.col("rank") == 1
    tops = ranking.where(F.col("rank") <= 2).groupBy(*by).agg(
        F.max(F.when(first, F.col("repo"))).alias("top1"), F.max(F.when(first, F.col("score"))).alias("top1_score"),
        F.max(F.when(~first, F.col("score"))).alias("runner"))
    margin = F.col("top1_score") - F.coalesce("runner", F.lit(0.0))
    tau_m = F.lit(tau_margin) if isinstance(tau_margin, (int, float)) else tau_margin
    tau_s = F.lit(tau_score) if isinstance(tau_score, (int, float)) else tau_score
    sure = (margin >= tau_m) & (F.col("top1_score") >= tau_s)
    return tops.select(*by, F.when(sure, F.col("top1")).alias("predicted"), margin.alias("margin"), "top1_score")


def run_arms(rankings: dict[str, tuple[DataFrame, float, float]]) -> DataFrame:
    """Match records (case_id, arm, ranked_names, scores, predicted, margin, top1_score) of all arms."""
    out = None
    for arm, (ranking, tau_margin, tau_score) in rankings.items():
        rows = ranking.select("case_id", "repo", "score", "rank")
        listed = rows.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "repo", "score"))).alias("r"))
        rec = (listed.join(decide(rows, tau_margin, tau_score), "case_id")
               .select("case_id", F.lit(arm).alias("arm"), F.transform("r", lambda x: x["repo"]).alias("ranked_names"),
                       F.transform("r", lambda x: x["score"]).alias("scores"), "predicted", "margin", "top1_score"))
        out = rec if out is None else out.unionByName(rec)
    return out

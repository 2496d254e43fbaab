"""Inverted index and BM25 search over unit rows.

Units are rows (uid, repo, kind, name, qualified_name, file, text, ...). Scores follow the full-text
engine's convention: lower is better, corpus statistics are global and filters apply after scoring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultlens import fixed_values as V
from faultlens.functions import text as T
from faultlens.session import cut, join_sized, salted_join, scratch_path, small, spread

PAIRS = 2_000_000  # meetings of a query's term with a unit that one task adds up
OWN_TERMS = 8  # at most so many of a query's rarest terms are looked up for it alone


@dataclass(frozen=True)
class Index:
    """Units and their postings(uid, repo, kind, term, len, tf), with one ALL_DOCS row per unit."""

    units: DataFrame
    postings: DataFrame


ALL_DOCS = ""  # pseudo-term carried by every unit, so one pass yields postings and corpus statistics


def counted(terms: Column) -> Column:
    """(term, tf) of an array's distinct members: counted in their sorted order, within the row."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return T.let(starts, lambda at: F.transform(at, lambda b, j: F.struct(
            F.element_at(s, b).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s) + 1) - b).cast("long").alias("tf"))))
    return T.let(F.sort_array(terms), runs)


def build_index(units: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """Postings of all terms, or only of a vocabulary(term) when the queries are known up front.

    A unit's terms are counted within its row and restricted to the vocabulary before anything is shuffled. uid is the units' key.
    """
    indexed = F.concat_ws(" ", "name", "qualified_name", "text")
    terms = spread(units).where(F.col("uid").isNotNull()).select("uid", "repo", "kind", T.index_terms(indexed).alias("terms"))
    rows = terms.select("uid", "repo", "kind", F.size("terms").alias("len"), counted(F.concat(F.array(F.lit(ALL_DOCS)), "terms")).alias("terms"))
    # explode() would count once more, to leave out empty arrays; none is empty here
    postings = rows.select("uid", "repo", "kind", "len", F.explode_outer("terms").alias("t")).select("uid", "repo", "kind", "t.term", "len", "t.tf")
    if vocabulary is not None:
        words = vocabulary.select("term").distinct()
        everyone = words.sparkSession.range(1).select(F.lit(ALL_DOCS).alias("term"))
        words = words.unionByName(everyone)
        postings = postings.join(F.broadcast(words) if small(words) else words, "term", "left_semi")
    return Index(units, postings)


def written(index: Index) -> Index:
    """The index with its postings in the shared folder, so that several passes tokenise once."""
    path = scratch_path(index.postings.sparkSession, "postings")
    index.postings.write.parquet(path)
    return replace(index, postings=index.postings.sparkSession.read.schema(index.postings.schema).parquet(path))


def term_weights(index: Index) -> DataFrame:
    """(term, df, avg_len, idf) from the whole corpus; terms without positive weight get the floor."""
    freq = index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("total_len"))
    everyone = F.col("term") == ALL_DOCS
    corpus = freq.agg(F.max(F.when(everyone, F.col("df"))).alias("n"), F.max(F.when(everyone, F.col("total_len") / F.col("df"))).alias("avg_len"))
    stats = freq.withColumn("one", F.lit(1)).join(F.broadcast(corpus.withColumn("one", F.lit(1))), "one")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return stats.select("term", "df", "avg_len", F.when(idf > 0, idf).otherwise(F.lit(V.BM25_MIN_IDF)).alias("idf"))


def query_vocabulary(queries: DataFrame) -> DataFrame:
    """(qid, term) rows of queries(qid, query)."""
    return queries.select("qid", F.explode(T.query_terms(F.col("query"))).alias("term"))


def _part() -> Column:
    """What a posting adds to a score."""
    norm = V.BM25_K1 * (F.lit(1 - V.BM25_B) + V.BM25_B * F.col("len") / F.col("avg_len"))
    return F.col("idf") * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + norm)


def bm25(postings: DataFrame, weighted: DataFrame) -> DataFrame:
    """(qid, uid, repo, score) of every unit matching any term of a query; weighted is (qid, term, avg_len, idf[, repo]).

    A query with a repo meets only that repo's postings. Postings are dealt by unit over as many tasks as keep about PAIRS meetings in each.
    """
    on = ["term", "repo"] if "repo" in weighted.columns else ["term"]
    asked = weighted.groupBy(*on).agg(F.count("*").alias("_asked"))
    met = postings.groupBy(*on).agg(F.count("*").alias("_n")).join(asked, on).agg(F.sum(F.col("_n") * F.col("_asked"))).first()[0] or 0
    tasks = max(postings.sparkSession.sparkContext.defaultParallelism, math.ceil(met / PAIRS))
    if small(weighted):
        hits = postings.repartition(tasks, "uid").join(F.broadcast(weighted), on)
    else:
        hits = salted_join(postings, weighted, on).repartition(tasks, "uid")
    return hits.groupBy("qid", "uid", "repo").agg(F.round(-F.sum(_part()), 9).alias("score"))


def _split(rows: DataFrame, scope: list[str]) -> DataFrame:
    """(qid, scope, t, own, rest) of rows(qid, scope, term, df): a query's (df, term) in rising order, how many of them are looked up for it alone,
    and the name of what is left, which queries may share.

    Of the first OWN_TERMS cuts the one is taken that meets the fewest units, those of shared terms being divided by the queries that share them.
    """
    lists = cut(rows.groupBy("qid", *scope).agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t")))

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x["df"])
    cuts = lists.select("qid", *scope, "t", F.explode(F.sequence(F.lit(0), F.least(F.size("t"), F.lit(OWN_TERMS)))).alias("own"))
    left = F.slice("t", F.col("own") + 1, F.size("t"))
    named = cuts.select("qid", *scope, "own", F.sha1(F.array_join(F.transform(left, lambda x: x["term"]), "\0")).alias("rest"),
                        (total(F.slice("t", 1, F.col("own"))) * F.size("t")).alias("alone"), total(left).alias("common"))
    shares = named.groupBy("rest", *scope).agg(F.count("*").alias("_by"))
    priced = join_sized(named, shares, ["rest", *scope])
    best = priced.groupBy("qid", *scope).agg(F.min_by(F.struct("own", "rest"), F.struct(F.col("alone") + F.col("common") / F.col("_by"), "own")).alias("b"))
    return lists.join(best, ["qid", *scope]).select("qid", *scope, "t", "b.own", "b.rest")


def _best(index: Index, terms: DataFrame, k: int | None, repos: list[str] | None = None, kinds: list[str] | None = None, by_repo: bool = False) -> DataFrame:
    """The k best units (qid, uid, repo, score, rank) per query, or per query and repo, of terms(qid, term[, repo]).

    A query's rarest terms are looked up for it alone, and the units that hold one are scored in full; what queries have in common beyond those
    is searched once for all of them. Every unit of the result is among the former or among the k best of the latter: a unit without own terms
    scores the same there, and whatever is ahead of it there is ahead of it in the whole.
    """
    scope = ["repo"] if "repo" in terms.columns else []
    by = ["qid", "repo"] if by_repo else ["qid"]
    order = [F.col("score"), F.col("uid")]
    index = written(index)
    weights = cut(join_sized(term_weights(index), terms.select("term").distinct(), ["term"], "left_semi"))
    postings = filter_units(index.postings.where(F.col("term") != ALL_DOCS), repos, kinds)
    rows = cut(join_sized(terms, weights, ["term"]))
    if k is None:
        return top_k(bm25(postings, rows.drop("df")), None, by, order)
    parts = cut(_split(rows, scope))
    weights = weights.drop("df")
    rest = parts.where(F.col("own") < F.size("t"))
    sets = rest.groupBy("rest", *scope).agg(F.min_by(F.slice("t", F.col("own") + 1, F.size("t")), "qid").alias("t"))
    asked = cut(join_sized(sets.select(F.col("rest").alias("qid"), *scope, F.explode("t.term").alias("term")), weights, ["term"]))
    shared = cut(top_k(bm25(postings, asked), k, ["qid", "repo"] if scope else by, order).drop("rank"))
    on = ["rest", *(["repo"] if scope else [])]
    found = join_sized(rest.select("qid", *on), shared.withColumnRenamed("qid", "rest"), on).select("qid", "uid", "repo", "score")
    own = parts.where("own > 0").select("qid", *scope, F.explode(F.slice("t.term", F.lit(1), F.col("own"))).alias("term"))
    held = salted_join(postings, own, ["term", *scope]).select("qid", "uid").distinct()
    wanted = held.join(rows.join(parts.where("own > 0").select("qid"), "qid", "left_semi").drop("df", *scope), "qid")
    full = wanted.join(postings, ["uid", "term"]).groupBy("qid", "uid", "repo").agg(F.round(-F.sum(_part()), 9).alias("score"))
    both = found.unionByName(full.select("qid", "uid", "repo", "score")).groupBy("qid", "uid", "repo").agg(F.min("score").alias("score"))
    return top_k(both, k, by, order)


def top_k(scored: DataFrame, k: int | None, by: list, order: list, name: str = "rank") -> DataFrame:
    """First k rows per key, None for all ranked; each partition keeps only its own first k before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    ranked = scored.withColumn(name, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def keyword_search(index: Index, queries: DataFrame, k: int = 20, repos: list[str] | None = None,
                   kinds: list[str] | None = None, scope: str | None = None) -> DataFrame:
    """Best k units per query(qid, query): (qid, uid, repo, kind, file, score, rank).

    repos / kinds filter the units after scoring, an empty list is no filter. scope names a column of
    queries holding the one repo a query may see, whose postings alone it meets.
    """
    terms = query_vocabulary(queries)
    if scope:
        terms = join_sized(terms, queries.select("qid", F.col(scope).alias("repo")), ["qid"])
    hits = cut(_best(index, terms, k, repos, kinds))
    return hits.drop("repo").join(filter_units(index.units, repos, kinds).select("uid", "repo", "kind", "file"), "uid")


def filter_units(units: DataFrame, repos: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """repo IN / kind IN; pushed down to the scan."""
    if repos:
        units = units.where(F.col("repo").isin(*repos))
    if kinds:
        units = units.where(F.col("kind").isin(*kinds))
    return units


def token_hits(units: DataFrame, tokens: DataFrame, k: int = V.TOKEN_TOP_K, catalogs: DataFrame | None = None) -> DataFrame:
    """Best k units of every distinct token: (token, uid, repo, kind, file, score, rank).

    Equal tokens of different cases are searched once. With catalogs(cat, repo), tokens is (token, cat) and the k best are those within the
    token's catalog: every token is searched once, its k best of each repo are kept and meet the catalogs, which cut last. Result rows carry cat.
    """
    asked = tokens.select("token").distinct().select(F.col("token").alias("qid"), F.col("token").alias("query"))
    index = build_index(units, query_vocabulary(asked))
    if catalogs is None:
        return keyword_search(index, asked, k).withColumnRenamed("qid", "token")
    fleet = catalogs.select("cat", "repo").distinct()
    hits = cut(_best(index, query_vocabulary(asked), k, by_repo=True).drop("rank").withColumnRenamed("qid", "token"))
    catted = join_sized(tokens.select("token", "cat").distinct(), fleet, ["cat"])
    best = top_k(join_sized(hits, catted, ["token", "repo"]), k, ["token", "cat"], [F.col("score"), F.col("uid")])
    return best.drop("repo").join(units.select("uid", "repo", "kind", "file"), "uid")


def search(units: DataFrame, queries: DataFrame, k: int = 20, **filters) -> DataFrame:
    """keyword_search over units when there is no stored index."""
    return keyword_search(build_index(units, query_vocabulary(queries)), queries, k, **filters)


def nearest_symbols(units: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """Symbols of a repo closest to a name; names is (qid, repo_name, query)."""
    return search(units, names, k, kinds=["symbol"], scope="repo_name")


def symbols_exist(units: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, name, exists): is there a symbol row carrying the name or qualified name."""
    symbols = units.where(F.col("kind") == "symbol")
    known = (symbols.select("repo", F.explode(F.array("name", "qualified_name")).alias("name"))
             .where(F.col("name").isNotNull()).distinct().withColumn("exists", F.lit(True)))
    return names.join(known, ["repo", "name"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def files_of(hits: DataFrame, k: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Files in first-hit order: (by..., file, rank); k keeps the first k after path normalisation."""
    by = by or ["qid"]
    seen = (hits.where(F.coalesce("file", F.lit("")) != "")
            .withColumn("file", T.norm_path(F.col("file")) if k else F.col("file"))
            .groupBy(*by, "file").agg(F.min("rank").alias("_first")))
    w = W.partitionBy(*by).orderBy("_first", "file")
    ranked = seen.withColumn("rank", F.row_number().over(w)).drop("_first")
    return ranked.where(F.col("rank") <= k) if k else ranked


def locate_files(units: DataFrame, queries: DataFrame, k: int = 20, top: int | None = None) -> DataFrame:
    """Keyword file localization in the query's repo: symbol hits only, files deduped in rank order."""
    hits = search(units, queries, k, kinds=["symbol"], scope="repo_name")
    return files_of(hits, top)


def rare_anchors(units: DataFrame, anchors: DataFrame, max_files: int = 10, max_anchors: int = 6) -> DataFrame:
    """Anchors of a query that point at few files, rarest first.

    anchors is (qid, repo_name, pos, anchor); an anchor stays when its best max_files+1 hits name
    between one and max_files distinct files.
    """
    asked = (anchors.select("repo_name", F.col("anchor").alias("query")).distinct()
             .withColumn("qid", F.sha1(F.concat_ws("\u0000", "repo_name", "query"))))
    hits = search(units, asked, max_files + 1, kinds=["symbol"], scope="repo_name")
    spread = (hits.where(F.coalesce("file", F.lit("")) != "").groupBy("qid")
              .agg(F.countDistinct("file").alias("n_files"))
              .where(F.col("n_files").between(1, max_files)))
    kept = asked.join(spread, "qid").select("repo_name", F.col("query").alias("anchor"), "n_files")
    found = join_sized(kept, anchors, ["repo_name", "anchor"])
    return top_k(found, max_anchors, ["qid"], [F.col("n_files"), F.col("pos")])

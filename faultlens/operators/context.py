"""Candidate pools, module documents, context blocks and plan grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import text as T
from faultlens.operators.lexical import top_k
from faultlens.session import cut, join_large, join_sized


def module_lut(entries: DataFrame) -> DataFrame:
    """(repo, key, files) of entities(repo, ord, module, wiki_page, file): module, page, page basename, page stem.

    The first module that claims a key keeps it; files keep their order.
    """
    files = entries.where(F.coalesce("file", F.lit("")) != "").groupBy("repo", "module", "wiki_page", "file").agg(F.min("ord").alias("ord"))
    listed = files.groupBy("repo", "module", "wiki_page").agg(
        F.min("ord").alias("ord"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "file"))), lambda x: x["file"]).alias("files"))
    page = F.coalesce("wiki_page", F.lit(""))
    keys = F.array("module", page, T.basename(page), F.regexp_replace(page, r"\.[^.]*\z", ""))
    rows = listed.select("repo", "ord", "module", "files", F.explode(T.distinct_tokens(keys)).alias("key"))
    return rows.groupBy("repo", "key").agg(F.min_by(F.struct("files"), F.struct("ord", "module")).alias("f")).select("repo", "key", "f.files")


def candidate_pool(hits: DataFrame, lut: DataFrame, k: int = 20) -> DataFrame:
    """(qid, file, rank, wiki): symbol hits keep their file, doc hits become their module's files.

    hits is (qid, rank, repo, kind, file, module, snippet). Doc hits without a module are dropped.
    """
    base = T.basename(F.col("file"))
    keys = T.non_empty(F.array("module", "file", base, F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*\z", ""))))
    docs = hits.where("kind = 'doc'").select("qid", "rank", "repo", "snippet", F.posexplode(keys).alias("kp", "key"))
    found = join_sized(docs, lut, ["repo", "key"])
    mapped = found.groupBy("qid", "rank").agg(F.min_by(F.struct("files", "snippet"), "kp").alias("m"))
    from_docs = mapped.select("qid", "rank", F.posexplode("m.files").alias("pos", "file"), F.col("m.snippet").alias("wiki"))
    none = F.lit(None).cast("string")
    from_symbols = hits.where("kind <> 'doc'").select("qid", "rank", F.lit(0).alias("pos"), "file", none.alias("wiki"))
    rows = from_docs.unionByName(from_symbols).where(F.coalesce("file", F.lit("")) != "")
    pool = rows.groupBy("qid", "file").agg(F.min(F.struct("rank", "pos")).alias("at"),
                                           F.min_by("wiki", F.when(F.col("wiki").isNotNull(), F.struct("rank", "pos"))).alias("wiki"))
    return top_k(pool, k, ["qid"], [F.col("at"), F.col("file")]).drop("at")


def context_blocks(pool: DataFrame, sources: DataFrame, graph_bits: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(qid, file, context) of pool(qid, repo, file, snippet, wiki): source, module and graph text, each cut to max_chars and all to three times that.

    sources is (repo, file, text); graph_bits is (qid, file, bits).
    """
    rows = join_sized(pool, sources.select("repo", "file", F.col("text").alias("source")), ["repo", "file"], "left").join(
        graph_bits, ["qid", "file"], "left")

    def part(label: str, c) -> F.Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), T.first_chars(c, max_chars)))

    src = F.coalesce(F.nullif("source", F.lit("")), "snippet")
    text = F.concat_ws("\n", part("SOURCE", src), part("WIKI", F.col("wiki")), part("GRAPH", F.col("bits")))
    return rows.select("qid", "file", T.first_chars(text, max_chars and 3 * max_chars).alias("context"))


def module_docs(docs: DataFrame) -> DataFrame:
    """(repo, module, doc): a module's doc sections in order; docs is (repo, module, ord, text)."""
    rows = docs.where(F.coalesce("text", F.lit("")) != "").groupBy("repo", "module").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("d"))
    return rows.select("repo", "module", F.array_join(F.transform("d", lambda x: x["text"]), "\n\n").alias("doc"))


def file_docs(files: DataFrame, entries: DataFrame, docs: DataFrame, max_chars: int | None = None, max_files: int | None = None) -> DataFrame:
    """(case_id, block) rows: the (first) files of a case with their module's document, equal documents once.

    Files meet a digest of the document; its text joins last and is not shuffled with them.

    files is (case_id, repo, pos, file); entries is (repo, ord, module, file). A file is looked up by
    its path, then by its basename.
    """
    known = entries.where(F.coalesce("file", F.lit("")) != "")
    first = known.groupBy("repo", "file").agg(F.min(F.struct("ord", "module")).alias("m"))
    by_path = first.select("repo", F.col("file").alias("key"), F.lit(0).alias("o"), "m")
    by_base = first.select("repo", T.basename(F.col("file")).alias("key"), F.lit(1).alias("o"), "m")
    lut = by_path.unionByName(by_base).groupBy("repo", "key").agg(F.min(F.struct("o", "m")).alias("x")).select("repo", "key", F.col("x.m.module").alias("module"))
    picked = top_k(files, max_files, ["case_id"], [F.col("pos")])
    hit = join_sized(picked.withColumn("key", F.col("file")), lut, ["repo", "key"], "left").withColumnRenamed("module", "m1").drop("key")
    hit = join_sized(hit.withColumn("key", T.basename(F.col("file"))), lut, ["repo", "key"], "left")
    named = hit.withColumn("module", F.coalesce("m1", "module")).where(F.col("module").isNotNull())
    texts = module_docs(docs).withColumn("doc", F.trim("doc")).where(F.col("doc") != "")
    texts = cut(texts.select("repo", "module", F.sha2("doc", 256).alias("digest"), T.first_chars(F.col("doc"), max_chars).alias("head")))
    same = join_sized(named, texts.select("repo", "module", "digest"), ["repo", "module"])
    once = same.groupBy("case_id", "digest").agg(F.min(F.struct("pos", "file", "repo", "module")).alias("f"))
    return join_large(once.select("case_id", "f.*"), texts.drop("digest"), ["repo", "module"]).select(
        "case_id", "pos", F.concat(F.lit("## "), "file", F.lit("\n"), "head").alias("block"))


def symbol_context(symbols: DataFrame, snippets: DataFrame, edges: DataFrame, max_chars: int | None = None, max_symbols: int | None = None,
                   max_neighbours: int | None = None) -> DataFrame:
    """(case_id, rank, block): source and first neighbours of the first symbols that have either.

    symbols is (case_id, pos, symbol); snippets is (symbol, snippet); edges is (caller, callee).
    """
    both = edges.select(F.col("caller").alias("symbol"), F.col("callee").alias("n")).unionByName(
        edges.select(F.col("callee").alias("symbol"), F.col("caller").alias("n"))).where(F.col("symbol") != F.col("n")).distinct()
    near = top_k(both, max_neighbours, ["symbol"], [F.col("n")]).groupBy("symbol").agg(
        F.array_join(F.array_sort(F.collect_list("n")), ", ").alias("calls"))
    asked = symbols.groupBy("case_id", "symbol").agg(F.min("pos").alias("pos"))
    rows = join_sized(join_sized(asked, snippets, ["symbol"], "left"), near, ["symbol"], "left")
    text = F.concat_ws("\n", F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("source:\n"), T.first_chars(F.col("snippet"), max_chars))),
                       F.concat(F.lit("calls: "), "calls"))
    found = rows.withColumn("body", text).where(F.col("body") != "")
    return top_k(found, max_symbols, ["case_id"], [F.col("pos")]).select(
        "case_id", "rank", F.concat(F.lit("## "), "symbol", F.lit("\n"), "body").alias("block"))


def check_plans(plans: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, ok, n_citations, n_resolved, groundedness, failures) of plans(case_id, repo, plan, candidates).

    Targets outside the candidate set, absolute or with '..' are never read. files is (repo, file, text).
    """
    rows = plans.withColumn("cand", F.transform("candidates", T.norm_path))
    live = rows.where(F.col("plan").isNotNull() & ~F.col("plan.abstain"))
    t = live.select("case_id", "repo", "cand", F.posexplode("plan.targets").alias("pos", "t"))
    safe = ~F.col("t.file").startswith("/") & ~F.array_contains(F.split("t.file", "/"), "..")
    scoped = t.withColumn("in_scope", F.array_contains("cand", T.norm_path(F.col("t.file"))) & safe).withColumn("file", F.col("t.file"))
    seen = scoped.join(files.select("repo", "file", "text"), ["repo", "file"], "left").withColumn(
        "text", F.when(F.col("in_scope"), F.col("text")))
    here = F.col("text").isNotNull()

    def word(token):
        return F.concat(F.lit(r"(?U)\b"), T.quoted(token), F.lit(r"\b"))

    symbol = F.coalesce("t.symbol", F.lit(""))
    sym_ok = here & F.regexp_like("text", word(symbol))
    per_target = seen.select(
        "case_id", (1 + F.when(symbol != "", 1).otherwise(0)).alias("cited"),
        (F.when(here, 1).otherwise(0) + F.when((symbol != "") & F.coalesce(sym_ok, F.lit(False)), 1).otherwise(0)).alias("ok"),
        F.array_compact(F.array(
            F.when(~F.col("in_scope"), F.concat(F.lit("target_out_of_scope:"), "file")).when(~here, F.concat(F.lit("target_file_missing:"), "file")),
            F.when((symbol != "") & ~F.coalesce(sym_ok, F.lit(False)), F.concat(F.lit("symbol_unresolved:"), symbol)))).alias("fails"))
    a = live.select("case_id", F.explode("plan.required_apis").alias("api"))
    api_hit = a.join(seen.where(here).select("case_id", "text"), "case_id", "left").groupBy("case_id", "api").agg(
        F.coalesce(F.bool_or(F.regexp_like("text", word(F.col("api")))), F.lit(False)).alias("hit"))
    per_api = a.join(api_hit, ["case_id", "api"]).select(
        "case_id", F.lit(1).alias("cited"), F.when(F.col("hit"), 1).otherwise(0).alias("ok"),
        F.array_compact(F.array(F.when(~F.col("hit"), F.concat(F.lit("api_unresolved:"), "api")))).alias("fails"))
    claims = per_target.unionByName(per_api).groupBy("case_id").agg(
        F.sum("cited").alias("n_citations"), F.sum("ok").alias("n_resolved"), F.array_sort(F.flatten(F.collect_list("fails"))).alias("fails"))
    p = F.col("plan")
    none = F.array().cast("array<string>")
    shape = (F.when(p.isNull(), F.array(F.lit("unparseable_plan"))).when(p["abstain"], F.array(F.lit("model_abstained"))).otherwise(
        F.array_compact(F.array(F.when(p["root_cause"] == "", F.lit("empty_root_cause")), F.when(p["strategy"] == "", F.lit("empty_strategy")),
                                F.when(F.size(p["targets"]) == 0, F.lit("no_targets"))))))
    out = rows.join(claims, "case_id", "left").withColumn("failures", F.concat(shape, F.coalesce("fails", none)))
    n, ok = F.coalesce("n_citations", F.lit(0)), F.coalesce("n_resolved", F.lit(0))
    return out.select("case_id", (F.size("failures") == 0).alias("ok"), n.alias("n_citations"), ok.alias("n_resolved"),
                      F.coalesce(F.try_divide(ok.cast("double"), n.cast("double")), F.lit(0.0)).alias("groundedness"), "failures")

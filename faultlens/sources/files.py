"""Reading whole files as rows: paths, text and JSON, and source-tree scans."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import text as T
from faultlens.operators.lexical import top_k

EMPTY = "path string, text string"


def whole_texts(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of every file a glob matches; bad UTF-8 becomes U+FFFD, no match is no rows."""
    try:
        raw = spark.read.format("binaryFile").load(glob)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], EMPTY)
    return raw.select(F.url_decode(F.col("path")).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def json_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """(path, v) of the JSON files that a glob matches."""
    return json_rows(whole_texts(spark, glob), schema)


def json_rows(texts: DataFrame, schema: str) -> DataFrame:
    """(path, v) of texts(path, text) decoded with an explicit schema; what is not JSON, or not of its shape, is dropped."""
    whole = texts.where(F.try_parse_json("text").isNotNull())
    rows = whole.withColumn("v", F.from_json("text", schema, {"mode": "PERMISSIVE"}))
    shape = "{" if schema.startswith("struct") else "["  # another value would be a struct of nulls
    return rows.where(F.col("v").isNotNull() & T.strip(F.col("text")).startswith(shape)).select("path", "v")


def segment(path: Column, back: int) -> Column:
    """Path segment counted from the end, 1 is the file name."""
    parts = F.split(path, "/")
    return F.get(parts, F.size(parts) - back)


def glob_pattern(globs: list[str]) -> str:
    """One regex for file-name globs."""
    return "|".join(re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") for g in globs)


def wanted_file(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Include and exclude rules of the tree scan on a repo-relative path."""
    include = V.INCLUDE_GLOBS if include is None else include
    exclude = V.IGNORE_GLOBS if exclude is None else exclude
    name = T.basename(path)
    anchored = lambda globs: r"\A(?:" + glob_pattern(globs) + r")\z"
    ok = path.rlike(anchored(include)) | name.rlike(anchored(include)) if include else F.lit(True)
    if not exclude:
        return ok
    folders = [g.rstrip("/") for g in exclude if g.endswith("/")]
    plain = [g for g in exclude if not any(c in g for c in "*?[")]
    parts = F.split(path, "/")
    named = F.exists(parts, lambda s: s.isin(*[g.rstrip("/") for g in plain])) if plain else F.lit(False)
    globbed = F.exists(parts, lambda s: s.rlike(anchored(exclude))) | path.rlike(anchored(exclude))
    return ok & ~(named | globbed | T.starts_any(path, folders))


def source_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(repo, path, length) below root/<repo>; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return select_files(relative(raw, root), include, exclude)


def relative(files: DataFrame, root: str) -> DataFrame:
    """Adds repo and turns the path repo-relative."""
    tail = F.substring_index(F.url_decode(F.col("path")), root.rstrip("/") + "/", -1)
    at = F.instr(tail, F.lit("/"))
    return files.withColumn("_t", tail).where(at > 0).withColumns(
        {"repo": F.substring_index("_t", "/", 1), "path": F.col("_t").substr(F.instr("_t", F.lit("/")) + 1, F.length("_t"))}).drop("_t")


def select_files(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    return files.where(wanted_file(F.col("path"), include, exclude))


def tree_summary(files: DataFrame) -> DataFrame:
    """(repo, total_files, total_size_kb)."""
    return files.groupBy("repo").agg(F.count("*").alias("total_files"), (F.sum("length") / 1024).alias("total_size_kb"))


def code_files(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Files with a known language, or one of the given ones."""
    rows = files.withColumn("language", T.language_of(F.col("path"))).where(F.col("language").isNotNull())
    return rows.where(F.col("language").isin(*languages)) if languages else rows


def lite_units(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Package, type and soname units of source files(repo, path, text); the first file wins per name. max_files keeps a repo's first files only."""
    source = files.where(T.ends_any(F.col("path"), V.LITE_EXTENSIONS))
    src = source
    if max_files is not None:
        first = top_k(source.select("repo", "path"), max_files, ["repo"], [F.col("path")]).drop("rank")
        src = source.join(first, ["repo", "path"], "left_semi")
    package = F.nullif(F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)", 1), F.lit(""))
    types = T.groups(F.col("text"), r"\b(?:class|interface|object|enum|struct)\s+([A-Z][A-Za-z0-9_]+)")
    sonames = T.groups(F.col("text"), r"\b(lib[A-Za-z0-9_]+\.so)\b")

    def row(qn: Column, kind: str) -> Column:
        return F.struct(qn.alias("qn"), F.lit(kind).alias("kind"))

    found = F.concat(
        F.array(row(F.col("package"), "package")),
        F.flatten(F.transform(types, lambda c: F.array(
            row(F.coalesce(F.concat(F.col("package"), F.lit("."), c), c), "class"), row(c, "class")))),
        F.transform(sonames, lambda s: row(s, "library")))
    rows = src.withColumn("package", package).select("repo", "path", F.posexplode(found).alias("pos", "f")).where(F.col("f.qn").isNotNull())
    best = rows.groupBy("repo", F.col("f.qn").alias("qn")).agg(F.min(F.struct("path", "pos", "f.kind")).alias("b"))
    qn = F.col("qn")
    return best.select(T.unit_uid(F.col("repo"), F.col("b.kind"), qn, qn, qn).alias("uid"), "repo", F.col("b.kind").alias("kind"),
                       F.substring_index(qn, ".", -1).alias("name"), qn.alias("qualified_name"), F.col("b.path").alias("file"),
                       F.lit("lite").alias("repo_head"), qn.alias("text"))


def text_profiles(files: DataFrame, repos: DataFrame, max_chunks: int | None = None, readme_chars: int | None = None) -> DataFrame:
    """(repo, rank, chunk): READMEs, manifest ids and path words of files(repo, path, text), shallow first.

    A repo without any chunk gets its own name.
    """
    parts = F.split("path", "/")
    live = files.where(~F.exists(parts, lambda s: s.isin(*V.PROFILE_SKIP)))
    low = F.lower(T.basename(F.col("path")))
    readme = live.where(low.startswith("readme")).select("repo", F.lit(0).alias("tier"), F.lit(0).alias("depth"), "path",
                                                         F.lit(0).alias("pos"), T.first_chars(F.col("text"), readme_chars).alias("chunk"))
    ns = r"""(?:namespace|applicationId)\s*[=(]?\s*["']([\w.]+)["']"""
    manifest = live.where(low.startswith("build.gradle") | (low == "androidmanifest.xml")).select(
        "repo", F.lit(1).alias("tier"), F.lit(0).alias("depth"), "path", F.posexplode(T.groups(F.col("text"), ns)).alias("pos", "chunk"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = live.where(F.size(parts) > 1).select("repo", F.explode(prefixes).alias("path")).distinct()
    words = F.regexp_replace("path", r"[/\-_]", " ")
    segs = folders.select("repo", F.lit(2).alias("tier"), F.size(F.filter(F.split(words, r"\s+"), lambda s: s != "")).alias("depth"), "path",
                          F.lit(0).alias("pos"), words.alias("chunk"))
    rows = readme.unionByName(manifest).unionByName(segs).withColumn("chunk", T.strip(F.col("chunk"))).where(F.col("chunk") != "")
    once = rows.groupBy("repo", "tier", "chunk").agg(F.min(F.struct("depth", "path", "pos")).alias("at"))
    kept = top_k(once, max_chunks, ["repo"], [F.col("tier"), F.col("at")]).select("repo", "rank", "chunk")
    bare = repos.select("repo").join(kept.select("repo").distinct(), "repo", "left_anti").select("repo", F.lit(1).alias("rank"), F.col("repo").alias("chunk"))
    return kept.unionByName(bare)

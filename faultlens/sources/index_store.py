"""The unit table on disk: building units, versions of a stored index, states and freshness."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from faultlens.functions import text as T
from faultlens.operators import blockmax, lexical
from faultlens.session import cut_round
from faultlens.sources import snapshots

UNIT = ["uid", "repo", "kind", "name", "qualified_name", "file", "repo_head", "text", "meta"]


def doc_units(docs: DataFrame) -> DataFrame:
    """Unit rows of wiki documents(repo, file, text, repo_head): one per markdown section."""
    rows = docs.select("repo", "file", "repo_head", F.explode(T.markdown_sections(F.col("text"))).alias("s"))
    name, none = F.col("s.heading"), F.lit(None).cast("string")
    body = F.regexp_replace(F.concat(name, F.lit("\n"), F.col("s.body")), r"\A\s+|\s+\z", "")
    meta = F.create_map(F.lit("module"), F.regexp_replace("file", r"\.[^.]*\z", ""), F.lit("ord"), F.col("s.ord").cast("string"))
    return rows.select(T.unit_uid(F.col("repo"), F.lit("doc"), none, name, body).alias("uid"), "repo", F.lit("doc").alias("kind"), name.alias("name"),
                       none.alias("qualified_name"), "file", "repo_head", body.alias("text"), meta.alias("meta"))


def symbol_units(symbols: DataFrame, camelcase: bool = False, with_source: bool = False, source_chars: int | None = None) -> DataFrame:
    """Unit rows of symbols(repo, name, qualified_name, label, file, repo_head[, source, start_line, end_line])."""
    name, qn = F.col("name"), F.coalesce(F.nullif("qualified_name", F.lit("")), "name")
    source = T.symbol_source(F.col("source"), name, F.col("start_line"), F.col("end_line"), source_chars) if with_source else None
    text = T.symbol_text(name, F.col("label"), qn, F.col("file"), source, camelcase)
    rows = symbols.withColumns({"qualified_name": qn, "text": text})
    return rows.select(T.unit_uid(F.col("repo"), F.lit("symbol"), F.col("qualified_name"), name, F.col("text")).alias("uid"), "repo",
                       F.lit("symbol").alias("kind"), "name", "qualified_name", "file", "repo_head", "text",
                       F.create_map(F.lit("label"), F.coalesce("label", F.lit(""))).alias("meta"))


BUCKETS = 64  # of terms, in the stored postings
SPREAD = 8  # tasks that write one repo of a plain unit table


def first_units(units: DataFrame, order: str = "file") -> DataFrame:
    """One row for each (repo, uid): the first by `order`, where units has it, then by the whole row."""
    rest = [c for c in units.columns if c not in ("repo", "uid")]
    first = [order] if order in units.columns else []
    # a map has no order of its own: its entries, sorted, have
    whole = [F.array_sort(F.map_entries(c)) if isinstance(units.schema[c].dataType, Ty.MapType) else F.col(c) for c in rest]
    return units.groupBy("repo", "uid").agg(F.min_by(F.struct(*rest), F.struct(*first, *whole)).alias("_r")).select("repo", "uid", "_r.*").select(*units.columns)


def write_units(units: DataFrame, path: str) -> None:
    """Replace the rows of every repo present in units; other repos stay. Of equal uids the first is kept."""
    spread = first_units(units).repartition("repo", F.pmod(F.xxhash64("uid"), F.lit(SPREAD)))
    spread.sortWithinPartitions("repo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def write_index(units: DataFrame, path: str) -> str:
    """Units, posting blocks, sizes and vectors (where units has vec) as a new version that replaces every repo present in units; its name.

    A version is a folder of its own, below which repos are sorted columns, not folders. It counts from the commit on, for all its tables at
    once: a write that fails before leaves what readers see, and a repo written without vectors keeps none. Repos not in units stay in their versions.
    """
    spark, version = units.sparkSession, f"v{uuid.uuid4().hex}"
    rows = cut_round(first_units(units).repartitionByRange("repo", "uid").sortWithinPartitions("repo", "uid"))

    def put(df: DataFrame, name: str, *by: str) -> None:
        df.write.partitionBy(*by).parquet(f"{path}/{name}/version={version}") if by else df.write.parquet(f"{path}/{name}/version={version}")

    put(rows.drop("vec"), "units")
    terms = rows.select("repo", "kind", "uid", T.index_terms(F.concat_ws(" ", "name", "qualified_name", "text")).alias("t")).withColumn("len", F.size("t"))
    put(terms.groupBy("repo").agg(F.count("*").alias("n"), F.sum("len").alias("total_len")).coalesce(1), "sizes")
    posted = cut_round(terms.select("repo", "kind", "uid", "len", F.explode(lexical.counted(F.col("t"))).alias("p"))
                       .select("repo", "kind", "uid", "len", "p.term", F.col("p.tf").cast("int").alias("tf")))
    put(blockmax.blocks(posted, term_bucket(F.col("term"))), "postings", "bucket")
    vectors = rows if "vec" in rows.columns else rows.withColumn("vec", F.lit(None).cast("array<double>"))
    put(vectors.where("vec IS NOT NULL").select("repo", "uid", "kind", "file", F.col("vec").cast("array<double>").alias("vec")), "vectors")
    snapshots.commit(spark, path, rows.select("repo").distinct(), version)
    return version


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _live(spark: SparkSession, path: str, name: str, live: DataFrame) -> DataFrame:
    """The rows of a stored table that the snapshot `live` (repo, version) names; versions are folders, so dead ones are not read."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").join(F.broadcast(live), ["repo", "version"], "left_semi")


def read_index(spark: SparkSession, path: str, queries: DataFrame, snapshot: str | None = None) -> blockmax.StoredIndex:
    """The stored index as far as queries(qid, query) need it: no text is tokenised, and only the buckets of their terms are read.

    All its tables are those of one snapshot, the last committed one unless named, whatever is written meanwhile.
    """
    live = snapshots.read(spark, path, snapshot)
    words = lexical.query_vocabulary(queries).select("term").distinct()
    buckets = [r.b for r in words.select(term_bucket(F.col("term")).alias("b")).distinct().collect()]
    posted = _live(spark, path, "postings", live).where(F.col("bucket").isin(buckets)).join(words, "term", "left_semi").drop("bucket", "version")
    corpus = _live(spark, path, "sizes", live).agg(F.sum("n").alias("n"), (F.sum("total_len") / F.sum("n")).alias("avg_len"))
    return blockmax.StoredIndex(_live(spark, path, "units", live).drop("version"), posted, corpus)


def read_vectors(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """Live stored vectors as units for the vector search: (repo, uid, kind, file, vec)."""
    return _live(spark, path, "vectors", snapshots.read(spark, path, snapshot)).drop("version")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def repo_states(units: DataFrame) -> DataFrame:
    return units.groupBy("repo").agg(F.count("*").alias("unit_count"), F.max("repo_head").alias("repo_head"))


def readiness(states: DataFrame) -> DataFrame:
    """One row: usable when at least one repo is indexed."""
    return states.agg((F.count("*") > 0).alias("ready"), F.count("*").alias("repos"), F.coalesce(F.sum("unit_count"), F.lit(0)).alias("units"))


def freshness(registry: DataFrame, states: DataFrame) -> DataFrame:
    """(repo, state) of registry(repo, head): unindexed, fresh or stale."""
    rows = registry.join(states.select("repo", "repo_head", F.lit(True).alias("_in")), "repo", "left")
    state = F.when(F.col("_in").isNull(), "unindexed").when(F.col("repo_head").eqNullSafe(F.col("head")), "fresh").otherwise("stale")
    return rows.select("repo", state.alias("state"))

"""Exact vector search in blocks: every query meets every unit shard, only per-shard top-k leaves a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from faultlens import fixed_values as V
from faultlens.functions import text as T
from faultlens.operators.lexical import filter_units, top_k
from faultlens.operators.ranking import catalogs_of
from faultlens.session import cut, ship, small

UNIT_BLOCK = 131_072  # at most so many units, and so many queries, meet in a task; fewer, if vectors are longer than USUAL
QUERY_BLOCK = 32_768
USUAL = 64
LEAST_QUERIES = 256  # queries are cut no finer than that for the sake of more tasks
TILE = 8192  # units that a task compares at once with ROWS queries
ROWS = 256


def _matrix(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length rows and a flag for rows of the right size and non-zero norm."""
    ok = np.array([v is not None and len(v) == dim and dim > 0 for v in vectors], dtype=bool)
    m = np.zeros((len(vectors), max(dim, 1)))
    if ok.any():
        m[ok] = np.stack([np.asarray(v, dtype=np.float64) for v, good in zip(vectors, ok) if good])
    norm = np.sqrt((m * m).sum(axis=1))
    ok &= norm > 0
    m[ok] /= norm[ok, None]
    return m, ok


def _kept(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row by falling score, then column, in the order of rows."""
    order = np.lexsort((cols, -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    keep = place < k
    return rows[keep], cols[keep], score[keep]


def _exact(qm: np.ndarray, um: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded cosines of some pairs in double precision."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), 65_536):
        part = slice(at, at + 65_536)
        out[part] = np.einsum("ij,ij->i", qm[rows[part]], um[cols[part]])
    return np.round(out, 9)


def _nearest(um: np.ndarray, uok: np.ndarray, qm: np.ndarray, qok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, unit, score) of the k best units of each query, ties to the earlier unit; rows that are not ok score -1.

    Single precision only leaves out units that are below the k-th best by more than its error; the rest are scored in double precision.
    """
    found = []
    bad = np.flatnonzero(~qok)
    first = np.arange(min(k, len(um)))
    found.append((np.repeat(bad, len(first)), np.tile(first, len(bad)), np.full(len(bad) * len(first), -1.0)))
    live, good = np.flatnonzero(uok), np.flatnonzero(qok)
    dead = np.flatnonzero(~uok)[:k]  # all score the same, so the first will do
    slack = (um.shape[1] + 8) * 2.0 ** -22 + 2e-9
    u32 = um[live].astype(np.float32)
    for at in range(0, len(good), ROWS):
        some = good[at:at + ROWS]
        q32 = qm[some].astype(np.float32)
        best = (np.repeat(np.arange(len(some)), len(dead)), np.tile(dead, len(some)), np.full(len(some) * len(dead), -1.0))
        floor = np.full(len(some), -np.inf)
        for lo in range(0, len(live), TILE):
            near = q32 @ u32[lo:lo + TILE].T
            bar = floor
            if near.shape[1] > k:
                bar = np.maximum(bar, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]) if lo == 0 else bar
            r, c = np.nonzero(near >= (bar - 2 * slack)[:, None])
            c = live[lo + c]
            s = _exact(qm[some], um, r, c)
            best = _kept(np.r_[best[0], r], np.r_[best[1], c], np.r_[best[2], s], k)
            full = np.bincount(best[0], minlength=len(some)) == k
            ends = np.cumsum(np.bincount(best[0], minlength=len(some))) - 1
            floor = np.where(full, best[2][np.maximum(ends, 0)] if len(best[2]) else -np.inf, -np.inf)
        found.append((some[best[0]], best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _block_top_k(k: int, skip_self: bool):
    """Cogroup function: the k best units of one shard for each query of one block."""

    def run(units: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(units) and len(queries):
            units = units.sort_values("uid", kind="stable").reset_index(drop=True)
            for dim, part in queries.groupby(queries["qvec"].map(lambda v: -1 if v is None else len(v))):
                um, uok = _matrix(units["vec"], int(dim))
                qm, qok = _matrix(part["qvec"], int(dim))
                row, at, score = _nearest(um, uok, qm, qok, k + skip_self)
                got = pd.DataFrame({"qid": part["qid"].values[row], "uid": units["uid"].values[at], "score": score})
                if skip_self:  # one more was asked for
                    other = np.asarray(units["uid"].values[at] != part["_key"].values[row], bool)
                    row, at, score = _kept(row[other], at[other], score[other], k)
                    got = pd.DataFrame({"qid": part["qid"].values[row], "uid": units["uid"].values[at], "score": score})
                out.append(got)
        if not out:
            return pd.DataFrame({"qid": queries["qid"].iloc[:0], "uid": units["uid"].iloc[:0],
                                 "score": pd.Series(dtype="float64")})
        return pd.concat(out, ignore_index=True)

    return run


def _blocks(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(_part, _shards, _blocks): into how many pieces the units and the queries(_part) of a part are cut. A unit is copied to each block of queries, and a
    query to each shard of units, so pieces are as large as a task may hold, or as small as it takes to give every core some."""
    sides = units.groupBy("_part").agg(F.count("*").alias("_u"), F.max(F.size("vec")).alias("_long")).join(
        queries.groupBy("_part").agg(F.count("*").alias("_q")), "_part").withColumn("_more", F.greatest(F.col("_long") / USUAL, F.lit(1.0)))
    sides = cut(sides.withColumn("_shards", F.ceil(F.col("_u") * F.col("_more") / UNIT_BLOCK).cast("int")))
    wanted = 4 * units.sparkSession.sparkContext.defaultParallelism / max(1, sides.agg(F.sum("_shards")).first()[0] or 0)
    fine = F.least(F.ceil(F.lit(wanted)), F.ceil(F.col("_q") / LEAST_QUERIES))
    return sides.select("_part", "_shards", F.greatest(F.ceil(F.col("_q") * F.col("_more") / QUERY_BLOCK), fine).cast("int").alias("_blocks"))


def vector_search(units: DataFrame, queries: DataFrame, k: int = 20, repos: list[str] | None = None,
                  kinds: list[str] | None = None, scope: str | None = None, skip_self: bool = False, catalogs: DataFrame | None = None) -> DataFrame:
    """Best k units by cosine per query: (qid, uid, repo, kind, file, score, rank).

    units is (uid, repo, kind, file, vec), queries is (qid, vec). Rows without a vector take no part; vectors of another size, empty or of
    zero norm score -1. Both sides are cut into hash blocks of bounded size and paired by an
    equi-join on (shard, block), so no side has to fit anywhere and a hot repo is spread over its own
    shards. scope names a query column with the one repo it may see; catalogs is (cat, repo), and a query with a column cat sees the repos of
    its catalog: units then meet only the queries of their repo or catalog. skip_self drops uid = qid.
    """
    kept = filter_units(units, repos, kinds).where(F.col("vec").isNotNull())
    queries = queries.where(F.col("vec").isNotNull())
    if scope:
        kept, part = kept.withColumn("_part", F.col("repo")), F.col(scope)
    elif catalogs is not None:
        kept, part = kept.join(catalogs.select("repo", F.col("cat").alias("_part")), "repo"), F.col("cat")
    else:
        kept, part = kept.withColumn("_part", F.lit(0)), F.lit(0)
    queries = queries.withColumn("_part", part)  # what a unit and a query must have in common
    cuts = cut(_blocks(kept, queries))
    cuts = F.broadcast(cuts) if small(cuts, 10_000) else cuts
    same = units.schema["vec"].dataType == queries.schema["vec"].dataType
    vec = F.col("vec") if same else F.col("vec").cast("array<double>")
    left = kept.join(cuts, "_part").select(
        "uid", "_part", vec.alias("vec"),
        F.pmod(F.xxhash64("uid"), F.col("_shards")).cast("int").alias("_shard"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    asked = queries.join(cuts, "_part").select(
        "qid", vec.alias("qvec"),
        F.col("qid").alias("_key") if skip_self else F.lit(None).cast("string").alias("_key"),
        "_part",
        F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_shard"),
        F.pmod(F.xxhash64("qid"), F.col("_blocks")).cast("int").alias("_block"))
    schema = Ty.StructType([Ty.StructField("qid", queries.schema["qid"].dataType),
                            Ty.StructField("uid", units.schema["uid"].dataType),
                            Ty.StructField("score", Ty.DoubleType())])
    ship(units.sparkSession)
    partial = (left.groupBy("_part", "_shard", "_block").cogroup(asked.groupBy("_part", "_shard", "_block"))
               .applyInPandas(_block_top_k(k, skip_self), schema))
    best = cut(top_k(partial, k, ["qid"], [F.col("score").desc(), F.col("uid")]))  # the search is dear, and rankings read it more than once
    return best.join(filter_units(units, repos, kinds).select("uid", "repo", "kind", "file"), "uid")


def check_dim(units: DataFrame, queries: DataFrame) -> DataFrame:
    """One row (ok, index_dim, query_dim); ok is false unless every size on both sides is the same."""
    def spans(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.min(F.size("vec")).alias(f"{name}_lo"), F.max(F.size("vec")).alias(f"{name}_hi"),
                      F.lit(1).alias("one"))
    both = spans(units, "i").join(spans(queries, "q"), "one")
    empty = F.col("i_lo").isNull()
    ok = empty | ((F.col("i_lo") == F.col("i_hi")) & (F.col("q_lo") == F.col("q_hi")) & (F.col("i_lo") == F.col("q_lo")))
    return both.select(ok.alias("ok"), F.col("i_hi").alias("index_dim"), F.col("q_hi").alias("query_dim"))


def require_dim(units: DataFrame, queries: DataFrame) -> DataFrame:
    """check_dim that fails the job on a mismatch."""
    fail = F.raise_error(F.concat(F.lit("query dim "), F.col("query_dim").cast("string"), F.lit(" != indexed dim "),
                                  F.col("index_dim").cast("string")))
    return check_dim(units, queries).withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(fail.cast("boolean")))


def embed(df: DataFrame, text: str, dim: int = 16) -> DataFrame:
    """Adds vec: the built-in hash embedding. A user embedder is any Column function in its place."""
    return df.withColumn("vec", T.hash_embedding(F.col(text), dim))


def case_hits(units: DataFrame, cases: DataFrame, k: int = V.VECTOR_TOP_K, skip_self: bool = False, cands: DataFrame | None = None) -> DataFrame:
    """Vector hits keyed by case: cases is (case_id, vec). With cands(case_id, repo) the k best are those among a case's candidates."""
    q = cases.select(F.col("case_id").alias("qid"), "vec")
    if cands is None:
        return vector_search(units, q, k, skip_self=skip_self).withColumnRenamed("qid", "case_id")
    of, catalogs = catalogs_of(cands)
    q = q.join(of.withColumnRenamed("case_id", "qid"), "qid")
    return vector_search(units, q, k, skip_self=skip_self, catalogs=catalogs).withColumnRenamed("qid", "case_id")

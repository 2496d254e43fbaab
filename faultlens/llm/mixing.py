"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultlens.llm.common import bundled, store, unbundled, WORD
from faultlens.session import ship, with_ordinal

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # of all sizes, shared out among the sources
REPEAT = 2.0  # times its size that a source, and so a document, gives at most
CHUNK = 4096  # documents in one flight
LANDING = 14  # documents of a source left to the landing
SEED = 42


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh `weights`, repeating. They share `share` times all sizes by weight; a target stops at `repeat` times its
    source's size and the excess is shared out again by weight until none is above. Each round is one sum over the table of sources.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = store(with_ordinal(sources, order, "_at"), "sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    s = ranked.select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(repeat))).alias("most"))
    full = F.lit(False)
    total = None
    while True:
        first = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most"))).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weights"),
                      F.sum(F.when(full, 1)).alias("n")).first()
        total = (first["all"] or 0) * share
        rest, weight = total - (first["given"] or 0.0), first["weights"] or 0.0
        level = rest / weight if weight else 0.0
        target = F.col("weight") * F.lit(level)
        if not weight or not s.where(~full & (target > F.col("most"))).limit(1).count():
            return s.select("source", "source_size", F.when(full, F.col("most")).otherwise(target).alias("target"))
        full = full | (target > F.col("most"))


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Inclusion probabilities moved until at most two stay inside (0, 1), while sum(size * p) and sum(p) stay what they are.

    Units enter in the given order. Each step takes three open ones: with two balancing equations their null space is a line, along which p moves
    to one of its two ends, at odds that keep every unit's chance; an end settles at least one unit.
    """
    out = p.tolist()
    sizes, draws = size.tolist(), draws.tolist()
    low, high = 1e-9, 1 - 1e-9
    active: list[int] = []
    for i, pi in enumerate(out):
        if not low < pi < high:
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, v in zip(active, u):
                if v > 0:
                    up, down = min(up, (1 - out[k]) / v), min(down, out[k] / v)
                elif v < 0:
                    up, down = min(up, out[k] / -v), min(down, (1 - out[k]) / -v)
            step = up if draws[i] * (up + down) < down else -down
            for k, v in zip(active, u):
                q = out[k] + step * v
                out[k] = 0.0 if q < low else 1.0 if q > high else q
            active = [k for k in active if 0.0 < out[k] < 1.0]
    return np.array(out)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few units still open (at most LANDING) are set to 0 or 1: of all choices the one nearest to their expected words, then documents."""
    at = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    words = np.abs(choices @ size[at] - size[at] @ p[at])
    units = np.abs(choices.sum(axis=1) - p[at].sum())
    out = p.copy()
    out[at] = choices[np.lexsort((units, words.round(6)))[0]]
    return out


def _fly(final: bool):
    """One flight over a chunk: its rows come back with p moved, but for a few of all sizes kept back for the landing; a final one lands."""
    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["size", "_h", "_row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size, p = chunk["size"].to_numpy(float), chunk["p"].to_numpy(float)
        draws = (chunk["_h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
        fly = np.ones(len(chunk), bool)
        fly[np.unique(np.linspace(0, len(chunk) - 1, min(len(chunk), LANDING - 2)).round().astype(int))] = False
        p[fly] = flight(p[fly], size[fly], draws[fly])
        return chunk.assign(p=landing(p, size) if final else p)[["_group", "_row", "_h", "size", "p"]]
    return run


def _row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, times, taken, row_hash): how often the mix takes each whole document.

    size is the number of words of the text, 0 for a null text. A source's share of its size, target / source_size, gives each document a whole number of
    copies and a chance of one more; flights balance the words and the documents of those chances, in chunks of one source, then over what
    the chunks left, until one chunk of a source holds the rest and lands. Targets that are no more than `repeat` times the size keep every
    document within that. Draws come from hashes of the rows, so that reruns agree, on any partitioning. docs needs doc_id, text and source.
    Null sources are one source, the last. A source without words gives none. Repeated rows each take part. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    sized = store(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                              _row_hash(seed).alias("_h")), "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    goal = store(targets(per.select("source", "source_size"), weights, share, repeat)
                 .join(per.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    g = goal.withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9).cast("long")
    rows = (sized.join(g, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("times", whole).withColumn("p", F.greatest(F.lit(0.0), rate - whole))
            .withColumn("_group", F.xxhash64(F.col("source").isNull(), "source"))
            .withColumn("_row", F.monotonically_increasing_id())
            .drop("_s"))
    names = ["_group", "_row", "_h", "size", "p"]
    schema = "_group long, _row long, _h long, size long, p double"
    rows = store(rows, "chances")
    inside = "p > 1e-9 AND p < 1 - 1e-9 AND size > 0"
    open_ = rows.where(inside).select(*names, "_n")
    settled = []
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / chunk)).cast("long")
    # the number of chunks follows from the documents of a source; a flight leaves at most LANDING of each chunk
    state = (open_.withColumn("_part", F.pmod(F.col("_h"), parts)).groupBy("_group", "_part")
             .applyInPandas(_fly(False), schema))
    while True:
        state = store(state, "flight")
        settled.append(state.where("p <= 0 OR p >= 1"))
        left = state.where("p > 0 AND p < 1")
        most = left.groupBy("_group").count().agg(F.max("count")).first()[0] or 0
        if most <= chunk:
            settled.append(left.groupBy("_group").applyInPandas(_fly(True), schema))
            break
        counts = left.groupBy("_group").agg(F.count("*").alias("_n"))
        state = (left.join(counts, "_group").withColumn("_part", F.pmod(F.xxhash64("_h"), F.ceil(F.col("_n") / chunk).cast("long")))
                 .groupBy("_group", "_part").applyInPandas(_fly(False), schema))
    chosen = settled[0]
    for s in settled[1:]:
        chosen = chosen.unionByName(s)
    extra = chosen.where("p > 0.5").select(F.col("_row"), F.lit(1).alias("_extra"))
    times = F.col("times") + F.coalesce("_extra", F.lit(0))
    return (rows.join(extra, "_row", "left").withColumn("times", times)
            .select("doc_id", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), F.col("_h").alias("row_hash")))


def repeat(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, with its columns as they are.

    Rows meet their numbers by a hash of id, source and text. Equal rows share theirs: the first of them give the larger ones. Nulls, blank texts and
    empty tables as for `mix`; columns may have any names.
    """
    taken = mix(docs, seed=seed).groupBy("row_hash").agg(F.count("*").alias("rows"), F.sum("times").alias("times"))
    rows = bundled(docs, _row_hash(seed).alias("row_hash")).join(taken, "row_hash").where("times > 0")
    one = rows.where("rows = 1").withColumn("n", F.lit(1))
    more = rows.where("rows > 1").withColumn("n", F.row_number().over(W.partitionBy("row_hash").orderBy("row_hash")))
    n = F.expr("times div rows + if(n <= times % rows, 1, 0)").cast("int")
    many = one.unionByName(more).withColumn("n", n).where("n > 0")
    return unbundled(many.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))), docs)

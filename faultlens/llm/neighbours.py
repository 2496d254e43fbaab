"""Approximate nearest neighbours by inner product: stable projections in kd-trees, verified until a chi-square test holds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultlens.llm.common import store
from faultlens.llm.vectors import dimension, matrix, usable
from faultlens.session import ship

K = 20
PROJECTED = 8
SURE = 0.985  # chance at least with which a true neighbour has been verified when a search stops
SAMPLE = 20_000  # vectors that the shards' borders are learned from
SHARD, SHARDS = 8_192, 4_096  # vectors wanted in a shard; shards at most
LEAF = 64
QUERIES = 2_048  # queries that meet a shard in one task


def chi_square_at(p: float, m: int) -> float:
    """The quantile of the chi-square distribution with an even number m of degrees of freedom, by bisection."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 40.0 * m
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@dataclass
class Index:
    """Projection of vectors lengthened to one norm, and the borders of the shards in projected space.

    A vector x becomes (x, sqrt(top - |x|^2)), so that the largest inner product is the least Euclidean distance; a query gets a 0.
    """
    top: float
    axes: np.ndarray  # (dim + 1, PROJECTED), normal entries
    splits: list[tuple[int, float]]  # a full binary tree in order of levels: axis and border
    low: np.ndarray
    high: np.ndarray

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top - (x * x).sum(axis=1)))
        return x @ self.axes[:-1] + rest[:, None] * self.axes[-1]

    def shard(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        for _ in range(int(math.log2(len(self.splits) + 1))):
            axis, border = np.array([s[0] for s in self.splits])[at], np.array([s[1] for s in self.splits])[at]
            at = 2 * at + 1 + (p[np.arange(len(p)), axis] > border)
        return at - len(self.splits)

    def gaps(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance of each row to each shard."""
        out = np.zeros((len(p), len(self.low)))
        for a in range(p.shape[1]):
            d = np.maximum(0, np.maximum(self.low[:, a] - p[:, a, None], p[:, a, None] - self.high[:, a]))
            out += d * d
        return out


def build(sample: np.ndarray, rows: int, top: float, seed: int = 5) -> Index:
    """Shards by halving the projected sample at medians, always across the axis of the widest spread."""
    dim = sample.shape[1]
    axes = np.random.default_rng(seed).normal(size=(dim + 1, PROJECTED))
    index = Index(top, axes, [], np.full((1, PROJECTED), -np.inf), np.full((1, PROJECTED), np.inf))
    levels = min(int(math.log2(SHARDS)), max(0, math.ceil(math.log2(max(1, rows / SHARD)))))
    groups, boxes = [index.project(sample, False)], [(index.low[0], index.high[0])]
    for _ in range(levels):
        below, inside = [], []
        for g, (low, high) in zip(groups, boxes):
            axis = int(np.argmax(g.std(axis=0))) if len(g) else 0
            border = float(np.median(g[:, axis])) if len(g) else 0.0
            index.splits.append((axis, border))
            left, right = high.copy(), low.copy()
            left[axis], right[axis] = min(high[axis], border), max(low[axis], border)
            below += [g[g[:, axis] <= border], g[g[:, axis] > border]]
            inside += [(low, left), (right, high)]
        groups, boxes = below, inside
    index.low, index.high = (np.array(x) for x in zip(*boxes))
    return index


class Tree:
    """A kd-tree over projected points, as leaves with bounding boxes."""

    def __init__(self, p: np.ndarray):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(p))]
        while todo:
            at = todo.pop()
            spread = np.ptp(p[at], axis=0)
            if len(at) <= LEAF or not spread.any():
                self.leaves.append(at)
                continue
            axis = int(np.argmax(spread))
            order = at[np.argpartition(p[at, axis], len(at) // 2)]
            todo += [order[:len(at) // 2], order[len(at) // 2:]]
        self.p = p
        self.low, self.high = (np.array([f(p[at], axis=0) for at in self.leaves]) for f in (np.min, np.max))

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each row of q to each leaf."""
        out = np.zeros((len(q), len(self.leaves)))
        for a in range(q.shape[1]):
            d = np.maximum(0, np.maximum(self.low[:, a] - q[:, a, None], q[:, a, None] - self.high[:, a]))
            out += d * d
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each row of q to each point."""
        out = np.zeros((len(q), len(self.p)))
        for a in range(q.shape[1]):
            d = self.p[:, a] - q[:, a, None]
            out += d * d
        return out


def verified(tree: Tree, scores: np.ndarray, far: np.ndarray, gap: np.ndarray, norm: float, limit: float, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and inner products of the best k points that the search of one query verifies, best first.

    Points are verified by exact inner product in order of projected distance, several leaves at a time; with d2 the squared distance of the k-th
    best so far, a point not yet seen is nearer with a chance under 1 - SURE once its squared projected distance is over limit * d2. bound is a d2
    known before; scores and far are the inner products and squared projected distances of all points.
    """
    best, d2, worst = np.empty(0, np.int64), bound, -np.inf
    order = np.argsort(gap)
    order = order[:np.searchsorted(gap[order], limit * d2, "right")]
    for at in range(0, len(order), 12):
        part = order[at:at + 12]
        if gap[part[0]] > limit * d2:
            break
        new = np.concatenate([tree.leaves[i] for i in part])
        best = np.concatenate([best, new[(far[new] <= limit * d2) & (scores[new] >= worst)]])
        if len(best) >= k:
            worst = np.partition(scores[best], len(best) - k)[len(best) - k]
            best = best[scores[best] >= worst]  # ties at the end stay
            d2 = min(d2, max(0.0, norm - 2 * float(worst)))
    best = best[np.argsort(-scores[best], kind="stable")]
    return best, scores[best]


CELLS = 2_000_000  # inner products worked out at a time


def search(tree: Tree, x: np.ndarray, q: np.ndarray, pq: np.ndarray, top: float, limit: float, k: int, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What is verified for each row of q in order. A few queries at a time meet all points of the shard by one matrix product."""
    step = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(q), step):
        some = slice(at, at + step)
        scores, far, gaps = q[some] @ x.T, tree.distances(pq[some]), tree.gaps(pq[some])
        norms = top + (q[some] * q[some]).sum(axis=1)
        for i in range(len(scores)):
            yield verified(tree, scores[i], far[i], gaps[i], norms[i], limit, k, bounds[some][i])


def nearest(rows: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest by inner product to each row whose vec_id is divisible by `every`.

    Candidates are all other rows; score is the inner product of the original vectors in double precision, ties go to the smaller vec_id. Vectors that are
    null, empty, zero, of another length than most, or hold null or non-finite components take no part, nor do rows without an id. Equal vectors are
    searched once: a distinct vector carries its k + 1 smallest ids, more can't be among k. Rows that share an id count once per distinct vector. The index
    is built from at most SAMPLE vectors and holds every row; each query searches its own shard, then those shards that its stopping
    test can't rule out. Queries meet a shard in blocks. With fewer than k candidates all are returned; no queries give no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    dim = dimension(rows, "embedding")
    fine = rows.select("vec_id", "embedding").where(usable("embedding", dim) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")).distinct()
    ranked = fine.withColumn("_r", F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    points = store(ranked.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    norms = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, top = points.agg(F.count("*"), F.max(norms)).first()
    few = points.orderBy(F.xxhash64("vec")).limit(SAMPLE).select("vec").toArrow()
    index = build(matrix(few.column("vec"), dim) if n else np.zeros((0, 1)), n, top or 0.0)
    held = spark.sparkContext.broadcast(index)
    limit = chi_square_at(SURE, PROJECTED)

    def shards(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    s = held.value.shard(held.value.project(matrix(b.column("vec"), dim), query))
                    yield pa.RecordBatch.from_arrays([pa.array(s), *b.columns], ["shard", *b.schema.names])
        return run

    kind = rows.schema["vec_id"].dataType.simpleString()
    cells = store(points.mapInArrow(shards(False), f"shard long, vec array<double>, ids array<{kind}>"), "shards")
    asked = store(fine.where(F.col("vec_id") % every == 0).select("vec").distinct().withColumn("q", F.monotonically_increasing_id())
                  .select("q", "vec").mapInArrow(shards(True), "shard long, q long, vec array<double>").withColumn("bound", F.lit(float("inf"))), "queries")

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        q_out, id_out, s_out = [], [], []
        if left.num_rows and right.num_rows:
            ix = held.value
            x, q = matrix(left.column("vec"), dim), matrix(right.column("vec"), dim)
            tree = Tree(ix.project(x, False))
            pq, ids = ix.project(q, True), left.column("ids").to_pylist()
            bounds = right.column("bound").to_numpy()
            for name, (best, score) in zip(right.column("q").to_pylist(), search(tree, x, q, pq, ix.top, limit, k + 1, bounds)):
                got = sorted((-s, v) for at, s in zip(best.tolist(), score.tolist()) for v in ids[at])[:k + 1]
                q_out += [name] * len(got)
                id_out += [v for _, v in got]
                s_out += [-s for s, _ in got]
        return pa.table({"q": pa.array(q_out, pa.int64()), "vec_id": pa.array(id_out, left.schema.field("ids").type.value_type), "score": pa.array(s_out, pa.float64())})

    def meet(queries: DataFrame) -> DataFrame:
        # one count per shard, SHARDS at most
        blocks = dict(queries.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES)).collect())
        several = F.create_map(*[F.lit(int(v)) for s, b in blocks.items() if b > 1 for v in (s, b)]) if any(b > 1 for b in blocks.values()) else None
        many = F.coalesce(several[F.col("shard")], F.lit(1)) if several is not None else F.lit(1)
        left = cells.withColumn("block", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)))
        right = queries.withColumn("block", F.pmod(F.xxhash64("q"), many.cast("long")).cast("int"))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(look, f"q long, vec_id {kind}, score double")

    first = store(meet(asked), "own_shard")
    tops = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("worst"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = matrix(part.column("vec"), dim)
                worst = part.column("worst").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                d2 = np.where(part.column("n").fill_null(0).to_numpy(zero_copy_only=False) > k, np.maximum(0, ix.top + (x * x).sum(axis=1) - 2 * worst), np.inf)
                open_ = ix.gaps(ix.project(x, True)) <= (limit * d2)[:, None]
                open_[np.arange(len(x)), part.column("shard").to_numpy()] = False
                i, s = np.nonzero(open_)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(s), part.column("q").take(take), part.column("vec").take(take), pa.array(d2[i])], ["shard", "q", "vec", "bound"])

    more = asked.drop("bound").join(tops, "q", "left").select("shard", "q", "vec", "n", "worst").mapInArrow(others, "shard long, q long, vec array<double>, bound double")
    found = first.unionByName(meet(store(more, "open_shards")))
    best = store(found.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1), "nearest")
    queries = fine.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").join(asked.select("q", "vec"), "vec").select("query_id", "q")
    out = queries.join(best, "q").where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

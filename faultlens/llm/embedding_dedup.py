"""Embedding near-duplicates: iterative-quantisation codes, multi-index Hamming tables, reranked by exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import merge_labels, store
from faultlens.llm.components import connected
from faultlens.llm.vectors import dimension, matrix, usable
from faultlens.session import ship

COSINE = 0.95
SAMPLE = 6_000  # vectors that the rotation is learned from
BITS = 64
TURNS = 30
BUCKET = 512  # vectors wanted in a bucket
MISSED = 0.02  # share of pairs just at the threshold that the tables may miss
BLOCK = 2_048  # vectors of a bucket that meet in one task, on each side


@dataclass
class Codes:
    """Centre, rotation and thresholds of the code, and the tables over it."""
    mean: np.ndarray
    rotation: np.ndarray
    middle: np.ndarray
    width: int  # bits of a table's key
    radius: int

    @property
    def tables(self) -> int:
        return self.rotation.shape[1] // self.width

    def code(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors as unsigned 64-bit integers."""
        bits = ((x - self.mean) @ self.rotation > self.middle).astype(np.uint8)
        return np.packbits(np.pad(bits, ((0, 0), (0, 64 - bits.shape[1]))), axis=1, bitorder="little").view(np.uint64).ravel()

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The key of each code in each table."""
        shift = (np.arange(self.tables) * self.width).astype(np.uint64)
        return (codes[:, None] >> shift) & np.uint64((1 << self.width) - 1)

    def masks(self) -> list[int]:
        return [sum(1 << b for b in c) for r in range(1, self.radius + 1) for c in combinations(range(self.width), r)]


def thinned(sample: np.ndarray, cosine: float) -> np.ndarray:
    """The unit vectors that have no earlier one within the threshold: a group of copies counts once, whatever its share of the rows."""
    kept = sample[:0]
    for at in range(0, len(sample), 1000):
        part = sample[at:at + 1000]
        part = part[~(part @ kept.T >= cosine).any(axis=1)]
        kept = np.concatenate([kept, part[~np.tril(part @ part.T >= cosine, -1).any(axis=1)]])
    return kept


def learn(sample: np.ndarray, rows: int, cosine: float = COSINE, seed: int = 3) -> Codes:
    """A rotation of the centred sample's principal axes that brings it near the corners of a cube, cut at medians so that each bit is balanced.

    Groups of near copies in the sample count once, so that no cut runs through a group for its mass. The tables' keys are as wide as buckets of BUCKET vectors need for `rows` vectors; their radius is the least that finds pairs just at the
    threshold but for MISSED of them, by the share of bits that differ between sample vectors and vectors turned to that cosine.
    """
    rng = np.random.default_rng(seed)
    sample, dim = thinned(sample, cosine), sample.shape[1]
    bits = min(BITS, dim)
    few = len(sample) < 4 * dim  # too few directions to balance: cuts go through the origin
    mean = sample.mean(axis=0) * (not few)
    axes = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim) if len(sample) > 1 else np.eye(dim))[1][:, ::-1][:, :bits]
    v = (sample - mean) @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(TURNS):
        z = v @ turn
        a, _, b = np.linalg.svd(np.where(z - np.median(z, axis=0) > 0, 1.0, -1.0).T @ v)
        turn = (a @ b).T
    rotation = axes @ turn
    middle = np.median((sample - mean) @ rotation, axis=0) * (not few)
    width = min(bits, max(min(8, bits), math.ceil(math.log2(max(1, rows / BUCKET)))))
    codes = Codes(mean, rotation, middle, width, 0)
    side = rng.normal(size=sample.shape)
    side -= (side * sample).sum(axis=1, keepdims=True) * sample
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    turned = cosine * sample + math.sqrt(1 - cosine * cosine) * side
    apart = np.bitwise_count(codes.keys(codes.code(sample)) ^ codes.keys(codes.code(turned)))
    while codes.radius < width and (apart > codes.radius).all(axis=1).mean() > MISSED:
        codes.radius += 1
    return codes


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(vectors: DataFrame, dim: int, cosine: float = COSINE) -> DataFrame:
    """(node, root, n): linked rows of (node, vec, weight); roots connect what is linked, n sums the weights linked to a node.

    Each vector goes to its bucket of each table, and to the buckets of higher keys within the radius. A pair is handled in the first
    table where it meets. Buckets with many vectors are cut into blocks that meet pairwise in separate tasks. A task sends on sums and a spanning
    forest, not pairs. `vectors` should be a written table.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.count()
    few = vectors.orderBy(F.xxhash64("vec"), "node").limit(SAMPLE).select("vec").toArrow()
    codes = spark.sparkContext.broadcast(learn(_unit(matrix(few.column("vec"), dim)), rows, cosine) if few.num_rows else None)
    part = vectors.schema["vec"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codes.value
        for b in batches:
            if not b.num_rows:
                continue
            code = c.code(_unit(matrix(b.column("vec"), dim)))
            keys = c.keys(code).astype(np.int64)
            for mask in [0, *c.masks()]:
                for t in range(c.tables):
                    to = keys[:, t] ^ mask
                    at = np.flatnonzero((to > keys[:, t]) | (mask == 0))
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((t << 58) | to[at]), b.column("node").take(take), b.column("weight").take(take), pa.array(code[at].view(np.int64)), pa.array(np.full(len(at), mask == 0)),
                         b.column("vec").take(take)], ["bucket", "node", "weight", "code", "own", "vec"])

    placed = vectors.select("node", "weight", "vec").mapInArrow(place, f"bucket long, node long, weight long, code long, own boolean, vec {part}")
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    spread = (placed.join(sizes, "bucket")
              .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
              .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "weight", "code", "own", "vec"))

    def compare(group: pa.Table) -> pa.Table:
        c = codes.value
        x = _unit(matrix(group.column("vec"), dim))
        table = group.column("bucket")[0].as_py() >> 58
        node, weight, code, own, block = (group.column(n).to_numpy() for n in ("node", "weight", "code", "own", "block"))
        keys = c.keys(code.view(np.uint64))[:, :table]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        n, labels = np.zeros(len(node), np.int64), np.arange(len(node))
        for at in range(0, len(left), 512):
            rows_ = left[at:at + 512]
            a, b = np.nonzero(x[rows_] @ x[right].T >= cosine)
            a, b = rows_[a], right[b]
            ok = (own[a] | own[b]) & ((a < b) if i == j else (a != b))
            a, b = a[ok], b[ok]
            for t in range(table):  # met before
                late = np.bitwise_count(keys[a, t] ^ keys[b, t]) > c.radius
                a, b = a[late], b[late]
            np.add.at(n, a, weight[b])
            np.add.at(n, b, weight[a])
            merge_labels(labels, a, b)
        at = np.flatnonzero(n)
        return pa.table({"node": node[at], "root": node[labels[at]], "n": n[at]})

    return spread.groupBy("bucket", "i", "j").applyInArrow(compare, "node long, root long, n long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of (vec_id, embedding), whatever its other columns.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components link with nothing: n_links 0,
    component_id their own id, kept true. Equal vectors are looked up once and counted as often as they occur. Ties and repeated ids keep
    their rows; a null id never names a component that has another. An empty table gives an empty table.
    """
    dim = dimension(rows, "embedding")
    # a zero has one sign, so that equal vectors are equal rows
    all_ = rows.select("vec_id", F.when(usable("embedding", dim), F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(
        rows.schema["embedding"].dataType.elementType)).otherwise(x))).alias("vec"))
    vectors = store(all_.where("vec IS NOT NULL").groupBy("vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("lo"))
                    .withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = store(links(vectors, dim, cosine), "links")
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = vectors.join(roots, "node", "left").join(sums, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    classes = named.join(least, "root").select(F.col("vec").alias("_vec"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return (all_.join(classes, F.col("vec") == F.col("_vec"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))

"""Vector code compression: a codebook of integer entries for each part of the vectors, searched by equal averages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import store
from faultlens.llm.vectors import dimension, matrix
from faultlens.session import ship

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
STEP = 4  # entries visited on a side before the bound is tested again


@dataclass
class Codebook:
    """The entries of one part, and their order by component sum."""
    entries: np.ndarray

    def __post_init__(self) -> None:
        sums = self.entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry to each row of x, ties to the lower index.

        Entries are visited outwards from where a row's own component sum falls among theirs. A side is left once the squared gap of the sums,
        over the dimension, strictly exceeds the best distance: by Cauchy's inequality no entry farther out comes as near.
        """
        n, (k, dim) = len(x), self.entries.shape
        own = x.sum(axis=1)
        best, index = np.full(n, np.iinfo(np.int64).max // max(1, dim)), np.full(n, k)
        start = np.searchsorted(self.sums, own)
        sides = [(np.arange(n), start, 1), (np.arange(n), start - 1, -1)]
        while sides:
            going = []
            for rows, at, way in sides:
                ok = (at >= 0) & (at < k)
                rows, at = rows[ok], at[ok]
                gap = self.sums[at] - own[rows]
                ok = gap * gap <= dim * best[rows]
                rows, at = rows[ok], at[ok]
                for _ in range(STEP):
                    if not len(rows):
                        break
                    entry = self.order[at]
                    apart = x[rows] - self.entries[entry]
                    d = np.einsum("ij,ij->i", apart, apart)
                    better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
                    best[rows[better]], index[rows[better]] = d[better], entry[better]
                    at = at + way
                    ok = (at >= 0) & (at < k)
                    rows, at = rows[ok], at[ok]
                if len(rows):
                    going.append((rows, at, way))
            sides = going
        return index, best


@dataclass
class Compressed:
    """codes: (vec_id, label, code, error), a byte of code for each part; books: the entries of each part's codebook."""
    codes: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """sha256 of all entries' components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(c) for b in self.books for e in b.tolist() for c in e).encode()).hexdigest()


def bounds(dim: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end; a dimension that does not divide makes the first parts longer by one."""
    return np.cumsum([0] + [dim // parts + (p < dim % parts) for p in range(parts)]).tolist()


def _integers(rows: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    limit = float((1 << 30) // max(1, -(-dim // parts)))
    v = F.col("embedding")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("long"))
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", whole.alias("v"))


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Codes and codebooks of (vec_id, embedding, label), whatever the other columns.

    Components become floor(scale * x); rows whose vector is null, or holds null or non-finite components, or is not as long as most, are
    dropped. Integers end at 2^30 over a part's dimension on both sides, so that distances stay exact. The codebooks start as the parts of the
    `entries` smallest vec_ids (null last, equal ids by their integers), fewer if there are fewer rows; each round assigns every part to its
    nearest entry (ties to the lower index) and replaces an entry by the floor of its parts' mean, unused ones stay. Repeated rows count as often as
    they occur. A table without usable rows gives no codes and empty books.

    Integers are written once. A task sends on one sum for each component of the entries it used, and the driver gets the merged ones: as many rows
    as the books have components, whatever the input.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = rows.sparkSession
    ship(spark)
    dim = dimension(rows.where(F.forall("embedding", lambda x: x.isNotNull())), "embedding")
    at = bounds(dim, parts)
    whole = store(_integers(rows, dim, parts, scale), "integers")
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow().column("v")
    seeds = matrix(first, dim).astype(np.int64) if len(first) else np.zeros((0, dim), np.int64)
    books = [seeds[:, a:b] for a, b in zip(at, at[1:])]

    def assigned(batch: pa.RecordBatch, sent: list[Codebook]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
        return x, [book.nearest(x[:, a:b]) for book, a, b in zip(sent, at, at[1:])]

    for _ in range(rounds if len(seeds) else 0):
        sent = spark.sparkContext.broadcast([Codebook(b) for b in books])

        def partial(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((parts, len(seeds)), np.int64)
            sums = [np.zeros(b.entries.shape, np.int64) for b in sent.value]
            for batch in batches:
                x, found = assigned(batch, sent.value)
                for p, (index, _) in enumerate(found):
                    counts[p] += np.bincount(index, minlength=len(seeds))
                    np.add.at(sums[p], index, x[:, at[p]:at[p + 1]])
            for p, total in enumerate(sums):
                used = np.flatnonzero(counts[p])
                e, j = (i.ravel() for i in np.indices((len(used), total.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p, np.int32)), pa.array(used[e]), pa.array(j), pa.array(counts[p][used[e]]), pa.array(total[used].ravel())],
                                                 ["part", "entry", "place", "n", "total"])

        books = [b.copy() for b in books]
        sums = whole.select("v").mapInArrow(partial, "part int, entry long, place long, n long, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        part, entry, place, total, n = (sums.column(c).to_numpy() for c in ("part", "entry", "place", "total", "n"))
        for p, book in enumerate(books):
            own = part == p
            book[entry[own], place[own]] = total[own] // n[own]
        sent.unpersist()

    final = spark.sparkContext.broadcast([Codebook(b) for b in books])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = assigned(batch, final.value)
            code = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())],
                                             ["vec_id", "label", "code", "error"])

    schema = whole.select("vec_id", "label").schema.add("code", "binary").add("error", "long")
    return Compressed(store(whole.mapInArrow(encode, schema), "codes"), books)


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """codes with `approximation` added: the entries that a code names, put together and scaled back. A null code gives null."""
    sent = codes.sparkSession.sparkContext.broadcast(books)
    ship(codes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if c is None else np.concatenate([book[i] for book, i in zip(sent.value, c)]) / scale for c in b.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, "approximation"])

    return codes.mapInArrow(run, T.StructType([*codes.schema, T.StructField("approximation", T.ArrayType(T.DoubleType()))]))


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error added: the errors of all rows of the same label, null labels together. A label is one row of the smaller side."""
    sums = codes.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_of")), "left").drop("_of")

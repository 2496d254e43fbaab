"""Helpers shared by the training-data operators: tables, words, fixed splits, tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import scratch_path

SAMPLE_BYTES = 32 << 20  # of text that a model is learned from on the driver
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor never replays what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket(col: str | Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `rows` labelled rows, and at most `size` bytes of text, for training; none from the held-out fifth (bucket 0).

    The sample goes by a hash of the id, so reruns agree; texts that no longer fit are passed over. It is taken from the labels first; the few ids are then
    sent to the documents, whose texts are not shuffled. Null ids, null labels and repeated labels are left out.
    """
    few = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (bucket("doc_id") != 0))
           .groupBy("doc_id").agg(F.max(label).alias("y"), F.min(label).alias("z")).where("y = z")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("id"), "y", F.xxhash64("doc_id").alias("h")))
    got = store(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), F.col("doc_id") == F.col("id"))
                .groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("h").alias("h")), "sample")
    left, fits = size, []
    for i, n in got.select("id", F.octet_length("text"), "h").orderBy("h", "id").select("id", "octet_length(text)").collect():
        if n <= left:
            left -= n
            fits.append(i)
    table = got.where(F.col("id").isin(fits)).select("id", "text", "y").toArrow().sort_by("id")
    return table.column("text").to_pylist(), table.column("y").to_numpy().astype(np.int64)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """UTF-8 bytes of a text column. bytes.split() cuts at exactly the six ASCII blanks, bytes.lower() folds only A-Z."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows`, so that one slice of texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the classes of a[i] and b[i] in place; a class is named by its least member."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        la, lb = la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def bundled(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text, rest) and `more`: the other columns go into one struct under numbers, so that their names clash with nothing."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("rest"), *more)


def unbundled(got: DataFrame, docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """The columns of docs from rows that hold (doc_id, text, rest); where `changed`, n_chars, if there, is the length of the new text."""
    out, at = [], 0
    for c in docs.columns:
        if c in ("doc_id", "text"):
            out.append(F.col(c))
            continue
        col, at = F.col(f"rest.c{at}"), at + 1
        if c == "n_chars" and changed is not None:
            col = F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(col)
        out.append(col.alias(c))
    return got.select(*out)

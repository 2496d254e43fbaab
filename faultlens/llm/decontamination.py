"""Benchmark decontamination: broadcast hash sets of normalised benchmark windows, scanned over training words, hits verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import bundled, raw, store, unbundled
from faultlens.llm.substrings import _mix, _powers, _runs, text_batches
from faultlens.session import salted_join, ship

WINDOW = 10
SLICE = 1 << 19  # windows of one broadcast set: 32 bytes each, and as much again for its bitmap
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INK = np.ones(256, bool)  # bytes of words after folding: digits, letters, and all of a character beyond ASCII
_INK[:128] = False
_INK[48:58] = _INK[97:123] = True


@dataclass
class Words:
    """The words of some texts: the text of each, its place in the folded bytes, and its hash."""
    data: np.ndarray
    of: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def window(self, at: int, n: int) -> bytes:
        """The n words from `at` on, joined by one space."""
        return b" ".join(self.data[b:e].tobytes() for b, e in zip(self.begin[at:at + n], self.end[at:at + n]))


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end outside a word."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and _INK[data[end]]:
            more = np.flatnonzero(~_INK[data[end:end + SEGMENT]])
            end = end + int(more[0]) if len(more) else min(len(data), end + SEGMENT)
        yield at, end
        at = end


def words_of(texts: list[bytes]) -> Words:
    data = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    back = pow(_BASE, -1, 1 << 64)
    begins, ends, hashes = [], [], []
    for lo, hi in _segments(data):
        part = data[lo:hi]
        ink = np.r_[False, _INK[part], False]
        s, e = np.flatnonzero(~ink[:-1] & ink[1:]), np.flatnonzero(ink[:-1] & ~ink[1:])
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * _powers(_BASE, len(part)), out=sums[1:])
        hashes.append(_mix((sums[e] - sums[s]) * _powers(back, len(part))[s] + (e - s).astype(_U) * _U(_BASE)))
        begins.append(s + lo)
        ends.append(e + lo)
    begin = np.concatenate(begins)
    return Words(data, np.searchsorted(firsts, begin, "right") - 1, begin, np.concatenate(ends), np.concatenate(hashes))


def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
    return _mix(_runs(hashes, n, _BASE) + _U(n))


def _digest(window: bytes) -> bytes:
    return hashlib.blake2b(window, digest_size=16).digest()


@dataclass
class HashSet:
    """Some windows of the benchmark: sorted 64-bit keys behind a bitmap, the digest of each window's words, and its set of items."""
    keys: np.ndarray
    digests: list[bytes]
    sets: list[int | None]
    sizes: list[int]  # numbers of words that windows have
    shift: int
    bitmap: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> HashSet:
        keys = rows.column("key").to_numpy().view(_U)
        order = np.argsort(keys, kind="stable")
        rows = rows.take(pa.array(order))
        bits = int(np.clip(np.ceil(np.log2(len(keys) + 1)) + 5, 12, 25))
        cells = np.zeros(1 << bits, bool)
        cells[(keys >> _U(64 - bits)).astype(np.int64)] = True
        return cls(keys[order], rows.column("digest").to_pylist(), rows.column("set_id").to_pylist(), sorted(set(rows.column("size").to_pylist())), 64 - bits, np.packbits(cells, bitorder="little"))

    def hits(self, words: Words) -> Iterator[tuple[int, int, int | None]]:
        """(first word, number of words, set of items) of every occurrence of a window, its words verified."""
        for n in self.sizes:
            if len(words.of) < n:
                continue
            keys = _keys(words.hash, n)
            cells = keys >> _U(self.shift)
            ok = (self.bitmap[(cells >> _U(3)).astype(np.int64)] >> (cells & _U(7)).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(ok & (words.of[:len(keys)] == words.of[n - 1:]))
            place = np.searchsorted(self.keys, keys[at])
            found = place < len(self.keys)
            at, place = at[found], place[found]
            found = self.keys[place] == keys[at]
            for i, p in zip(at[found].tolist(), place[found].tolist()):
                digest, key = _digest(words.window(i, n)), self.keys[p]
                while p < len(self.keys) and self.keys[p] == key:
                    if self.digests[p] == digest:
                        yield i, n, self.sets[p]
                        break
                    p += 1


def _merged(pairs: list[tuple[int, int]]) -> list[int]:
    """Flat ascending ranges [from, to) that cover the same words."""
    out: list[int] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, key, digest, size): the distinct windows of each item; an item of fewer than n words, but not none, is one window."""
    ship(benchmark.sparkSession)
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(raw(b, "text")):
                words = words_of([text or b""])
                size = min(n, len(words.of))
                if size:
                    digests = [_digest(words.window(at, size)) for at in range(len(words.of) - size + 1)]
                    many = len(digests)
                    yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array([i] * many)), pa.array(_keys(words.hash, size).view(np.int64)), pa.array(digests, pa.binary()),
                                                      pa.array([size] * many, pa.int32())], ["item_id", "key", "digest", "size"])

    return benchmark.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, key long, digest binary, size int").distinct()


def _scan(docs: DataFrame, hashes: HashSet, keep: bool) -> DataFrame:
    """docs (doc_id, text, rest, spans, sets) with what one set of windows hits added; the text and the rest only where keep asks for them."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(hashes)
    carried = ["doc_id", "text", "rest"] if keep else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in text_batches(batches):
            words = words_of([t or b"" for t in raw(b, "text")])
            first = np.searchsorted(words.of, np.arange(b.num_rows + 1))
            spans = [list(zip(s[::2], s[1::2])) for s in b.column("spans").to_pylist()]
            sets = [set(s) for s in b.column("sets").to_pylist()]
            of = words.of
            for i, n, name in known.hits(words):
                d = int(of[i])
                at = i - int(first[d])
                if spans[d] and spans[d][-1][0] <= at <= spans[d][-1][1]:
                    spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], at + n))
                else:
                    spans[d].append((at, at + n))
                if name is not None:
                    sets[d].add(name)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carried), pa.array(np.diff(first), pa.int64()), pa.array([_merged(s) for s in spans], pa.list_(pa.int32())),
                 pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))], [*carried, "n_words", "spans", "sets"])

    schema = docs.select(*carried).schema.add("n_words", "long").add("spans", T.ArrayType(T.IntegerType())).add("sets", T.ArrayType(T.LongType()))
    return docs.select("doc_id", "text", *(["rest"] if keep else []), "spans", "sets").mapInArrow(run, schema)


def _marked(docs: DataFrame, wins: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame]:
    """Every row of docs (doc_id, text, rest) with n_words, spans (ranges of hit words) and sets (numbers of sets of items); and (set_id, item_id).

    The windows are sent out in slices of about SLICE, however many there are: a benchmark of one slice is one pass over the documents, and each
    further slice one more.
    """
    hashed = F.xxhash64("item_id")
    named = F.count("item_id")
    set_id = F.xxhash64(named, F.sum(F.when(F.col("item_id").isNotNull(), hashed).cast("decimal(20,0)")), F.bit_xor(F.when(F.col("item_id").isNotNull(), F.xxhash64(hashed, F.lit(1)))))
    per = store(wins.groupBy("digest", "key", "size").agg(F.when(named > 0, set_id).alias("set_id")), "windows")
    slices = max(1, -(-per.count() // SLICE))
    got = docs.withColumn("spans", F.expr("CAST(array() AS array<int>)")).withColumn("sets", F.expr("CAST(array() AS array<long>)"))
    for k in range(slices):
        part = per.where(F.pmod("key", F.lit(slices)) == k).toArrow()
        got = _scan(got, HashSet.of(part), keep or k < slices - 1)
        if k < slices - 1:
            got = store(got.drop("n_words"), "scanned")
    sets = per.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("digest").alias("digest"))
    return got, wins.join(sets, "digest").where("item_id IS NOT NULL").select("set_id", "item_id").distinct()


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: x - acc)  # the ends less the starts, in turn


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans): one row per row of docs.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered. A window is `window` consecutive words of an item, or a shorter item
    as a whole; a document's words inside any occurrence of one are hit, spans lists their ranges as flat pairs [from, to). items_sha256 is of
    the ids of the items with windows that occur, as strings, sorted, joined by commas; n_items counts them. Null and empty texts have no words, as documents
    and as items. An item without an id hits words but is not counted. Repeated items count once, repeated documents each. Other columns
    are not looked at. An empty benchmark hits nothing; an empty table gives an empty table.

    Windows with the same items share one number, and documents with the same numbers one digest: a window that a third of all items or
    documents have is worked out once. Documents without such numbers meet no join, the others a salted one.
    """
    wins = store(windows(benchmark, window), "items")
    plain = docs.select("doc_id", "text", F.lit(None).cast("int").alias("rest"))
    scanned, items = _marked(plain, wins, False)
    marked = store(scanned, "marked")
    combos = marked.where(F.size("sets") > 0).select("sets").distinct()
    named = (combos.select("sets", F.explode("sets").alias("set_id")).join(items, "set_id")
             .groupBy("sets").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
             .select("sets", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("ids"), ",").cast("binary"), 256).alias("sha")))
    none = hashlib.sha256(b"").hexdigest()
    clean = marked.where(F.size("sets") == 0).withColumn("n", F.lit(None).cast("long")).withColumn("sha", F.lit(None).cast("string"))
    found = salted_join(marked.where(F.size("sets") > 0), named, ["sets"], "left").select(clean.columns)
    return (clean.unionByName(found)
            .select("doc_id", "n_words", _n_hit().alias("n_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.lit(none)).alias("items_sha256"),
                    (F.size("spans") > 0).alias("contaminated"), "spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW) -> DataFrame:
    """docs without what `benchmark` holds; all columns stay.

    remove="documents" drops every row with a hit word. remove="spans" cuts each stretch of hit words from its text, from the first byte of
    its first word to the last byte of its last; n_chars, if there, follows the text. Rows without hits, null texts among them, stay as they are.
    Nulls, repeats and empty tables as for `contamination`; columns may have any names.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    got, _ = _marked(bundled(docs), store(windows(benchmark, window), "items"), True)
    if remove == "documents":
        return unbundled(got.where(F.size("spans") == 0), docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            out = raw(b, "text")
            for i, s in enumerate(b.column("spans").to_pylist()):
                if s:
                    words, at, kept = words_of([out[i]]), 0, []
                    for lo, hi in zip(s[::2], s[1::2]):
                        kept.append(out[i][at:words.begin[lo]])
                        at = int(words.end[hi - 1])
                    out[i] = b"".join([*kept, out[i][at:]])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()) if c == "text" else b.column(c) for c in names], names)

    names = ["doc_id", "text", "rest", "spans"]
    got = got.select(*names)
    return unbundled(got.mapInArrow(cut, got.schema), docs, F.size("spans") > 0)

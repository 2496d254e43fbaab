"""Repeated passages: windows of words that also start earlier, found behind a merged count-min sketch."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import bundled, raw, unbundled
from faultlens.session import ship

WINDOW = 20
GRAM = 10  # words of an anchor; a window holds WINDOW - GRAM + 1 of them
ROWS = 2  # hash rows of the sketch
BLOCK_BITS = 20
SKETCH_BITS = (20, 28)  # a row has at least and at most two to the power of so many cells, by the size of the corpus
SEGMENT = 1 << 18
BATCH_BYTES = 1 << 21
BUFFER = 1 << 20  # candidate windows held before they are pre-aggregated

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASES = [0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93]
_U = np.uint64


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    got = cache.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, SEGMENT + 256), base, _U)
        steps[0] = 1
        got = cache[base] = np.multiply.accumulate(steps)
    return got[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _mix_here(x: np.ndarray) -> np.ndarray:
    """_mix in the array's own place."""
    t = x >> _U(30)
    x ^= t
    x *= _U(0xBF58476D1CE4E5B9)
    np.right_shift(x, _U(27), out=t)
    x ^= t
    x *= _U(0x94D049BB133111EB)
    np.right_shift(x, _U(31), out=t)
    x ^= t
    return x


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end at a blank."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and not _BLANK[data[end]]:
            more = np.flatnonzero(_BLANK[data[end:end + SEGMENT]])
            end = end + int(more[0]) if len(more) else min(len(data), end + SEGMENT)
        yield at, end
        at = end


def word_hashes(texts: list[bytes], many: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """(text of each word, `many` independent 64-bit hashes of each word), words being runs of bytes other than ASCII blanks."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    of, hashes = [], [[] for _ in range(many)]
    for lo, hi in _segments(joined):
        data = joined[lo:hi]
        ink = np.r_[False, ~_BLANK[data], False]
        s, e = np.flatnonzero(~ink[:-1] & ink[1:]), np.flatnonzero(ink[:-1] & ~ink[1:])
        of.append(np.searchsorted(begins, s + lo, "right") - 1)
        for out, base in zip(hashes, _BASES):
            sums = np.zeros(len(data) + 1, _U)
            np.cumsum((data.astype(_U) + _U(1)) * _powers(base, len(data)), out=sums[1:])
            back = pow(base, -1, 1 << 64)
            out.append(_mix((sums[e] - sums[s]) * _powers(back, len(data))[s] + (e - s).astype(_U) * _U(base)))
    return np.concatenate(of), [np.concatenate(h) for h in hashes]


def _runs(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of each run of n words, built by doubling."""
    out, size, have = None, 0, h
    step, left = 1, n
    while left:
        if left & 1:
            out, size = (have, step) if out is None else (out[:len(out) - step] * _U(pow(base, step, 1 << 64)) + have[size:][:len(out) - step], size + step)
        left >>= 1
        if left:
            have = have[:max(0, len(have) - step)] * _U(pow(base, step, 1 << 64)) + have[step:]
            step *= 2
    return out[:max(0, len(h) - n + 1)]


def _extreme(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each run of n values."""
    step = 1
    while step * 2 <= n:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[:len(x) - (n - step)], x[n - step:]) if n > step else x


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(text, start, anchor, key 1, key 2) of every window, or None if there is none.

    A window's anchor is the least hash among its runs of GRAM words: equal windows have equal anchors.
    """
    of, (h1, h2) = word_hashes(texts)
    if len(of) < WINDOW:
        return None
    ok = np.flatnonzero(of[:len(of) - WINDOW + 1] == of[WINDOW - 1:])
    if not len(ok):
        return None
    anchors = _extreme(_mix(_runs(h1, GRAM, _BASES[1])), WINDOW - GRAM + 1, np.minimum)
    first = np.searchsorted(of, np.arange(len(texts)))
    return (of[ok], (ok - first[of[ok]]).astype(np.int32), anchors[ok], *(_mix(_runs(h, WINDOW, b))[ok] for h, b in zip((h1, h2), _BASES)))


def selected(texts: list[bytes]) -> np.ndarray:
    """The anchors of all windows, once for each place that serves as one: an anchor's count is at least that of any window that has it."""
    of, (h1,) = word_hashes(texts, 1)
    if len(of) < WINDOW:
        return np.empty(0, _U)
    grams = _mix(_runs(h1, GRAM, _BASES[1]))
    span = WINDOW - GRAM + 1
    least = _extreme(grams, span, np.minimum)
    least[of[:len(of) - WINDOW + 1] != of[WINDOW - 1:]] = 0
    pad = np.zeros(span - 1, _U)
    most = _extreme(np.r_[pad, least, pad], span, np.maximum)
    return grams[(most == grams) & (most > 0)]


def _cells(anchors: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(ROWS):
        yield _mix(anchors + _U(k * 0x51ED270B7F4A7C15 % (1 << 64))) >> _U(64 - bits)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about BATCH_BYTES of text; a longer text is a slice of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and held + n > BATCH_BYTES:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def sketch_bits(docs: DataFrame) -> int:
    """Bits of a sketch row, from the characters of the corpus: about four cells for each anchor, within SKETCH_BITS."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(max(np.ceil(np.log2(1 + chars / 10)), SKETCH_BITS[0]), SKETCH_BITS[1]))


def sketch(docs: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the sketch cells that count two or more, rows one after another: ROWS * 2 ** bits bits, whatever the input.

    Each partition counts its own anchors, saturating at two, and sends its filled cells in blocks; blocks are added up in parallel.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]

        def flush() -> Iterator[pa.RecordBatch]:
            for k in range(ROWS):
                if not held[k]:
                    continue
                cells, n = np.unique(np.concatenate(held[k]), return_counts=True)
                held[k] = []
                if not len(cells):
                    continue
                block = (cells >> _U(BLOCK_BITS)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(block)) + 1
                low = (cells & _U((1 << BLOCK_BITS) - 1)).astype(np.uint32)
                names, out = block[np.r_[0, cuts]], []
                for cell, many in zip(np.split(low, cuts), np.split(n > 1, cuts)):
                    out.append(zlib.compress(np.diff(cell, prepend=np.uint32(0)).tobytes() + np.packbits(many).tobytes(), 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), k, np.int32)), pa.array(names), pa.array(out, pa.binary())], ["row", "block", "cells"])

        n = 0
        for b in text_batches(batches):
            got = selected([t or b"" for t in raw(b, "text")])
            n += len(got)
            for k, cells in enumerate(_cells(got, bits)):
                held[k].append(cells)
            if n > 4 * BUFFER:
                yield from flush()
                n = 0
        yield from flush()

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BLOCK_BITS, np.uint8)
        for b in parts:
            for packed in b.column("cells").to_pylist():
                data = zlib.decompress(packed)
                n = 8 * len(data) // 33  # four bytes and a bit each
                cell = np.cumsum(np.frombuffer(data, np.uint32, n))
                counts[cell] = np.minimum(counts[cell] + 1 + np.unpackbits(np.frombuffer(data, np.uint8, offset=4 * n), count=n), 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], ["row", "block", "cells"])

    parts = docs.select("text").mapInArrow(count, "row int, block long, cells binary")
    merged = parts.groupBy("row", "block").applyInArrow(add, "row int, block long, cells binary")
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    size = (1 << BLOCK_BITS) // 8
    for row, block, cells in merged.collect():
        out[row, block * size:(block + 1) * size] = np.frombuffer(cells, np.uint8)
    return out


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, starts, spans): the repeated windows of each document that has any.

    starts lists first words of windows, spans lists flat pairs [from, to) of covered words; both together cover exactly the words
    of windows whose word sequence also starts earlier. Windows that the sketch estimates once are dropped; the others are told
    apart by 128-bit keys. Within a partition only the earliest window of a key travels, so a passage of any frequency sends at
    most a row from each buffer of BUFFER windows.
    """
    spark = docs.sparkSession
    ship(spark)
    bits = sketch_bits(docs)
    seen = spark.sparkContext.broadcast(sketch(docs, bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = seen.value
        ids: list[pa.Array] = []
        hashes: list[int] = []
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            doc_id = pa.concat_arrays(ids)
            th = np.array(hashes, _U).view(np.int64)
            doc, start, k1, k2 = (np.concatenate(x) for x in zip(*held))
            codes = doc_id.dictionary_encode()
            rank = np.full(len(codes.dictionary) + 1, len(codes.dictionary), np.int64)  # null comes last
            rank[pc.array_sort_indices(codes.dictionary).to_numpy()] = np.arange(len(codes.dictionary))
            rank = rank[codes.indices.fill_null(len(codes.dictionary)).to_numpy()]
            place = (rank[doc] << 32) | start
            first = np.argsort(place, kind="stable")
            first = first[np.argsort(k1[first], kind="stable")]
            new = np.r_[True, (k1[first][1:] != k1[first][:-1]) | (k2[first][1:] != k2[first][:-1])]
            lead = place[first][np.flatnonzero(new)][np.cumsum(new) - 1]
            late = place[first] > lead
            out = np.sort(first[~late])  # in document order ids and starts compress well
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[out].view(np.int64)), pa.array(k2[out].view(np.int64)), doc_id.take(pa.array(doc[out])), pa.array(th[doc[out]]), pa.array(start[out]),
                 pa.nulls(n, pa.list_(pa.int32()))], names)
            gone = first[late]
            if not len(gone):
                return
            gone = gone[np.lexsort((start[gone], doc[gone]))]
            d, s = doc[gone], start[gone]
            cut = np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + WINDOW)]
            at = np.flatnonzero(cut)
            spans = np.stack([s[at], s[np.r_[at[1:] - 1, len(s) - 1]] + WINDOW], axis=1).astype(np.int32)
            owner = d[at]
            step = np.r_[True, owner[1:] != owner[:-1]]
            own = owner[step]
            offsets = np.r_[np.flatnonzero(step), len(owner)].astype(np.int32) * 2
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(spans.ravel()))
            m = len(own)
            key = _mix(th[own].view(_U) + own.astype(_U)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(key), doc_id.take(pa.array(own)), pa.array(th[own]), pa.array(np.full(m, -1, np.int32)), lists], names)

        n = 0
        for b in text_batches(batches):
            texts = [t or b"" for t in raw(b, "text")]
            got = windows(texts)
            if got is None:
                continue
            of, start, anchors, k1, k2 = got
            ok = np.ones(len(of), bool)
            for row, cells in zip(often, _cells(anchors, bits)):
                ok &= (row[(cells >> _U(3)).astype(np.int64)] >> (cells & _U(7)).astype(np.uint8) & 1).astype(bool)
            if not ok.any():
                continue
            held.append((of[ok] + len(hashes), start[ok], k1[ok], k2[ok]))
            ids.append(b.column("doc_id"))
            hashes += [xxhash.xxh64_intdigest(t, 42) for t in texts]
            n += int(ok.sum())
            if n >= BUFFER:
                yield from flush()
                ids, hashes, held, n = [], [], [], 0
        if held:
            yield from flush()

    names = ["k1", "k2", "doc_id", "text_hash", "start", "spans"]
    found = docs.select("doc_id", "text").mapInArrow(
        mark, f"k1 long, k2 long, doc_id {kind}, text_hash long, start int, spans array<int>")
    place = "struct(doc_id IS NULL, doc_id, start)"
    late = (found.withColumn("first", F.expr(f"min({place}) OVER (PARTITION BY k1, k2)"))
            .where(F.expr(f"start = -1 OR first < {place}")))
    return late.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.expr("nullif(start, -1)")).alias("starts"), F.flatten(F.collect_list("spans")).alias("spans"))


def _cut(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest, kept, n_words, n_removed) for every row of docs; rest is a struct of its other columns."""
    marks = repeated(docs)
    own = bundled(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    m = marks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "starts", "spans").hint("shuffle_hash")
    both = own.join(m, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "rest", "starts", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            kept, total, gone = [], [], []
            for text, starts, spans in zip(raw(b, "text"), b.column("starts"), b.column("spans")):
                words = text.split() if text else []
                total.append(len(words))
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    s, p = (x.values.to_numpy().astype(np.int64) for x in (starts, spans))
                    np.add.at(edge, np.r_[s, p[::2]], 1)
                    np.add.at(edge, np.r_[s + WINDOW, p[1::2]], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone.append(len(words) - int(stays.sum()))
                    words = [w for w, ok in zip(words, stays.tolist()) if ok]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "text", "rest")), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                ["doc_id", "text", "rest", "kept", "n_words", "n_removed"])

    schema = own.drop("text_hash").schema.add("kept", "string").add("n_words", "long").add("n_removed", "long")
    return both.mapInArrow(run, schema)


def remove_repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, kept, n_words, n_removed): every row of docs with its words that no repeated window covers.

    A window is WINDOW consecutive words (`[^\\x20\\x09-\\x0D]+`, unchanged) of one document. A word goes if a window over it has a
    word sequence that also starts earlier: in a smaller doc_id, or earlier in the same document; windows are judged on the input.
    kept is the words left, joined by one space. Null and blank texts have no words and kept ''. Rows without a doc_id come after
    all others. Rows that share a doc_id count as one place, so equal rows do not remove each other. Other columns are not looked at.
    An empty table gives an empty table.
    """
    return _cut(docs.select("doc_id", "text")).select("doc_id", "text", "kept", "n_words", "n_removed")


def without_repeated(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of the texts; a text that loses nothing stays as it is. n_chars, if there, follows the text.

    Nulls, blank and repeated texts, ties and empty tables as for `remove_repeated`; columns may have any names.
    """
    got = _cut(docs)
    return unbundled(got.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs, F.col("n_removed") > 0)

"""Scores of texts under a bigram model smoothed by deleted interpolation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import bucket, raw, store
from faultlens.llm.substrings import _mix, text_batches, word_hashes
from faultlens.session import ship

LEFT_OUT = 1  # bucket of crc32(id) modulo 5 that the model does not learn from
HELD = 10  # one training document of so many is held out to learn the mixture
BLOCK = 1 << 20  # tokens of a block
SHARD = 1 << 23  # bytes of text to a shard of the counts
SHARDS = (16, 1 << 20)
BUCKETS = 16  # of context counts, by powers of two
STEPS = 4  # of a factor of two, in the table that the mixture is learned from
WEIGHTS = (0.6, 0.3, 0.1)  # of bigram, unigram and uniform estimates where nothing was held out
LEAST = 1e-4  # of the uniform estimate

_U = np.uint64
START, END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def _pack(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: small ones leave whole planes of zeros."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1) if len(x) else b""


def _unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1).T).view(kind).ravel() if data else np.empty(0, kind)


def _pack_sorted(h: np.ndarray) -> bytes:
    """Ascending 64-bit integers as steps of six bytes, or of eight where one is larger."""
    step = np.diff(h, prepend=_U(0))
    width = 6 if len(step) and int(step[1:].max(initial=0)) < 1 << 48 else 8
    return bytes([width]) + (h[:1].tobytes() + step[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes() if len(h) else b"")


def _unpack_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    if len(data) == 1:
        return np.empty(0, _U)
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(body) + 1, 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8, offset=1)
    step[1:, :width] = body
    return np.cumsum(step.view(_U).ravel(), dtype=_U)


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as rows of about BLOCK tokens: ids, lengths, the block's distinct word hashes and its tokens as positions among them.

    Tokens are the words with A-Z folded, then one end. Held-out training documents have blocks of their own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 24
        parts: dict[bool, list] = {False: [], True: []}

        def block(held: bool) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, trains, lengths, hashes = zip(*parts[held])
            parts[held] = []
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([made]), pa.array([held]), pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                 pa.array([_pack(np.concatenate(lengths))]), pa.array([np.packbits(np.concatenate(trains)).tobytes()]),
                 pa.array([_pack_sorted(words)]), pa.array([_pack(tokens.astype(np.uint32))])], names)

        for b in text_batches(batches):
            for held in (False, True):
                part = b.filter(b.column("held")) if held else b.filter(pa.array(~b.column("held").to_numpy(zero_copy_only=False)))
                if not part.num_rows:
                    continue
                of, (h,) = word_hashes([(t or b"").lower() for t in raw(part, "text")], 1)
                n = np.bincount(of, minlength=part.num_rows)
                tokens = np.full(len(h) + len(n), END, _U)
                tokens[np.arange(len(h)) + of] = h
                parts[held].append((part.column("doc_id"), part.column("train").to_numpy(zero_copy_only=False), (n + 1).astype(np.int64), tokens))
                if sum(len(p[3]) for p in parts[held]) >= BLOCK:
                    yield block(held)
        for held in (False, True):
            if parts[held]:
                yield block(held)

    names = ["block", "held", "ids", "lengths", "train", "words", "tokens"]
    rest = bucket("doc_id")
    train = F.coalesce(rest != LEFT_OUT, F.lit(False))
    flagged = docs.select("doc_id", "text", train.alias("train"), (train & F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0, F.lit(False))).alias("held"))
    return flagged.mapInArrow(run, f"block long, held boolean, ids array<{kind}>, lengths binary, train binary, words binary, tokens binary")


class Block:
    """A block's arrays: words and bigrams are its distinct ones in order of their hashes, with a token's place among them."""

    def __init__(self, row: dict):
        self.lengths = _unpack(row["lengths"], np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(self.lengths)).astype(bool)
        self.words, self.token = _unpack_sorted(row["words"]), _unpack(row["tokens"], np.uint32).astype(np.int64)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = len(self.words)
        code, place = np.unique(before * (len(self.words) + 1) + self.token, return_inverse=True)
        self.context, self.last = np.divmod(code, len(self.words) + 1)
        h = _mix(np.r_[self.words, START][self.context] * _U(0x9E3779B97F4A7C15) + self.words[self.last])
        order = np.argsort(h)
        self.bigrams, self.context, self.last = h[order], self.context[order], self.last[order]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.pair = back[place]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training tokens of each word and of each bigram."""
        on = self.train[self.doc]
        return np.bincount(self.token[on], minlength=len(self.words)), np.bincount(self.pair[on], minlength=len(self.bigrams))


def _messages(bits: int):
    """What a block asks each shard of the counts: its distinct words (kind 1) or bigrams (kind 2) there, with its own counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                for kind, h, n in zip((1, 2), (block.words, block.bigrams), block.counts()):
                    shard = (h >> _U(64 - bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(shard)) + 1
                    names = shard[np.r_[0, cuts]] if len(shard) else shard
                    packed = [(_pack_sorted(x), _pack(y.astype(np.uint64))) for x, y in zip(np.split(h, cuts), np.split(n, cuts))] if len(shard) else []
                    m = len(packed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, kind, np.int32)), pa.array(names), pa.array(np.full(m, row["block"], np.int64)), pa.array(np.full(m, row["held"])),
                         pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                        ["kind", "shard", "block", "held", "keys", "n"])
    return run


def _answer(group: pa.Table) -> pa.Table:
    """Sums over all blocks of one shard, back to each block in the order it asked; block -1 has how many keys were seen in training."""
    keys, n = [_unpack_sorted(k) for k in group.column("keys").to_pylist()], [_unpack(x, np.uint64).astype(np.int64) for x in group.column("n").to_pylist()]
    held, block = group.column("held").to_pylist(), group.column("block").to_pylist()
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate(n)
    all_ = np.bincount(at, own).astype(np.uint64)
    kept = np.bincount(at, own * ~np.repeat(held, [len(k) for k in keys])).astype(np.uint64)
    parts = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    size = len(block) + 1
    return pa.table({
        "block": pa.array([*block, -1], pa.int64()), "kind": pa.array(np.full(size, group.column("kind")[0].as_py(), np.int32)), "shard": pa.array(np.full(size, group.column("shard")[0].as_py(), np.int64)),
        "total": pa.array([*(_pack(all_[p]) for p in parts), _pack(np.array([(all_ > 0).sum()], np.uint64))], pa.binary()),
        "kept": pa.array([*(_pack(kept[p]) if h else None for p, h in zip(parts, held)), _pack(np.array([(kept > 0).sum()], np.uint64))], pa.binary())})


def _answers(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a block's words and bigrams, put together from the shards' answers."""
    got = sorted(row["answers"], key=lambda a: (a["kind"], a["shard"]))
    return tuple(np.concatenate([_unpack(a[name], np.uint64).astype(np.float64) for a in got if a["kind"] == kind]) for kind in (1, 2))


def _bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole binary logarithm of its count, to BUCKETS - 1."""
    return np.minimum(BUCKETS - 1, np.where(n > 0, np.log2(np.maximum(n, 1)).astype(np.int64) + 1, 0))


def estimates(block: Block, words: np.ndarray, pairs: np.ndarray, tokens: int, distinct: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(bucket of the context, bigram, unigram, uniform maximum-likelihood estimate) of each bigram of a block."""
    context = np.r_[words, documents][block.context]
    return _bucket(context), pairs / np.maximum(context, 1), words[block.last] / max(1, tokens), 1.0 / (distinct + 1)


def mixture(table: list[tuple[int, int, int, int]], rounds: int = 200) -> np.ndarray:
    """Weights of the three estimates by bucket, from held-out counts (bucket, bigram step, unigram step, count), by expectation-maximisation.

    Steps are STEPS times the binary logarithm of an estimate over the uniform one; a negative step is an estimate of 0.
    """
    out = np.tile(WEIGHTS, (BUCKETS, 1)).astype(float)
    x = np.array(table, np.int64).reshape(-1, 4)
    for b in range(BUCKETS):
        part = x[x[:, 0] == b]
        if len(part):
            p = np.stack([*(np.where(part[:, k] < 0, 0.0, 2.0 ** (part[:, k] / STEPS)) for k in (1, 2)), np.ones(len(part))], axis=1)
            n, w = part[:, 3].astype(float), out[b]
            for _ in range(rounds):
                share = p * w
                share /= share.sum(axis=1, keepdims=True)
                new = n @ share / n.sum()
                moved, w = np.abs(new - w).max(), new
                if moved < 1e-7:
                    break
            out[b] = w
        elif b:
            out[b] = out[b - 1]
    out[0, 0] = 0.0
    out[:, 2] = np.maximum(out[:, 2], LEAST)
    return out / out.sum(axis=1, keepdims=True)


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs, on its whole text.

    The model learns from the documents whose bucket is not LEFT_OUT: counts of all their words and bigrams, and for each bucket of context counts the weights that
    mix bigram, unigram and uniform estimates, learned on one training document of HELD against the counts of the others. held_out tells the
    documents left out. base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))). Null and blank texts are one end. A document without an id is scored
    but not learned from, and not held out. Repeated rows count as often as they occur. Without training documents both scores are 0.

    Documents are put into blocks in the shared folder; each block asks the shards of the counts for its distinct words and bigrams
    and is joined with the answers. No key's rows meet beyond one for each block, and no table of counts is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    made = store(blocks(docs), "blocks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(SHARDS[0], min(SHARDS[1], size // SHARD + 1)).bit_length()
    asked = made.mapInArrow(_messages(bits), "kind int, shard long, block long, held boolean, keys binary, n binary")
    answers = store(asked.groupBy("kind", "shard").applyInArrow(_answer, "block long, kind int, shard long, total binary, kept binary"), "answers")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = np.zeros((len(rows), 4), np.int64)
            for i, r in enumerate(rows):
                lengths = _unpack(r["lengths"], np.int64)
                on = np.unpackbits(np.frombuffer(r["train"], np.uint8), count=len(lengths)).astype(bool)
                out[i] = lengths[on].sum(), on.sum(), (not r["held"]) * lengths[on].sum(), (not r["held"]) * on.sum()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T.copy()], ["n", "d", "kn", "kd"])

    total = made.select("held", "lengths", "train").mapInArrow(sums, "n long, d long, kn long, kd long").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "d", "kn", "kd"))).first()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(_unpack(x, np.uint64)[0]) for x in b.column(c).to_pylist())]) for c in ("total", "kept")], ["v", "kv"])

    distinct = answers.where("block = -1 AND kind = 1").select("total", "kept").mapInArrow(seen, "v long, kv long").agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("kv"), F.lit(0)).alias("kv")).first()
    n, d, kn, kd, v, kv = *total, *distinct

    def joined(what: DataFrame, name: str) -> DataFrame:
        by = answers.where(f"block >= 0 AND {name} IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("kind", "shard", name)).alias("answers"))
        return what.join(by, "block")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                at, two, one, zero = estimates(block, *_answers(row, "kept"), kn, kv, kd)
                step = [np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p / zero, 1.0))), -1).astype(np.int64) for p in (two, one)]
                cell, place = np.unique(np.stack([at, *step], axis=1), axis=0, return_inverse=True)
                count = np.bincount(place.ravel(), block.counts()[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cell.T.copy()), pa.array(count)], ["b", "two", "one", "n"])

    held = joined(made.where("held"), "kept").mapInArrow(steps, "b long, two long, one long, n long").groupBy("b", "two", "one").agg(F.sum("n").alias("n"))
    weights = mixture([tuple(r) for r in held.collect()])  # one row for each filled cell of a table of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            for i, row in enumerate(b.drop_columns(["ids"]).to_pylist()):
                block = Block(row)
                words, pairs = _answers(row, "total")
                at, two, one, zero = estimates(block, words, pairs, n, v, d)
                w = weights[at]
                p = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * zero) if n else np.zeros(len(at))
                base = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))
                rows = len(block.lengths)
                add = lambda x: np.bincount(block.doc, x, minlength=rows)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values, pa.array(block.lengths), pa.array(add(words[block.token] > 0).astype(np.int64)), pa.array(add(base[block.token])), pa.array(add(p[block.pair]))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    got = joined(made, "total").mapInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return got.select("doc_id", F.coalesce(bucket("doc_id") == LEFT_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")

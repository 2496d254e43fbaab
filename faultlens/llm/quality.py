"""Quality of documents: random-indexing word vectors, pooled, under a small network with calibrated probabilities."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import bucket, labelled_sample, raw
from faultlens.llm.substrings import _mix, _powers, text_batches
from faultlens.session import ship

SAMPLE, SAMPLE_BYTES = 4_000, 5 << 20  # labelled documents, and bytes of them, to learn from
DIM, SPARSE = 48, 6
WIDTH = DIM + 3
VOCABULARY, LEAST = 30_000, 5
SPAN = 2  # neighbours to each side
HIDDEN, EPOCHS, STEP = 24, 60, 0.01
CHUNK = 1 << 18  # characters whose words are looked up together
_BASE = 0x9E3779B97F4A7C15
THRESHOLD = 0.3

_PARTS = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)


def features_of(word: str) -> list[str]:
    """Tokens of one word: its letters in lower case, their case, and the marks around them."""
    before, core, after = _PARTS.match(word).groups()
    out = [f"<{before[:4]} {after[:4]}>"]
    if core:
        out.append("<9>" if not core.isalpha() and any(map(str.isdigit, core)) else "<AA>" if len(core) > 1 and core.isupper() else "<aa>" if core.islower() else "<Aa>")
        out.append(core.lower())
    return out


def _index_vector(token: str) -> np.ndarray:
    """The token's sparse ternary vector, from its hash alone."""
    v = np.zeros(DIM, np.float32)
    h = xxhash.xxh3_128_digest(token.encode())
    for i in range(SPARSE):
        v[h[i] % DIM] += 1.0 if h[15 - i] & 1 else -1.0
    return v


@dataclass
class Model:
    """Word vectors by token and the network over pooled documents."""
    rows: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((h @ self.w2 + self.b2) / self.temperature, -40, 40)))


LATIN = 0x250  # code points that are classed by table; words with others, or with odd ones, are looked up one by one
_BLANK, _LOWER, _UPPER, _DIGIT, _MARK, _ODD = range(6)
_CLASS = np.full(LATIN + 1, _ODD, np.uint8)
_FOLD = np.arange(LATIN + 1, dtype=np.uint32)
for _c in map(chr, range(LATIN)):
    if _c in " \t\n\x0b\x0c\r":
        _CLASS[ord(_c)] = _BLANK
    elif not _c.isalnum():
        _CLASS[ord(_c)] = _MARK
    elif _c.isalpha() and _c.islower():
        _CLASS[ord(_c)] = _LOWER
    elif _c.isalpha() and _c.isupper() and len(_c.lower()) == 1:
        _CLASS[ord(_c)], _FOLD[ord(_c)] = _UPPER, ord(_c.lower())
    elif _c in "0123456789":
        _CLASS[ord(_c)] = _DIGIT


class Lookup:
    """Token vectors by hashes, for many words at once."""

    def __init__(self, rows: dict[str, int], vectors: np.ndarray):
        self.rows, self.vectors = rows, np.concatenate([vectors, np.zeros((1, DIM), np.float32)])
        none = len(vectors)
        words = [t for t in rows if t[0] != "<"]
        codes = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        keys = _hashes(codes, np.r_[0, ends[:-1] + 1] if words else ends, ends)
        order = np.argsort(keys)
        self.keys, self.at = keys[order], np.array([rows[w] for w in words], np.int64)[order]
        marks = [rows.get(f"< {chr(c) if c < LATIN else ''}>", none) for c in range(LATIN + 1)]
        kinds = [rows.get(k, none) for k in ("<aa>", "<AA>", "<Aa>", "<9>")]
        self.frames = (self.vectors[marks][:, None] + self.vectors[kinds][None]).reshape(-1, DIM)  # of the mark after a plain word and of its case

    def of(self, word: str) -> list[int]:
        return [self.rows[t] for t in features_of(word) if t in self.rows]


def _hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), out=sums[1:])
    return _mix((sums[end] - sums[begin]) * _powers(pow(_BASE, -1, 1 << 64), len(codes) + 1)[begin] + (end - begin).astype(np.uint64))


def _stretches(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK characters that end at a blank."""
    at = 0
    while at < len(codes):
        end = min(len(codes), at + CHUNK)
        while end < len(codes) and codes[end] != 10:
            blanks = np.flatnonzero(_CLASS[np.minimum(codes[end:end + CHUNK], LATIN)] == _BLANK)
            if len(blanks):
                end += int(blanks[0])
                break
            end = min(len(codes), end + CHUNK)
        yield at, end
        at = end


def pooled(texts: list[bytes | None], look: Lookup) -> np.ndarray:
    """For each text the mean word vector, the log of the number of words, the shares of words that repeat the last one and that differ; zeros without words.

    Words of plain letters or digits, with a mark behind or none, are classed and looked up together, some CHUNK characters at a time; the others one by
    one. Nothing is kept from one call to the next.
    """
    out = np.zeros((len(texts), WIDTH))
    for i, text in enumerate(texts):
        words = text.split() if text else []
        n = max(1, len(words))
        out[i, DIM:] = np.log1p(len(words)), sum(map(eq, words, islice(words, 1, None))) / n, len(set(words)) / n
    decoded = [(t or b"").decode(errors="replace") for t in texts]
    whole = "\n".join([*decoded, ""])
    codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    firsts = np.cumsum([0] + [len(t) + 1 for t in decoded[:-1]])
    for lo, hi in _stretches(codes):
        small = np.minimum(codes[lo:hi], LATIN)
        kind = _CLASS[small]
        ink = np.r_[False, kind != _BLANK, False]
        s, e = np.flatnonzero(~ink[:-1] & ink[1:]), np.flatnonzero(ink[:-1] & ~ink[1:])
        if not len(s):
            continue
        of = np.searchsorted(firsts, s + lo, "right") - 1
        upper, lower, digit, mark, odd = (np.add.reduceat(np.r_[kind == k, False].astype(np.int32), np.stack([s, e], axis=1).ravel())[::2] for k in (_UPPER, _LOWER, _DIGIT, _MARK, _ODD))
        last = (kind[e - 1] == _MARK).astype(np.int64)
        plain = (odd == 0) & (mark == last) & (e - s > last)
        case = np.where(digit > 0, 3, np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 1, 2)))
        frame = np.where(last > 0, small[e - 1], LATIN) * 4 + case
        at = np.flatnonzero(plain)
        keys = _hashes(_FOLD[small], s[at], (e - last)[at])
        place = np.minimum(np.searchsorted(look.keys, keys), max(0, len(look.keys) - 1))
        core = np.where(look.keys[place] == keys, look.at[place], len(look.vectors) - 1) if len(look.keys) else np.full(len(at), len(look.vectors) - 1)
        for k in range(0, len(at), 8192):
            own = of[at[k:k + 8192]]
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[cut], :DIM] += np.add.reduceat(look.frames[frame[at[k:k + 8192]]] + look.vectors[core[k:k + 8192]], cut, axis=0, dtype=np.float64)
        rest = np.flatnonzero(~plain)
        seen: dict[str, list[int]] = {}
        owners, flat = [], []
        for i, b, c in zip(of[rest].tolist(), (s[rest] + lo).tolist(), (e[rest] + lo).tolist()):
            w = whole[b:c]
            ids = seen.get(w)
            if ids is None:
                ids = seen[w] = look.of(w)
            flat += ids
            owners += [i] * len(ids)
        if flat:
            own = np.array(owners)
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[cut], :DIM] += np.add.reduceat(look.vectors[flat], cut, axis=0, dtype=np.float64)
    out[:, :DIM] /= np.maximum(1, np.expm1(out[:, DIM:DIM + 1]).round())
    return out


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Unit context vectors of the frequent tokens: sums of their own and their neighbours' index vectors."""
    form: dict[bytes, int] = {}
    ids = [np.fromiter((form.setdefault(w, len(form)) for w in t.encode().split()), np.int32) for t in texts]
    often = np.bincount(np.concatenate(ids), minlength=len(form)) if form else np.empty(0, np.int64)
    token: dict[str, int] = {}
    of_, has_ = array("i"), array("i")
    for w, i in form.items():
        for t in features_of(w.decode(errors="replace")):
            of_.append(i)
            has_.append(token.setdefault(t, len(token)))
    of, has = np.frombuffer(of_, np.int32) if of_ else np.empty(0, np.int32), np.frombuffer(has_, np.int32) if has_ else np.empty(0, np.int32)
    counts = np.bincount(has, weights=often[of], minlength=len(token))
    top = sorted(((-int(counts[i]), t, i) for t, i in token.items() if counts[i] >= LEAST))[:VOCABULARY]
    row = np.full(len(token) + 1, -1)
    row[[i for _, _, i in top]] = np.arange(len(top))
    of, has = of[row[has] >= 0], row[has][row[has] >= 0]
    index = np.stack([_index_vector(t) for _, t, _ in top]) if top else np.zeros((0, DIM), np.float32)
    # what the neighbours of a word form see of it; the last form is a gap between texts
    shown = np.zeros((len(form) + 1, DIM), np.float32)
    for lo in range(0, len(of), 50_000):
        np.add.at(shown, of[lo:lo + 50_000], index[has[lo:lo + 50_000]])
    around = np.zeros_like(shown)
    gap = np.full(SPAN, len(form), np.int32)
    run = np.concatenate([gap, *(x for t in ids for x in (t, gap))])
    for lo in range(SPAN, len(run) - SPAN, 20_000):
        hi = min(lo + 20_000, len(run) - SPAN)
        seen = shown[run[lo - SPAN:hi + SPAN]]
        near, own = sum(seen[k:k + hi - lo] for k in range(2 * SPAN + 1)), run[lo:hi]
        order = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        around[own[order][cut]] += np.add.reduceat(near[order], cut, axis=0)
    vectors = np.zeros((len(top), DIM), np.float32)
    for lo in range(0, len(of), 50_000):
        np.add.at(vectors, has[lo:lo + 50_000], around[of[lo:lo + 50_000]])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return {t: i for i, (_, t, _) in enumerate(top)}, vectors / np.maximum(norm, 1e-9)


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> Model:
    """Fit on labelled texts: four fifths set the network's weights, the last fifth its temperature. Without both labels every score is their share."""
    rows, vectors = word_vectors(texts)
    look = Lookup(rows, vectors)
    x = np.concatenate([np.zeros((0, WIDTH)), *(pooled([t.encode() for t in texts[at:at + 500]], look) for at in range(0, len(texts), 500))])
    y = labels.astype(float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(seed)
    blank = Model(rows, vectors, np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)
    if len(set(labels.tolist())) < 2:
        return blank
    order = rng.permutation(len(y))
    fit, check = order[len(y) // 5:], order[:len(y) // 5]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = {"w1": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.array(blank.b2)}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        turn = rng.permutation(fit)
        for at in range(0, len(turn), 256):
            i = turn[at:at + 256]
            h = np.tanh(z[i] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40))) - y[i]) / len(i)
            back = d[:, None] * p["w2"] * (1 - h * h)
            g = {"w1": z[i].T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum()}
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - STEP * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    model = Model(rows, vectors, mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"]), 1.0)
    if len(check):
        logit = np.tanh(z[check] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
        signed = np.where(y[check] > 0, logit, -logit)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        model.temperature = float(grid[np.argmin([np.logaddexp(0, -signed / k).mean() for k in grid])])
    return model


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs, scored on its whole text alone.

    The model is fitted on at most `sample` labelled rows, of SAMPLE_BYTES at most, outside the held-out fifth and sent to the workers; its size is bounded by VOCABULARY. Null
    and blank texts have the pooled vector zero and are scored like any other. A null doc_id is not held out. docs needs doc_id and text,
    labels doc_id and the label; other columns are not looked at. Without labels every score is one half; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(*labelled_sample(docs, labels, label, sample, SAMPLE_BYTES)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        look = Lookup(m.rows, m.vectors)
        for b in text_batches(batches):
            s = m.score(pooled(raw(b, "text"), look))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    got = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return got.select("doc_id", F.coalesce(bucket("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects (score under THRESHOLD), as they are; every row is judged by its own text.

    Null and blank texts, repeated rows and missing labels as for `scores`; an empty table gives an empty table, and columns may have any names.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(*labelled_sample(docs, labels, "quality", SAMPLE, SAMPLE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        look = Lookup(m.rows, m.vectors)
        for b in text_batches(batches):
            yield b.filter(pa.array(m.score(pooled(raw(b, "text"), look)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

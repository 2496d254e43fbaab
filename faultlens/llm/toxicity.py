"""Toxicity of documents: a weighted lexicon found by Aho-Corasick in folded text, less exception phrases, over length."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import bucket, labelled_sample, raw
from faultlens.llm.substrings import text_batches
from faultlens.session import ship

SAMPLE = 8_000  # labelled documents to learn from
STEMS = (4, 5, 6, 7)  # letters of word beginnings that can be entries
LEAST = 6  # toxic documents that an entry or a phrase needs
WEIGHT = 3.5  # log odds that an entry needs
ENTRIES = 20_000
POWERS = (0.05, 0.1, 0.25, 0.5, 1.0)  # of the number of words, that the sum may be divided by
THRESHOLD = 0.5

# Letters of other scripts, digits and signs that are written for Latin letters, and signs that show nothing.
LOOKALIKES = dict(zip("аасԁеһіјӏорԛѕԝхуѵαβειкκνορτυχωɑɡıɩ", "aacdehijlopqswxyvabeikknoptuxwagii")) | dict(zip("0134578@$€", "oieastbase"))
UNSEEN = "­​‌‍⁠﻿"

_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in UNSEEN} | {ord(c): " " for c in "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~¡¿«»…“”„‘’–—\t\n\r\x0b\x0c"}


def fold(text: str) -> str:
    """Words of a text in one spelling, each between blanks: compatibility forms, case, look-alike letters and digit substitutions are undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {' '.join(text.casefold().translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """Weights of folded words (" word ") and word beginnings (" stem"), phrases that excuse an entry in them, and the calibration of the sum."""
    weights: dict[str, float]
    excused: dict[str, float]
    power: float
    slope: float
    offset: float

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for key, w in (self.weights | {k: -w for k, w in self.excused.items()}).items():
            a.add_word(key, w)
        a.make_automaton()
        return a

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * total / np.maximum(1, words) ** self.power + self.offset, -40, 40)))


def weigh(automaton: ahocorasick.Automaton | None, folded: str) -> float:
    """Sum of the weights of all entries in a folded text, phrases counting against the entries they excuse."""
    return max(0.0, sum(w for _, w in automaton.iter(folded))) if automaton is not None else 0.0


def learn(texts: list[str], labels: np.ndarray) -> Lexicon:
    """Entries, exception phrases, length power and calibration from labelled texts.

    Words and word beginnings are weighed by their smoothed log odds of being in a toxic document. A beginning stands for its words if it is found
    in half as many toxic documents again as the commonest of them; of several, the shortest is taken. A phrase of an entry and a word beside it
    is an exception if it is found in LEAST clean documents and in no toxic one. Without both labels every score is the label's share.
    """
    y = labels.astype(bool)
    folded = [fold(t) for t in texts]
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = Lexicon({}, {}, POWERS[0], 0.0, math.log(share / (1 - share)))
    if not y.any() or y.all():
        return flat
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for t, toxic in zip(folded, y.tolist()):
        words = set(t.split())
        counts[toxic].update(f" {w} " for w in words)
        counts[toxic].update({f" {w[:n]}" for w in words for n in STEMS if len(w) > n})
    clean, bad = counts
    n_bad, n_clean = int(y.sum()), int((~y).sum())

    def odds(key: str) -> float:
        return math.log((bad[key] + 0.5) / (n_bad + 1)) - math.log((clean[key] + 0.5) / (n_clean + 1))

    good = {k for k, n in bad.items() if n >= LEAST and odds(k) >= WEIGHT}
    most: Counter = Counter()  # of a beginning: the commonest word below it
    for k in bad:
        if k.endswith(" "):
            for n in STEMS:
                if len(k) > n + 2:
                    most[k[:n + 1]] = max(most[k[:n + 1]], bad[k])
    stems: set[str] = set()
    for k in sorted((k for k in good if not k.endswith(" ")), key=len):
        if bad[k] >= 1.5 * most[k] and not any(k[:n] in stems for n in range(STEMS[0] + 1, len(k))):
            stems.add(k)
    words = {k for k in good if k.endswith(" ") and not any(k[:n + 1] in stems for n in STEMS)}
    weights = {k: odds(k) for k in sorted(stems | words, key=lambda k: (-bad[k] * odds(k), k))[:ENTRIES]}
    first = Lexicon(weights, {}, 1.0, 1.0, 0.0)
    finder = first.automaton()
    beside: tuple[Counter, Counter] = (Counter(), Counter())
    of: dict[str, float] = {}
    for t, toxic in zip(folded, y.tolist()):
        seen = set()
        for end, w in (finder.iter(t) if finder is not None else ()):
            at = t.rfind(" ", 0, end if t[end] == " " else end + 1)
            to = t.find(" ", at + 1)
            before, after = t.rfind(" ", 0, at), t.find(" ", to + 1)
            for phrase in ((t[before:to + 1] if before >= 0 else ""), (t[at:after + 1] if after > 0 else "")):
                if phrase:
                    seen.add(phrase)
                    of[phrase] = w
        beside[toxic].update(seen)
    excused = {p: of[p] for p, n in beside[0].items() if n >= LEAST and not beside[1][p]}
    finder = Lexicon(weights, excused, 1.0, 1.0, 0.0).automaton()
    total = np.array([weigh(finder, t) for t in folded])
    size = np.array([max(1, t.count(" ") - 1) for t in folded], float)
    best = None
    for power in POWERS:
        x = total / size ** power
        scale = x.std() or 1.0
        z = np.stack([x / scale, np.ones(len(x))], axis=1)
        beta = np.array([0.0, flat.offset])
        for _ in range(40):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
            grad = z.T @ (p - y) + 0.01 * beta
            beta = beta - np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), grad), -5, 5)
        loss = np.logaddexp(0, -np.where(y, 1, -1) * (z @ beta)).mean()
        if best is None or loss < best[0]:
            best = loss, Lexicon(weights, excused, power, max(0.0, float(beta[0] / scale)), float(beta[1]))
    return best[1]


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, weight): one row per row of docs, scored on its whole text alone.

    The lexicon is learned from at most `sample` labelled rows outside the held-out fifth, holds at most ENTRIES entries and is sent to the workers. weight is
    the sum before it is divided by a power of the number of words and calibrated. Null and blank texts have weight 0. A null doc_id is not held out.
    docs needs doc_id and text, labels doc_id and toxic; other columns are not looked at. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    lexicon = spark.sparkContext.broadcast(learn(*labelled_sample(docs, labels, "toxic", sample)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = lexicon.value.automaton()
        for b in text_batches(batches):
            folded = [fold((t or b"").decode()) for t in raw(b, "text")]
            total = np.array([weigh(finder, t) for t in folded])
            size = np.array([t.count(" ") - 1 for t in folded], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lexicon.value.score(total, size)), pa.array(total)], ["doc_id", "score", "weight"])

    got = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, weight double")
    return got.select("doc_id", F.coalesce(bucket("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight")

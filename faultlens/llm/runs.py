"""Periodic runs of words: maximal pairs from a bottom-up LCP-interval tree over each document's suffixes."""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import bundled, raw, unbundled
from faultlens.llm.substrings import text_batches
from faultlens.session import ship

TIMES, LEAST = 4, 6  # a run of period q has at least TIMES * q and at least LEAST words
SHARED = -(-LEAST * (TIMES - 1) // TIMES)  # words that the suffixes of the shortest run share at least
Run = tuple[int, int, int]  # start, length, period
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def _numbers(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, number of the word) of every word; equal words have equal numbers."""
    form: dict[bytes, int] = {}
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return of, np.fromiter((form.setdefault(w, len(form)) for d in docs for w in d), np.int64, len(of))


def _suffixes(of: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, words shared with the next) of the suffixes that may begin one of a run's maximal pairs, in suffix order.

    Ranks of the first h words are refined by doubling h, among suffixes whose rank is shared; documents never share one. A pair that shares at least h
    and fewer than 2 h words is no nearer than the nearest equal at h. If that is a third of 2 h away or more at every h, no pair of the suffix is
    near enough for a run, and it is left out.
    """
    n = len(ids)
    end = np.searchsorted(of, of, "right")
    _, name, counts = np.unique(of * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[name].astype(np.int32)
    levels, kept = [rank], np.zeros(n, bool)
    active, h = np.flatnonzero(counts[name] > 1), 1
    while len(active):
        order = active[np.argsort(rank[active], kind="stable")]  # by rank, then place
        same = rank[order][1:] == rank[order][:-1]
        gap = np.where(same, np.diff(order), n)
        near = np.minimum(np.r_[gap, n], np.r_[n, gap])
        then = np.where(order + h < end[order], rank[np.minimum(order + h, n - 1)], -1).astype(np.int64)
        key = rank[order].astype(np.int64) * (n + 1) + then + 1
        place = np.argsort(key, kind="stable")
        order, near, key = order[place], near[place], key[place]
        first = np.r_[True, key[1:] != key[:-1]]
        head = np.r_[True, rank[order][1:] != rank[order][:-1]]
        at = np.arange(len(order))
        begin = at[head][np.cumsum(head) - 1]  # where the old rank's group begins
        own = at[first][np.cumsum(first) - 1]
        fresh = rank[order] + (own - begin)
        rank = rank.copy()
        rank[order] = fresh
        levels.append(rank)
        alone = first & np.r_[first[1:], True]
        if 2 * h > SHARED:
            kept[order[near * (TIMES - 1) < 2 * h]] = True
        active = np.sort(order[~alone])
        h *= 2
    starts = np.flatnonzero(kept)
    starts = starts[np.argsort(rank[starts])]
    a, b = starts[:-1], starts[1:]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + shared, b + shared
        ok = (i < end[a]) & (j < end[b])
        equal = levels[k][np.where(ok, i, 0)] == levels[k][np.where(ok, j, 0)]
        shared += np.where(ok & equal, 1 << k, 0)
    return starts, np.r_[shared, 0][:len(starts)]


def runs_of(docs: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words, by start and then period.

    Suffixes hang in the tree of intervals that share l words. An interval keeps its suffixes in order of place, each under the class of the word to its
    left; where children of one interval meet, the smaller list is looked up in the larger. Two suffixes d apart, from different children and of
    different classes, are a maximal pair: their l + d words have period d and no neighbour extends them. With l >= (TIMES - 1) * d they are
    a run; the suffixes one period apart are neighbours in the joined list, since one between them would give a shorter period, so only neighbours
    are compared. Multiples of a period yield the same words and lose to it.
    """
    found: list[dict[tuple[int, int], int]] = [{} for _ in docs]
    of, ids = _numbers(docs)
    if not len(of):
        return [[] for _ in docs]
    starts, shared = _suffixes(of, ids)
    first = np.searchsorted(of, np.arange(len(docs)))
    before = np.r_[-1, ids[:-1]]
    before[np.r_[True, of[1:] != of[:-1]]] = -1
    left = dict(zip(starts.tolist(), before[starts].tolist()))

    def join(a: list[int], b: list[int], l: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        reach, many = l // (TIMES - 1), len(a)
        for x in b:
            k = bisect(a, x)
            for y in ((a[k - 1],) if k else ()) + ((a[k],) if k < many else ()):
                d = x - y if x > y else y - x
                if d <= reach and l + d >= LEAST and left[x] != left[y]:
                    s = min(x, y)
                    doc = int(of[s])
                    at = (s - int(first[doc]), l + d)
                    if d < found[doc].get(at, d + 1):
                        found[doc][at] = d
        if len(b) * 16 < many:
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()
        return a

    open_: list[tuple[int, list[int]]] = []
    for place, l in zip(starts.tolist(), shared.tolist()):
        last = [place]
        if l < SHARED:
            l = 0
        while open_ and open_[-1][0] > l:
            depth, own = open_.pop()
            last = join(own, last, depth)
        if l:
            if open_ and open_[-1][0] == l:
                open_[-1] = (l, join(open_[-1][1], last, l))
            else:
                open_.append((l, last))
    return [sorted(((s, n, q) for (s, n), q in f.items()), key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run covers after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    s, n, q = np.array(runs).T
    np.add.at(edge, s + q, 1)
    np.add.at(edge, s + n, -1)
    return [w for w, over in zip(words, np.cumsum(edge[:-1]).tolist()) if not over]


Change = Callable[[object, list[bytes]], list[bytes]]


def _scan(docs: DataFrame, change: Change | None, carried: list[str]) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            words = [t.split() if t else [] for t in raw(b, "text")]
            if change:
                words = [change(i, w) for i, w in zip(b.column("doc_id").to_pylist(), words)]
            runs = runs_of(words)
            kept = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs)]
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3).T
            offsets = np.cumsum([0] + [len(r) for r in runs]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in flat], RUN.names))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(list(map(len, words)), pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())],
                                             [*carried, "n_words", "runs", "collapsed"])

    schema = docs.select(*carried).schema.add("n_words", "long").add("runs", T.ArrayType(RUN, False)).add("collapsed", "string")
    return docs.mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row per row of docs, whatever its other columns.

    Words are runs of characters other than the six ASCII blanks. A run is a stretch of words with smallest period q and at least max(LEAST, TIMES * q) of
    them that no neighbouring word extends with that period; runs holds (start, length, period) by start, then period. collapsed is the text's words without those
    that any run covers after its first q, joined by one space. `change` may give the words to look at instead, from a document's id and words. Null and blank
    texts have no words, no runs and collapsed ''. Repeated rows and ids, null ids too, each keep their row; rows never look at each other. An empty
    table gives an empty table. Whole texts are cut into batches of a few MB; a longer text is a batch of its own.
    """
    return _scan(docs.select("doc_id", "text"), change, ["doc_id"])


def collapse(docs: DataFrame) -> DataFrame:
    """docs with every run cut to its first period; a text without runs stays as it is, null texts too. n_chars, if there, follows the text."""
    got = _scan(bundled(docs), None, ["doc_id", "text", "rest"])
    got = got.withColumn("text", F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("text")))
    return unbundled(got, docs, F.size("runs") > 0)

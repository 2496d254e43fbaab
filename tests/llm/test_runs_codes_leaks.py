"""Periodic runs, vector codes and decontamination against brute force, on awkward rows and on empty tables."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultlens.llm import codes, decontamination, queries, runs


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- periodic runs -----------------------------------------------------------------------------------

def brute_runs(w):
    """Every stretch of matches at every distance, the least period of each."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q):
                best.setdefault((i, n), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w):
    gone = {i for s, n, q in brute_runs(w) for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_are_those_of_all_distances():
    rng = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            w = []
            for _ in range(rng.randrange(0, 6)):
                p = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 12))]
                w += (p * rng.randrange(1, 12))[:rng.randrange(1, 80)]
            docs.append(w)
        assert runs.runs_of(docs) == [brute_runs(w) for w in docs]


def test_runs_inside_runs_and_long_ones():
    word = [b"a", b"b"]
    for _ in range(14):  # a Fibonacci word: many squares, no fourth powers
        word = word + word[:len(word) * 5 // 8]
    many = [x for i in range(500) for x in [b"w%d" % i] + [b"a"] * 6]
    assert runs.runs_of([many, [b"x"] * 5000]) == [[(7 * i + 1, 6, 1) for i in range(500)], [(0, 5000, 1)]]
    assert runs.runs_of([word[:900]])[0] == brute_runs(word[:900])


def test_periodic_runs_on_awkward_rows(table, awkward):
    rows = awkward + [(300, "a b a b a b a b c c c c c c tail"), (300, "a b a b a b a b c c c c c c tail"), (301, "z z z z z"), (302, "z z z z z z")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(table(rows)).collect())
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        want.append((i is None, i or 0, len(w), brute_runs(w) if len(w) < 5000 else [], (brute_collapsed(w) if len(w) < 5000 else b" ".join(w)).decode()))
    assert got == sorted(want)
    assert runs.periodic_runs(table([])).collect() == []


def test_collapse_keeps_columns(table):
    docs = table([(1, "a b a b a b a b c"), (2, "plain  text\n"), (3, None)]).selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS n_words", "3 AS c0", "4 AS `_`")
    got = {r.doc_id: r for r in runs.collapse(docs).collect()}
    assert runs.collapse(docs).columns == docs.columns
    assert (got[1].text, got[1].n_chars, got[1].runs, got[1].collapsed) == ("a b c", 5, 1, "x")
    assert (got[2].text, got[2].n_chars) == ("plain  text\n", 12) and got[3].text is None


def test_op11_against_brute_force(spark, tmp_path, awkward):
    rng = random.Random(9)
    rows = [r for r in awkward if len(r[1] or "") < 20_000] + [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 300)))) for i in range(500, 700)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        r = brute_runs(w)
        top = None
        for x in r:
            if top is None or x[1] * top[2] > top[1] * x[2]:
                top = x
        want.append((str(i), len(r), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in r)), sha(brute_collapsed(w))))
    got = [(str(r[0]), *r[1:]) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(x[1] > 0 for x in want) > 5


# --- vector codes -------------------------------------------------------------------------------------

def test_nearest_is_the_first_least_distance():
    rng = np.random.default_rng(2)
    for k, dim, spread in ((256, 16, 200), (256, 4, 3), (7, 3, 2), (1, 5, 9), (30, 0, 1)):
        entries, x = rng.integers(-spread, spread + 1, (k, dim)), rng.integers(-2 * spread, 2 * spread + 1, (700, dim))
        index, d = codes.Codebook(entries).nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, np.array([int(np.floor(1024 * float(x))) for x in v], np.int64), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))[:entries]
    cut = codes.bounds(len(kept[0][1]), parts)
    x = np.stack([v for _, v, _ in kept])
    code, error, books = [], np.zeros(len(kept), np.int64), []
    for a, b in zip(cut, cut[1:]):
        own, book = x[:, a:b], np.stack([v[a:b] for _, v, _ in first])
        for last in [False] * rounds + [True]:
            d = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            if not last:
                book = np.stack([own[at == e].sum(axis=0) // (at == e).sum() if (at == e).any() else book[e] for e in range(len(book))])
        code.append(at)
        error += d.min(axis=1)
        books.append(book)
    by = defaultdict(int)
    for (_, _, lab), e in zip(kept, error.tolist()):
        by[lab] += e
    digest = sha(",".join(str(c) for b in books for e in b.tolist() for c in e))
    return [(i, "".join(f"{c[k]:02x}" for c in code), int(error[k]), by[lab], digest) for k, (i, _, lab) in enumerate(kept)]


@pytest.mark.parametrize("n,dim", [(600, 16), (90, 10), (3, 4)])
def test_codes_against_brute_force(spark, tmp_path, n, dim):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(9, dim))
    rows = [(i, (centre[i % 9] + rng.normal(size=dim) * 0.3).astype(np.float32).tolist(), None if i % 7 == 0 else i % 5) for i in range(n)]
    rows += [(5000, None, 1), (5001, [float("nan")] * dim, 2), (5002, [float("inf")] + [0.0] * (dim - 1), None), (5003, [None] + [0.0] * (dim - 1), 3), (5004, [0.0] * dim, 4),
             (None, [0.5] * dim, None), (2, rows[2][1], 2), (1, rows[0][1], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS v", "2 AS code", "3 AS error", "4 AS `_of`").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in queries.op12_vector_codes(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(brute_codes(rows))


def test_codes_of_no_rows_and_back(spark):
    shape = "vec_id long, embedding array<float>, label int"
    none = codes.compress(spark.createDataFrame([], shape))
    assert none.codes.collect() == [] and none.digest() == sha("")
    bad = codes.compress(spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [float("nan")], 1)], shape))
    assert bad.codes.collect() == []
    few = spark.createDataFrame([(i, [i / 8, -i / 4, 0.5, 1.0], i) for i in range(20)], shape)
    got = codes.compress(few)
    assert {r.vec_id: r.approximation for r in codes.decode(got.codes, got.books).collect()} == {i: [i / 8, -i / 4, 0.5, 1.0] for i in range(20)}


# --- decontamination ----------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(rows, items):
    wins = defaultdict(set)
    for i, t in items:
        w = folded(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[s:s + n])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in rows:
        w, hit, found = folded(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s:s + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((str(d), len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


ITEMS = [(1, "The quick, brown fox jumps over the lazy dog near a river bank"), (2, "short Item"), (3, None), (4, " .,; "), (5, "Über-straße naïve café"), (10, "short item"),
         (None, "an item without any id at all is still hit by words here ok"), (1, "The quick, brown fox jumps over the lazy dog near a river bank"),
         (7, "common opening words of many items that are shared by all of them first"), (8, "common opening words of many items that are shared by all of them second")]


def planted(awkward):
    return awkward + [(400, "x THE QUICK brown fox; jumps over the lazy dog near a river bank y"), (401, "the quick brown fox jumps over the lazy cat near a river bank"), (402, "a short\nitem, a short item!"),
                      (403, "über straße NAïVE café"), (404, "Über straße naïve café"), (405, "so an item without any id at all is still hit by words here ok"), (406, "the quick brown fox jumps over the lazy dog near the quick brown fox jumps over the lazy dog near"),
                      (407, "common opening words of many items that are shared by all of them third"), (407, "common opening words of many items that are shared by all of them third")]


@pytest.mark.parametrize("slice_", [1 << 19, 9])
def test_contamination_against_brute_force(spark, table, awkward, monkeypatch, slice_):
    monkeypatch.setattr(decontamination, "SLICE", slice_)
    rows = planted(awkward)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS key", "2 AS size", "3 AS digest", "4 AS set_id")
    got = decontamination.contamination(table(rows).selectExpr("*", "1 AS sets", "2 AS spans", "3 AS had", "4 AS n_words"), items)
    assert Counter((str(r[0]), *r[1:6]) for r in got.collect()) == Counter(brute_hits(rows, ITEMS))


def test_nothing_against_nothing(spark, table, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontamination.contamination(table(awkward), none).collect()} == {False}
    assert decontamination.contamination(table([]), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
    assert decontamination.decontaminate(table([]), none).collect() == []


@pytest.mark.parametrize("slice_", [1 << 19, 9])
def test_spans_and_documents_go(spark, table, awkward, monkeypatch, slice_):
    monkeypatch.setattr(decontamination, "SLICE", slice_)
    rows = planted(awkward)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = table(rows).selectExpr("*", "1 AS sets", "2 AS spans", "3 AS `c0`", "4 AS `_`")
    hit = {r[0] for r in brute_hits(rows, ITEMS) if r[5]}
    left = decontamination.decontaminate(docs, items, "documents")
    assert left.columns == docs.columns and Counter((str(r.doc_id), r.text) for r in left.collect()) == Counter((str(i), t) for i, t in rows if str(i) not in hit)
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, items).collect()}
    assert got[400].text == "x  y" and got[400].n_chars == 4 and got[402].text == "a , a !" and got[401].text == dict(rows)[401] and got[406].text == ""
    assert (got[400].sets, got[400].spans, got[400].c0, got[400]["_"]) == (1, 2, 3, 4)
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, "lines")

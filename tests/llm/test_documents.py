"""Operators on documents against brute force, on awkward rows and on empty tables."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from faultlens.llm import licenses, lm, mixing, packing, quality, simhash, substrings, toxicity

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


# --- SimHash ---------------------------------------------------------------------------------------

def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashed = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_simhash_against_all_pairs(table, awkward):
    rows = awkward + [(200 + i, " ".join(f"w{j}" if j != 50 * i else "changed" for j in range(400))) for i in range(8)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(rows)).collect())
    fps = [fingerprint(t) for _, t in rows]
    name = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    name[a] = name[b] = min(name[a], name[b])
    least = defaultdict(lambda: None)
    for n, (i, _) in zip(name, rows):
        if i is not None:
            least[n] = i if least[n] is None else min(least[n], i)
    want = sorted((i is None, i or 0, f"{f:016x}", least[n]) for (i, _), f, n in zip(rows, fps, name))
    assert got == want


def test_simhash_links_equal_all_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)]
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    dense = np.uint64(12345) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, dense, dense ^ np.uint64(3)]))
    monkeypatch.setattr(simhash, "HOME_BLOCK", 16)
    monkeypatch.setattr(simhash, "SIDE_BLOCK", 32)
    df = spark.createDataFrame([(0, int(x)) for x in fps.view(np.int64)], "k int, fp long")
    found = simhash.links(df).collect()
    from faultlens.llm.common import merge_labels
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = np.arange(len(fps))
    merge_labels(want, a, b)
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    have = np.arange(len(fps))
    merge_labels(have, np.array([at[r.a] for r in found]), np.array([at[r.b] for r in found]))
    assert (have == want).all() and len(found) < len(a)


def test_fingerprint_rows_are_simhashes():
    text = b"a b c d e f g h a b c " * 700
    h = np.concatenate(list(simhash.shingle_hashes(text)))
    got = simhash.fingerprint_row(text, 3)
    for k in range(3):
        m = substrings._mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int(((m >> np.uint64(b)) & np.uint64(1)).sum()) > len(m))
    assert simhash.fingerprint_row(None, 2).tolist() == [0, 0]


def test_similar_documents_are_found_and_others_left(table):
    rng = np.random.default_rng(5)
    rows, copies = [], []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((10 * i, " ".join(w)))
        for j in range(2):  # two or three words changed: about 0.9 to 0.95 of the five-word shingles stay
            v = list(w)
            for at in rng.integers(0, 300, 2 + j):
                v[at] = "changed"
            rows.append((10 * i + 1 + j, " ".join(v)))
            copies.append(10 * i + 1 + j)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(rows)).collect()}
    assert all(c == i - i % 10 for i, c in got.items() if i % 10 == 0) and all(c in (i, i - i % 10) for i, c in got.items())
    assert sum(got[i] != i for i in copies) >= 0.95 * len(copies)


def test_keep_one_keeps_columns_and_one_of_each_class(table, awkward):
    docs = table(awkward)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[7] == 1 and ids[8] == 0 and ids[1] == 1 and ids[2] == 0 and ids[13] == 2 and ids[None] == 2


# --- repeated passages -----------------------------------------------------------------------------

def cut(rows):
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            first[key] = min(first.get(key, (rank(i), s)), (rank(i), s))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] < (rank(i), s) for j in range(s, s + 20)}
        out.append((rank(i), len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("buffer", [1 << 20, 50])
def test_substrings_against_all_windows(table, awkward, monkeypatch, buffer):
    monkeypatch.setattr(substrings, "BUFFER", buffer)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeated(table(awkward)).collect())
    assert got == cut(awkward)


def test_unsplit_texts_keep_their_form_and_columns(table, awkward):
    docs = table(awkward)
    got = substrings.without_repeated(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    texts = {r.doc_id: r for r in got.collect()}
    assert texts[19].text == "hello   world  \n \n end  " and texts[1].text is None and texts[8].text == "" and texts[8].n_chars == 0 and texts[8].rest == "r"


def test_word_hashes_follow_words_alone():
    texts = [b"a b  c\nd", b"", b" a\tb c d ", b"ab cd", b"x" * 700_000 + b" y"]
    of, hashes = substrings.word_hashes(texts)
    h = [[tuple(int(x[k]) for x in hashes) for k in np.flatnonzero(of == i)] for i in range(len(texts))]
    assert h[0] == h[2] and len(h[1]) == 0 and len(h[3]) == 2 and len(h[4]) == 2 and len(set(map(tuple, h[0] + h[3] + h[4]))) == 8


# --- packing ---------------------------------------------------------------------------------------

def test_packing_round_trip(table, awkward):
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(table(awkward)).collect()
    texts = Counter()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and 0 < r.length <= 2048
    for part in by.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
    for i in {i for i, _ in awkward if i is not None}:
        same = [x for j, x in awkward if j == i]
        ids = t.encode(same[0] or "", add_special_tokens=False).ids + [0]
        pieces = sorted(whole[i], key=lambda r: r.piece)
        first = pieces[::len(same)]
        assert b"".join(bytes(p.ids) for p in first) == np.array(ids, "<u4").tobytes()
        assert [p.length for p in first[1:]] == [2048] * (len(first) - 1)
    assert len(texts) == 0 and len(by) >= math.ceil(sum(r.length for r in rows) / 2048)


def test_tokens_of_awkward_blanks_equal_the_tokenizer():
    import public_tokenizers
    t = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a   b", "a \n b", "a\n \nb", "a\n\n", "\n a", "it's  'll x y 　z", "<|endoftext|> b", "a <|endoftext|> b", "\t\ta b\t c", "é ñ  ü"]
    assert t(texts) == t.whole(texts)


def test_tokens_of_random_texts_equal_the_tokenizer():
    import public_tokenizers
    t = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    blanks = [" ", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000", "\ufeff"]
    others = [*"abzAZ019.,'!<|>_-$", "'s", "'ll", "'D", "é", "ß", "×", "÷", "ª", "e\u0301", "Ā", "日", "本", "д", "🙂", "²", "٣", "\x00", "\x7f", "\x80", "<|endoftext|>", "Ċ", "Ġ"]
    for _ in range(30):
        some, share = rng.sample(others, rng.choice((3, 8, len(others)))), rng.choice((0.1, 0.3, 0.6))
        texts = ["".join(rng.choice(blanks if rng.random() < share else some) for _ in range(rng.randrange(30))) for _ in range(300)]
        assert t(texts) == t.whole(texts)


def test_a_word_goes_through_the_tokenizer_once_whatever_follows_it(monkeypatch):
    import public_tokenizers
    t = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéou") for _ in range(9)) for _ in range(400)]
    texts = [" ".join(w + mark for w in rng.sample(words, 400)) for mark in ("", ".", ",", "!", ";", ":", "$$$", "***", ".\nnext", "\n\nnext")]
    want, seen, real = t.whole(texts), [0], t.tokenizer

    class Counted:
        def encode_batch_fast(self, got, **more):
            seen[0] += sum(map(len, got))
            return real.encode_batch_fast(got, **more)

    monkeypatch.setattr(t, "tokenizer", Counted())
    assert t(texts) == want and seen[0] < 2 * sum(map(len, words))
    monkeypatch.setattr(packing, "REMEMBERED", 1)  # what is forgotten is learned again
    assert t(texts[::-1]) == want[::-1] and t(texts[:1] * 3) == want[:1] * 3 and len(t.known) <= 401


def test_tokens_of_other_pre_tokenizers_are_not_cut(tmp_path):
    import json
    import public_tokenizers
    made = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    made["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "t.json").write_text(json.dumps(made))
    t = packing.Tokens(str(tmp_path / "t.json"))
    texts = ["the end. Of the\n day", "", "of the the", "the end. Of the\n day"]
    assert t(texts) == t.whole(texts)


def test_long_documents_are_cut_behind_the_first_piece(table):
    rows = [(1, "a b " * 40), (2, None), (3, ""), (4, "it's  two\n"), (5, "x " * 7)]
    got = sorted((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in packing.tokenised(table(rows), capacity=7).collect())
    import public_tokenizers
    t = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = t.whole([text or ""])[0] + bytes(4)
        n = len(ids) // 4
        edges = [0, *range(n % 7 or 7, n + 1, 7)]
        want += [(i, k, a, b - a, ids[4 * a:4 * b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert got == want


def test_bin_completion_uses_every_piece_and_beats_best_fit():
    rng = np.random.default_rng(2)
    better = 0
    for n, lo, hi in ((0, 1, 9), (1, 5, 9), (40, 300, 900), (60, 200, 700), (500, 1, 100), (90, 34, 67)):
        x = rng.integers(lo, hi, n)
        counts = {int(s): int(k) for s, k in zip(*np.unique(x, return_counts=True))}
        best = packing.best_fit(counts, 1000 if hi > 100 else 100)
        capacity = 1000 if hi > 100 else 100
        got = packing.complete(counts, capacity)
        used = Counter()
        for f, k in got:
            assert sum(s * c for s, c in f) <= capacity
            for s, c in f:
                used[s] += c * k
        assert used == Counter(counts)
        assert sum(k for _, k in got) <= sum(k for _, k in best)
        better += sum(k for _, k in got) < sum(k for _, k in best)
    # best fit needs four here, completion three
    hard = {60: 1, 50: 2, 40: 1, 30: 2, 20: 2}
    assert sum(k for _, k in packing.complete(hard, 100)) == 3


def used_whole(counts, got, capacity):
    used = Counter()
    for f, k in got:
        assert sum(s * c for s, c in f) <= capacity
        for s, c in f:
            used[s] += c * k
    return used == Counter(counts)


def test_bin_completion_finds_planted_packings():
    for each in (2, 1000):
        counts = {1030: each, 400: each, 310: each, 308: each}
        got = packing.complete(counts, 2048)
        assert used_whole(counts, got, 2048) and sum(n for _, n in got) == each
    for m, seed in ((12, 0), (12, 1), (12, 2), (30, 30)):
        rng = np.random.default_rng(seed)
        counts = Counter()
        for _ in range(m):
            a = int(rng.integers(700, 1000))
            b = int(rng.integers(500, 1548 - a))
            counts.update((a, b, 2048 - a - b))
        got = packing.complete(dict(counts), 2048)
        assert used_whole(counts, got, 2048) and sum(n for _, n in got) == m


def test_bin_completion_against_all_packings():
    def fewest(left):  # the largest piece with every subset of the others
        if not left:
            return 0
        best = len(left)
        for mask in range(1 << len(left) - 1):
            with_ = [x for i, x in enumerate(left[1:]) if mask >> i & 1]
            if left[0] + sum(with_) <= 30:
                best = min(best, 1 + fewest([x for i, x in enumerate(left[1:]) if not mask >> i & 1]))
        return best
    rng = np.random.default_rng(8)
    for _ in range(25):
        x = sorted(rng.integers(4, 17, 8).tolist(), reverse=True)
        got = packing.complete(dict(Counter(x)), 30)
        assert used_whole(Counter(x), got, 30) and sum(n for _, n in got) == fewest(x)
        counts = np.bincount(x, minlength=31)
        assert packing.least_sequences(counts, 30) <= fewest(x)


def test_undominated_fillings_against_all_fillings():
    rng = np.random.default_rng(9)
    for _ in range(20):
        x = rng.integers(2, 12, 7)
        counts = np.bincount(x, minlength=21)
        room = 20
        got = list(packing.fillings(counts, room))
        assert len(set(got)) == len(got)
        waste = [room - sum(s * n for s, n in f) for f in got]
        assert waste == sorted(waste) and all(n <= counts[s] for f in got for s, n in f)
        # every set that fits is a filling given, or a piece left out can replace a part of it
        sets = {tuple(sorted(Counter(int(v) for i, v in enumerate(x) if m >> i & 1).items(), reverse=True)) for m in range(1 << len(x))}
        for f in sets:
            flat = [s for s, n in f for _ in range(n)]
            if sum(flat) > room or counts[room]:
                continue
            out = [int(s) for s in np.flatnonzero(counts) if counts[s] > dict(f).get(int(s), 0)]
            parts = [[v for i, v in enumerate(flat) if m >> i & 1] for m in range(1 << len(flat))]
            beaten = any((sum(p) < o or sum(p) == o and len(p) > 1) and sum(flat) - sum(p) + o <= room for p in parts for o in out)
            assert beaten != (f in got)


# --- mixing ----------------------------------------------------------------------------------------

def test_mix_meets_targets_and_repeats_itself(table, awkward):
    rows = [(i, t, f"s{(i or 0) % 7}" if i is None or i % 11 else None) for i, t in awkward]
    a = mixing.mix(table(rows)).collect()
    b = mixing.mix(table(rows).repartition(1)).collect()
    key = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.taken) for r in rs)
    assert key(a) == key(b) and len(a) == len(rows)
    size = Counter()
    for i, t, s in rows:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 2.0 * size[s] if s in full else weight[s] * level for s in names}
    for r in a:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)


def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 900, 400).astype(float), np.full(400, 0.37)
    out = mixing.flight(p, size, rng.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-4
    mean = np.mean([mixing.flight(p, size, rng.random(400)) for _ in range(300)], axis=0)
    assert abs(mean - 0.37).max() < 0.16  # every document keeps its chance


def test_mixed_rows_are_the_taken_ones(table, awkward):
    docs = table(awkward)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.times
    out = mixing.repeat(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == +taken


# --- licences --------------------------------------------------------------------------------------

def test_licenses(table):
    filler = "lorem ipsum " * 300
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, filler + "This work is licensed under the GNU General Public License, version 3." + filler), (3, "a fishing licence for the lake"),
            (4, None), (5, ""), (6, "Licensed under the terms of the Apache License, Version 2.0"), (None, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0.\n" + "word\n" * 50 + "Released under the MIT License.")]
    got = sorted((r.doc_id or 0, r.license, r.exact, tuple(r.extra)) for r in licenses.scan(table(rows)).collect())
    assert got == [(0, "CC-BY-NC-4.0", True, ()), (1, "MIT", True, ()), (2, "GPL-3.0", True, ()), (6, "Apache-2.0", False, ("the", "terms", "of")), (7, "CC-BY-NC-4.0", True, ()), (7, "MIT", True, ())]
    text = rows[0][1].encode()
    r = licenses.scan(table(rows[:1])).first()
    assert text[r.start:r.end] == b"Released under the MIT License."


# --- language model --------------------------------------------------------------------------------

def test_lm_base_scores_and_probabilities(table, awkward, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 2000)
    rows = awkward + [(300 + i, "the cat sat on the mat " * (i + 1)) for i in range(30)]
    got = [r.asDict() for r in lm.scores(table(rows)).collect()]
    assert len(got) == len(rows)
    left = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    c = Counter(w for i, x in tokens for w in x if i is not None and not left(i))
    n, v = sum(c.values()), len(c)
    want = sorted((i or 0, len(x), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)) for i, x in tokens)
    assert want == sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert all(r["train_tokens"] == n and r["held_out"] == left(r["doc_id"]) and r["score"] < 0 for r in got)


def test_lm_weights_follow_the_likelihood():
    rng = np.random.default_rng(0)
    table = [(3, int(a), int(b), int(n)) for a, b, n in zip(rng.integers(-1, 60, 200), rng.integers(0, 40, 200), rng.integers(1, 50, 200))]
    w = lm.mixture(table)[3]
    x = np.array(table)
    p = np.stack([np.where(x[:, 1] < 0, 0, 2.0 ** (x[:, 1] / 4)), 2.0 ** (x[:, 2] / 4), np.ones(len(x))], axis=1)
    like = lambda w: (x[:, 3] * np.log(p @ w)).sum()
    assert abs(w.sum() - 1) < 1e-9 and all(like(w) >= like(r) - 1e-2 for r in rng.dirichlet([1, 1, 1], 500))


def test_lm_packing_of_arrays():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (lm._unpack_sorted(lm._pack_sorted(h)) == h).all()
        x = rng.integers(0, 1 << 40, n).astype(np.uint64)
        assert (lm._unpack(lm._pack(x), np.uint64) == x).all()


# --- classifiers -----------------------------------------------------------------------------------

def labelled(n=240):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        w = [f"{rng.choice(['ren', 'tal', 'mor', 'sin'])}{rng.choice(['da', 'ko', 'li'])}" for _ in range(60)]
        w = [x.upper() + "!!" for x in w] if bad else w
        if toxic:
            w[int(rng.integers(60))] = rng.choice(["blorkhead", "zapface"])
        rows.append((1000 + i, " ".join(w)))
        marks.append((1000 + i, int(not bad), int(toxic), "clash"))
    return rows, marks


@pytest.mark.parametrize("run, at, threshold", [(lambda d, m: quality.scores(d, m), 1, 0.3), (lambda d, m: toxicity.scores(d, m), 2, 0.5)])
def test_held_out_accuracy(table, labels, awkward, run, at, threshold):
    rows, marks = labelled()
    truth = {m[0]: m[at] for m in marks}
    got = run(table(rows + awkward), labels(marks + [(None, 1, 1, None), (1, None, None, None)])).collect()
    assert len(got) == len(rows) + len(awkward)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_disguised_words_and_exceptions():
    assert toxicity.fold("Zаpf4ce, BL0RK​HEAD!") == " zapface blorkhead "
    texts = ["a zapface b"] * 20 + ["c zapface tower d"] * 20 + ["plain text"] * 100
    x = toxicity.learn(texts, np.array([1] * 20 + [0] * 20 + [0] * 100))
    assert " zapface " not in x.weights or " zapface tower " in x.excused


def test_keep_good_keeps_columns(table, labels):
    rows, marks = labelled()
    docs = table(rows)
    got = quality.keep_good(docs, labels(marks))
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    good = {m[0] for m in marks if m[1]}
    assert len(ids ^ good) <= 4


# --- nothing there ---------------------------------------------------------------------------------

@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c")]])
def test_small_tables(table, labels, rows):
    docs, none = table(rows), labels([])
    n = len(rows)
    assert simhash.near_duplicates(docs).count() == n and substrings.remove_repeated(docs).count() == n and packing.pack_documents(docs).count() == n
    assert mixing.mix(docs).count() == n and licenses.scan(docs).count() == 0 and lm.scores(docs).count() == n
    assert quality.scores(docs, none).count() == n and toxicity.scores(docs, none).count() == n


def test_digest_of_kept_words(spark):
    from faultlens.llm import queries
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = {(i[1], n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in cut(list(zip(docs["doc_id"], docs["text"])))}
    assert {tuple(r) for r in queries.op8_substring_dedup(spark, sf).collect()} == want

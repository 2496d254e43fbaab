"""The SimHash stage against brute-force Jaccard similarity of five-word shingles."""
import numpy as np

from faultlens.llm import simhash


def shingles(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Class of each row by all pairs at 0.8 or more, and the similarities of the linked pairs."""
    sets = [shingles(t) for _, t in rows]
    name, hits = [i for i, _ in rows], []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                hits.append((a, b))
    for _ in rows:
        before = list(name)
        for a, b in hits:
            name[a] = name[b] = min(name[a], name[b])
        if name == before:
            break
    return {i: n for (i, _), n in zip(rows, name)}


def variants(groups=60, length=200):
    """Texts with copies on both sides of 0.8: one to nine words changed."""
    rng, rows = np.random.default_rng(11), [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a c")]
    for g in range(1, groups + 1):
        w = [f"w{x}" for x in rng.integers(0, 9000, length)]
        rows.append((100 * g, " ".join(w)))
        for j in range(1, 10):
            v = list(w)
            for at in rng.choice(length, j, replace=False):
                v[at] = f"c{rng.integers(1 << 30)}"
            rows.append((100 * g + j, " ".join(v)))
    return rows


def test_similar_documents_are_the_brute_force_classes(table):
    rows = variants()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(table(rows)).collect()} == want
    assert any(want[100 * g + 9] == 100 * g + 9 for g in range(1, 61))  # below 0.8, so it stays


def test_large_classes_are_settled_in_blocks(table, monkeypatch):
    rows = variants(12)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 4)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(table(rows)).collect()} == brute(rows)


def test_pairs_below_the_threshold_do_not_link(table):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 9000, 3000)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # similarity about 0.75: three-word fingerprints linked a part of these
        v = list(base)
        for at in range(i, 3000, 35):
            v[at] = f"c{i}x{at}"
        rows.append((i, " ".join(v)))
    assert all(r.component_id == r.doc_id for r in simhash.similar_documents(table(rows)).collect())


def test_shingles_are_hashed_once_for_all_proposals(monkeypatch):
    texts = [None, b"", b"one", b"one two three four five", b"Some words that repeat " * 900]
    want = [np.concatenate([simhash.fingerprint_row(x, 8, simhash.SIMILAR_SHINGLE), simhash.bands(simhash.shingle_set(x))]) for x in texts]
    seen, hashes = [], simhash.shingle_hashes
    monkeypatch.setattr(simhash, "shingle_hashes", lambda *a: seen.append(1) or hashes(*a))
    assert all((simhash.proposals(x) == w).all() for x, w in zip(texts, want)) and len(seen) == len(texts)

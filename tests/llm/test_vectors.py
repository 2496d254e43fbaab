"""Vector operators against brute force, with vectors that take no part."""
import math

import numpy as np
import pytest

from faultlens.llm import embedding_dedup, neighbours
from faultlens.llm.common import merge_labels

SCHEMA = "vec_id long, embedding array<float>, label int, node long, weight long, component_id string, rank int"


def rows_of(n, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n, n // 2)] + 0.05 * rng.normal(size=(n // 2, dim))
    hot = np.repeat(base[:1], n // 3, axis=0) + 0.03 * rng.normal(size=(n // 3, dim)) * (np.arange(n // 3) % 2)[:, None]
    x = np.concatenate([base, near, hot]).astype(np.float32)
    out = [(i * 5, v.tolist(), 1, 0, 0, "c", 0) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * dim, [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [math.nan] + [1.0] * (dim - 1), [math.inf] + [1.0] * (dim - 1)]
    return out + [(10_000 + 20 * i, v, None, None, None, None, None) for i, v in enumerate(odd)] + [(None, x[3].tolist(), 1, 0, 0, "c", 0)]


@pytest.mark.parametrize("block", [2048, 40])
def test_embedding_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = rows_of(240)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    fine = [(i, np.array(v, float)) for i, v, *_ in rows if v and len(v) == 32 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in fine])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    labels = np.arange(len(fine))
    merge_labels(labels, *np.nonzero(near))
    name = {}
    for k, (i, _) in zip(labels, fine):
        name[k] = min([x for x in (name.get(k), i) if x is not None], default=None)
    want = {i: (int(n), name[k]) for (i, _), n, k in zip(fine, near.sum(axis=1), labels)}
    assert len(got) == len(rows)
    same = [want.get(r.vec_id, (0, r.vec_id)) == (r.n_links, r.component_id) for r in got]
    assert np.mean(same) > 0.97 and sum(r.n_links for r in got) >= 0.98 * near.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in got if r.vec_id is not None and r.vec_id >= 10_000)


def test_first_table_rule_counts_a_pair_once(spark):
    x = np.tile(np.eye(8, dtype=np.float32)[0], (50, 1)) + np.linspace(0, 0.01, 50)[:, None].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == {(49, 0)}


@pytest.mark.parametrize("shard", [8192, 64])
def test_neighbours_against_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    rows = rows_of(240)
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    fine = {i: np.array(v, float) for i, v, *_ in rows if i is not None and v and len(v) == 32 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert abs(r.score - fine[r.query_id] @ fine[r.vec_id]) < 1e-9
    assert found.keys() == {i for i in fine if i % 20 == 0}
    hits = total = 0
    for q, part in found.items():
        part.sort()
        assert [p[0] for p in part] == list(range(1, 21)) and part == sorted(part, key=lambda p: (-p[2], p[1]))
        best = sorted((-(fine[q] @ v), i) for i, v in fine.items() if i != q)[:20]
        hits += len({i for _, i in best} & {p[1] for p in part})
        total += 20
    assert hits / total >= 0.95


def test_queries_that_meet_a_shard_together_find_what_each_finds(monkeypatch):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(900, 24)), rng.normal(size=(30, 24))
    tree, top = neighbours.Tree(x[:, :8]), float((x * x).sum(axis=1).max())
    monkeypatch.setattr(neighbours, "CELLS", 6_300)  # seven queries at a time
    bounds = np.full(30, np.inf)
    for limit, same in ((1e9, True), (0.02, False)):
        found = list(neighbours.search(tree, x, q, q[:, :8], top, limit, 5, bounds))
        alone = [next(neighbours.search(tree, x, q[i:i + 1], q[i:i + 1, :8], top, limit, 5, bounds[:1])) for i in range(30)]
        assert len(found) == 30 and all((a[0] == b[0]).all() and np.allclose(a[1], b[1]) for a, b in zip(found, alone))
        assert all((at == np.argsort(-(x @ v))[:5]).all() for (at, _), v in zip(found, q)) == same


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none).count() == 0 and embedding_dedup.near_duplicates(none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0]), (4, None)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in neighbours.nearest(few).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.5)]
    assert neighbours.chi_square_at(0.95, 8) == pytest.approx(15.507, abs=1e-3)

"""Exact vector search in large blocks: single precision leaves out nothing, copies follow each part's own size, and one search serves all arms."""
import numpy as np
import pytest

from faultlens.operators import vectors
from faultlens.plans import vector_queries


@pytest.mark.parametrize("tile", [1, 7, 64, 1000])
def test_nearest_equals_brute_force(monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "ROWS", 5)
    rng = np.random.default_rng(tile)
    u, q = rng.normal(size=(300, 8)), rng.normal(size=(23, 8))
    u[50:120] = u[3]  # copies
    u[130:140] = u[3] * (1 + 1e-7) + 1e-8 * rng.normal(size=(10, 8))  # and all but copies, which single precision can't tell apart
    u[200], u[201], q[4], q[5] = 0, 0, 0, u[3]
    um, uok = vectors._matrix(list(u), 8)
    qm, qok = vectors._matrix(list(q), 8)
    got = {}
    for r, c, s in zip(*vectors._nearest(um, uok, qm, qok, 90)):
        got.setdefault(r, []).append((-s, c))
    for r in range(len(q)):
        cos = [float(np.round(qm[r] @ um[c], 9)) if qok[r] and uok[c] else -1.0 for c in range(len(u))]
        assert [c for _, c in sorted(got[r])] == [c for _, c in sorted((-s, c) for c, s in enumerate(cos))[:90]]


def test_parts_are_cut_by_their_own_size(spark, monkeypatch):
    monkeypatch.setattr(vectors, "UNIT_BLOCK", 100)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 100)
    rows = spark.range(1000).selectExpr("IF(id < 10, 'small', 'big') AS _part", "array(1.0D, 2.0D) AS vec")
    got = {r._part: (r._shards, r._blocks) for r in vectors._blocks(rows, rows).collect()}
    assert got["small"] == (1, 1) and got["big"] == (10, 10)


def test_copies_do_not_grow_with_the_square(spark):
    rows = spark.range(30_000).selectExpr("0 AS _part", "array(1.0D, 2.0D) AS vec")
    r = vectors._blocks(rows, rows).first()
    assert r._shards == 1 and r._blocks <= 4 * spark.sparkContext.defaultParallelism


def test_arms_share_one_search(spark, monkeypatch):
    calls, search = [], vectors.vector_search
    monkeypatch.setattr(vectors, "vector_search", lambda *a, **b: calls.append(1) or search(*a, **b))
    vector_queries.vec_records(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1

"""Approximate neighbours against brute force."""

from __future__ import annotations

import numpy as np

from docloom.llm import vector_search as vs


def data(n, seed=0, size=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, size))
    return (centres[rng.integers(0, len(centres), n)] + 0.5 * rng.standard_normal((n, size))).astype(np.float32)


def brute(ids, x, k=4):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = u @ u.T
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, near string, rank int") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(vs.nearest(df, **kw).collect(), key=lambda r: (r.vec_id, r["rank"])):
        got.setdefault(r.vec_id, []).append(r.near)
    return got


def test_recall(spark):
    x = data(3000)
    ids = np.arange(3000) * 3
    want = brute(ids, x)
    got = run(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)], block=64)
    assert np.mean([len(set(got[i]) & set(want[i])) / 4 for i in want]) >= 0.9


def test_recall_does_not_fall_with_the_table(spark):
    """Neighbours at cosine 0.5, a table of 500 windows: more trees are built."""
    n, block = 8000, 8
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = x[n // 2 :] - (x[n // 2 :] * x[: n // 2]).sum(axis=1)[:, None] * x[: n // 2]
    x[n // 2 :] = 0.5 * x[: n // 2] + 0.75**0.5 * z / np.linalg.norm(z, axis=1)[:, None]
    x = x.astype(np.float32)
    s = x[: n // 2] @ x.T
    s[np.arange(n // 2), np.arange(n // 2)] = -2
    inside = [i for i in range(n // 2) if (s[i] > s[i, i + n // 2]).sum() < 4]
    got = run(spark, list(zip(range(n), x.tolist())), block=block)
    assert len(inside) > 2000
    assert np.mean([i + n // 2 in got[i] for i in inside]) >= 0.9
    assert vs.trees_for(200) == vs.TREES and vs.trees_for(5_000_000) > vs.trees_for(500_000) > vs.trees_for(50_000) >= vs.TREES


def test_small_is_exact(spark):
    x = data(200, 1)
    ids = np.arange(200)
    assert run(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]) == brute(ids, x)


def test_copies_and_edges(spark):
    x = data(40, 2)
    rows = [(i, x[0].tolist()) for i in range(30)] + [(100 + i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 64), (903, [1.0] * 32), (904, [float("nan")] * 64), (905, [None] + [1.0] * 63), (100, x[0].tolist()), (None, x[1].tolist())]
    got = run(spark, [(*r, "x", 1) for r in rows])
    assert got[0] == [1, 2, 3, 4] and got[2] == [0, 1, 3, 4] and got[100] == [0, 1, 2, 3]
    assert set(got) == set(range(30)) | {100 + i for i in range(40)}
    assert run(spark, rows[30:32]) == {100: [101], 101: [100]}
    assert run(spark, rows[70:73]) == {}


def test_pairs(spark):
    n = spark.createDataFrame([(1, 1, 2, 0.95), (2, 1, 1, 0.95), (3, 1, 1, 0.89)], "vec_id long, rank int, near long, cosine double")
    assert [tuple(r) for r in vs.similar_pairs(n).collect()] == [(1, 2)]

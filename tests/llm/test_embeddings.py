"""Whitening and exact top-k search against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.llm import bidiagonal, topk, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, x string, id double, component string, n string"


def rows_of(vectors):
    return [(i, v, 1, "c", "x", 0.5, "k", "n") for i, v in vectors]


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def odd_vectors(rng, n=230, d=6):
    out = [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    out += [(n + i, list(out[0][1])) for i in range(60)]  # copies under other keys
    out += [out[20], out[20], out[40]]  # rows that occur twice and three times
    out += [(None, list(out[5][1])), (20, [0.0] * d), (7, [0.25] * (d - 2)), (60, [])]
    out += [(900, None), (920, [None] * d), (940, [float("nan")] * d), (960, [float("inf")] + [0.0] * (d - 1))]
    return out


def padded(vectors, scale):
    kept = [(i, v) for i, v in vectors if good(v)]
    d = max(len(v) for _, v in kept)
    x = np.zeros((len(kept), d), dtype=np.int64)
    for r, (_, v) in enumerate(kept):
        x[r, : len(v)] = np.floor(scale * np.float32(v).astype(float))
    return [i for i, _ in kept], x


def best_of(ids, x, every, k):
    out = []
    for q, own in enumerate(ids):
        if own is not None and own % every == 0:
            order = sorted((-int(x[q] @ x[c]), ids[c] is None, ids[c] or 0) for c in range(len(ids)) if c != q)[:k]
            out += [(own, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(order)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,pivots,group,block", [(20, 128, 2048, 4096), (5, 7, 3, 40), (400, 3, 2, 50), (1, 1, 1, 30)])
def test_top_k(spark, monkeypatch, k, pivots, group, block):
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "ROWS", block)
    vectors = odd_vectors(random.Random(k))
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, pivots=pivots).collect()
    assert sorted(map(tuple, got), key=str) == best_of(*padded(vectors, 64), 20, k)


def test_top_k_leaves_far_cells_out(spark):
    """Well parted clusters: a group takes only rows of its own neighbourhood."""
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 4
    x = centres[np.arange(800) % 8] + rng.normal(0, 0.05, (800, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=3, pivots=16)
    assert sorted(map(tuple, got.collect()), key=str) == best_of(*padded([(i, v.tolist()) for i, v in enumerate(x)], 64), 20, 3)


def test_rings_hold_every_result():
    """The ring of a query's distance bound holds all rows whose score reaches the bound."""
    rng = np.random.default_rng(2)
    x = rng.integers(-60, 60, (500, 16))
    x[:100] = x[0]
    norm2 = int((x * x).sum(axis=1).max())
    space = topk._Space(16, 60, norm2, x[::25])
    far = space.distances(space.points(x))
    for q in x[::40]:
        at = space.distances(space.queries(q[None, :]))[0]
        for least in np.quantile(x @ q, [0.5, 0.9, 1.0]).astype(int):
            factor = space.factor(q[None, :])[0]
            within = np.sqrt(max(2 * norm2 - 2 * factor * least, 0)) + space.slack
            good = x @ q >= least
            assert (np.abs(far[good] - at) <= within + space.slack).all()


def test_top_k_edges(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame(rows_of([(20, [1.0, 2.0])]), SCHEMA)
    assert topk.top_k(one, F.col("vec_id") % 20 == 0).count() == 0
    none = spark.createDataFrame(rows_of([(21, [1.0, 2.0]), (22, [1.0, 2.0])]), SCHEMA)
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
    zero = spark.createDataFrame(rows_of([(i, [0.0, 0.0]) for i in range(41)]), SCHEMA)
    got = topk.top_k(zero, F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0), (0, 2, 2, 0), (20, 1, 0, 0), (20, 2, 1, 0), (40, 1, 0, 0), (40, 2, 1, 0)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame(rows_of([(0, [1e12])]), SCHEMA), F.col("vec_id") % 20 == 0)
    large = [(i, [1e6 * math.cos(i), 1e6 * math.sin(i * i)]) for i in range(60)]
    got = topk.top_k(spark.createDataFrame(rows_of(large), SCHEMA), F.col("vec_id") % 20 == 0, k=4).collect()
    assert sorted(map(tuple, got), key=str) == best_of(*padded(large, 64), 20, 4)


def exact_facts(vectors):
    ids, x = padded(vectors, 256)
    fit = np.unique(x, axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    return ids, x, fit, values[::-1], axes[:, ::-1]


def check_whitening(got, vectors, components=4):
    ids, x, fit, values, axes = exact_facts(vectors)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    axes, values, trace = axes[:, :components], values[:components], values.sum()
    want = {}
    for i, v in zip(ids, x):
        far = sum((n * int(c) - s) ** 2 for c, s in zip(v, sums))
        want.setdefault(str(i), []).append((far, (v - fit.mean(axis=0)) @ axes / np.sqrt(values)))
    rows = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - values[r.component - 1] / trace) < 1e-9
        rows.setdefault((str(r.vec_id), r.component), []).append((r.deviation, r.whitened))
    signs = np.zeros(components)
    assert sum(map(len, rows.values())) == components * len(ids)
    for (i, c), found in rows.items():
        expected = sorted((far, w[c - 1]) for far, w in want[i])
        for (far, value), (far2, value2) in zip(sorted(found), expected):
            assert far == far2 and abs(abs(value) - abs(value2)) < 1e-8
            if abs(value) > 1e-6:
                sign = np.sign(value * value2)
                assert signs[c - 1] in (0, sign)
                signs[c - 1] = sign


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    vectors = odd_vectors(random.Random(3))
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5)
    check_whitening(whitening.whiten(df).collect(), vectors)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    from signalframe.llm.queries import QUERIES

    check_whitening(QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect(), [(r.vec_id, r.embedding) for r in rows])


def test_whitening_edges(spark):
    make = lambda vectors: whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA))
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert make([(1, [1.0, 2.0])] * 5).count() == 0  # one distinct vector has no variance
    line = make([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    assert make([(i, []) for i in range(3)]).count() == 0
    far = make([(i, [1e13 * i, 0.0]) for i in range(3)]).collect()
    assert [r.deviation for r in far if r.vec_id == 1] == [0] and all(r.deviation is None for r in far if r.vec_id != 1)


@pytest.mark.parametrize("gap", [0.0, 1e-15, 1e-8, 1e-3])
def test_close_values(gap):
    rng = np.random.default_rng(4)
    axes = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    scale = np.r_[5.0, 5.0 - gap, 5.0 - 2 * gap, 4.0, np.ones(36)]
    r = np.linalg.qr(axes * scale @ axes.T, mode="r")
    values, v = bidiagonal.right_singular(r, 4)
    assert np.allclose(values, np.sort(scale**2)[::-1], rtol=1e-13)
    assert np.abs(v.T @ v - np.eye(4)).max() < 1e-12 and np.abs(r.T @ (r @ v) - v * values[:4]).max() < 1e-12


@pytest.mark.parametrize("r", [np.zeros((5, 5)), np.diag([3.0, 3, 3, 1, 0]), np.triu(np.ones((5, 5))), np.diag(np.logspace(0, -9, 30)) @ np.triu(np.ones((30, 30)))])
def test_small_matrices(r):
    values, v = bidiagonal.right_singular(r, 4)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-10, atol=1e-30)
    assert np.abs(v.T @ v - np.eye(4)).max() < 1e-12 and np.abs(r.T @ (r @ v) - v * values[:4]).max() <= 1e-12 * max(1, want[0])

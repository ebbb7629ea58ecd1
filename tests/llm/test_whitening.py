import math
import random

import numpy as np
import pytest

from duotide.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x binary, d int, v string"


def frame(spark, vectors, parts=4):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "i", b"x", 3, "v") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(vectors, k=4):
    """(n, deviations, whitened, explained) by numpy's double-precision solver."""
    grid = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in vectors}
    x = np.array(sorted(set(grid.values())), dtype=float)
    n, s = len(x), [sum(int(c) for c in col) for col in x.T]
    c = x - x.mean(axis=0)
    v = c.T @ c / n
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    out = {}
    for i, g in grid.items():
        deviation = sum((n * a - b) ** 2 for a, b in zip(g, s, strict=True))
        out[i] = (n, deviation, (np.array(g) - x.mean(axis=0)) @ vectors_ / np.sqrt(values), values / np.trace(v))
    return out


def sample(n, d, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (np.linspace(1, 3, d) if spread is None else spread) / 4
    return [(i, row.tolist()) for i, row in enumerate(x @ np.linalg.qr(rng.normal(size=(d, d)))[0])]


def test_equals_double_precision(spark):
    vectors = sample(400, 24)
    vectors += [(1000 + i, v) for i, v in vectors[:50]]  # copies count once
    want = plain(vectors)
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert len(rows) == 4 * len(vectors) and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-12
    signs = {}
    for r in rows:
        n, deviation, whitened, explained = want[r["id"]]
        at = r["component"] - 1
        assert r["n"] == n == 400 and r["deviation"] == deviation and r["explained"] == pytest.approx(explained[at], rel=1e-12)
        sign = signs.setdefault(at, 1.0 if r["whitened"] * whitened[at] > 0 else -1.0)
        assert r["whitened"] == pytest.approx(sign * whitened[at], abs=1e-9)


def test_rows_left_out(spark):
    vectors = sample(60, 5)
    bad = [(100, None), (101, []), (102, [1, 2, None, 4, 5]), (103, [1, math.nan, 3, 4, 5]), (104, [math.inf, 1, 2, 3, 4]), (105, [1, 2, 3]), (106, [3e38, 0, 0, 0, 0])]
    found = whitening.whiten(frame(spark, vectors + bad + [(None, vectors[0][1]), vectors[3]])).collect()
    ids = [r["id"] for r in found]
    assert sorted(i for i in set(ids) if i is not None) == list(range(60)) and ids.count(None) == 4 and ids.count(3) == 8
    assert {r["n"] for r in found} == {60}


def test_tables_without_spread(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(i, [1, 2, 3]) for i in range(9)])).collect() == []
    line = whitening.whiten(frame(spark, [(i, [i, 2 * i, 5]) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1) and len(line) == 9
    one = whitening.whiten(frame(spark, [(i, [i % 5]) for i in range(20)])).collect()
    assert len(one) == 20 and {r["n"] for r in one} == {5}


def test_whole_numbers_beyond_a_double(spark):
    rng = random.Random(5)
    vectors = [(i, [float(np.float32(rng.uniform(-1e9, 1e9))) for _ in range(6)]) for i in range(80)]
    want = plain(vectors)
    for r in whitening.whiten(frame(spark, vectors)).collect():
        assert int(r["deviation"]) == want[r["id"]][1] > 2**63


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1, 0.5],
        [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.5 + 1e-13, 0.25],
        [1 + 3e-14, 1 + 1e-14, 1, 1 - 1e-14, 1e-3, 1e-9],
        [1, 1, 1, 1, 1, 1],
        [1, 1e-8, 1e-8 + 1e-15, 0, 0, 0],
        [0] * 6,
    ],
)
def test_refinement_reaches_the_working_precision(values):
    """Residual and orthogonality far below what single precision gives, in clusters too."""
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q @ (1.5 * np.eye(6, dtype=np.longdouble) - 0.5 * q.T @ q)
    exact = (q * np.array(values, np.longdouble)) @ q.T
    a = ((exact + exact.T) / 2).astype(float)
    start = whitening.single_precision(a)
    found, x = whitening.refined(a, start)
    size = max(map(abs, values))
    assert np.allclose(found, sorted(values, reverse=True), rtol=0, atol=4e-16 * size)
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-15
    assert np.abs(a @ x - x * found).max() <= 1e-15 * size


def test_refinement_of_many_dimensions():
    rng = np.random.default_rng(8)
    b = rng.normal(size=(90, 90))
    a = b @ b.T / 90
    values, x = whitening.refined(a, whitening.single_precision(a))
    want, y = np.linalg.eigh(a)
    assert np.allclose(values, want[::-1], rtol=1e-12)
    assert np.allclose(np.abs(np.einsum("ij,ij->j", x, y[:, ::-1])), 1, atol=1e-9)

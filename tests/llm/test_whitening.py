import math

import numpy as np
import pytest

from tieout.llm import qd, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "c") for i, v in rows], SCHEMA).repartition(3)


def by_matrix(rows, components=16):
    kept = [(i, np.array([math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v])) for i, v in rows]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > e[0] * 1e-12).sum()))
    return kept, n, s, e, v[:, :k], k


def held(spark, rows, usable, components=16):
    got = whitening.query(table(spark, rows), components).collect()
    kept, n, s, e, v, k = by_matrix(usable, components)
    assert len(got) == len(kept) * k and all(r["n"] == n for r in got)
    signs = {}
    want = {}
    for i, x in kept:
        z = (n * x - s) / n @ v / np.sqrt(e[:k])
        for j in range(k):
            want.setdefault((i, j + 1, int(((n * x - s) ** 2).sum())), []).append(z[j])
    for r in got:
        z = want[(r["vec_id"], r["component"], r["deviation"])][0]
        if abs(z) > 1e-6:
            signs.setdefault(r["component"], np.sign(z * r["whitened"]))
        assert abs(r["whitened"] * signs.get(r["component"], 1) - z) < 1e-8
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12
        assert r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_against_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=20).tolist()) for i in range(700)]
    good += [good[3], good[3], (900, good[4][1]), (None, good[5][1])]
    bad = [(1000, None), (1001, [1.0, None, *[0.0] * 18]), (1002, [float("nan")] * 20), (1003, [float("inf")] + [0.0] * 19), (1004, []), (1005, [1.0, 2.0]), (1006, [1e30] * 20)]
    held(spark, good + bad, good)
    monkeypatch.setattr(whitening, "FOLDED_TOGETHER", 2)  # several rounds of folding
    monkeypatch.setattr(whitening, "ROWS_A_BLOCK", 7)
    held(spark, good + bad, good, components=30)


def test_fewer_components_than_dimensions(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 3)).round(1) * 64
    rows = [(i, [*b.tolist(), float(b[0]), 5.0]) for i, b in enumerate(base)]
    held(spark, rows, rows)


def test_nothing_varies(spark):
    assert whitening.query(table(spark, [])).count() == 0
    assert whitening.query(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.query(table(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(2**45 * (i % 2)), float(i)]) for i in range(50)]
    got = whitening.query(table(spark, rows)).collect()  # the second entry's deviation is nothing beside the first's
    assert len(got) == 50 and all(r["deviation"] is None for r in got)


def graded(rng, d):
    return np.diag(10.0 ** -np.arange(d)) @ np.triu(rng.normal(size=(d, d)))


@pytest.mark.parametrize(
    "make",
    [
        lambda g: np.triu(g.normal(size=(1, 1))),
        lambda g: np.triu(g.normal(size=(2, 2))),
        lambda g: np.linalg.qr(g.normal(size=(5000, 48)), "r"),
        lambda g: np.eye(6),
        lambda g: np.zeros((4, 4)),
        lambda g: np.diag([3.0, 3, 2, 2, 0, 0]),
        lambda g: np.vstack([np.linalg.qr(g.normal(size=(5, 30)), "r"), np.zeros((25, 30))]),
        lambda g: np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1),
        lambda g: np.linalg.qr(np.diag(np.repeat([5.0, 2, 1], 10)) @ np.linalg.qr(g.normal(size=(30, 30)))[0], "r"),
        lambda g: graded(g, 12),
    ],
)
def test_solver(make):
    r = make(np.random.default_rng(1))
    values, vectors = qd.eigen_of_gram(r)
    gram, top = r.T @ r, max(values[0], 1e-300)
    assert (np.diff(values) <= 1e-12 * top).all()
    assert np.abs(gram @ vectors - vectors * values).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(r))).max() < 1e-10


def test_small_values_are_as_accurate_as_large_ones():
    """Of a graded bidiagonal matrix, squares from 1 to 1e-22: those of its inverse's entries tell the least ones."""
    diagonal, above = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    got = qd.squared_singular_values(diagonal, above)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.allclose(1 / got[-1], np.linalg.norm(np.linalg.inv(b), 2) ** 2, rtol=1e-12)
    assert np.allclose(np.prod(np.sqrt(got)), np.prod(diagonal), rtol=1e-12)

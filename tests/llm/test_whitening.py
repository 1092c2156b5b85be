"""Whitening against numpy's eigenvectors and exact whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pairloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, __v int"


def vectors(count=300, d=12, seed=1, shift=0.0):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((count, d)) * np.linspace(0.2, 3, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return (mixed + shift).astype(np.float32)


def table(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "clash", 2) for i, v in data], SCHEMA).repartition(4)


def check(spark, data, most=4):
    good = [(i, v) for i, v in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max({len(v) for _, v in good}, key=lambda s: (sum(len(v) == s for _, v in good), s))
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in good if len(v) == size]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = [[float(sum(Fraction(n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) / n**3) for j in range(size)] for i in range(size)]
    values, basis = np.linalg.eigh(np.array(exact))
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    rows = whitening.whitened(table(spark, data)).collect()
    assert len(rows) == len(good) * most and {r.n for r in rows} == {n}
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    wanted = {}
    for i, x in good:
        wanted.setdefault(i, []).append(x)
    signs = None
    for i, xs in wanted.items():
        for c in range(1, most + 1):
            got = sorted(by[i, c], key=lambda r: r.deviation)
            assert [int(r.deviation) for r in got] == sorted(sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs)
            assert all(abs(r.explained / (values[c - 1] / np.trace(exact)) - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
        plain = np.array([[float(Fraction(a * n - s, n)) for a, s in zip(x, sums)] for x in xs]) @ basis / np.sqrt(values)
        found = np.array([sorted(r.whitened for r in by[i, c]) for c in range(1, most + 1)])
        assert np.allclose(np.sort(np.abs(plain.T), 1), np.sort(np.abs(found), 1), rtol=1e-7, atol=1e-8)
        signs = signs if signs is not None else []
        if len(xs) == 1:
            signs.append(np.sign(plain[0] * found[:, 0]))
    # One sign per component for all rows.
    assert all((s == signs[0]).all() for s in signs)


def test_awkward_rows(spark):
    data = list(enumerate(vectors()))
    data += [(900, None), (901, [1.0] * 11 + [None]), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, [1.0, 2.0]), (905, [])]
    data += [(906, data[0][1]), (906, data[0][1]), (None, data[1][1]), (907, [-0.0] * 12), (908, [0.001] * 12)] + [(909, data[2][1])] * 40
    check(spark, data)


@pytest.mark.parametrize("shift", [0.0, 3e4])
def test_large_numbers_stay_exact(spark, shift):
    check(spark, list(enumerate(vectors(80, 5, 3, shift) * np.float32(1e3))))


def test_nothing_to_whiten(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    # Fewer dimensions, or fewer vectors, than components.
    assert len(whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [5.0, 3.0])])).collect()) == 6
    assert len(whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [4.0, 3.0])])).collect()) == 2


def test_gram_of_any_size():
    rng = np.random.default_rng(2)
    for most in (9, 25, 45, 60):
        y = rng.integers(-(1 << most), 1 << most, (50, 3))
        assert (whitening._gram(y) == y.astype(object).T.dot(y.astype(object))).all()
    assert all(sum(p << 48 * k for k, p in enumerate(whitening._pieces(v))) == v for v in (0, -1, 1 << 140, -(1 << 140) + 7))


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "diagonal", "zero", "rank one"])
def test_divide_and_conquer(kind):
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = {
        "random": rng.random(40), "clusters": np.repeat([5.0, 3.0, 3.0 + 1e-9, 1.0], 10), "equal": np.full(40, 2.0),
        "diagonal": np.arange(40.0), "zero": np.zeros(40), "rank one": np.eye(40)[0] * 7,
    }[kind]
    basis = np.eye(40) if kind == "diagonal" else basis
    a = basis * values @ basis.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigen(a)
    assert np.allclose(np.sort(found), np.sort(values), atol=1e-13 * 40)
    assert np.allclose(vectors.T @ vectors, np.eye(40), atol=1e-13) and np.abs(a @ vectors - vectors * found).max() < 1e-12

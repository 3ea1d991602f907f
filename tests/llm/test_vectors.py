"""Whitening and centroids against plain numpy and exact integers."""

import hashlib
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from galena.llm import centroids, whitening
from galena.llm.integer_vectors import square_sums

SCHEMA = "vec_id long, embedding array<float>, label int, n long, cluster int, x string, distance double"


def rows_of(d=64, n=90):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.15, (n, d)).astype("float32")
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, base[0].tolist()) for k in range(60)]  # one vector has a third of the rows
    rows += [(7, base[3].tolist()), (7, base[7].tolist()), (None, base[8].tolist()), (None, rng.normal(0, 0.1, d).tolist())]
    rows += [(200, None), (201, [None] * d), (202, [nan] * d), (203, [inf] + [0.0] * (d - 1)), (204, [])]
    return [(i, v, 1, 2, 3, "x", 0.5) for i, v in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5).cache()


def kept(rows, d=64):
    return [(r[0], [float(np.float32(c)) for c in r[1]]) for r in rows if r[1] and len(r[1]) == d and all(c is not None and abs(c) < inf for c in r[1])]


def plain_whitening(rows, d=64):
    own = [(i, [floor(64 * c) + 1_000_000 for c in v]) for i, v in kept(rows, d)]
    fit = np.array(sorted({tuple(x) for _, x in own}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return own, n, sums, values[::-1], axes.T[::-1]


def test_whitening(vectors):
    own, n, sums, values, axes = plain_whitening(rows_of())
    got = whitening.whitening_report(vectors).collect()
    assert len(got) == 16 * len(own)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(round(r.whitened, 6))
        assert r.n == n and r.identity_error < 1e-9 and r.deviation_digits == str(r.deviation)
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
    signs = {}
    for i, x in own:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(16):
            (value,) = by[i, deviation][k + 1]
            want = float((np.array(x) - sums / n) @ axes[k] / np.sqrt(values[k]))
            if abs(want) > 1e-3:
                signs.setdefault(k, value * want > 0)
                assert signs[k] == (value * want > 0)
            assert abs(abs(value) - abs(want)) < 2e-6


def test_whitening_of_hard_rows(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, 2, 3, "x", 0.5) for i, v in rows], SCHEMA)
    assert whitening.whitening_report(make([])).count() == 0
    assert whitening.whitening_report(make([(1, None), (2, [])])).count() == 0
    assert whitening.whitening_report(make([(1, [0.5, 0.25])] * 3)).count() == 0  # no variance, no component
    # two lengths are two spaces; three vectors in five dimensions have two components
    rng = np.random.default_rng(1)
    three = [(k, rng.normal(0, 1, 5).tolist()) for k in range(3)]
    two = [(10 + k, rng.normal(0, 1, 2).tolist()) for k in range(9)]
    got = whitening.whitening_report(make(three + two)).collect()
    assert {(r.vec_id, r.component, r.n) for r in got} == {(k, c, 3) for k in range(3) for c in (1, 2)} | {(10 + k, c, 9) for k in range(9) for c in (1, 2)}
    # entries past 64 bits stop there; deviations past a long are told in digits
    huge = whitening.whitening_report(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.deviation for r in huge} == {None, *(r.deviation for r in huge if len(r.deviation_digits) < 19)}
    top = (1 << 61) + 1_000_000
    assert {r.deviation_digits for r in huge if r.vec_id == 1} == {str((3 * top - 3_000_000) ** 2 + (3 * 1_000_000 - (3_000_000 + 192)) ** 2)}


def test_moments_merge_like_one_stream():
    rng = np.random.default_rng(2)
    x = rng.integers(999_000, 1_001_000, (500, 7))
    whole, parts = whitening.Moments(7), [whitening.Moments(7) for _ in range(5)]
    whole.add(x)
    for k, m in enumerate(parts):
        m.add(x[k * 60 : (k + 1) * 60] if k < 4 else x[240:])
    first = whitening.Moments(7)
    for m in parts:
        first.merge(m)
    assert first.n == whole.n == 500 and first.sums == whole.sums == x.sum(axis=0).tolist()
    want = np.cov(x.T, bias=True)
    for m in (first, whole):
        assert np.abs(m.spread / 500 - want).max() < 1e-11 * np.abs(want).max()


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(d, d)), np.eye(d), np.zeros((d, d)), np.ones((d, d)), np.diag(np.arange(d, dtype=float))):
        v = a @ a.T
        values, rows = whitening.symmetric_qr(v)
        scale = max(1.0, np.abs(v).max()) * d
        assert np.allclose(rows @ rows.T, np.eye(d), atol=1e-12)
        assert np.allclose(rows.T @ np.diag(values) @ rows, v, atol=1e-13 * scale)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * scale) and (np.diff(values) <= 0).all()


def plain_clusters(rows, k=40, rounds=5):
    own = [(i, [floor(256 * c) for c in v]) for i, v in kept(rows)]
    order = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:k]]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for step in range(rounds + 1):
        best = [min((apart(x, m), k) for k, m in enumerate(c)) for _, x in own]
        if step < rounds:
            c = [[floor(Fraction(sum(col), len(mine))) for col in zip(*mine, strict=True)] if (mine := [x for (_, x), (_, b) in zip(own, best, strict=True) if b == k]) else m for k, m in enumerate(c)]
    sums = {k: sum(d for d, b in best if b == k) for k in range(len(c))}
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((-1 if i is None else i, b, d, sums[b], sum(sums.values()), name[b]) for (i, _), (d, b) in zip(own, best, strict=True))


def test_centroids(vectors):
    got = centroids.cluster_report(vectors)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == plain_clusters(rows_of())


def test_few_vectors_and_none(spark):
    few = rows_of()[:3] + rows_of()[-5:] + [(5, [1.0, 2.0], 1, 2, 3, "x", 0.5)]
    got = centroids.cluster_report(spark.createDataFrame(few, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == plain_clusters(few) and {r.distance for r in got} == {0}
    assert centroids.cluster_report(spark.createDataFrame([], SCHEMA)).count() == 0
    huge = [(k, [3e38 * (-1) ** k] * 64, 1, 2, 3, "x", 0.5) for k in range(3)]
    got = centroids.cluster_report(spark.createDataFrame(huge, SCHEMA), k=1).collect()
    assert {r.inertia for r in got} == {None} and len(got) == 3


@pytest.mark.parametrize("size", [3, 200, 1 << 23, 1 << 30, 1 << 60])
def test_screening_never_loses_the_nearest(size):
    """Intervals hold the exact values; ties and near ties end with the smallest number at any magnitude."""
    rng = np.random.default_rng(size % 97)
    x, c = rng.integers(-size, size + 1, (60, 16)), rng.integers(-size, size + 1, (12, 16))
    c[7] = c[2]
    c[9] = c[2] + rng.integers(-1, 2, 16)
    x[:20] = c[2] + rng.integers(-1, 2, (20, 16))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    best, distance = centroids.nearest(x, c)
    assert best.tolist() == [min((v, k) for k, v in enumerate(e))[1] for e in exact]
    assert [int(v) for v in distance] == [min(e) for e in exact]
    low, high = centroids.intervals(x, c)
    for p, e, a, b in zip(x, exact, low, high, strict=True):
        own = sum(int(v) ** 2 for v in p)
        assert all(lo == -inf or Fraction(lo) <= v - own <= Fraction(hi) for v, lo, hi in zip(e, a, b, strict=True))


def test_square_sums_past_64_bits():
    assert square_sums(np.array([[1 << 62, 1], [3, 4]])).tolist() == [(1 << 124) + 1, 25]

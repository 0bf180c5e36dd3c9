"""Whitening against covariances from exact fractions and all products."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from wearhouse.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, deviation double, id string, v int"


def make(seed=1, count=120, d=12):
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    out = []
    for i in range(count):
        z = [rng.gauss(0, 1 + k) for k in range(d)]
        out.append((i, [sum(m * x for m, x in zip(row, z)) / 10 for row in mix]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 0.5, "x", 9) for i, v in rows], SCHEMA).repartition(3)


def usable(v, d):
    return v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)


def exact(rows, d):
    """(x vectors, sums, covariance in fractions) of the usable rows, float32 entries."""
    xs = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if usable(v, d)]
    n = len(xs)
    sums = [sum(x[k] for _, x in xs) for k in range(d)]
    centred = [[n * x[k] - sums[k] for k in range(d)] for _, x in xs]
    cov = [[Fraction(sum(c[a] * c[b] for c in centred), n**3) for b in range(d)] for a in range(d)]
    return xs, sums, centred, cov


def test_whitening_against_fractions(spark):
    rows = make()
    rows += [(200, None), (201, []), (202, [None] + [0.5] * 11), (203, [math.nan] * 12), (204, [math.inf] + [0.0] * 11), (205, [1.0, 2.0])]
    rows += [rows[3], rows[3], (4, rows[5][1]), (None, rows[6][1])]
    got = whitening.whiten(frame(spark, rows)).collect()
    xs, sums, centred, cov = exact(rows, 12)
    n = len(xs)
    v = np.array([[float(c) for c in r] for r in cov])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    want = sorted(((i, sum(c * c for c in own)) for (i, _), own in zip(xs, centred)), key=str)
    assert sorted(((r.vec_id, int(r.deviation)) for r in got if r.component == 1), key=str) == want
    for r in got:
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(v), rel_tol=1e-9)
        assert r.identity_error < 1e-9
    for k in range(8):
        own = [(np.array(c, float) / n) @ vectors[:, k] / math.sqrt(values[k]) for c in centred]
        seen = {(r.vec_id, int(r.deviation)): r.whitened for r in got if r.component == k + 1}
        sign = 1 if seen[xs[0][0], sum(c * c for c in centred[0])] * own[0] > 0 else -1
        for (i, _), c, w in zip(xs, centred, own):
            assert math.isclose(seen[i, sum(a * a for a in c)], sign * w, rel_tol=1e-7, abs_tol=1e-9)


def test_covariance_is_exact():
    rng = np.random.default_rng(2)
    for scale in (10, 10**6, 10**17):  # the last ones need Python integers
        x = np.array([[int(v) for v in row] for row in rng.integers(-scale, scale, (30, 5)).tolist()], object)
        n, sums = len(x), x.sum(0)
        m = np.array([s // n for s in sums.tolist()], object)
        u = whitening.centred(x, m)
        assert (u.dtype == object) == (scale == 10**17)
        got = whitening.polarised(n, [int(s - n * k) for s, k in zip(sums, m)], [int(v) for v in whitening.pair_squares(u)])
        c = n * x - sums
        want = [[float(Fraction(int((c[:, a] * c[:, b]).sum()), n**3)) for b in range(5)] for a in range(5)]
        assert got.tolist() == want


def test_large_entries(spark):
    rows = [(i, [float(1e15 * i), float(i % 7), -1e30 * (i % 3)]) for i in range(20)]
    got = whitening.whiten(frame(spark, rows)).collect()
    xs, _, centred, _ = exact(rows, 3)
    want = {i: sum(c * c for c in own) for (i, _), own in zip(xs, centred)}
    assert all(r.deviation is None if want[r.vec_id] >= 10**38 else int(r.deviation) == want[r.vec_id] for r in got)


def test_whole_numbers():
    assert whitening.whole(np.array([[0.5, -0.0001], [1.0, -3.25]])).tolist() == [[100512, 99999], [101024, 96672]]
    assert whitening.whole(np.array([[1e20, 1e308]])).tolist() == [[1024 * 10**20 + 100_000, 1024 * int(1e308) + 100_000]]


def test_fewer_components_and_none(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and math.isclose(got[0].explained, 1)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    empty = whitening.whiten(frame(spark, line).limit(0))
    assert empty.count() == 0 and empty.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_most_frequent_length_is_fitted(spark):
    rows = make(3, 20, 3) + [(100 + i, v) for i, v in make(4, 15, 5)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(range(20)) and {r.n for r in got} == {20}


@pytest.mark.parametrize("partitions", [1, 7])
def test_layout_does_not_matter(spark, partitions):
    rows = frame(spark, make()).repartition(partitions)
    w = whitening.fit(rows.selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS v"))
    again = whitening.fit(frame(spark, make()).selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS v"))
    assert w.sums == again.sums and (w.covariance == again.covariance).all()

"""Whitening against a direct eigendecomposition with exact whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from textmill.llm import whitening

VECTORS = "vec_id long, embedding array<double>, n int, whitened int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS).repartition(parts)


def check(got, rows, k):
    """Every column against its definition; eigenvectors up to their sign."""
    fine = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows]
    n, d = len(fine), len(fine[0][1])
    sums = [sum(v[j] for _, v in fine) for j in range(d)]
    x = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for _, v in fine])
    cov = x.T @ x / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    by = {}
    for r in got:
        assert r.n == n and abs(r.identity_error) < 1e-9
        assert abs(r.explained - e[r.component - 1] / np.trace(cov)) <= 1e-9
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(by) == n and all(sorted(c) == list(range(1, min(k, d) + 1)) for c in by.values())
    for c in range(1, min(k, d) + 1):
        want = x @ vec[:, c - 1] / np.sqrt(e[c - 1])
        have = np.array([by[i][c].whitened for i, _ in fine])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
    for i, v in fine:
        assert by[i][1].deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))


@pytest.mark.parametrize("parts", [1, 40])
def test_against_eigenvectors(spark, parts):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 12)) * np.linspace(1, 3, 12) @ np.linalg.qr(r.normal(size=(12, 12)))[0] + 50 * r.normal(size=12)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [float("nan")] * 12), (5003, [float("inf"), *[1.0] * 11]), (5004, [None, *[1.0] * 11]), (5005, [1.0] * 11)]
    got = whitening.by_component(whitening.whiten(table(spark, rows + odd, parts), 32))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows, 32)


def test_fewer_components_and_sorted_partitions(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=6) * [5, 4, 3, 2, 1.5, 1] + (i // 100) * 4).tolist()) for i in range(600)]  # partitions differ in their means
    check(whitening.by_component(whitening.whiten(table(spark, rows).repartitionByRange(9, "vec_id"), 4)).collect(), rows, 4)


def test_repeated_rows_and_ids(spark):
    r = np.random.default_rng(4)
    rows = [(7 if i % 3 == 0 else i, [1.0, -2.0, 0.5] if i % 3 == 0 else r.normal(size=3).tolist()) for i in range(300)] + [(None, [0.0, 0.0, 0.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 301 and sum(g.vec_id == 7 for g in got) == 101 and sum(g.vec_id is None for g in got) == 1 and {g.n for g in got} == {301}
    assert len({tuple(g.whitened) for g in got if g.vec_id == 7}) <= 2 and max(g.identity_error for g in got) < 1e-9


def test_no_variance(spark):
    one = whitening.by_component(whitening.whiten(table(spark, [(1, [1.0, 2.0])]))).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(table(spark, [(i, [float(i), 3.0, 2.0 * i]) for i in range(50)])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] and abs(r.explained[0] - 1) < 1e-9 and r.explained[1:] == [0, 0] and r.identity_error < 1e-9 for r in flat)


def test_empty_table(spark):
    got = whitening.by_component(whitening.whiten(table(spark, [])))
    assert got.collect() == [] and got.columns[1] == "component"


def test_deviations_are_exact():
    r = np.random.default_rng(5)
    for top, n in ((300, 7), (1 << 30, 1 << 20), (1 << 61, 9)):
        x = r.integers(-top, top, (20, 5))
        sums = [int(t) for t in r.integers(-top, top, 5)]
        assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]


def test_merging_loses_nothing():
    r = np.random.default_rng(6)
    x = r.integers(-500, 500, (400, 8)) + np.arange(8) * 1000
    total = None
    for part in np.split(x, [3, 5, 100, 101, 350]):
        k = whitening.sketch(part)
        total = k if total is None else whitening.merged(total, k)
    whole = whitening.sketch(x)
    assert total.n == 400 and total.sums == whole.sums
    assert np.allclose((total.vt.T * total.s**2) @ total.vt, (whole.vt.T * whole.s**2) @ whole.vt, rtol=1e-12)


def test_huge_entries(spark):
    rows = [(i, [1e300 if i == 3 else float(i), -float(i * i)]) for i in range(30)]
    got = whitening.by_component(whitening.whiten(table(spark, rows))).collect()
    assert len(got) == 60 and any(r.deviation is None for r in got)

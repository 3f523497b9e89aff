"""The solver against plain decompositions, the whitened rows against exact integers and a plain eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from ledgerscope.llm import whitening


def triangles():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 24):
        yield rng.normal(size=(d, d))
    yield rng.normal(size=(24, 24)) * np.logspace(0, -11, 24)
    yield np.eye(6)
    yield np.diag([3.0, 3.0, 1.0, 0.0, 0.0])
    low = rng.normal(size=(9, 9))
    low[:, 4] = low[:, 2]
    yield low
    isotropic = rng.normal(size=(20_000, 32))
    yield isotropic - isotropic.mean(0)


@pytest.mark.parametrize("a", list(triangles()), ids=lambda a: "x".join(map(str, a.shape)))
def test_values_and_directions(a):
    r = np.linalg.qr(a, mode="r")
    diagonal, above, back = whitening.bidiagonalise(r)
    true = np.linalg.svd(r)[1] ** 2
    assert np.allclose(back.T @ back, np.eye(len(r)), atol=1e-12)
    assert np.allclose(whitening.dqds(diagonal, above), true, rtol=1e-11, atol=1e-13 * true[0])
    values, found = whitening.directions(r)
    assert np.allclose(found.T @ found, np.eye(len(values)), atol=1e-11)
    assert np.max(np.abs(r.T @ r @ found - found * values)) <= 1e-11 * true[0]
    assert len(values) == min(16, int((true > 1e-28 * true[0]).sum()))


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, `x.y` int")


def plain(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e, *_ in rows
            if e and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return kept, n, sums, values[::-1], vectors[:, ::-1], np.trace(cov)


def test_rows_same_as_plain(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=20) * np.linspace(3, 0.5, 20)).tolist(), "c", 1) for i in range(300)]
    rows += [(300 + i, rows[5][1], "c", 1) for i in range(40)]  # a hot vector
    rows += [(7, rows[7][1], "c", 1), (None, rows[8][1], None, None), (400, None, "c", 1), (401, [], "c", 1), (402, [None] + [1.0] * 19, "c", 1),
             (403, [float("nan")] + [1.0] * 19, "c", 1), (404, [float("inf")] * 20, "c", 1), (405, [1.0] * 19, "c", 1)]
    got = whitening.whiten(table(spark, rows).repartition(5)).collect()
    kept, n, sums, values, vectors, trace = plain([r for r in rows if r[0] != 405])
    assert len(got) == 16 * len(kept)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    for component in range(1, 17):
        e, z = values[component - 1], vectors[:, component - 1]
        sign = 0
        for vec_id, x in kept:
            row = next(r for r in by[vec_id] if r["component"] == component)
            want = sum((n * v - s) / n * c for v, s, c in zip(x, sums, z)) / math.sqrt(e)
            sign = sign or (1 if abs(row["whitened"] - want) < abs(row["whitened"] + want) else -1)
            assert row["whitened"] == pytest.approx(sign * want, abs=1e-9)
            assert row["deviation"] == sum((n * v - s) ** 2 for v, s in zip(x, sums)) and row["n"] == n
            assert row["explained"] == pytest.approx(e / trace, rel=1e-10) and row["identity_error"] < 1e-9


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], "a", 1), (2, [1.0, 2.0], "a", 1)])).collect() == []
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i], "a", 1) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and all(r["explained"] == pytest.approx(1.0) for r in line)


def test_huge_entries_are_held(spark):
    rows = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    x = {r["vec_id"]: r["x"] for r in whitening.quantised(rows).collect()}
    assert x[1] == [(1 << 52) + 1_000_000, 1_000_064] and x[2] == [-(1 << 52) + 1_000_000, 1_000_128]

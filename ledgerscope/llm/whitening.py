"""Embedding whitening through a bidiagonal qd solver.

Spark reduces the centred distinct rows by QR block by block and merges the triangles in rounds, so the covariance is never formed.
What is left, one triangle of the size of the embedding, is brought to bidiagonal form by Householder reflections; dqds finds
its singular values to high relative accuracy, twisted factorisations of the shifted tridiagonal give the vectors, and the
reflections carry them back to whitening directions. A second pass over the rows measures how white the result is.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import arrow_schema
from ledgerscope.session import pin

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries are held within this, so that a double carries them exactly.
_MOST = float(1 << 52)
_MERGE = 32
_EPS = float(np.finfo(float).eps)


# ---- the solver (dimension by dimension matrices on the driver) ---------------------------------

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right-hand transformation of a square matrix, by Householder reflections."""
    a = np.array(r, float)
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0:
            return None
        u = x.copy()
        u[0] += np.copysign(size, x[0])
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            u = reflector(a[k, k + 1:])
            if u is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference step; None if the shift was above the least value."""
    d, qs, es = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0:
            return None
        up = d + e[i]
        if up == 0:
            qs.append(0.0)
            es.append(0.0)
            d = q[i + 1] - shift
            continue
        ratio = q[i + 1] / up
        qs.append(up)
        es.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return qs + [d], es, d


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, largest first."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    tiny, found = (_EPS ** 2), []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        if not q:
            continue
        if len(q) == 1:
            found.append(max(q[0] + moved, 0.0))
            continue
        size = max(max(q), max(e)) + moved
        cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (moved + min(q[i], q[i + 1])) or e[i] <= tiny * tiny * size), None)
        if cut is not None:
            blocks += [(q[:cut + 1], e[:cut], moved), (q[cut + 1:], e[cut + 1:], moved)]
            continue
        if q[0] < q[-1]:  # small values belong at the end; a reversed bidiagonal has the same ones
            q, e = q[::-1], e[::-1]
        # the lesser value of the last two by two, less a margin, is tried first; a step without shift can't fail
        a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
        least = 0.5 * (a + b - np.hypot(a - b, 2 * np.sqrt(c)))
        for shift in (0.999 * least, 0.5 * least, 0.1 * least, 0.0):
            done = _dqds_step(q, e, shift) if shift >= 0 else None
            if done:
                q, e, _ = done
                moved += shift
                break
        blocks.append((q, e, moved))
    return np.sort(np.array(found))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of the stationary and the progressive factorisation of L D L' - value, and the twist elements."""
    n, floor = len(d), _EPS * _EPS * max(abs(value), float(np.max(np.abs(d))), 1e-300)
    safe = lambda x: x if abs(x) > floor else (floor if x >= 0 else -floor)
    down, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = safe(s[i] + d[i])
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        sum_ = d[i] * low[i] * low[i] + p[i + 1]
        pivot = safe(sum_)
        share = d[i] / pivot
        up[i] = low[i] * share
        p[i] = (p[i + 1] + (pivot - sum_)) * share - value  # a pivot of nothing moves with its summand
    return down, up, s + p + value


def _vector(down: np.ndarray, up: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, len(up)):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of a bidiagonal matrix for the given squared singular values, as columns.

    Values that lie close together are told apart by taking out the directions already found and, where little is left, twisting
    at the next best place.
    """
    n = len(diagonal)
    safe = np.where(diagonal == 0, _EPS * max(float(np.max(np.abs(diagonal))), 1e-300), diagonal)
    d, low, out = safe * safe, above / safe[:-1], np.zeros((n, len(values)))
    for j, value in enumerate(values):
        near = [i for i in range(j) if abs(values[i] - value) <= 1e-3 * max(abs(values[i]), abs(value))]
        best = None
        for turn in range(3):  # Rayleigh corrections of the shift
            down, up, gamma = _twisted(d, low, value)
            z = _vector(down, up, int(np.argmin(np.abs(gamma))))
            if near or turn == 2:
                break
            b = diagonal * z
            b[:-1] += above * z[1:]
            better = float(b @ b)
            if abs(better - value) <= 4 * _EPS * abs(value):
                break
            value = better
        for at in np.argsort(np.abs(gamma), kind="stable"):
            z = _vector(down, up, int(at))
            for _ in range(2):
                for i in near:
                    z -= (out[:, i] @ z) * out[:, i]
            left = np.linalg.norm(z)
            if best is None or left > best[0]:
                best = (left, z / left if left else z)
            if left > 0.5:
                break
        out[:, j] = best[1]
    return out


def directions(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a triangle and the unit right singular vectors, as columns.

    Directions in which the rows don't differ beyond rounding are left out.
    """
    size = float(np.max(np.abs(r))) if r.size else 0.0
    if size == 0:
        return np.zeros(0), np.zeros((r.shape[1], 0))
    diagonal, above, back = bidiagonalise(r / size)
    values = dqds(diagonal, above)
    keep = values[:most][values[:most] > (len(r) * _EPS) ** 2 * values[0]]
    found = back @ vectors(diagonal, above, keep)
    # one Rayleigh-Ritz step among the directions found: what rounding mixed is told apart again
    small = np.linalg.qr((r / size) @ found)[1]
    d, a, turn = bidiagonalise(small)
    values = dqds(d, a)
    found = found @ (turn @ vectors(d, a, values))
    return values * size * size, found / np.linalg.norm(found, axis=0)


# ---- Spark steps --------------------------------------------------------------------------------

def quantised(rows: DataFrame) -> DataFrame:
    """``vec_id, x``: the rows that have a whole finite vector, x = floor(64 c) + 1000000 per entry.

    Entries that would pass 2^52 are held there. Only vectors of the length that most rows have (the longer one of two) are comparable
    and stay.
    """
    c = F.col("embedding")
    sound = c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    x = F.transform(c, lambda v: (F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(-_MOST)), F.lit(_MOST))) + SHIFT).cast("long"))
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(sound).select("vec_id", x.alias("x"))
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit_list(x: DataFrame) -> DataFrame:
    """The distinct vectors."""
    return x.select("x").distinct()


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension, summed per task before they meet."""
    def run(batches):
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                high, low = x >> 26, x & ((1 << 26) - 1)  # neither half can overflow in a batch
                part = [(int(h) << 26) + int(s) for h, s in zip(high.sum(0), low.sum(0))]
                sums = part if sums is None else [a + b for a, b in zip(sums, part)]
                n += batch.num_rows
        if sums:
            yield pa.RecordBatch.from_pydict({"i": range(-1, len(sums)), "s": [Decimal(v) for v in (n, *sums)]},
                                             schema=pa.schema([("i", pa.int64()), ("s", pa.decimal128(38, 0))]))

    found = {r["i"]: int(r["s"]) for r in fit.mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(float)


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: per task over its blocks of rows, then ``_MERGE`` triangles to one until one is left."""
    d = len(sums)

    def reduced(blocks):
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": [0], "r": [r.ravel().tolist()]}, schema=pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))]))

    def rows(batches):
        return reduced(_centred(_matrix(b), n, sums) for b in batches if b.num_rows)

    def triangles(batches):
        return reduced(np.array(r).reshape(-1, d) for b in batches for r in b.column("r").to_pylist())

    kind = "part long, r array<double>"
    found = pin(fit.mapInArrow(rows, kind).withColumn("part", F.spark_partition_id().cast("long")), "triangles")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        groups = -(-parts // _MERGE)
        merged = found.withColumn("to", F.floor(F.col("part") / _MERGE)).repartitionByRange(groups, "to").sortWithinPartitions("part")
        found = pin(merged.select("part", "r").mapInArrow(triangles, kind).withColumn("part", F.spark_partition_id().cast("long")), "triangles")
        parts = groups
    r = np.vstack([np.array(row["r"]).reshape(-1, d) for row in found.collect()])
    r = np.linalg.qr(r, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))])


def identity_error(fit: DataFrame, n: int, sums: list[int], transform: np.ndarray) -> float:
    """Largest entry, in size, of the covariance of the whitened fit list less the identity."""
    k = transform.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = _centred(_matrix(batch), n, sums) @ transform
                total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_pydict({"i": range(total.size), "s": total.ravel()}, schema=arrow_schema("i long, s double"))

    found = fit.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    total = np.array([r["s"] for r in found]).reshape(k + 1, k) / n
    return float(np.max(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k))))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per row of ``rows(vec_id, embedding)`` with a whole finite vector and per component: its whitened coordinate.

    ``n`` counts the distinct vectors, ``deviation`` is the exact sum of squares of n*x - S, ``explained`` the share of the variance and
    ``identity_error`` how far the whitened distinct rows are from unit covariance. Repeated rows each get their own rows but are fitted
    once. Directions without variance have no component, so a table of one distinct vector, or an empty one, gives an empty result.
    A deviation beyond the range of a long ends the job with an error.
    """
    x = pin(quantised(rows), "quantised")
    fit = pin(fit_list(x), "fit_list")
    n, sums = totals(fit)
    if not n:
        return rows.sparkSession.createDataFrame([], _OUT)
    r = triangle(fit, n, sums)
    values, found = directions(r, most)
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], _OUT)
    transform = found / np.sqrt(values / n)
    explained = values / float((r * r).sum())
    error = identity_error(fit, n, sums, transform)
    schema = arrow_schema(_OUT)

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            scaled = _scaled(_matrix(batch), n, sums)
            w = (scaled / n).astype(float) @ transform
            exact = scaled.astype(object) if scaled.dtype == object or float(np.abs(scaled).max()) ** 2 * scaled.shape[1] >= 2.0 ** 62 else scaled
            deviation = (exact * exact).sum(1)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(count), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, n, np.int64)),
                pa.array(np.repeat(deviation, k).tolist() if deviation.dtype == object else np.repeat(deviation, k), pa.int64()),
                pa.array(w.ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error))], schema=schema)

    return x.mapInArrow(run, _OUT)

"""Embedding whitening by a bidiagonal qd solver (operator 12).

The rows, centred, are reduced block by block to the triangular factor ``R`` of a QR
factorisation; the factors of tasks are stacked and reduced again, in a tree, so what
travels has the size of the dimension squared. Householder reflections bring ``R`` to a
bidiagonal ``B``, and dqds (differential quotient-difference steps with shifts) finds the
singular values of ``B`` to high relative accuracy. The vector of each value comes from a
twisted factorisation of ``B'B`` less its square, taken where the twist is least; vectors
of values that lie together are made orthogonal to each other. The covariance itself is
never formed for the solution.

Entries are taken as the integers ``floor(64 c) + 1000000``, so counts, sums and deviations
are exact.

Defined results: rows whose vector is null or holds a null or an entry that isn't finite
are dropped, and so are empty vectors, those with an entry beyond ``LARGEST``, and those of
another dimension than the most frequent one (of equals the largest). Repeated rows count
and return each for itself, also with a null id. Components without variance (eigenvalue
under ``FLAT`` of the greatest) can't be scaled and are left out, so a table of equal
vectors, like an empty one, gives no rows. A deviation that doesn't fit a long is null.
Components of equal eigenvalues are some orthonormal basis of their space. There is no
text; columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.batches import small_batches

#: Scale and offset of the integers that entries become.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond it are no longs any more after scaling.
LARGEST = float(1 << 55)
#: Share of the greatest eigenvalue under which a component has no direction.
FLAT = 1e-13
#: Factors that are reduced together.
FAN_IN = 32
#: Singular values nearer than this share of the greater one have their vectors made orthogonal.
CLUSTER = 1e-3


# ---- the solver, on matrices of the dimension squared


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor ``V`` of ``r = U B V'``, by Householder reflections."""
    a = np.array(r, dtype=np.float64)
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray:
        u = x.copy()
        size = np.linalg.norm(x)
        if size:
            u[0] += np.copysign(size, x[0])
            u /= np.linalg.norm(u)
        return u

    for k in range(n):
        u = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 2 < n:
            u = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Singular values of the bidiagonal matrix, greatest first.

    Works on the squares ``q`` and ``e``. A step with shift ``s`` gives the squares of the
    bidiagonal factor of ``B B' - s``; a shift that is too great shows as a negative number
    and is taken again, smaller. When the last ``e`` is negligible, its value splits off.
    """
    eps = np.finfo(np.float64).eps
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    # matrices still to be solved, each with the shifts taken from it so far
    todo = [((diagonal / scale) ** 2, (upper / scale) ** 2, 0.0)]
    while todo:
        q, e, shift = todo.pop()
        n = len(q)
        if n == 1:
            found.append(shift + q[0])
            continue
        if n == 2:
            found += [shift + x for x in _pair(q[0], e[0], q[1])]
            continue
        while True:
            small = np.flatnonzero(e <= eps * eps * (shift + np.minimum(q[:-1], q[1:])))
            if len(small):
                k = int(small[-1])
                todo += [(q[: k + 1], e[:k], shift), (q[k + 1 :], e[k + 1 :], shift)]
                break
            if e[-1] <= eps * (shift + q[-1]) * eps:
                todo += [(q[:-1], e[:-1], shift), (q[-1:], e[:0], shift)]
                break
            if q[-1] > 1.5 * q[0]:  # the small values belong at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            _, low = _pair(q[-2], e[-1], q[-1])
            s = low if e[-1] < 0.25 * q[-1] else 0.25 * low
            while True:
                nq, ne = _step(q, e, s)
                if nq is not None:
                    break
                s = 0.0 if s < eps * (shift + q.min()) else 0.25 * s
            q, e, shift = nq, ne, shift + s
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _step(q: np.ndarray, e: np.ndarray, s: float):
    nq, ne = np.empty_like(q), np.empty_like(e)
    d = q[0] - s
    for k in range(len(e)):
        if d < 0:
            return None, None
        nq[k] = d + e[k]
        if nq[k] == 0:
            ne[k], d = 0.0, q[k + 1] - s
        else:
            t = q[k + 1] / nq[k]
            ne[k], d = e[k] * t, d * t - s
    if d < 0:
        return None, None
    nq[-1] = d
    return nq, ne


def _pair(q1: float, e1: float, q2: float) -> tuple[float, float]:
    """The two eigenvalues of the two-by-two case, the smaller one without cancellation."""
    half = 0.5 * (q1 + q2 + e1)
    root = np.sqrt((0.5 * (q1 - q2 + e1)) ** 2 + q2 * e1)
    top = half + root
    return top, (q1 / top * q2 if top else 0.0)


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, sigma: float) -> np.ndarray:
    """Unit vector of ``B'B`` for the eigenvalue ``sigma`` squared, from its twisted factorisation.

    ``B'B - s`` is factored from the top (``L D L'``) by stationary and from the bottom
    (``U D U'``) by progressive qd steps; the two meet at the index where the pivot of the
    twist is least, and the vector follows from there by products alone.
    """
    n = len(diagonal)
    q, e, off = diagonal**2, upper**2, diagonal[:-1] * upper
    tiny = np.finfo(np.float64).eps ** 2 * max(float(q.max()), float(e.max(initial=0))) + np.finfo(np.float64).tiny
    s = sigma * sigma

    def pivot(d: float) -> float:
        return d if abs(d) > tiny else tiny

    down, top = np.empty(n - 1), np.empty(n)  # factors from the top and what each index has got from above
    top[0] = -s
    for k in range(n - 1):
        down[k] = pivot(top[k] + q[k])
        top[k + 1] = top[k] * (e[k] / down[k]) - s
    up, low = np.empty(n - 1), np.empty(n)
    low[-1] = q[-1] - s
    for k in range(n - 2, -1, -1):
        up[k] = pivot(low[k + 1] + e[k])
        low[k] = low[k + 1] * (q[k] / up[k]) - s
    twist = int(np.argmin(np.abs(top + low + s)))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -off[k] / down[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -off[k] / up[k] * z[k]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, greatest first, and their right vectors, as columns.

    A vector is made orthogonal to those of the values next to its own. What is left of
    the angles between vectors goes by one QR step and by rotations of pairs.
    """
    n = len(r)
    diagonal, upper, v = bidiagonal(r)
    sigma = dqds(diagonal, upper)
    z = np.empty((n, n))
    start = 0
    for k in range(n):
        if k and sigma[k - 1] - sigma[k] > CLUSTER * sigma[k - 1]:
            start = k
        x = twisted_vector(diagonal, upper, sigma[k])
        for _ in range(2):
            x = x - z[:, start:k] @ (z[:, start:k].T @ x)
        size = np.linalg.norm(x)
        z[:, k] = x / size if size > 1e-4 else _new_direction(z[:, :k])
    z, factor = np.linalg.qr(z)
    z = _rotated(diagonal, upper, z * np.where(np.diag(factor) < 0, -1.0, 1.0))
    return sigma, v @ z


def _new_direction(z: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the columns."""
    k = int(np.argmin((z * z).sum(axis=1)))
    x = np.zeros(len(z))
    x[k] = 1.0
    for _ in range(2):
        x -= z @ (z.T @ x)
    return x / np.linalg.norm(x)


def _rotated(diagonal: np.ndarray, upper: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The columns turned in pairs until their images under ``B`` are orthogonal, too."""
    y = diagonal[:, None] * z
    y[:-1] += upper[:, None] * z[1:]
    z = z.copy()
    for _ in range(30):
        turned = False
        for i in range(z.shape[1] - 1):
            for j in range(i + 1, z.shape[1]):
                a, b, c = y[:, i] @ y[:, i], y[:, j] @ y[:, j], y[:, i] @ y[:, j]
                if abs(c) <= 4e-16 * np.sqrt(a * b) and a >= b:
                    continue
                theta = 0.5 * np.arctan2(2 * c, a - b)
                turn = np.array([[np.cos(theta), -np.sin(theta)], [np.sin(theta), np.cos(theta)]])
                y[:, [i, j]], z[:, [i, j]] = y[:, [i, j]] @ turn, z[:, [i, j]] @ turn
                turned = turned or abs(theta) > 1e-15
        if not turned:
            break
    return z


# ---- the rows


def _valid(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, _x): the scaled integers of the vectors that count."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)), F.lit(False)) & (F.size(v) > 0)
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return df.where(good).select(F.col(f"`{id_col}`"), x.alias("_x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of the most frequent dimension, and their exact sums by dimension."""

    def run(batches):
        totals: dict[int, list] = {}
        for rb in batches:
            x = rb.column(0)
            for width in set(sizes := x.value_lengths().to_pylist()):
                some = x.filter(pa.array([s == width for s in sizes]))
                part = _matrix(some, width)
                exact = [int(s) for s in (part >> 31).sum(axis=0)], [int(s) for s in (part & ((1 << 31) - 1)).sum(axis=0)]
                known = totals.setdefault(width, [0, [0] * width])
                known[0] += len(part)
                known[1] = [k + (h << 31) + low for k, h, low in zip(known[1], *exact)]
        out = [(w, k, n, Decimal(s)) for w, (n, sums) in totals.items() for k, s in enumerate(sums)]
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.decimal128(38, 0))],
            names=["width", "dim", "n", "total"],
        )

    parts = rows.select("_x").mapInArrow(run, "width int, dim int, n long, total decimal(38,0)")
    by_dim = parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    best = by_dim.where("dim = 0").orderBy(F.col("n").desc(), F.col("width").desc()).limit(1).collect()
    if not best:
        return 0, []
    found = by_dim.where(F.col("width") == best[0]["width"]).orderBy("dim").collect()  # one row per dimension
    return best[0]["n"], [int(r["total"]) for r in found]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean goes in integers, its fraction in doubles."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - part


def _factor(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular QR factor of all centred rows."""
    width = len(sums)

    def blocks(batches):
        r = np.zeros((0, width))
        for rb in batches:
            r = np.linalg.qr(np.vstack([r, _centred(_matrix(rb.column(0), width), n, sums)]), mode="r")
        if len(r):
            yield _factor_row(r)

    def stacked(batches):
        r = np.zeros((0, width))
        for rb in batches:
            for flat in rb.column(0).to_pylist():
                r = np.linalg.qr(np.vstack([r, np.frombuffer(flat).reshape(-1, width)]), mode="r")
        if len(r):
            yield _factor_row(r)

    parts = rows.select("_x").mapInArrow(blocks, "r binary")
    left = parts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(stacked, "r binary")
    out = np.zeros((width, width))
    for row in parts.collect():  # one factor
        r = np.frombuffer(bytes(row["r"])).reshape(-1, width)
        out[: len(r)] = r
    return out


def _factor_row(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])


def _identity_error(rows: DataFrame, n: int, whiten: Callable[[np.ndarray], np.ndarray], width: int, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity.

    Each task centres by its own mean; the sums of two parts join by the difference of
    their means, so nothing is multiplied before it is centred.
    """

    def moments(batches):
        for rb in batches:
            z = whiten(_matrix(rb.column(0), width))
            mean = z.mean(axis=0)
            yield _moment_row(len(z), mean, (z - mean).T @ (z - mean))

    def joined(batches):
        count, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for rb in batches:
            for m, flat in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                other = np.frombuffer(flat).reshape(k + 1, k)
                gap = other[0] - mean
                square = square + other[1:] + np.outer(gap, gap) * (count * m / (count + m))
                mean, count = mean + gap * (m / (count + m)), count + m
        if count:
            yield _moment_row(count, mean, square)

    fields = "m long, s binary"
    parts = rows.select("_x").mapInArrow(moments, fields).mapInArrow(joined, fields)
    left = parts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(joined, fields)
    flat = bytes(parts.collect()[0]["s"])
    return float(np.abs(np.frombuffer(flat).reshape(k + 1, k)[1:] / n - np.eye(k)).max())


def _moment_row(m: int, mean: np.ndarray, square: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([np.vstack([mean, square]).tobytes()], pa.binary())], names=["m", "s"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> Iterator[int | None]:
    """Exact sums over the dimensions of (n x - S) squared; None where it doesn't fit a long."""
    top = max(int(np.abs(x).max(initial=0)) * n, max(abs(s) for s in sums))
    gap = x * n - np.array(sums, dtype=np.int64) if top < 1 << 62 else x.astype(object) * n - np.array(sums, dtype=object)
    if x.shape[1] * int(abs(gap).max(initial=0)) ** 2 < 1 << 63:
        gap = gap.astype(np.int64)
        return iter((gap * gap).sum(axis=1).tolist())
    exact = (sum(int(v) ** 2 for v in row) for row in gap)
    return (d if d < 1 << 63 else None for d in exact)


FIELDS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {FIELDS}"
    rows = _valid(df, id_col, vector)
    n, sums = _sums(rows)
    width = len(sums)
    rows = rows.where(F.size("_x") == width)
    sigma, vectors = directions(_factor(rows, n, sums)) if n else (np.zeros(0), np.zeros((0, 0)))
    e = sigma**2
    k = min(components, int((e > FLAT * e[:1].max(initial=0)).sum()))
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    explained = (e / e.sum())[:k]
    turn = vectors[:, :k] * (np.sqrt(n) / sigma[:k])

    def whiten(x: np.ndarray) -> np.ndarray:
        return _centred(x, n, sums) @ turn

    error = _identity_error(rows, n, whiten, width, k)

    def run(batches):
        for rb in batches:
            x = _matrix(rb.column(1), width)
            m = len(x)
            ids = rb.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(list(_deviations(x, n, sums)), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(whiten(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[id_col, *[f.split()[0] for f in FIELDS.split(", ")]],
            )

    return rows.mapInArrow(run, schema)

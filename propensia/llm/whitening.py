"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

The covariance of all vectors is gathered in two passes (sums, then centred products added up inside the tasks) and is a
matrix of the vectors' dimension. Its eigenvectors come from spectral divide and conquer: the polar factor U of A - s I
(``polar``, the dynamically weighted Halley iteration on QR factors) gives the projector (U + I) / 2 on the invariant
subspace above the shift s; bases of it and of its complement split A into two smaller blocks, and so on down to
blocks that are diagonal to double precision (``eigen``). The components are broadcast and every vector is projected
where it lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIMENSIONS = 8192
"""Longest vector: its covariance is held by every task and by the driver (512 MB at this bound)."""

BATCH_NUMBERS = 1 << 21
"""Entries of vectors that a task works on at a time."""

_SMALL = np.int64(1) << 40


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: QDWH, each step one QR of the matrix stacked on the identity."""
    n = len(a)
    x = a / max(np.linalg.norm(a), 1e-300)
    try:  # singular values lie between 1 / |x^-1| and |x| = 1 in the Frobenius norm
        low = max(1 / float(np.linalg.norm(np.linalg.inv(x))), 1e-16)
    except np.linalg.LinAlgError:
        low = 1e-16
    eye = np.eye(n)
    for _ in range(40):
        d = (4 * (1 - low * low) / low**4) ** (1 / 3) if low < 1 else 0.0
        s = np.sqrt(1 + d)
        alpha = s + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * s), 0.0))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(gamma) * x, eye]))
        new = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(low * (alpha + beta * low * low) / (1 + gamma * low * low), 1.0)
        if moved < 1e-15 * n or abs(1 - low) < 1e-15 and moved < 1e-8:
            break
    return x


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """Orthogonal Q whose first k columns span the invariant subspace above the shift; None where it does not split."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(float(np.trace(projector))))
    if not 0 < k < n:
        return None
    scale = np.linalg.norm(a)
    basis = rng.standard_normal((n, n))
    for _ in range(3):  # subspace iterations with the projector; one is mostly enough
        top, _ = np.linalg.qr(projector @ basis[:, :k])
        rest = basis[:, k:] - projector @ basis[:, k:]
        rest -= top @ (top.T @ rest)
        q, _ = np.linalg.qr(np.concatenate([top, rest], 1))
        if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) <= 1e-14 * n * scale:
            return q, k
        basis = q
    return None


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    The shift of a block is the middle of its diagonal; where an eigenvalue lies too close to it, other shifts between the
    diagonal's ends follow. A block that no shift splits has equal eigenvalues to rounding error, and any basis serves.
    """
    n = len(matrix)
    values, vectors = np.zeros(n), np.eye(n)
    scale = float(np.linalg.norm(matrix)) or 1.0
    rng = np.random.default_rng(7)
    work = [(np.asarray(matrix, float), np.eye(n), 0)]
    while work:
        a, basis, at = work.pop()
        m = len(a)
        a = (a + a.T) / 2
        diagonal = np.diag(a)
        off = a - np.diag(diagonal)
        if m == 1 or np.linalg.norm(off) <= 1e-17 * scale:
            values[at : at + m], vectors[:, at : at + m] = diagonal, basis
            continue
        radius = np.linalg.norm(off, axis=1)
        lowest, highest = float((diagonal - radius).min()), float((diagonal + radius).max())
        shifts = [float(np.median(diagonal)), float(diagonal.mean())]
        shifts += [lowest + (highest - lowest) * f for f in (0.5, 0.382, 0.618, 0.25, 0.75, 0.1, 0.9, 0.03, 0.97)]
        for shift in shifts:
            found = _split(a, shift, rng)
            if found is not None:
                q, k = found
                b = q.T @ a @ q
                work.append((b[:k, :k], basis @ q[:, :k], at))
                work.append((b[k:, k:], basis @ q[:, k:], at + k))
                break
        else:
            values[at : at + m], vectors[:, at : at + m] = diagonal, basis
    vectors, _ = np.linalg.qr(vectors)  # products of many bases: orthogonal again to the last digit
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _matrix(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """x = floor(64 c) + 1,000,000 as int64, a row per vector; the dimensions that a short vector lacks count as c = 0."""
    offsets = np.asarray(vectors.offsets, np.int64)
    flat = np.asarray(vectors.values.cast(pa.float64()).fill_null(np.nan))[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if (sizes == dimensions).all():
        c = flat.reshape(len(sizes), dimensions)
    else:
        c = np.zeros((len(sizes), dimensions))
        c[np.arange(dimensions) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(64.0 * c), -(2.0**61), 2.0**61).astype(np.int64) + 1_000_000


def _rows(batches, dimensions: int):
    """(batch slice, x) of a bounded number of entries at a time."""
    step = max(1, BATCH_NUMBERS // max(dimensions, 1))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, _matrix(part.column(part.num_columns - 1), dimensions)


def _exact_sums(dimensions: int):
    """(i, s): the task's sums per dimension, exact, and its number of rows as i = -1."""

    def run(batches):
        total, n = [0] * dimensions, 0
        for _, x in _rows(batches, dimensions):
            small = bool((np.abs(x) < _SMALL).all())  # a slice has at most 2**21 rows, so its sums fit
            total = [a + int(b) for a, b in zip(total, x.sum(0) if small else x.astype(object).sum(0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dimensions)], pa.int32()), pa.array([str(v) for v in (n, *total)], pa.string())], ["i", "s"])

    return run


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in double precision, from the exact difference n x - S wherever that fits in 64 bits."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / n
    return np.array([[(n * int(v) - s) / n for v, s in zip(row, sums, strict=True)] for row in x], float).reshape(x.shape)


def _products(n: int, sums: list[int], components: np.ndarray | None):
    """(i, row): rows of the task's sum of outer products of the centred (and, with components, whitened) vectors."""
    dimensions = len(sums)

    def run(batches):
        width = dimensions if components is None else components.shape[1]
        total, first = np.zeros((width, width)), np.zeros(width)
        for _, x in _rows(batches, dimensions):
            y = _centred(x, n, sums)
            if components is not None:
                y = y @ components
            total += y.T @ y
            first += y.sum(0)
        rows = [first, *total]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["i", "row"])

    return run


def _gather(vectors: DataFrame, n: int, sums: list[int], components: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred or whitened vectors; tasks send one matrix each, added up entry by entry."""
    width = len(sums) if components is None else components.shape[1]
    parts = vectors.select("c").mapInArrow(_products(n, sums, components), "i int, row array<double>")
    entries = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((width + 1, width))
    for i, row in entries.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row")).collect():  # dimension + 1 rows
        total[i + 1] = [v for _, v in row]
    mean = total[0] / n
    return total[1:] / n - np.outer(mean, mean)


def _whiten(n: int, sums: list[int], components: np.ndarray, explained: list[float | None], error: float | None):
    """A row per vector and component."""
    dimensions, width = len(sums), components.shape[1]

    def run(batches):
        for part, x in _rows(batches, dimensions):
            top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
            if top * top * dimensions < 1 << 62:
                d = n * x - np.array(sums, np.int64)
                deviation = (d * d).sum(1).tolist()
            elif top < 1 << 62:
                d = n * x - np.array(sums, np.int64)
                big = float(np.abs(d).max(initial=0)) ** 2 * dimensions >= 2.0**62
                deviation = [sum(v * v for v in row) for row in d.tolist()] if big else (d * d).sum(1).tolist()
            else:
                deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
            deviation = [v if v < 1 << 63 else None for v in deviation]
            w = _centred(x, n, sums) @ components
            count = len(x)
            repeat = np.repeat(np.arange(count), width)
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)), pa.array(np.full(count * width, n, np.int64)),
                 pa.array(deviation, pa.int64()).take(pa.array(repeat)), pa.array(flat, mask=np.isnan(flat)), pa.array(explained * count, pa.float64()), pa.array([error] * (count * width), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable vector and leading component.

    Vectors that are null or hold a null, NaN or infinite entry are left out, everywhere. An entry c counts as
    x = floor(64 c) + 1,000,000 (|64 c| beyond 2**61 counts as 2**61). Components are the unit eigenvectors of the
    covariance of all remaining vectors, by falling eigenvalue. ``deviation`` is the exact squared distance n x - S, null
    where it exceeds a long. ``identity_error`` is measured on the whitened vectors in a pass of its own.

    Vectors of different lengths: a shorter one counts as c = 0 in the dimensions it lacks. A component without variance
    (eigenvalue below rounding error of the largest) has a null ``whitened`` and stays out of ``identity_error``; without any
    variance ``explained`` and ``identity_error`` are null too. Repeated rows and null or equal ids are rows of their
    own and count in the fit. No vector, or only empty ones, gives no rows. Other columns are not read.
    """
    c = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    vectors = table.select(F.col(f"`{key}`").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dimensions = vectors.agg(F.max(F.size("c"))).first()[0]
    if not dimensions:
        return table.sparkSession.createDataFrame([], schema)
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} dimensions: at most {MAX_DIMENSIONS} fit a covariance held in memory")
    sums_of = vectors.select("c").mapInArrow(_exact_sums(dimensions), "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by_dimension = {i: int(s) for i, s in sums_of.collect()}  # dimension + 1 rows
    n, sums = by_dimension[-1], [by_dimension[i] for i in range(dimensions)]

    covariance = _gather(vectors, n, sums)
    values, basis = eigen(covariance)
    trace = float(np.trace(covariance))
    count = min(components, dimensions)
    alive = values[:count] > max(float(values[0]), 0.0) * dimensions * 1e-15
    scaled = np.where(alive, basis[:, :count] / np.sqrt(np.where(alive, values[:count], 1.0)), np.nan)
    explained = [float(v) / trace if trace > 0 else None for v in values[:count]]
    error = float(np.abs(_gather(vectors, n, sums, scaled[:, alive]) - np.eye(int(alive.sum()))).max()) if alive.any() else None
    return vectors.mapInArrow(_whiten(n, sums, scaled, explained, error), schema)

"""Embedding whitening by QDWH spectral divide and conquer.

Vectors become integers, so their sums and cross products are exact, whatever
order tasks finish in. The covariance, a matrix of the vectors' width, is split
on the driver: the polar factor of the matrix less a shift, found by
dynamically weighted Halley steps with QR, gives the projectors of the
eigenvalues above and below the shift; each half is projected on its subspace
and split again until single components are left (Nakatsukasa and Higham,
2013). The whitening matrix is broadcast and applied to all rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitgrain.llm._common import columns

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
OUT = "vec_id long, component int, n long, deviation long, whitened double"
#: Integers below it are exact as doubles, sums of products too.
EXACT = 1 << 53


def polar_factor(a: np.ndarray) -> np.ndarray:
    """U of a symmetric A = U H, H positive semidefinite: Halley's iteration
    with dynamic weights, each step by a QR factorisation of [sqrt(c) X; I]."""
    n = len(a)
    norm = np.linalg.norm(a)
    x = a / norm
    low = max(np.linalg.norm(x, -2) * 0.9, np.finfo(float).eps)  # a lower bound of the smallest singular value
    for _ in range(60):
        # the weights of the best rational step for singular values in [low, 1]
        d = (4 * (1 - low**2) / low**4) ** (1 / 3) if low < 1 else 0.0
        wa = math.sqrt(1 + d) + math.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d)), 0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(n)]))
        step = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        step = (step + step.T) / 2
        moved = np.linalg.norm(step - x)
        x = step
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if moved <= 1e-14 * math.sqrt(n) or (low > 1 - 1e-15 and moved <= 1e-10):
            break
    return x


def split_basis(u: np.ndarray) -> tuple[np.ndarray, int]:
    """(basis, k): the first k columns span the range of the projector
    (U + I) / 2, the others its complement."""
    n = len(u)
    projector = (u + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    order = np.argsort(-np.diag(projector), kind="stable")
    start = projector[:, order[:k]] if k else projector[:, :0]
    basis, _ = np.linalg.qr(np.hstack([start, np.eye(n)[:, order]]))
    for _ in range(2):  # a step of subspace iteration mends the first choice
        first, _ = np.linalg.qr(projector @ basis[:, :k])
        basis, _ = np.linalg.qr(np.hstack([first, np.eye(n) - first @ first.T]))
        basis = basis[:, :n]
    return basis, k


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns."""
    a = (a + a.T) / 2
    size = max(np.linalg.norm(a), np.finfo(float).tiny)
    values, vectors = _divide(a, size * np.finfo(float).eps)
    # one refinement over all: a rotation to first order, then orthonormal again
    r = vectors.T @ a @ vectors
    gaps = np.subtract.outer(np.diag(r), np.diag(r)).T
    turn = np.where(np.abs(gaps) > size * 1e-12, r / np.where(gaps == 0, 1, gaps), 0.0)
    np.fill_diagonal(turn, 0.0)
    if np.abs(turn).max(initial=0.0) < 1e-6:
        vectors, _ = np.linalg.qr(vectors + vectors @ turn)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _divide(a: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    if n == 1:
        return a[0].copy(), np.eye(1)
    off = np.linalg.norm(a - np.diag(np.diag(a)))
    if off <= tiny:  # one cluster, or split already
        return np.diag(a).copy(), np.eye(n)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.eye(n) * diagonal.mean())
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread * s for s in (0.3, -0.3, 0.7, -0.7, 0.1, -0.1, 0.05, -0.05))):
        basis, k = split_basis(polar_factor(a - shift * np.eye(n) + np.eye(n) * (tiny if np.any(diagonal == shift) else 0.0)))
        if 0 < k < n:
            turned = basis.T @ a @ basis
            if np.linalg.norm(turned[k:, :k]) <= 100 * n * max(tiny, np.finfo(float).eps * spread):
                break
    else:
        raise ArithmeticError("no shift splits the matrix")
    parts = [_divide((m + m.T) / 2, tiny) for m in (turned[:k, :k], turned[k:, k:])]
    return np.concatenate([p[0] for p in parts]), np.hstack([basis[:, :k] @ parts[0][1], basis[:, k:] @ parts[1][1]])


def good_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that can be used, v as doubles."""
    v = F.transform(F.col("v"), lambda c: c.cast("double"))
    usable = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return columns(table, key, vector).toDF("vec_id", "v").filter(usable & (F.size("v") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def width_of(rows: DataFrame) -> int:
    """The number of places that most vectors have; of equal ones the larger."""
    found = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()  # one row
    return found["width"] if found else 0


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The integers x - SHIFT of a batch, as exact doubles."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * flat.reshape(-1, width))
    if len(x) and np.abs(x).max() >= EXACT >> 4:
        raise OverflowError("an entry is too large for whole numbers of 64 bits")
    return x


def sums(rows: DataFrame, value, fields: int) -> list[list[int]]:
    """Sums over all rows of `fields` whole numbers that value(batch) gives. A
    task adds up its own and sends one row a number; the sums, as many as
    `fields`, come to the driver."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = value(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(fields), pa.int32()), pa.array([str(t) for t in total.tolist()])], ["place", "amount"])

    found = rows.mapInArrow(run, "place int, amount string").groupBy("place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()
    out = [0] * fields
    for r in found:
        out[r["place"]] = int(r["amount"])
    return out


def exact_products(y: np.ndarray) -> np.ndarray:
    """The upper triangle of y^T y for whole numbers, exact: blocks of rows so
    short that no sum leaves the whole numbers that doubles hold."""
    most = max(np.abs(y).max(), 1.0)
    upper = np.triu_indices(y.shape[1])
    if most * most >= EXACT:
        whole = y.astype(np.int64).astype(object)
        return (whole.T @ whole)[upper]
    block = max(1, int(EXACT / (most * most)))
    total = np.zeros(len(upper[0]), object)
    for i in range(0, len(y), block):
        total = total + (y[i : i + block].T @ y[i : i + block])[upper].astype(np.int64).astype(object)
    return total


def covariance(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, V): rows, sums of the x in each dimension, and their covariance
    with divisor n. Products are of x less the whole number nearest to its
    mean; what is left of the mean, at most a half, is taken off exactly."""
    found = sums(rows, lambda b: np.append(_matrix(b, width).astype(np.int64).sum(axis=0).astype(object), b.num_rows), width + 1)
    n, first = found[-1], found[:-1]
    if not n:
        return 0, [], np.zeros((width, width))
    near = np.array([round(Fraction(s, n)) for s in first], np.float64)
    products = sums(rows, lambda b: exact_products(_matrix(b, width) - near), width * (width + 1) // 2)
    left = [s - int(m) * n for s, m in zip(first, near)]
    v = np.zeros((width, width))
    for i, j, p in zip(*np.triu_indices(width), products):
        v[i, j] = v[j, i] = float(Fraction(p * n - left[i] * left[j], n * n))
    return n, [s + SHIFT * n for s in first], v


def _projector(model):
    def run(batches):
        n, total, mean, axes, roots, width = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part, width)
                d = None
                if n * int(np.abs(x).max(initial=1)) < 1 << 61:
                    d = n * x.astype(np.int64) - total
                if d is not None and int(np.abs(d).max(initial=0)) ** 2 * width < 1 << 63:
                    deviation = (d * d).sum(axis=1)
                else:  # beyond 64 bits on the way
                    whole = n * x.astype(np.int64).astype(object) - total.astype(object)
                    deviation = (whole * whole).sum(axis=1)
                    if max(deviation) >= 1 << 63:
                        raise OverflowError("a deviation is too large for a long")
                white = (x - mean) @ axes / roots
                k = len(roots)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(part.num_rows * k, n, np.int64)),
                                                  pa.array(np.repeat(deviation.astype(np.int64), k)), pa.array(white.ravel())], [c.split()[0] for c in OUT.split(", ")])
    return run


def identity_error(rows: DataFrame, run, k: int, n: int) -> float:
    """The largest absolute entry of the whitened values' covariance, less the
    identity, over all rows: sums of each task, merged on the driver's side of
    an aggregation by place."""
    def value(batches):
        mean, products, count = np.zeros(k), np.zeros((k, k)), 0
        for batch in run(batches):
            w = batch.column(4).to_numpy().reshape(-1, k)
            m, c = w.mean(axis=0), len(w)
            apart = m - mean
            products += (w - m).T @ (w - m) + np.outer(apart, apart) * (count * c / (count + c))  # centred, then merged
            mean, count = mean + apart * (c / (count + c)), count + c
        if count:
            shifted = products + count * np.outer(mean, mean)
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([shifted.ravel(), mean * count]))], ["place", "amount"])

    found = {r["place"]: r["amount"] for r in rows.mapInArrow(value, "place int, amount double").groupBy("place").agg(F.sum("amount").alias("amount")).collect()}
    flat = np.array([found[i] for i in range(k * k + k)])
    mean = flat[k * k :] / n
    return float(np.abs(flat[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null, empty or holds a null or non-finite entry are
    dropped, and so are vectors of another width than most have (of equally
    many, the wider). Every other row counts, repeated ids and equal rows too;
    a null id stays null. x = floor(64 * entry) + 1000000; the covariance of
    all x, divisor n, has the components, by falling eigenvalue, equal ones in
    any order. Components without variance (below the width times the double's
    precision times the largest) cannot be whitened and are not returned, so a
    table of one row or of equal rows gives an empty table, as an empty one
    does. Other columns are not read.

    Four passes: widths, sums, products, and whitened products; then the rows.
    The sums that come to the driver are as many as the width squared.
    """
    spark = table.sparkSession
    rows = good_vectors(table, key, vector)
    width = width_of(rows)
    empty = spark.createDataFrame([], OUT + ", explained double, identity_error double")
    if not width:
        return empty
    rows = rows.filter(F.size("v") == width)
    n, total, v = covariance(rows, width)
    values, axes = eigen(v)
    keep = min(components, int((values > width * np.finfo(float).eps * max(values[0], 0)).sum()))
    if not keep:
        return empty
    shifted = np.array([s - SHIFT * n for s in total])
    mean = np.array([float(Fraction(int(s), n)) for s in shifted])
    model = spark.sparkContext.broadcast((n, shifted, mean, axes[:, :keep], np.sqrt(values[:keep]), width))
    run = _projector(model)
    error = identity_error(rows, run, keep, n)
    return rows.mapInArrow(run, OUT).withColumns({"explained": _by_component(values[:keep] / np.trace(v)), "identity_error": F.lit(error)})


def _by_component(values: np.ndarray) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("component"))

"""Correlations of many columns from masked cross products.

A task adds up, over its Arrow batches, four products of the block of values X
(nulls as 0) and of the block M of which are there: M'M, X'M, (X*X)'M and X'X.
From them come each pair's count, means, variances and covariance over the rows
that have both. Tasks' sums are added row of the matrix by row of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose means values are taken from before they are multiplied.
SHIFT_ROWS = 10_000
SUMS = "i int, n array<double>, s array<double>, q array<double>, c array<double>"


def _pack(total: list[np.ndarray], places: np.ndarray | None = None) -> pa.RecordBatch:
    places = np.arange(len(total[0])) if places is None else places
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), *[pa.array(list(t), pa.list_(pa.float64())) for t in total]], ["i", "n", "s", "q", "c"])


def _products(shift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(shift)
        total = [np.zeros((d, d)) for _ in range(4)]
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            m = (~np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns])).astype(float)
            x = np.where(m > 0, x, 0.0)
            for t, (a, b) in zip(total, ((m, m), (x, m), (x * x, m), (x, x))):
                t += a.T @ b
        yield _pack(total)
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of one place; a task holds those places that it got."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            part = [np.array(r[k]) for k in ("n", "s", "q", "c")]
            total[r["i"]] = part if r["i"] not in total else [a + b for a, b in zip(total[r["i"]], part)]
    if total:
        yield _pack([np.array(t) for t in zip(*total.values())], np.array(list(total)))


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns: Pearson's r over the rows that have
    both values, null where one of them is constant there. Values are shifted
    by their mean over the first SHIFT_ROWS rows, which changes no result but
    keeps products small. A task sends a row a column, as wide as the columns
    are many."""
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    means = values.limit(SHIFT_ROWS).agg(*[F.avg(c).alias(c) for c in values.columns]).first()  # one row
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    sums = values.mapInArrow(_products(shift), SUMS).repartition("i").mapInArrow(_added, SUMS)
    mine = sums.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "c")).alias("j", "x")).select("i", "j", "x.*")
    # s and q of j where i is there stand in j's row
    other = mine.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    n = F.col("n")
    pair = mine.filter("i < j").join(other, ["i", "j"])
    cov, va, vb = n * F.col("c") - F.col("s") * F.col("s2"), n * F.col("q") - F.col("s") * F.col("s"), n * F.col("q2") - F.col("s2") * F.col("s2")
    tiny = lambda v, q: v <= 1e-12 * n * q  # noqa: E731  what rounding leaves of a constant
    r = F.when(~(tiny(va, F.col("q")) | tiny(vb, F.col("q2"))), cov / F.sqrt(va * vb))
    label = F.array(*[F.lit(c) for c in names])
    return pair.select(F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"), r.alias("r"))

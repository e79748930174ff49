"""Rows as cells: trees read a row only through the bins of its values, so rows
of the same bins, label and weight are one row with a number (M2, M3, M5-M9)."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Cells of one task, about.
TASK_CELLS = 1 << 15
#: Rows of one step in which blocks are mixed, about.
TASK_ROWS = 1 << 19
#: Draws of a cell that are kept at once.
DRAWS = 10


def numbers(values: Sequence[Column]) -> list[Column]:
    """Columns x0, x1 and so on; nulls are no numbers."""
    return [F.coalesce(v.cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, v in enumerate(values)]


def columns(df: DataFrame, values: Sequence[Column], label: str, weight: str | None, held: Column | None = None) -> DataFrame:
    """(x0, x1 and so on, label, weight, held): what models read of the rows,
    without vectors; without weights each is 1. Rows that are held are not
    fitted."""
    return df.select(*numbers(values), F.col(label).cast("double").alias("label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), (F.lit(False) if held is None else held).alias("held"))


def cut_points(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """For each of the columns x of rows the values after which a bin ends:
    all midpoints where there are at most `bins` values, otherwise values at
    equal shares of the rows. Values that are no numbers are above all others."""
    place = lambda i: F.col(f"x{i}")
    shares = [(i + 1) / bins for i in range(bins - 1)]
    first = [f for i in range(width) for f in (F.approx_count_distinct(place(i)).alias(f"n{i}"), F.percentile_approx(place(i), shares, 10_000).alias(f"q{i}"))]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label").isin(0, 1) | F.col("label").isNull()).alias("odd"), *first).first()  # one row
    if seen["odd"]:
        raise ValueError("label has other values than 0 and 1")
    if not seen["n"]:
        raise ValueError("no rows to fit")
    few = [i for i in range(width) if seen[f"n{i}"] <= 2 * bins]
    values = rows.agg(*[F.collect_set(place(i)).alias(f"v{i}") for i in few]).first() if few else None  # one row
    most = sys.float_info.max
    out = []
    for i in range(width):
        mine = sorted(v for v in values[f"v{i}"] if v == v) if i in few else None
        if mine is not None and len(mine) <= bins:
            cuts = [min(max((a + b) / 2, -most), most) for a, b in zip(mine, mine[1:])]
            cuts += mine[-1:] if len(mine) < len(values[f"v{i}"]) else []
        else:
            cuts = [v for v in seen[f"q{i}"] or [] if v == v]
        out.append(sorted({min(max(float(v), -most), most) for v in cuts}))
    return out


def _codes(cuts: list[list[float]], rest: Sequence[str]):
    """Batches of (x0, x1 and so on, rest) as (code, rest): two bytes for the
    bin of each value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, width, bins = batch.num_rows, len(cuts), _bins(batch, cuts)
            ends = np.arange(0, (n + 1) * 2 * width, 2 * width, dtype="<i4") if width else np.zeros(n + 1, "<i4")
            code = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([code, *[batch.column(c) for c in rest]], ["code", *rest])
    return run


def coded(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """(code, rest) of rows (x0, x1 and so on, rest)."""
    rest = [f for f in rows.schema.fields if not (f.name[:1] == "x" and f.name[1:].isdigit())]
    x = [f"x{i}" for i in range(len(cuts))]
    return rows.select(*x, *[f.name for f in rest]).mapInArrow(_codes(cuts, [f.name for f in rest]), ", ".join(["code binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rest]]))


@F.pandas_udf(ArrayType(DoubleType()))
def _places(code: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(c, "<u2").astype("f8") for c in code])


def values(code: Column, cuts: list[list[float]]) -> Column:
    """A value of each bin: that at which it ends, above the last one infinity.
    It is on the same side of all cuts as the bin's other values."""
    ends = [np.array([*c, np.inf]) for c in cuts]

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(code: pd.Series) -> pd.Series:
        return pd.Series([np.array([e[b] for e, b in zip(ends, np.frombuffer(c, "<u2"))]) for c in code])

    return array_to_vector(run(code))


def grouped(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """(held, code, label, weight, rows, features): a row a cell, in the same
    order in the same partitions however rows lie, and persisted; features are
    the numbers of the bins."""
    key = ["held", "code", "label", "weight"]
    found = coded(rows, cuts).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).persist()
    try:
        made = found.repartition(found.count() // TASK_CELLS + 1, *key).sortWithinPartitions(*key).select(*key, "rows", array_to_vector(_places("code")).alias("features")).persist()
        made.count()
    finally:
        found.unpersist()
    return made


class Cells:
    """Cells of the rows that are fitted, and of those that are held, both by
    the cuts of the former. Columns are kept while cuts are found."""

    def __init__(self, rows: DataFrame, bins: int):
        self.width = len(rows.columns) - 3
        kept = rows.persist()
        try:
            self.cuts = cut_points(kept.filter("not held"), self.width, bins)
            self.every = grouped(kept, self.cuts)
        finally:
            kept.unpersist()
        self.fitted, self.held = (self.every.filter(c).drop("held") for c in ("not held", "held"))

    def close(self) -> None:
        self.every.unpersist()


def _bins(batch: pa.Table | pa.RecordBatch, cuts: list[list[float]]) -> np.ndarray:
    out = np.empty((batch.num_rows, len(cuts)), "<u2")
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, np.asarray(batch.column(f"x{i}")), side="left")
    return out


def mix(cuts: list[list[float]], repeats: int):
    """Batches of (block, k0, k1 and so on, x0, x1 and so on, label) in order of
    blocks as (label, feature, code, rows): rows meet those at their place in
    another order of their block. The two halves of k are a row's two orders."""
    width = len(cuts)
    sizes = [len(c) + 1 for c in cuts]

    def out(label: np.ndarray, feature: int, bins: np.ndarray) -> pa.RecordBatch:
        """Counted, if the bins of a row make one whole number."""
        labels, y = np.unique(label, return_inverse=True)
        dims = (len(labels), *sizes)
        if math.prod(dims) < 1 << 62:
            cell, rows = np.unique(np.ravel_multi_index((y, *bins.T.astype("i8")), dims), return_counts=True)
            y, *back = np.unravel_index(cell, dims)
            bins = np.stack(back, axis=1).astype("<u2") if width else bins[:len(cell)]
        else:
            rows = np.ones(len(y), "i8")
        n = len(y)
        ends = np.arange(n + 1, dtype="<i4") * (2 * width)
        code = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(bins).tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(labels[y], from_pandas=True), pa.array(np.full(n, feature, "i4")), code, pa.array(rows.astype("i8"))], ["label", "feature", "code", "rows"])

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bins, label = _bins(table, cuts), table.column("label").to_numpy()
        block = np.cumsum(np.diff(table.column("block").to_numpy(), prepend=-1) != 0).astype("u8") << np.uint64(32)
        first: list[np.ndarray] = []
        second: list[np.ndarray] = []
        for r in range(repeats):
            k = table.column(f"k{r}").to_numpy().view("u8")
            for orders, half in ((first, k >> np.uint64(32)), (second, k & np.uint64(0xFFFFFFFF))):
                place = block | half
                order = np.argsort(place, kind="stable")
                if (np.diff(place[order]) == 0).any():  # rows of one key, by their values
                    order = np.lexsort((label, *bins.T[::-1], place))
                orders.append(order)
        yield out(label, -1, bins)
        for i in range(width):
            mixed = [bins[a] for a in first]
            for m, b in zip(mixed, second):
                m[:, i] = bins[b, i]
            yield out(np.concatenate([label[a] for a in first]), i, np.concatenate(mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TASK_ROWS:
                table = pa.Table.from_batches(held)
                block = table.column("block").to_numpy()
                done = int(np.searchsorted(block, block[-1], side="left"))  # the last block may go on
                if done:
                    yield from whole(table.slice(0, done))
                held, n = table.slice(done).to_batches(), len(block) - done
        if n:
            yield from whole(pa.Table.from_batches(held))

    return run


def thresholds(nodes: DataFrame, width: int) -> list[list[float]]:
    """For each feature the values at which the trees of a saved node table cut."""
    split = F.col("nodeData.split")
    found = nodes.filter(split["featureIndex"] >= 0).select(split["featureIndex"].alias("i"), split["leftCategoriesOrThreshold"][0].alias("at")).distinct().collect()  # a row a bin at most
    return [sorted({r["at"] for r in found if r["i"] == i}) for i in range(width)]


def draws(seed: int, rate: float, repeats: bool) -> Column:
    """How often DRAWS samples have rows of a cell: with repeats a row's number
    is Poisson's, so that of a cell is Poisson's for the sum; without, each row
    is taken or not, so the cell's is binomial. From the cell's key alone."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(key: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for k, n in zip(key.to_numpy().view("u8").tolist(), rows.tolist()):
            own = np.random.Generator(np.random.Philox(key=k))
            out.append((own.poisson(n * rate, DRAWS) if repeats else own.binomial(n, rate, DRAWS)).astype("f8"))
        return pd.Series(out)

    return run(F.xxhash64("code", "label", "weight", F.lit(seed)), "rows")


def with_values(node: Column, cuts: list[list[float]]) -> Column:
    """A saved node whose threshold lies between two numbers of bins, with the
    value at which the lower one ends."""
    table = F.from_json(F.lit(json.dumps(cuts)), "array<array<double>>")
    split = node["split"]
    at = F.get(F.get(table, split["featureIndex"]), F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0))).cast("int"))
    return node.withField("split", F.when(split["featureIndex"] >= 0, split.withField("leftCategoriesOrThreshold", F.array(at))).otherwise(split))

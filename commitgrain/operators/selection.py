"""Exact percentiles by distributed selection.

The first pass counts every column's values in fixed cells, sixteen to a power
of two; the next ones cut only those cells that hold a wanted rank into equal
parts between their smallest and largest value, until a cell holds one value or
few enough to be put in order. What a task keeps are cells, not values, however
many distinct ones there are, and cells shrink by a factor of PARTS a pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitgrain.sources import tables

PARTS = 4096
#: Values of one cell that are put in order in one group.
PICK = 10_000


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later passes start there."""
    at = tables.work_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def first_cell(v: Column) -> Column:
    """A number that never falls as v grows: sixteenths of powers of two, apart
    for each sign; nan is above all, as Spark orders it."""
    a = F.abs(v)
    power = F.floor(F.log2(a))
    place = F.floor(16 * (1100 + power + a / F.pow(F.lit(2.0), power.cast("double")) - 1))
    cell = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(1 << 17)).otherwise(place) * F.when(v < 0, -1).otherwise(1)
    return F.when(F.isnan(v), F.lit(1 << 18).cast("long")).otherwise(cell)


def _same(by: Sequence[str], other: DataFrame, df: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [df[c].eqNullSafe(other[c]) for c in by])


def _ranks(ps: Sequence[float], total: Column) -> Column:
    """The two ranks that each percentile lies between."""
    at = [p * (total - 1) for p in ps]
    return F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])


def _wanted(cells: DataFrame, ps: Sequence[float]) -> DataFrame:
    return cells.filter(F.exists(_ranks(ps, F.col("total")), lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("n"))))


def percentiles(df: DataFrame, names: Sequence[str], ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, q): each column's exact percentiles, of all rows or of
    each group's, interpolated between the two values next to each. Nulls do
    not count; a column without values has no row. Runs its passes at once; the
    cells that come with rows are at most two a percentile, column and group."""
    group = [f"_g{i}" for i in range(len(by))]
    key = [*group, "column"]
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])
    rows = df.select(*[F.col(b).alias(g) for b, g in zip(by, group)], F.explode(values).alias("x")).select(*group, "x.column", "x.v").filter("v is not null")
    stats = F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    cells = rows.groupBy(*key, first_cell(F.col("v")).alias("cell")).agg(*stats)
    whole, upto = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("cell")
    cells = cells.withColumns({"first": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(whole)})
    cells, known = kept(_wanted(cells, ps).select(*key, "total", "first", "n", "lo", "hi"), "cells"), []
    while True:
        known.append(cells.filter("lo = hi").select(*key, "total", "first", "n", F.array("lo").alias("vs")))
        cells = cells.filter("lo <> hi")
        most = cells.agg(F.max("n")).first()[0]  # one row
        if most is None:
            break
        at = cells.withColumnsRenamed({c: f"_{c}" for c in key})
        if not by:
            at = F.broadcast(at)  # two rows a percentile and column
        inside = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
        held = rows.join(at, inside & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        if most <= PICK:
            known.append(kept(held.groupBy(*key, "total", "first", "n").agg(F.array_sort(F.collect_list("v")).alias("vs")), "picked"))
            break
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))
        parts = held.groupBy(*key, "total", F.col("first").alias("begin"), part.alias("cell")).agg(*stats)
        upto = Window.partitionBy(*key, "begin").orderBy("cell")
        parts = parts.withColumn("first", F.col("begin") + F.sum("n").over(upto) - F.col("n"))
        cells = kept(_wanted(parts, ps).select(*key, "total", "first", "n", "lo", "hi"), "cells")
    found = reduce(DataFrame.unionByName, known).groupBy(*key, "total").agg(F.collect_list(F.struct("first", "n", "vs")).alias("s"))

    def value(rank: Column) -> Column:
        s = F.get(F.filter("s", lambda c: (rank >= c["first"]) & (rank < c["first"] + c["n"])), F.lit(0))
        return F.when(F.size(s["vs"]) == 1, F.get(s["vs"], F.lit(0))).otherwise(F.get(s["vs"], (rank - s["first"]).cast("int")))

    def between(p: float) -> Column:
        at = p * (F.col("total") - 1)
        below, above = F.floor(at), F.ceil(at)
        return F.when(below == above, value(below)).otherwise((above - at) * value(below) + (at - below) * value(above))

    return found.select(*[F.col(g).alias(b) for g, b in zip(group, by)], "column", F.array(*[between(p) for p in ps]).alias("q"))

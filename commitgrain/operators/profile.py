"""Audits and profiles of columns, each in one pass where it can be."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitgrain.operators import gram, selection

#: So many columns are gathered in one aggregation.
BATCH = 20
PERCENTS = [0.25, 0.5, 0.75]


def quantiles(df: DataFrame, names: Sequence[str], at: Sequence[float], by: Sequence[str] = (), approx: int | None = None) -> DataFrame:
    """(by..., column, q): exact by selection; with approx, an accuracy such as
    10000, by a sketch of fixed size."""
    if approx is None:
        return selection.percentiles(df, names, at, by)
    return _rows(df, names, {"q": lambda c: F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(x) for x in at]), approx)}, by)


def with_quantiles(stats: DataFrame, q: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """stats, a row a column and group, with q."""
    q = q.withColumnsRenamed({c: f"_{c}" for c in (*by, "column")})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "column")])
    return stats.join(q, same, "left").drop(*[f"_{c}" for c in (*by, "column")])


def _rows(df: DataFrame, names: Sequence[str], stats: dict[str, Column | str], by: Sequence[str] = ()) -> DataFrame:
    """One row a column (and group): stats are functions of the column's name,
    gathered in one aggregation and turned to rows."""
    parts = []
    for i in range(0, len(names), BATCH):
        some = names[i : i + BATCH]
        one = df.groupBy(*by).agg(*[F.struct(F.lit(c).alias("column"), *[f(c).alias(s) for s, f in stats.items()]).alias(f"_{k}") for k, c in enumerate(some)])
        parts.append(one.select(*by, F.explode(F.array(*[F.col(f"_{k}") for k in range(len(some))])).alias("r")).select(*by, "r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return _rows(df, names, {"nulls": lambda c: F.count_if(F.col(c).isNull())}).filter("nulls > 0")


def duplicate_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def value_shares(df: DataFrame, name: Column, by: Sequence[str] = ()) -> DataFrame:
    """(value, n, share) of a column, of all rows or of each group's."""
    n = df.groupBy(*by, name.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def range_scan(df: DataFrame, names: Sequence[str], approx: int | None = None) -> DataFrame:
    stats = _rows(df, names, {"min": lambda c: F.min(c).cast("double"), "mean": lambda c: F.avg(c), "max": lambda c: F.max(c).cast("double")})
    return with_quantiles(stats, quantiles(df, names, [0.5], approx=approx)).select("column", "min", F.get("q", F.lit(0)).alias("median"), "mean", "max")


def negative_shares(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return _rows(df, names, {"negatives": lambda c: F.count_if(F.col(c) < 0), "share": lambda c: F.try_divide(F.count_if(F.col(c) < 0), F.count(c))})


def outlier_scan(df: DataFrame, name: str, approx: int | None = None) -> DataFrame:
    stats = df.agg(F.lit(name).alias("column"), F.count_if(F.col(name) < 0).alias("negatives"), F.min(name).alias("min"), F.max(name).alias("max"))
    return with_quantiles(stats, quantiles(df, [name], [0.999], approx=approx)).select("negatives", F.get("q", F.lit(0)).alias("p999"), "min", "max")


def not_binary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values other than 0 and 1, nulls among them."""
    return _rows(df, names, {"invalid": lambda c: F.count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1))})


def array_sizes(df: DataFrame, name: str) -> DataFrame:
    """(size, n); null arrays have a null size."""
    return df.groupBy(F.when(F.col(name).isNotNull(), F.size(name)).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def time_audit(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count_if(F.col(name).isNull()).alias("nulls"), F.min(name).alias("first"), F.max(name).alias("last"))


def constant_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns with one distinct value that is not null. A column is constant
    where its smallest and largest values agree, so nothing is counted."""
    return _rows(df, names, {"one": lambda c: F.min(c) == F.max(c)}).filter("one").select("column")


def describe(df: DataFrame, values: dict[str, Column], by: Sequence[str] = (), approx: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of each named expression."""
    named = df.select(*by, *[v.cast("double").alias(k) for k, v in values.items()])
    out = _rows(named, list(values), {"count": lambda c: F.count(c), "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}, by)
    out = with_quantiles(out, quantiles(named, list(values), PERCENTS, by, approx), by)
    return out.select(*by, "column", "count", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(PERCENTS)], "max")


def empties(df: DataFrame, size: Column) -> DataFrame:
    return df.agg(F.count_if(size == 0).alias("empty"), F.try_divide(F.count_if(size == 0), F.count(F.lit(1))).alias("share"))


def not_positive(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.count_if(value <= 0).alias("not_positive"))


def shape(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Population skewness and excess kurtosis, mean and sample deviation."""
    named = df.select(*[v.cast("double").alias(k) for k, v in values.items()])
    return _rows(named, list(values), {"n": lambda c: F.count(c), "skew": lambda c: F.skewness(c), "kurtosis": lambda c: F.kurtosis(c), "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c)})


def sample_shape(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Skewness and kurtosis adjusted for the sample's size."""
    s, n = shape(df, values), F.col("n")
    skew = F.when(n > 2, F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("kurtosis") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return s.select("column", skew.alias("skew"), kurt.alias("kurtosis"))


def fences(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), width: float = 1.5, approx: int | None = None) -> DataFrame:
    """(column, lo, hi) beyond which a value is an outlier, and the quartiles."""
    q = with_quantiles(_rows(df, names, {"rows": lambda c: F.count(F.lit(1))}, by), quantiles(df, names, PERCENTS, by, approx), by)
    a, m, b = (F.get("q", F.lit(i)) for i in range(3))
    return q.select(*by, "column", a.alias("q1"), m.alias("median"), b.alias("q3"), (a - width * (b - a)).alias("lo"), (b + width * (b - a)).alias("hi"))


def long_form(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(by), list(names), "column", "value")


def outlier_report(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), width: float = 1.5, approx: int | None = None) -> DataFrame:
    """Outliers by quartile fences, of all rows or of each group's. The fences
    meet the rows as a row a column (and group); then one aggregation."""
    f = fences(df, names, by, width, approx).withColumnsRenamed({c: f"_{c}" for c in (*by, "column")})
    x = long_form(df, names, by)
    both = x.join(f if by else F.broadcast(f), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "column")]))  # a row a column
    beyond = F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return both.groupBy(*by, "column").agg(
        beyond.alias("outliers"), F.try_divide(beyond, F.count("value")).alias("share"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("median").alias("median"),
        F.first(F.col("q3") - F.col("q1")).alias("iqr"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def zero_shares(df: DataFrame, names: Sequence[str], approx: int | None = None) -> DataFrame:
    out = _rows(df, names, {"min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double"), "zero_share": lambda c: F.try_divide(F.count_if(F.col(c) == 0), F.count(c))})
    out = with_quantiles(out, quantiles(df, names, PERCENTS, approx=approx))
    return out.select("column", F.get("q", F.lit(1)).alias("median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"), "min", "max", "zero_share")


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows that have both; null where one is constant."""
    x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, by masked cross products of blocks of
    rows: one scan, however many columns there are (`gram.py`)."""
    return gram.correlations(df, names)


def target_correlations(df: DataFrame, names: Sequence[str], target: str, least: float = 0.0, top: int = 20) -> DataFrame:
    """The `top` columns by absolute correlation with the target, from `least` on."""
    one = df.agg(*[correlation(c, target).alias(c) for c in names]).unpivot([], list(names), "column", "r")
    return one.filter(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "column").limit(top)


def histogram(df: DataFrame, names: Sequence[str], bins: int = 50) -> DataFrame:
    """(column, bin, n): equal bins from each column's smallest to largest value."""
    edges = _rows(df, names, {"lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")})
    x = long_form(df, names).filter("value is not null").join(F.broadcast(edges), "column")  # a row a column
    return x.groupBy("column", bin_of("value", "lo", "hi", bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bin_of(value: str, lo: str, hi: str, bins: int) -> Column:
    place = F.floor(F.try_divide(F.col(value) - F.col(lo), F.col(hi) - F.col(lo)) * bins)
    return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("long")


def auto_bins(df: DataFrame, name: str, approx: int | None = None) -> int:
    """Bins of equal width for a column: the finer of Sturges' rule, log2(n) + 1
    bins, and Freedman and Diaconis', a width of 2 * IQR / cube root of n."""
    v = df.filter(F.col(name).isNotNull())
    r = v.agg(F.count(F.lit(1)).alias("n"), (F.max(name) - F.min(name)).cast("double").alias("span")).first()  # one row
    if not r["n"] or not r["span"]:
        return 1
    q = quantiles(v, [name], PERCENTS, approx=approx).first()["q"]  # one row
    widths = [r["span"] / (math.log2(r["n"]) + 1), 2 * (q[2] - q[0]) / r["n"] ** (1 / 3)]
    return max(1, math.ceil(r["span"] / min(w for w in widths if w > 0)))


def class_overlap(df: DataFrame, name: str, label: str, bins: int | str = "auto") -> DataFrame:
    """Overlap of the two classes' histograms over shared bins, 0 to 1; the
    number of bins is given, or found by `auto_bins`."""
    bins = auto_bins(df, name) if bins == "auto" else int(bins)
    v = df.select(F.col(name).cast("double").alias("v"), F.col(label).alias("y")).filter("v is not null")
    edges = F.broadcast(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    n = v.join(edges).groupBy(bin_of("v", "lo", "hi", bins).alias("bin")).agg(F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b"))
    total = F.broadcast(n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))  # one row
    return n.join(total).agg(F.sum(F.least(F.try_divide("a", "ta"), F.try_divide("b", "tb"))).alias("overlap"))


def dimension_histograms(df: DataFrame, name: str, share: float = 0.05, bins: int = 50, seed: str = "42") -> DataFrame:
    """(pos, bin, n) for a seeded part of an array's places, one at least."""
    x = df.select(F.posexplode(name).alias("pos", "value"))
    width = df.agg(F.max(F.size(name)).alias("w"))
    rank = F.row_number().over(Window.orderBy(F.md5(F.concat(F.col("pos").cast("string"), F.lit(seed)).cast("binary"))))
    picked = width.select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("pos"), "w").select("pos", "w", rank.alias("k")).filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("w") * share)))
    x = x.join(F.broadcast(picked.select("pos")), "pos")  # at most the array's width
    edges = x.groupBy("pos").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return x.join(F.broadcast(edges), "pos").groupBy("pos", bin_of("value", "lo", "hi", bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def norm(array: Column) -> Column:
    return F.sqrt(F.aggregate(array, F.lit(0.0), lambda s, x: s + x * x))


def bad_by_group(df: DataFrame, bad: Column, group: str) -> DataFrame:
    """(group, n, share of all rows) of bad rows, for groups that have any."""
    n = df.groupBy(group).agg(F.count_if(bad).alias("n"), F.count(F.lit(1)).alias("all"))
    return n.withColumn("share", F.col("n") / F.sum("all").over(Window.partitionBy())).filter("n > 0").select(group, "n", "share")


def table_profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, present, nulls)."""
    types = dict(df.dtypes)
    out = _rows(df, df.columns, {"rows": lambda c: F.count(F.lit(1)), "present": lambda c: F.count(c), "nulls": lambda c: F.count_if(F.col(c).isNull())})
    return out.withColumn("type", F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), F.col("column")))


def repeated_keys(df: DataFrame, keys: Sequence[str], top: int = 5) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.orderBy(F.desc("n"), *keys).limit(top)


def family(name: Column, kind: Column) -> Column:
    named = F.when(F.regexp_like(name, F.lit(r"emb_\d+$")), "embedding").when(F.regexp_like(name, F.lit("^tfidf_.+")), "tfidf")
    return F.when(kind.isin("string", "binary"), "categorical").otherwise(named.otherwise("structural"))


def family_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per family of columns: how many, which, share of nulls and of zeros."""
    types = dict(df.dtypes)
    zeros = lambda c: F.count_if(F.col(c) == 0) if types[c] not in ("string", "binary") else F.lit(0).cast("long")
    one = _rows(df, names, {"kind": lambda c: F.lit(types[c]), "n": lambda c: F.count(F.lit(1)), "nulls": lambda c: F.count_if(F.col(c).isNull()), "zeros": zeros})
    return one.groupBy(family(F.col("column"), F.col("kind")).alias("family")).agg(
        F.count(F.lit(1)).alias("columns"), F.array_sort(F.collect_list("column")).alias("names"), F.try_divide(F.sum("nulls"), F.sum("n")).alias("null_share"), F.try_divide(F.sum("zeros"), F.sum("n")).alias("zero_share"))

"""Rows and columns: filters, duplicates, joins of the table (P, U, J)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only_repos(df: DataFrame, repos: Sequence[str] | None, registry: DataFrame | None = None) -> DataFrame:
    """Rows of the repos asked for, or all. A repo that the registry lacks is an error."""
    if not repos:
        return df
    if registry is not None:
        asked = df.sparkSession.createDataFrame([(r,) for r in repos], "repo string")
        unknown = [r["repo"] for r in asked.join(registry, "repo", "left_anti").collect()]
        if unknown:
            raise ValueError(f"unknown repos: {sorted(unknown)}")
    return df.filter(F.col("repo").isin(list(repos)))


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the named columns; names that are missing do not matter."""
    return df.drop(*names)


def _predicates(df: DataFrame, rules: dict[str, Callable[[Column], Column]]) -> dict[str, Column]:
    if missing := [c for c in rules if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return {c: rule(F.col(c)) for c, rule in rules.items()}


def drop_invalid(df: DataFrame, rules: dict[str, Callable[[Column], Column]], recheck: bool = False) -> DataFrame:
    """Rows for which every rule holds; an unknown (null) does not hold. With
    recheck, rows that are left are counted against the rules once more, and
    any that a rule drops is an error."""
    out = df.filter(reduce(lambda a, b: a & b, _predicates(df, rules).values(), F.lit(True)))
    if recheck and (left := [r["rule"] for r in invalid_counts(out, rules).filter("dropped > 0").collect()]):  # a row a rule
        raise ValueError(f"rows are left that break the rules of {sorted(left)}")
    return out


def invalid_counts(df: DataFrame, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(rule, dropped): rows that each rule alone drops, in one pass."""
    ok = _predicates(df, rules)
    one = df.agg(*[(F.count(F.lit(1)) - F.count_if(p)).alias(c) for c, p in ok.items()])
    return one.unpivot([], list(ok), "rule", "dropped")


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(names))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The projection to names, in that order; an error where one is missing."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*names)


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def flat_paths(df: DataFrame, path: str = "filepath") -> DataFrame:
    """Distinct normalised paths without a directory."""
    return df.select(normal_path(F.col(path)).alias(path)).filter(~F.contains(F.col(path), F.lit("/"))).distinct()


def extension(path: Column) -> Column:
    """What follows the last dot; the whole path where there is none."""
    return F.element_at(F.split(path, r"\."), -1)


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def append_rows(old: DataFrame, new: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """old and new, one row a key: new before old, then the last by ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_of(both, keys, [F.desc("_new"), *[F.desc(t) for t in ties]]).drop("_new")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of a key that more than one row has."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def new_duplicates(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows duplicated after a step and not before it."""
    return duplicates(after, keys).exceptAll(duplicates(before, keys))


def stack_reports(reports: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [r.withColumn("model", F.lit(m)) for m, r in reports.items()])


def attach_features(df: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Features onto the rows that have them."""
    return df.join(features, keys, "inner")


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in done."""
    return df.join(done.select(*keys), keys, "left_anti")


def inducing_commits(labels: DataFrame) -> DataFrame:
    """Distinct (repo, commit) of all inducing lists; null lists and entries drop."""
    return labels.select("repo", F.explode("inducing").alias("commit")).filter("commit is not null").distinct()


def label_rows(df: DataFrame, inducing: DataFrame, out: str = "label") -> DataFrame:
    """1 for commits in their repo's inducing set, else 0."""
    hits = inducing.select("repo", "commit", F.lit(1).alias("_hit"))
    return df.join(hits, ["repo", "commit"], "left").withColumn(out, F.coalesce("_hit", F.lit(0)).cast("int")).drop("_hit")


def attach_messages(df: DataFrame, messages: DataFrame) -> DataFrame:
    """The commit's message, empty where there is none. messages has one row a key."""
    return df.join(messages.select("repo", "commit", "message"), ["repo", "commit"], "left").withColumn("message", F.coalesce("message", F.lit("")))


def work_list(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct commits that the cache lacks."""
    return df.select("repo", "commit").distinct().join(cache.select("repo", "commit"), ["repo", "commit"], "left_anti")


def attach_authors(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Author and time of each commit; rows without either are dropped."""
    joined = df.join(meta.select("repo", "commit", "author_email", "canonical_datetime"), ["repo", "commit"], "left")
    return drop_missing(joined, ["author_email", "canonical_datetime"])

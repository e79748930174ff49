"""Developer and file history: windows over ordered commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
HOUR = 3_600_000_000
#: Rows of a repo that one bucket of numbers has.
NUMBERS = 1 << 16


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def prior_experience(df: DataFrame, keys: list[str], ts: str, ties: list[str], out: str = "author_exp_pre", bucket: int = 7 * DAY) -> DataFrame:
    """Rows of the same keys that come earlier, in order of time and ties. Rows
    are numbered inside buckets of time; earlier buckets are summed. Keys and
    bucket are one struct, in which nulls are alike, so rows stay where they
    were numbered when they meet the sums."""
    df = df.withColumn("_at", F.struct(*keys, F.floor(micros(ts) / bucket).alias("_b")))
    sums = df.groupBy("_at").agg(F.count(F.lit(1)).alias("_sum"))
    w = Window.partitionBy(*[F.col("_at")[k] for k in keys]).orderBy(F.col("_at")["_b"])  # a row a bucket
    before = sums.select("_at", (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_at").orderBy(ts, *ties)) - 1
    return df.withColumn(out, inside).join(before, "_at").withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_at", "_before")


def trailing(df: DataFrame, value: Column, keys: list[str], place: Column, ties: list[str], span: int, bucket: int, out: str) -> DataFrame:
    """Sum of value over rows of the same keys that come before this one and
    whose place, a long, is at most `span` smaller, bound included; 0 for none.
    Null values count 0.

    No task sees a whole key: places are dealt into buckets no shorter than
    span, and rows that those of the next bucket may reach are there too, by
    place and value alone. Inside a bucket a row's sum is what comes before it
    less what comes before place - span, both running sums: one exchange, and
    work that follows rows however many a span has."""
    bucket, payload = max(bucket, span), df.columns
    df = df.withColumns({"_x": place, "_v": F.coalesce(value, F.lit(0)).cast("long")}).withColumn("_b", F.floor(F.col("_x") / bucket))
    reached = F.floor((F.col("_x") + span) / bucket) > F.col("_b")
    df = df.withColumn("_later", F.explode(F.when(reached, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    df = df.select(*[F.col(c) if c in keys else F.when(F.col("_later") == 0, F.col(c)).alias(c) for c in payload], "_x", "_v", "_later", (F.col("_b") + F.col("_later")).alias("_b"))
    part = Window.partitionBy(*keys, "_b")
    upto = F.sum("_v").over(part.orderBy("_x", *ties).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    gone = F.sum("_v").over(part.orderBy("_x").rangeBetween(Window.unboundedPreceding, -span - 1))
    df = df.withColumn("_upto", upto).withColumn("_gone", F.when(F.col("_x").isNotNull(), F.coalesce(gone, F.lit(0))).otherwise(0))
    return df.filter("_later = 0").select(*payload, (F.col("_upto") - F.col("_gone")).alias(out))


def sliding(df: DataFrame, value: Column, keys: list[str], ts: str, ties: list[str], days: int, out: str) -> DataFrame:
    """Sum of value over rows of the same keys that come before this one and at
    most `days` days earlier, bound included. Rows of the same instant come in
    order of ties."""
    return trailing(df, value, keys, micros(ts), ties, days * DAY, HOUR, out)


def recent_activity(df: DataFrame, keys: list[str], ts: str, ties: list[str], days: int = 30, out: str = "author_recent_activity_pre") -> DataFrame:
    """Rows of the same keys in the `days` days before this row."""
    return sliding(df, F.lit(1).cast("long"), keys, ts, ties, days, out)


def recent_churn(df: DataFrame, keys: list[str], ts: str, ties: list[str], days: int = 30, added: str = "loc_added", deleted: str = "loc_deleted", out: str = "recent_churn", distinct_commits: bool = False) -> DataFrame:
    """Added and deleted lines of the same keys in the `days` days before. With
    distinct_commits a commit counts once, by its first row in order of ties,
    and all its rows get that row's sum."""
    if distinct_commits:
        first = Window.partitionBy(*keys, "commit").orderBy(ts, *ties)
        one = df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
        sums = recent_churn(one, keys, ts, ties, days, added, deleted, out).select(*keys, "commit", out)
        return df.join(sums, [*keys, "commit"], "left")
    return sliding(df, (F.col(added) + F.col(deleted)).cast("long"), keys, ts, ties, days, out)


def seconds_since_file_change(df: DataFrame, ts: str = "canonical_datetime", out: str = "seconds_since_file_change") -> DataFrame:
    """Seconds since the row before of the same repo and file; null for the first."""
    w = Window.partitionBy("repo", "filepath").orderBy(ts, "commit")
    return df.withColumn(out, ((micros(ts) - F.lag(micros(ts)).over(w)) / 1_000_000).cast("long"))


def earlier_file_churn(df: DataFrame, ts: str = "canonical_datetime", changes: int = 5, out: str = "earlier_file_churn") -> DataFrame:
    """Churn of the `changes` changes of the file before the previous one; 0 without any."""
    w = Window.partitionBy("repo", "filepath").orderBy(ts, "commit").rowsBetween(-1 - changes, -2)
    return df.withColumn(out, F.coalesce(F.sum(F.col("loc_added") + F.col("loc_deleted")).over(w), F.lit(0)).cast("long"))


def capped_experience(df: DataFrame, ts: str = "canonical_datetime", last: int = 10_000, out: str = "author_exp_capped") -> DataFrame:
    """The author's rows among the `last` rows of the repo before this one.

    A repo's rows are numbered day by day: a table of a row a repo and day says
    how many come before, so no task orders a whole repo."""
    df = df.withColumn("_day", F.floor(micros(ts) / DAY))
    days = df.groupBy("repo", "_day").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("repo").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(F.col("repo").alias("_repo"), F.col("_day").alias("_d"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("repo", "_day").orderBy(ts, "commit", "filepath"))
    df = df.withColumn("_n", within).join(days, F.col("repo").eqNullSafe(F.col("_repo")) & F.col("_day").eqNullSafe(F.col("_d"))).drop("_repo", "_d")
    df = df.withColumn("_n", F.col("_n") + F.col("_before")).drop("_day", "_before")
    return trailing(df, F.lit(1), ["repo", "author_email"], F.col("_n").cast("long"), [], last, NUMBERS, out).drop("_n")


def seconds_since_parent(meta: DataFrame, out: str = "time_since_last_change") -> DataFrame:
    """Seconds between a commit and its first parent in the same repo; null for
    roots and unknown parents. May be negative. meta has repo, commit,
    canonical_datetime, parents."""
    own = meta.select("repo", "commit", F.col("canonical_datetime").alias("_at"), F.get("parents", F.lit(0)).alias("_parent"))
    of = meta.select(F.col("repo"), F.col("commit").alias("_parent"), F.col("canonical_datetime").alias("_before"))
    joined = own.join(of, ["repo", "_parent"], "left")
    return joined.select("repo", "commit", ((micros("_at") - micros("_before")) / 1_000_000).cast("long").alias(out))

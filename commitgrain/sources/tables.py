"""Reading, writing and versioning of tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir;
    a local session without that setting gets a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="commitgrain-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df dealt to all tasks where its files are fewer: a file of one row group
    is one task otherwise."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


def size_report(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Written whole or not at all by Spark's commit protocol."""
    df.write.mode(mode).parquet(path)


def convert_tree(spark: SparkSession, source: str, target: str, kind: str = "orc", pattern: str = "*.parquet*") -> None:
    """All files below source that fit the pattern, in another format; a target
    that is there already is left alone."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(source)
    found.write.mode("ignore").format(kind).save(target)


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The highest version among the folders below path; no file is opened."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
    found = [int(n.removeprefix("version=")) for n in names if re.fullmatch(r"version=\d+", n)]
    return max(found, default=None)


def write_next(df: DataFrame, path: str) -> int:
    """Write as the version after the newest; the first is 1."""
    version = (latest_version(df.sparkSession, path) or 0) + 1
    df.write.parquet(f"{path}/version={version}")
    return version


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; the filter prunes partitions. A path without any is an error."""
    newest = latest_version(spark, path)
    if newest is None:
        raise ValueError(f"no version below {path}")
    return spark.read.parquet(path).filter(F.col("version") == newest).drop("version")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each (repo, commit), by batch."""
    raw = spark.read.schema("batch_id long, repo string, commit string, message string").json(path)
    return last_records(raw)


def last_records(raw: DataFrame) -> DataFrame:
    order = Window.partitionBy("repo", "commit").orderBy(F.desc("batch_id"), F.desc("message"))
    return raw.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("repo", "commit", "message")


def append_cache(df: DataFrame, path: str, batch_id: int) -> None:
    df.select(F.lit(batch_id).alias("batch_id"), "repo", "commit", "message").write.mode("append").json(path)


def head(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows in order of the keys."""
    return df.orderBy(*keys).limit(n)

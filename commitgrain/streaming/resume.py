"""Incremental processing that can stop and go on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process_new_files(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files_a_batch: int = 100) -> StreamingQuery:
    """Run `step` over files that have not been processed and append the result.

    Each batch is one file of the target under its batch's number, so a batch
    that runs again after a failure replaces itself; the checkpoint keeps which
    files are done. Ends when all that is there is done.
    """
    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_new_rows(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], buckets: int = 64, files_a_batch: int = 100) -> StreamingQuery:
    """As `process_new_files`, and rows whose keys an earlier batch has written
    are skipped: a file that comes again, two files that share rows and a run
    that was killed give each key once.

    The target is kept by a bucket of the keys' hash and by batch. A batch is
    compared with those of its keys' buckets that earlier batches wrote, and
    replaces what it wrote itself if it runs again. Of rows of one batch with
    equal keys one stays; null keys are equal. `step` must keep the keys, and
    runs on new rows only."""
    def write(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = batch.dropDuplicates(list(keys)).withColumn("_bucket", bucket).persist()
        try:
            if exists(spark, target):
                touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets` rows
                done = spark.read.parquet(target).filter(F.col("bucket").isin(touched) & (F.col("batch") < number)).select("bucket", *[F.col(k).alias(f"_done_{k}") for k in keys])
                same = (F.col("_bucket") == F.col("bucket")) & reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys])
                fresh = new.join(done, same, "left_anti")
            else:
                fresh = new
            out = step(fresh.drop("_bucket")).withColumns({"bucket": bucket, "batch": F.lit(number)})
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)
        finally:
            new.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

"""A training corpus from `documents`: judged, deduplicated, mixed, encoded."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitgrain.llm import bpe_codec, exact_dedup, mixing, ngram_join, ordinal_quality
from commitgrain.llm._common import SPACE, stored, table


def _digest() -> Column:
    """Tells texts apart; null counts as empty."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def _rows(docs: DataFrame, *key: Column) -> DataFrame:
    """(row, key): all columns as one struct, so that none can clash. A struct
    equals another with nulls in the same places."""
    return docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.struct(*key).alias("key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels.

    Each row is judged by its text alone: null counts as empty, texts of any
    length are read whole, rows that repeat or have no id are judged like
    others, an empty table stays empty, and other columns pass untouched."""
    return ordinal_quality.select_good(docs, ordinal_quality.graded(table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays.

    Null and empty texts are equal. Rows that repeat the kept id with an equal
    text all stay; rows without an id stay only where no equal text has one. An
    empty table stays empty; other columns pass, whatever their names."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.struct("doc_id", F.col("text_sha256").alias("sha")).alias("kept")).distinct()
    same = F.sha2(F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "), "utf-8"), 256)
    return _rows(docs, F.col("doc_id").cast("long").alias("doc_id"), same.alias("sha")).join(kept, F.col("key") == F.col("kept"), "left_semi").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the smallest, which names it.
    Documents link from a similarity of 0.8 of their five-word shingles on.

    What goes is told by id and text together. Where an id has several texts,
    or none is given, the join sees a number for each (doc_id, text) instead,
    in the order of ids, rows without an id last: each text is a document of
    its own, and of near copies without any id one stays too. Equal rows stay
    or go together. Texts without words link with nothing. An empty table stays
    empty; other columns pass, whatever their names."""
    link = lambda d: ngram_join.jaccard_join(d, k=5, pct=80).filter("doc_id <> component_id").select("doc_id").distinct()
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    several = keys.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b or doc_id is null")
    rows = _rows(docs, F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    if several.isEmpty():
        gone = link(docs).select(F.struct("doc_id").alias("gone"))
        return rows.join(gone, F.struct("key.doc_id") == F.col("gone"), "left_anti").select("row.*")
    numbers = stored(numbered(keys.distinct()).select("number", F.struct("doc_id", "digest").alias("at")), "near-numbers")
    named = stored(rows.join(numbers, F.col("key") == F.col("at")).select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), "near-texts")
    gone = numbers.join(link(named).withColumnRenamed("doc_id", "number"), "number", "left_semi").select(F.col("at").alias("gone"))
    return rows.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")


def numbered(keys: DataFrame) -> DataFrame:
    """keys with number: 0, 1, ... in order of doc_id, nulls last, and digest.
    Rows are numbered inside each range of the order; a row a range says how
    many come before it."""
    order = (F.col("doc_id").isNull(), "doc_id", "digest")
    ranged = stored(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "near-ranges")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a range
    return ranged.withColumn("inside", inside).join(before, "range").withColumn("number", F.col("before") + F.col("inside") - 1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it. Rows that repeat id, source
    and text are told apart by a number, as the mix does; where there are none,
    nothing is put in order. A null source is a source, rows without an id are
    drawn like others, texts without words are never taken, and an empty table
    stays empty; other columns pass, whatever their names."""
    names = [F.col(f"`{n}`") for n in docs.columns]
    mixed = stored(mixing.pareto_mix(docs).select("doc_id", "source", "text_md5", "number", F.col("copies").cast("int").alias("copies")), "mixed")
    md5 = _digest()
    number = F.lit(1).cast("long")
    if not mixed.filter("number > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy("doc_id", "source", md5).orderBy(*names)).cast("long")
    rows = _rows(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), md5.alias("text_md5"), number.alias("number"))
    taken = mixed.filter("copies > 0").select(F.struct("doc_id", "source", "text_md5", "number").alias("taken"), F.sequence(F.lit(1), "copies").alias("copies"))
    drawn = rows.join(taken, F.col("key") == F.col("taken")).select("row", F.explode("copies"))
    return drawn.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of what they decode
    to. Null text is empty and has no tokens, texts are encoded whole, rows that
    repeat or have no id give a row each, an empty table gives none; columns
    other than doc_id and text end here."""
    return bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode),
]

#: The classifier's fit, the components and the encoding are beyond SQL; tests
#: hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact duplicates by content-defined chunk recipes.

A document's normalised text is cut where a rolling hash of the last WINDOW
bytes says so, so equal texts get equal chunks wherever they lie. Each chunk
content crosses the network once, to be verified: chunks are gathered by
(hash, content), and a hash that stands for two contents gets a numbered
variant for each. From there on a document is its recipe, the ordered list of
chunk identifiers, and only recipes are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitgrain.llm import _bytes as B
from commitgrain.llm._common import SPACE, columns, stored

WINDOW = 16
CHUNKS = "doc_id long, text_sha256 string, recipe array<long>, chunks array<binary>"


def cut_points(data: np.ndarray, offsets: np.ndarray, mean: int = 1024, longest: int = 8192) -> np.ndarray:
    """Ends of all chunks. A cut falls behind each window whose hash is 0 in
    the low bits, at each document's end, and after `longest` bytes without."""
    n = len(data)
    cuts = [offsets[1:]]
    if n >= WINDOW:
        h = B.byte_table(7)[data]
        step = 1
        while step < WINDOW:  # h[i] covers the `step` bytes from i on
            h = h[: len(h) - step] * np.uint64(pow(B._BASE, step, 2**64)) + h[step:]
            step *= 2
        ends = np.flatnonzero((h >> np.uint64(40)) & np.uint64(mean - 1) == 0) + WINDOW
        firsts = offsets[np.searchsorted(offsets, ends, "left") - 1]
        cuts.append(ends[ends - firsts >= WINDOW])
    cuts = np.unique(np.concatenate(cuts))
    cuts = cuts[cuts > 0]
    lengths = np.diff(cuts, prepend=0)
    if len(lengths) and lengths.max() > longest:
        parts = -(-lengths // longest)
        left = np.repeat(cuts - lengths, parts)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        cuts = np.minimum(left + number * longest, np.repeat(cuts, parts))
    return cuts


def _chunker(with_content: bool, mask: int):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text"):
                ends = cut_points(data, offsets)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                ids = (B.span_hashes(data, starts, ends, seed=11) & np.uint64(mask)).view(np.int64)
                firsts = np.searchsorted(starts, offsets)
                firsts[-1] = len(starts)
                if with_content:
                    raw = data.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([raw[s:e] for s, e in zip(starts, ends)], pa.binary())], ["chunk", "content"])
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), B.list_column(ids, firsts, pa.int64())], ["doc_id", "text_sha256", "recipe"])
    return run


def recipes(docs: DataFrame, mask: int = 2**64 - 1) -> DataFrame:
    """(doc_id, text_sha256, recipe) with one row a document; recipe lists
    verified chunk identifiers. docs has doc_id and normalised text."""
    hashed = docs.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"), "text")
    chunks = docs.select("text").mapInArrow(_chunker(True, mask), "chunk long, content binary")
    contents = chunks.groupBy("chunk", "content").agg(F.lit(1).alias("one"))
    doubtful = stored(contents.groupBy("chunk").agg(F.sum("one").alias("n")).filter("n > 1").select("chunk"), "chunk-clashes")
    plain = stored(hashed.mapInArrow(_chunker(False, mask), "doc_id long, text_sha256 string, recipe array<long>"), "recipes")
    if doubtful.isEmpty():  # every identifier stands for one content
        return plain
    # the few clashing hashes: number their contents, and name chunks by (hash, number)
    clash = contents.join(doubtful, "chunk", "left_semi")
    clash = clash.select("chunk", "content", F.row_number().over(Window.partitionBy("chunk").orderBy("content")).cast("long").alias("variant"))
    # one recipe for each text, whatever the ids of its rows
    whole = hashed.mapInArrow(_whole(mask), CHUNKS).drop("doc_id")
    each = whole.select("text_sha256", F.posexplode(F.arrays_zip("recipe", "chunks")).alias("place", "c"))
    each = each.select("text_sha256", "place", F.col("c.recipe").alias("chunk"), F.col("c.chunks").alias("content"))
    named = each.join(clash, ["chunk", "content"], "left").select("text_sha256", F.struct("place", "chunk", F.coalesce("variant", F.lit(0)).alias("variant")).alias("c"))
    lists = named.groupBy("text_sha256").agg(F.array_sort(F.collect_set("c")).alias("c"))
    lists = lists.select("text_sha256", F.flatten(F.transform("c", lambda c: F.array(c["chunk"], c["variant"]))).alias("recipe"))
    return plain.select("doc_id", "text_sha256").join(lists, "text_sha256", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<long>")))


def _whole(mask: int):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text"):
                ends = cut_points(data, offsets)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                ids = (B.span_hashes(data, starts, ends, seed=11) & np.uint64(mask)).view(np.int64)
                firsts = np.searchsorted(starts, offsets)
                firsts[-1] = len(starts)
                raw = data.tobytes()
                content = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array([raw[s:e] for s, e in zip(starts, ends)], pa.binary()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), B.list_column(ids, firsts, pa.int64()), content], ["doc_id", "text_sha256", "recipe", "chunks"])
    return run


def exact_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mask: int = 2**64 - 1) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after each run of white space became one space. Null
    text is empty; all empty texts are equal. The smallest doc_id of a group
    stays; rows that repeat this id are the same document and stay with it. A
    null doc_id is never the one kept unless the whole group has none. An
    empty table gives an empty table. `mask` narrows the chunk hash, for tests
    of clashing identifiers.

    Groups are summed before the shuffle, so a group of any size is one row a
    task there; the join that brings keep_id back is an equi-join on recipes,
    which adaptive execution splits where a group is hot.
    """
    base = columns(docs, key, text).toDF("doc_id", "text")
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ").alias("text"))
    lists = recipes(base, mask)
    groups = lists.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return (lists.join(groups, "recipe")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))

"""Substring deduplication by sliding sentence spans.

Each document is cut into sentences; every shortest run of consecutive
sentences with MIN_WORDS words, from each start and to each end, is hashed.
Runs are joined over all documents, and a sentence that lies in a run which is
not the run's first occurrence is removed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgrain.llm._common import WORD, columns, stored

#: Words of a run at least; a single sentence is a run from LONE words on.
MIN_WORDS, LONE = 20, 50
_words = re.compile(WORD).findall
_border = re.compile(r"[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*")
#: Without a hash: a stretch of a text that its own earlier runs cover.
SPANS = "doc_id long, digest long, h1 long, h2 long, start int, stop int"
CLEAN = "doc_id long, n_sentences long, n_removed long, n_spans long, removed_words long, kept_sha256 string, text string"


def sentences(text: str) -> tuple[list[str], list[str]]:
    """The sentences of a text, each with what follows it, and the words of
    each with one space between. Pieces without a word go to the one before."""
    raw, plain, at = [], [], 0
    for end in [*(m.end() for m in _border.finditer(text)), len(text)]:
        if end > at:
            piece, at = text[at:end], end
            words = " ".join(_words(piece))
            if words or not raw:
                raw.append(piece)
                plain.append(words)
            else:
                raw[-1] += piece
    return raw, plain


def runs(counts: list[int], least: int = MIN_WORDS, lone: int = LONE) -> list[tuple[int, int]]:
    """Shortest runs (start, stop) of two sentences or more with `least` words,
    or of one with `lone`, for every start and for every end."""
    n, total = len(counts), [0]
    for c in counts:
        total.append(total[-1] + c)
    fits = lambda i, j: total[j] - total[i] >= least and (j - i > 1 or counts[i] >= lone)
    found, j = set(), 0
    for i in range(n):
        j = max(j, i + 1)
        while j <= n and not fits(i, j):
            j += 1
        if j > n:
            break
        found.add((i, j))
    i = n - 1
    for j in range(n, 0, -1):
        i = min(i, j - 1)
        while i >= 0 and not fits(i, j):
            i -= 1
        if i < 0:
            break
        found.add((i, j))
    return sorted(found)


def marked(text: str, least: int, lone: int) -> tuple[list[tuple[bytes, int, int]], list[list[int]]]:
    """The first runs of each content in this text as (hash, start, stop), and
    the stretches [start, stop] that later runs cover together."""
    plain = sentences(text)[1]
    counts = [p.count(" ") + 1 if p else 0 for p in plain]
    each = [xxhash.xxh3_128_digest(p) for p in plain]
    seen, first, later = set(), [], []
    for i, j in runs(counts, least, lone):
        h = xxhash.xxh3_128_digest(b"".join(each[i:j]))
        if h not in seen:
            seen.add(h)
            first.append((h, i, j))
        elif later and i <= later[-1][1]:
            later[-1][1] = max(later[-1][1], j)
        else:
            later.append([i, j])
    return first, later


def _emit(least: int, lone: int):
    names = [c.split()[0] for c in SPANS.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                ids, digests, hashes, starts, stops, known = [], [], [], [], [], []
                for doc, digest, text in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)):
                    first, later = marked(text or "", least, lone)
                    for h, i, j in [*first, *((bytes(16), i, j) for i, j in later)]:
                        hashes.append(h)
                        starts.append(i)
                        stops.append(j)
                    ids += [doc] * (len(first) + len(later))
                    digests += [digest] * (len(first) + len(later))
                    known += [False] * len(first) + [True] * len(later)
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                known = np.array(known, bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(both[:, 0], mask=known), pa.array(both[:, 1], mask=known),
                                                  pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names)
    return run


def _clean(batches):
    names = [c.split()[0] for c in CLEAN.split(", ")]
    kinds = pa.schema(list(zip(names, [pa.int64()] * 5 + [pa.string()] * 2)))
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            rows = []
            for doc, text, hits in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)):
                raw, plain = sentences(text or "")
                gone = [False] * len(raw)
                for h in hits or ():
                    gone[h["start"] : h["stop"]] = [True] * (h["stop"] - h["start"])
                kept = "".join(r for r, g in zip(raw, gone) if not g)
                spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
                words = sum(p.count(" ") + 1 for p, g in zip(plain, gone) if g and p)
                rows.append((doc, len(raw), sum(gone), spans, words, hashlib.sha256(kept.encode()).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)


def span_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS, lone: int = LONE) -> DataFrame:
    """One row a document: doc_id, n_sentences, n_removed, n_spans (maximal
    removed runs), removed_words, kept_sha256, text (what is left).

    First means the smallest doc_id, then the earliest start. Null text is
    empty and has no sentence. Rows that repeat an id are one document to each
    other: they lose nothing on each other's account, and a row with a null id
    only loses what it repeats itself. An empty table gives an empty table.

    Runs are found and hashed once, in one table of hashes and places that all
    that follows reads. A text's own later runs leave the task as the stretches
    that they cover. Of the others each content is summed to its smallest
    document before the shuffle; the way back is an equi-join, which adaptive
    execution splits where a run is hot.
    """
    base = columns(docs, key, text).toDF("doc_id", "text")
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    spans = stored(base.mapInArrow(_emit(least, lone), SPANS), "spans")
    first = spans.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("hi > lo").select("h1", "h2", "lo")
    later = spans.join(first, ["h1", "h2"]).filter("doc_id > lo").select("doc_id", "digest", "start", "stop")
    own = spans.filter("h1 is null").select("doc_id", "digest", "start", "stop")
    hits = later.unionByName(own).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "stop")).alias("hits")).select(F.struct("doc_id", "digest").alias("of"), "hits")
    return base.join(hits, F.struct("doc_id", "digest") == F.col("of"), "left").select("doc_id", "text", "hits").mapInArrow(_clean, CLEAN)

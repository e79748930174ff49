"""Document fingerprints by a quartile bucket digest.

All byte triplets inside a sliding window of five bytes are hashed into BUCKETS
counters. Whether a counter lies in the first, second, third or last quarter of
them is two bits of the digest; a header holds the text's length on a
logarithmic scale and how the quartiles relate. Two digests are compared by a
difference score with an upper bound, so likeness runs from 0 to 1: equal
digests have 1, and digests that differ as much as those of random counters do
have 0.

To meet each document with the next one in order of ids, rows are dealt by
ranges of (id, text hash): one shuffle of compressed texts, in which the first
row of each range also goes to the range before it.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgrain.llm import _bytes as B
from commitgrain.llm._common import columns, partitions

BUCKETS = 256
#: Places of a triplet's second and third byte in the window of five.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: A random byte for each byte at each place of the window.
TABLES = [(B.byte_table(13 + i) >> np.uint64(20)).astype(np.uint8) for i in range(5)]
PIECE = 1 << 16
#: What a difference of 0, 1, 2 or 3 quarters counts: opposite ends count most.
APART = np.array([0, 1, 2, 6])
#: The mean score of buckets whose quarters are drawn at random: 4 of 16 pairs
#: are equal, 6 differ by 1, 4 by 2 and 2 by 3.
CHANCE = BUCKETS * float(np.array([4, 6, 4, 2]) @ APART) / 16
LENGTH_STEPS = 4
RANGES_A_TASK = 8
FOLLOWS = 1

SENT = "part int, none boolean, id long, h long, follows int, n_chars long, digest string, body binary"
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket, piece by piece. A triplet's
    bucket is the xor of a table's entry for each of its bytes, by place."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + 4, len(data) - at), at)
        place = [table[b] for table in TABLES]
        for second, third in TRIPLETS:
            n = min(len(b) - third, PIECE)
            if n > 0:
                out += np.bincount(place[0][:n] ^ place[second][second : second + n] ^ place[third][third : third + n], minlength=BUCKETS)
    return out


def fingerprint(text: str | bytes) -> str:
    """The digest in hexadecimal: length, two ratios of quartiles, quarters."""
    data = text.encode() if isinstance(text, str) else text
    c = counts(data)
    q1, q2, q3 = (int(q) for q in np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    quarter = ((c > q1).astype(np.uint8) + (c > q2) + (c > q3)).reshape(-1, 4)
    body = (quarter[:, 0] << 6 | quarter[:, 1] << 4 | quarter[:, 2] << 2 | quarter[:, 3]).tobytes()
    ratios = (15 * q1 // q3 << 4 | 15 * q2 // q3) if q3 else 0
    return bytes([min(255, round(LENGTH_STEPS * math.log2(1 + len(data)))), ratios]).hex() + body.hex()


def quarters(digest: str) -> np.ndarray:
    body = np.frombuffer(bytes.fromhex(digest)[2:], np.uint8)
    return np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=1).ravel().astype(np.int64)


def difference(a: str, b: str) -> float:
    """A score of 0 for equal digests, and at most CHANCE."""
    x, y = bytes.fromhex(a[:4]), bytes.fromhex(b[:4])
    head = min(64, 4 * abs(x[0] - y[0])) + 2 * (abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15)))
    return min(CHANCE, float(APART[np.abs(quarters(a) - quarters(b))].sum() + head))


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else 1 - difference(a, b) / CHANCE


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the beginning of the text after it."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def range_starts(keys: DataFrame) -> list[tuple]:
    """The first key of each range of the keys' order. Spark deals the keys to
    ranges of about equal size; a row a range comes to the driver."""
    n = RANGES_A_TASK * partitions(keys.sparkSession)
    ranged = keys.repartitionByRange(n, *keys.columns).groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*keys.columns)).alias("first"))
    return sorted(tuple(r["first"]) for r in ranged.collect())


def _send(starts):
    def run(batches):
        first, pack = starts.value, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text"):
                raw, out = data.tobytes(), []
                for i, key in enumerate(zip(*(rows.column(c).to_pylist() for c in ("none", "id", "h")))):
                    text = raw[offsets[i] : offsets[i + 1]]
                    at = bisect.bisect_right(first, key) - 1
                    row = (*key, 0, len(text.decode()), fingerprint(text), pack(text))
                    out.append((at, *row))
                    if key == first[at]:
                        out.append(((at - 1) % len(first), *key, FOLLOWS, *row[4:]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SENT_TYPES)], SENT_NAMES)
    return run


SENT_TYPES = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
SENT_NAMES = [c.split()[0] for c in SENT.split(", ")]


def _meet(batches):
    """Rows in order of part: each with the one after it. What ends a part is
    the row that the next one begins with."""
    unpack, last, out = zstandard.ZstdDecompressor().decompress, None, []
    for batch in batches:
        columns_ = [batch.column(c) for c in range(batch.num_columns)]
        for i in range(batch.num_rows):
            part, none, key, _, follows, n, digest, body = (c[i].as_py() for c in columns_)
            text = unpack(body).decode()
            if last is not None and last[0] == part and not last[1]:
                _, _, doc, size, own, mine = last
                new = edited(mine, text)
                other = fingerprint(new)
                out.append((doc, size, hashlib.sha256(new.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, digest)))
                if len(out) == 256:
                    yield _out(out)
                    out = []
            last = part, follows, None if none else key, n, digest, text
    if out:
        yield _out(out)


def _out(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in OUT.split(", ")])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many, or all there are, of the next document in ascending order of
    ids; after the last comes the first, so a lone row is its own next. Null
    text is empty; an empty text has a digest of zeros and is unlike any text
    with triplets. Rows that repeat an id follow each other in the order of
    their texts' hashes, equal rows in any; rows without an id come last. An
    empty table gives an empty table; other columns are not read. Texts are
    taken whole: triplets are counted piece by piece, and a task holds two
    texts besides an Arrow batch.

    Ids and hashes alone are put in ranges first; then each text crosses the
    network once, compressed, to the task of its range. Ranges split rows that
    share an id, but not rows that share id and text.
    """
    spark = docs.sparkSession
    base = columns(docs, key, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = base.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"), "text")
    starts = spark.sparkContext.broadcast(range_starts(keyed.select("none", "id", "h")))  # a row a range
    sent = keyed.mapInArrow(_send(starts), SENT).repartition(partitions(spark), "part").sortWithinPartitions("part", "follows", "none", "id", "h")
    return sent.mapInArrow(_meet, OUT)

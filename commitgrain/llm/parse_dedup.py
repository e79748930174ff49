"""Removal of repeated byte strings over a prefix-free parse.

A rolling hash of GRAM bytes sets triggers: of every REACH neighbouring places
the one with the smallest hash. Triggers cut a text into phrases, each from a
trigger to the end of the next one's gram, so that neighbours share GRAM bytes.
A trigger depends on the bytes near it alone: the first trigger of a string of
`length` bytes (of the REACH places it begins with) is the same wherever the
string lies. There the string falls into two parts, a suffix of what the
dictionary's phrases have up to the trigger, and a beginning of the parse from
the trigger on. So strings are equal where both parts are, and the order of all
strings comes from two orders that are much smaller:

1. Of the parse: its suffixes, one for each phrase, in the order of their bytes.
   All strings around a trigger hold the first HEAD bytes of its parse suffix,
   so suffixes are dealt by these; one whose head is alone in the corpus has no
   repeated string around it and ends here.
2. Of the dictionary: what stands before the triggers, in order read backwards.

With the common prefixes of neighbours in the first order and the common
suffixes in the second, the strings that begin d bytes before their trigger fall
into classes: equal for d bytes before it and for length - d from it on. In each
class the first string in order of (doc_id, text digest, place) stays.

Only distinct contexts are put in order. A context that an earlier one equals
byte by byte is removed at once, first within a slice of the input, then where
heads meet. Heads that a slice has twice, or that are very frequent, meet in
parts first, and each part sends on only contexts that are first in it for some
d. Orders compare bytes; a hash only brings equal heads to one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgrain.llm import _bytes as B
from commitgrain.llm._common import columns, partitions, stored

LENGTH, GRAM, REACH = 100, 16, 64
HEAD = LENGTH - REACH + 1
#: Parse suffixes in a bucket, about; and those of one head in a part.
BUCKET, HOT = 1 << 20, 1 << 12
#: Contexts that are put in order at a time, about.
SORTED = 1 << 15
#: A context: the bytes that strings around a trigger reach.
AROUND = np.arange(-(REACH - 1), LENGTH)
COUNTED = "bucket int, head binary, digest binary, place binary, known_digest binary, known_place binary, known_rounds binary"
FOUND = "digest long, place int, rounds int"
CUTS = "doc_id long, digest long, begin long, end long"
#: Packed columns of contexts and their types.
CONTEXT = {"head": np.uint64, "doc": np.int64, "own": np.int64, "place": np.int64, "near": np.int16, "far": np.int16, "rounds": np.int8, "bytes": np.uint8}
#: Stretches to remove, packed.
STRETCH = ("cut_doc", "cut_own", "cut_begin", "cut_end")
CONTEXTS = "bucket int, " + ", ".join(f"{c} binary" for c in (*CONTEXT, *STRETCH))
RESOLVED = f"{CUTS}, {CONTEXTS}"


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The triggers that strings of LENGTH bytes inside a document begin with:
    their places, hashes of their heads, and the first and last such string.
    A phrase goes from each place to the next one's gram."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.view(np.uint64), none, none
    h = B.byte_table(31)[data]
    step = 1
    while step < GRAM:
        h = h[: len(h) - step] * np.uint64(pow(B._BASE, step, 2**64)) + h[step:]
        step *= 2
    key = (B.mix(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    del h
    size = 1
    while size * 2 <= REACH:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the trigger of the string from each place on
    lengths = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    starts = np.arange(lengths.sum()) + np.repeat(offsets[:-1] - (np.cumsum(lengths) - lengths), lengths)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    places = at[first]
    return places, B.span_hashes(data, places, places + HEAD, seed=32), starts[first], starts[last]


def _bucketed(bucket: np.ndarray, buckets: int, arrays: list[np.ndarray]) -> list[pa.Array]:
    """The full buckets and, for each, the packed values of each array."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    return [pa.array(full.astype(np.int32)), *[pa.array([a[order[cuts[b] : cuts[b + 1]]].tobytes() for b in full], pa.binary()) for a in arrays]]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Which keys are the first of their value."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def _rounds(n: np.ndarray, hot: int) -> np.ndarray:
    """For heads that meet in parts first, of which n are expected: one more
    than the parts' number in powers of two."""
    return 1 + np.ceil(np.log2(np.maximum(n / hot, 1))).astype(np.int32)


def _count(buckets: int, slices: float, hot: int):
    def run(batches):
        turn = 0
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text", 2 * B.SLICE_BYTES):
                digests = rows.column(0).to_numpy()
                places, heads, _, _ = parse(data, offsets)
                doc = np.searchsorted(offsets, places, "right") - 1
                keep = _firsts(digests)[doc]  # copies in this slice are one text
                places, heads, doc = places[keep] - offsets[doc[keep]], heads[keep], doc[keep]
                _, group, count = np.unique(heads, return_inverse=True, return_counts=True)
                count = count[group] if len(group) else count
                # what repeats in this slice is known; one of it goes on, to tell the others
                known, sent = np.flatnonzero(count > 1), np.flatnonzero(_firsts(heads))
                packed = _bucketed((heads[sent] % np.uint64(buckets)).astype(np.int64), buckets, [heads[sent], digests[doc[sent]], np.where(count[sent] > 1, -count[sent], places[sent]).astype(np.int32)])
                yield pa.RecordBatch.from_arrays([*packed, *[pa.array([b""] * len(packed[0]), pa.binary())] * 3], _names(COUNTED))
                if len(known):
                    turn = (turn * 31 + len(known)) % buckets
                    there = [digests[doc[known]], places[known].astype(np.int32), _rounds(count[known] * slices, hot)]
                    yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), *[pa.array([b""], pa.binary())] * 3, *[pa.array([x.tobytes()], pa.binary()) for x in there]], _names(COUNTED))
    return run


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in table.column(column)), kind)


def _repeated(hot: int):
    """Of a bucket: (digest, place, rounds) of parse suffixes whose head is not
    alone. rounds is 0 for a head that no slice has twice and that is not hot."""
    def run(table: pa.Table) -> pa.Table:
        head, digest, place = _joined(table, "head", np.uint64), _joined(table, "digest", np.int64), _joined(table, "place", np.int32)
        order = np.lexsort((place, digest, head))
        head, digest, place = head[order], digest[order], place[order]
        new = np.ones(len(head), bool)
        new[1:] = (head[1:] != head[:-1]) | (digest[1:] != digest[:-1]) | (place[1:] != place[:-1])
        head, digest, place = head[new], digest[new], place[new]
        begins = np.ones(len(head), bool)
        begins[1:] = head[1:] != head[:-1]
        group = np.cumsum(begins) - 1
        count, sliced = (np.bincount(group, w)[group] if len(group) else group for w in (np.where(place < 0, -place, 1), place < 0))
        rounds = np.where((sliced > 0) | (count > hot), _rounds(count, hot), 0)
        keep = (count > 1) & (place >= 0)
        out = [(digest, "known_digest", np.int64), (place, "known_place", np.int32), (rounds.astype(np.int32), "known_rounds", np.int32)]
        return pa.table([pa.array(np.concatenate([x[keep], _joined(table, name, kind)])) for x, name, kind in out], _names(FOUND))
    return run


def _mixed(rows: dict[str, np.ndarray]) -> np.ndarray:
    """A hash of each context's bytes and bounds."""
    weights = B.mix(np.arange(1, len(AROUND) + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(rows["head"]), np.uint64)
    for j, w in enumerate(weights):
        total += rows["bytes"][:, j].astype(np.uint64) * w
    return B.mix(total + rows["near"].astype(np.uint64) * np.uint64(1 << 40) + rows["far"].astype(np.uint64) * np.uint64(1 << 50))


def copies(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Which contexts, given in order, equal an earlier one of their head in
    all bytes and bounds."""
    _, first, group = np.unique(_mixed(rows), return_index=True, return_inverse=True)
    of = first[group]
    out = of < np.arange(len(of))
    same = np.flatnonzero(out)
    out[same] = (rows["near"][same] == rows["near"][of[same]]) & (rows["far"][same] == rows["far"][of[same]]) & (rows["bytes"][same] == rows["bytes"][of[same]]).all(1)
    return out


def _taken(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {c: x[which] for c, x in rows.items()}


def _stretches(rows: dict[str, np.ndarray], most: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """What the strings from `most` to `least` bytes before each trigger cover."""
    return [rows["doc"], rows["own"], rows["place"] - most, rows["place"] - least + LENGTH]


def _packed(rows: dict[str, np.ndarray], buckets: int) -> list[pa.Array]:
    """Contexts by bucket of their head, and of the part of it that follows from
    their document."""
    parts = np.uint64(1) << np.maximum(rows["rounds"].astype(np.int64) - 1, 0).astype(np.uint64)
    part = B.mix(rows["doc"].view(np.uint64) * np.uint64(3) + rows["own"].view(np.uint64)) % parts
    bucket = B.mix(rows["head"] + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
    packed = _bucketed(bucket.astype(np.int64), buckets, list(rows.values()))
    return [*packed, *[pa.array([b""] * len(packed[0]), pa.binary())] * len(STRETCH)]


def _contexts(buckets: int):
    def run(batches):
        turn = 0
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text"):
                lists = rows.column(3)
                at = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))
                found = lists.flatten()
                wanted, rounds = found.field("place").to_numpy() + at, found.field("rounds").to_numpy()
                order = np.lexsort((rounds, wanted))
                wanted, rounds = wanted[order], rounds[order]
                places, heads, first, last = parse(data, offsets)
                spot = np.maximum(np.searchsorted(wanted, places, "right") - 1, 0)  # the most rounds that a place was given
                keep = wanted[spot] == places if len(wanted) else np.zeros(len(places), bool)
                places, heads, first, last, rounds = places[keep], heads[keep], first[keep], last[keep], rounds[spot[keep]]
                doc = np.searchsorted(offsets, places, "right") - 1
                ids, own = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                padded = np.concatenate([data, np.zeros(1, np.uint8)])
                order = np.lexsort((places - offsets[doc], own[doc], ids[doc]))
                where = np.stack([ids[doc], own[doc], places - offsets[doc]])[:, order]
                order = order[np.append(True, (where[:, 1:] != where[:, :-1]).any(0))[: len(order)]]  # rows that repeat an id and text are one
                for i in range(0, len(order), 16384):
                    some = order[i : i + 16384]
                    p, d = places[some], doc[some]
                    near, far = p - last[some], p - first[some]
                    reached = (AROUND >= -far[:, None]) & (AROUND < LENGTH - near[:, None])  # other bytes do not count
                    one = {"head": heads[some], "doc": ids[d], "own": own[d], "place": p - offsets[d], "near": near.astype(np.int16), "far": far.astype(np.int16), "rounds": rounds[some].astype(np.int8),
                           "bytes": np.where(reached, padded[np.clip(p[:, None] + AROUND, 0, len(data))], 0).astype(np.uint8)}
                    again = copies(one)
                    yield pa.RecordBatch.from_arrays(_packed(_taken(one, ~again), buckets), _names(CONTEXTS))
                    if again.any():
                        gone = _taken(one, again)
                        turn = (turn * 31 + len(gone["head"])) % buckets
                        cuts = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in _stretches(gone, gone["far"], gone["near"])]
                        yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), *[pa.array([b""], pa.binary())] * len(CONTEXT), *cuts], _names(CONTEXTS))
    return run


def orders(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in the parse's order with the common prefix of each with the
    one before, and in the dictionary's order with the common suffix."""
    out = []
    for part in (rows[:, REACH - 1 :], rows[:, : REACH - 1][:, ::-1]):
        part = np.ascontiguousarray(part)
        order = np.argsort(part.view(f"S{part.shape[1]}").ravel(), kind="stable")
        differs = part[order[1:]] != part[order[:-1]]
        common = np.where(differs.any(1), differs.argmax(1), part.shape[1])
        out += [order, np.concatenate([[0], common])]
    return tuple(out)


def firsts_at(rows: dict[str, np.ndarray]) -> np.ndarray:
    """For contexts in order: a matrix that says for which d the string from d
    bytes before the trigger on is the first of its class."""
    n = len(rows["head"])
    by_parse, prefix, by_dictionary, suffix = orders(rows["bytes"])
    out, right, left = np.zeros((n, REACH), bool), np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(REACH):
        some = np.flatnonzero((rows["near"] <= d) & (d <= rows["far"]))
        if len(some):
            right[by_parse], left[by_dictionary] = np.cumsum(prefix < LENGTH - d), np.cumsum(suffix < d)
            out[some, d] = _firsts(right[some] * (n + 1) + left[some])
    return out


def _resolve(buckets: int):
    """Of a bucket: the stretch that strings around each trigger remove, which
    is one stretch since they all overlap; and of heads that meet in parts the
    contexts that are first for some d, to meet again."""
    def run(table: pa.Table) -> pa.Table:
        rows = {c: _joined(table, c, kind) for c, kind in CONTEXT.items()}
        rows["bytes"] = rows["bytes"].reshape(-1, len(AROUND))
        order = np.lexsort((rows["place"], rows["own"], rows["doc"], rows["head"]))
        new = np.ones(len(order), bool)
        new[1:] = np.any([rows[c][order][1:] != rows[c][order][:-1] for c in ("head", "doc", "own", "place")], 0)
        order = order[new]  # rows that repeat an id and text are one
        head = rows["head"][order]
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1, [len(order)]]))
        found, again, i = [[_joined(table, c, np.int64) for c in STRETCH]], [], 0
        while i < len(cuts) - 1:  # whole heads, about SORTED contexts at a time
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + SORTED, "right")) - 1)
            one = _taken(rows, order[cuts[i] : cuts[j]])
            twice = copies(one)
            gone = _taken(one, twice)
            found.append(_stretches(gone, gone["far"], gone["near"]))
            one = _taken(one, ~twice)
            single = np.ones(len(one["head"]), bool)
            single[1:] &= one["head"][1:] != one["head"][:-1]
            single[:-1] &= one["head"][1:] != one["head"][:-1]
            again.append(_taken(one, single & (one["rounds"] > 0)))
            one = _taken(one, ~single)
            if len(one["head"]):
                first, d = firsts_at(one), np.arange(REACH)
                later = ~first & (one["near"][:, None] <= d) & (d <= one["far"][:, None])
                hit, on = later.any(1), first.any(1) & (one["rounds"] > 0)
                found.append(_stretches(_taken(one, hit), np.where(later, d, -1).max(1)[hit], np.where(later, d, REACH).min(1)[hit]))
                sent = _taken(one, on)
                sent["near"], sent["far"] = (x[on].astype(np.int16) for x in (np.where(first, d, REACH).min(1), np.where(first, d, -1).max(1)))
                again.append(sent)
            i = j
        cut = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)]
        tables = [pa.table([*cut, *[pa.nulls(len(cut[0]), pa.int32() if c == "bucket" else pa.binary()) for c in _names(CONTEXTS)]], _names(RESOLVED))]
        if again:
            rest = {c: np.concatenate([a[c] for a in again]) for c in CONTEXT}
            rest["rounds"] = np.zeros(len(rest["head"]), np.int8)
            packed = _packed(rest, buckets)
            tables.append(pa.table([*[pa.nulls(len(packed[0]), pa.int64())] * len(cut), *packed], _names(RESOLVED)))
        return pa.concat_tables(tables)
    return run


def _cut(batches):
    for batch in batches:
        ids, digests, removed, spans, hashes, kept = [], [], [], [], [], []
        for doc, digest, text, cuts in zip(*batch.columns):
            raw, out, at, n = text.as_buffer().to_pybytes() if text.is_valid else b"", [], 0, 0
            for c in sorted((x["begin"], x["end"]) for x in cuts.as_py()):
                if c[0] > at or not n:
                    n += 1
                    out.append(raw[at : c[0]])
                at = max(at, c[1])
            out.append(raw[at:])
            left = b"".join(out)
            ids.append(doc.as_py())
            digests.append(digest.as_py())
            removed.append(len(raw) - len(left))
            spans.append(n)
            hashes.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string()), pa.array(kept, pa.binary())],
                                         ["doc_id", "digest", "n_removed", "n_spans", "kept_sha256", "kept"])


def parse_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of LENGTH bytes that covers it also starts
    earlier: in a smaller doc_id, or in the same document further left. Null
    text is empty. Texts shorter than LENGTH bytes keep all. Copies of a whole
    text keep nothing but in the smallest doc_id. Rows that repeat an id with
    the same text are the same document, with equal results; with other texts,
    each is its own, and the one whose digest is smaller is the earlier. Rows
    with a null id keep all and take nothing from others. An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    base = columns(docs, key, text).toDF("doc_id", "text")
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(base.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha")), "texts")
    firsts = stored(rows.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.first("digest").alias("digest")), "first-texts")
    size = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(partitions(spark), int(size * 2 / REACH / BUCKET) + 1)
    counted = base.filter("doc_id is not null").select("digest", "text").mapInArrow(_count(buckets, size / (2 * B.SLICE_BYTES), hot), COUNTED)
    found = counted.groupBy("bucket").applyInArrow(_repeated(hot), FOUND)
    lists = found.groupBy("digest").agg(F.collect_set(F.struct("place", "rounds")).alias("places"))
    lists = lists.join(firsts.select("digest", F.col("first").alias("doc_id")), "digest")
    touched = stored(base.join(lists, ["doc_id", "digest"]).select("doc_id", "digest", "text", "places"), "touched-texts")
    contexts = touched.mapInArrow(_contexts(buckets), CONTEXTS)
    resolved = contexts.groupBy("bucket").applyInArrow(_resolve(buckets), RESOLVED)  # read twice, from one exchange
    met = resolved.filter("bucket is not null").select(*_names(CONTEXTS)).groupBy("bucket").applyInArrow(_resolve(buckets), RESOLVED)
    cuts = resolved.filter("bucket is null").select(*_names(CUTS)).unionByName(met.select(*_names(CUTS)))
    cuts = cuts.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    done = touched.select("doc_id", "digest", "text").dropDuplicates(["doc_id", "digest"]).join(cuts, ["doc_id", "digest"]).select("doc_id", "digest", "text", "cuts").mapInArrow(_cut, "doc_id long, digest long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = rows.join(firsts.select("sha", "first"), "sha", "left").join(done.drop("kept"), ["doc_id", "digest"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return out.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                      F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))

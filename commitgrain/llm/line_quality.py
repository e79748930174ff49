"""Quality rules from lines that many documents of a host share.

Lines are normalised (ASCII lower case, runs of white space to one space) and
hashed; each (host, line) counts the documents it is in. Lines above the
host's limit are boilerplate and are removed; a document that keeps too few
words is rejected. Rules on the document alone come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgrain.llm import _bytes as B
from commitgrain.llm._common import columns, stored

RUN = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
MEASURED = "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<long>, line_words array<int>"


def _repeated(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items share key and document with another, and with an earlier one."""
    order = np.lexsort((np.arange(len(keys)), keys, docs))
    same = np.zeros(len(keys) + 1, bool)
    k, d = keys[order], docs[order]
    same[1:-1] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order], later[order] = same[:-1] | same[1:], same[:-1]
    return any_, later


def text_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lines with a word: begin, end (without its newline), place of the
    first word, number of words, and the hash of the normalised line, which is
    the list of its lower-cased words."""
    n = len(starts)
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1], offsets[1:]]))
    begin, end = cuts[:-1], cuts[1:].copy()
    if len(begin):
        end -= data[np.maximum(end - 1, 0)] == 10
    first_word = np.searchsorted(starts, begin)
    words = np.searchsorted(starts, end) - first_word
    full = words > 0
    begin, end, first_word, words = begin[full], end[full], first_word[full], words[full]
    low = B.span_hashes(B.LOWER[data], starts, ends, seed=4)
    place = np.arange(n) - np.repeat(first_word, words)
    up, _ = B.power_tables(max(n, 1))
    sums = B.running(low * up[place] if n else low)
    return begin, end, first_word, words, B.mix(sums[first_word + words] - sums[first_word] + words.astype(np.uint64))


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The counts of each document, and the distinct normalised lines of each
    with a word: hashes, words in all copies of the line, first places."""
    starts, ends, firsts = B.words(data, offsets)
    n = len(starts)
    inside = ~B.IS_SPACE[data]
    out = {"n_words": np.diff(firsts), "word_chars": B.per_doc((inside & (data & 0xC0 != 0x80)).astype(np.int64), offsets),
           "n_symbols": B.per_doc(_SYMBOL[data].astype(np.int64), offsets)}
    hashes = B.span_hashes(data, starts, ends, seed=2)
    docs = B.owner(firsts)
    runs, at = B.windows(hashes, firsts, RUN)
    twice, _ = _repeated(runs, docs[at])
    edge = np.zeros(n + RUN + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + RUN, -1)
    out["n_repeat_words"] = B.per_doc((np.cumsum(edge)[:n] > 0).astype(np.int64), firsts)
    begin, end, first_word, words, keys = text_lines(data, offsets, starts, ends)
    line_doc = docs[first_word] if n else np.zeros(0, np.int64)
    _, again = _repeated(B.span_hashes(data, begin, end, seed=3), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=len(offsets) - 1)
    order = np.lexsort((keys, line_doc))
    k, d, w = keys[order], line_doc[order], words[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    groups = np.flatnonzero(head)
    total = np.add.reduceat(w, groups) if len(groups) else w
    return out, (k[groups].view(np.int64), total, np.searchsorted(d[groups], np.arange(len(offsets))))


def _measured(with_text: bool):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text"):
                counts, (keys, words, firsts) = measure(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                     B.list_column(keys, firsts, pa.int64()), B.list_column(words.astype(np.int32), firsts, pa.int32()), *[rows.column(2)] * with_text],
                    ["doc_id", "host", *COUNTS, "lines", "line_words", *["text"] * with_text])
    return run


def _cleaned(batches):
    """doc_id, kept, text, gone -> doc_id, kept, text without the lines whose
    hash is in gone; a line goes with its newline."""
    for batch in batches:
        for rows, data, offsets in B.slices(batch, "text"):
            starts, ends, _ = B.words(data, offsets)
            begin, end, _, _, keys = text_lines(data, offsets, starts, ends)
            doc = np.searchsorted(offsets, begin, "right") - 1
            out = np.ones(len(data), bool)
            for i, gone in enumerate(rows.column(3)):
                mine = slice(*np.searchsorted(doc, [i, i + 1]))
                if gone.is_valid and len(gone):
                    hit = np.isin(keys[mine].view(np.int64), gone.values.to_numpy())
                    for a, b in zip(begin[mine][hit], end[mine][hit]):
                        out[a : min(b + 1, offsets[i + 1])] = False
            text = [data[offsets[i] : offsets[i + 1]][out[offsets[i] : offsets[i + 1]]].tobytes().decode() for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string())], ["doc_id", "kept", "text"])


def line_rules(docs: DataFrame, *, key: str = "doc_id", host: str = "source", text: str = "text",
               least_docs: int = 20, share: float = 0.02, depleted: float = 0.5, least_words: int = 20, repeat_pct: int = 30) -> DataFrame:
    """One row a document: doc_id, the five counts, base_failed, kept,
    removed_words, removed_lines.

    A line is removed where more than max(least_docs, share * documents of the
    host) documents of its host have it; a line in just as many stays. A
    document is rejected by the base rules (fewer than least_words words, or
    more than repeat_pct % of its words in repeated 8-word windows), or as
    depleted: less than the part `depleted` of its words is left, or fewer than
    least_words. Null text has no words and fails; a null host is a host of its
    own; rows that repeat an id count as documents of their own; an empty table
    gives an empty table. Hashes of 64 bits name lines: two lines of a host that
    clash are counted together. `clean_lines` gives the texts that are left.

    Counts are summed in each task before the shuffle, and hot lines meet as
    partial counts; the way back is an equi-join, split where a line is hot.
    """
    return _judged(docs, key, host, text, least_docs, share, depleted, least_words, repeat_pct, False)


def clean_lines(docs: DataFrame, *, key: str = "doc_id", host: str = "source", text: str = "text",
                least_docs: int = 20, share: float = 0.02, depleted: float = 0.5, least_words: int = 20, repeat_pct: int = 30) -> DataFrame:
    """One row a document: doc_id, kept, and text without the lines that
    `line_rules` removes, by the same rules. A line goes with the newline behind
    it; nothing else of a text changes, and null becomes empty."""
    judged = _judged(docs, key, host, text, least_docs, share, depleted, least_words, repeat_pct, True)
    return judged.select("doc_id", "kept", "text", "gone").mapInArrow(_cleaned, "doc_id long, kept boolean, text string")


def _judged(docs: DataFrame, key: str, host: str, text: str, least_docs: int, share: float, depleted: float, least_words: int, repeat_pct: int, with_text: bool) -> DataFrame:
    base = columns(docs, key, host, text).toDF("doc_id", "host", "text")
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("host").cast("string").alias("host"), "text")
    seen = base.mapInArrow(_measured(with_text), MEASURED + ", text string" * with_text)
    seen = stored(seen.withColumn("row", F.monotonically_increasing_id()), "line-counts")
    each = seen.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hosts = seen.groupBy("host").agg(F.greatest(F.lit(float(least_docs)), F.count(F.lit(1)) * F.lit(share)).alias("limit"))
    counted = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least_docs)
    over = (counted.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
            .filter("c.n > h.limit").select("c.host", "c.line"))
    which = [F.collect_list("e.line").alias("gone")] * with_text  # at most the lines of one document
    gone = (each.alias("e").join(over.alias("o"), F.col("e.host").eqNullSafe(F.col("o.host")) & (F.col("e.line") == F.col("o.line")))
            .groupBy("e.row").agg(F.sum("e.words").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"), *which))
    done = seen.drop("lines", "line_words").join(gone, "row", "left").na.fill(0, ["removed_words", "removed_lines"])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    thin = (rest < F.col("n_words") * F.lit(depleted)) | (rest < least_words)
    return done.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~thin).alias("kept"), "removed_words", "removed_lines", *["text", "gone"] * with_text)

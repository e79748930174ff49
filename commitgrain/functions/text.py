"""Message flags, message cleaning and term weights."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from heapq import nlargest

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that the vectorizer leaves out, in natural order. A short
#: list of English function words; both the Spark side and the SQL use it.
STOP_WORDS = ("a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by", "can", "could", "did", "do", "for", "from",
              "had", "has", "have", "he", "her", "his", "how", "if", "in", "into", "is", "it", "its", "may", "more", "no", "not", "of", "on", "only", "or", "other", "our", "out",
              "over", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "under", "up", "very", "was",
              "we", "were", "what", "when", "where", "which", "who", "will", "with", "would", "you", "your")

#: Patterns that message cleaning replaces, in this order.
CLEANING = (
    (r"git-svn-id:.*", ""),
    (r"https?://\S+", ""),
    (r"\b[0-9a-f]{4,}\b", ""),
    (r"#\d+", ""),
    (r"\.py|\.c|\.cpp|\.h", " "),
    (r"[^a-zA-Z\s]", " "),
)


def message_flags(message: Column) -> dict[str, Column]:
    low = F.lower(message)
    return {"msg_len": F.length(message), "has_fix_kw": F.contains(low, F.lit("fix")).cast("int"), "has_bug_kw": F.contains(low, F.lit("bug")).cast("int")}


def clean_message(message: Column) -> Column:
    """Lower case without revision trailers, links, hex words, issue numbers,
    file extensions and everything that is no letter; white space stays, but
    for that at the ends. Classes are Unicode's, and only \\n ends a line."""
    out = F.lower(message)
    for pattern, to in CLEANING:
        out = F.regexp_replace(out, "(?U)(?d)" + pattern, to)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use has it inside a
    function over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of two characters or more without stop words, and their pairs."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"\w\w+"), F.lit(0)), lambda w: ~w.isin(*stop_words))
    rest = lambda w, start: F.slice(w, start, F.greatest(F.size(w) - 1, F.lit(0)))
    return once(words, lambda w: F.concat(w, F.zip_with(rest(w, 1), rest(w, 2), lambda a, b: F.concat_ws(" ", a, b))))


#: Counters of a task's summary, for each term that is asked for.
COUNTERS = 64


def _lists(column: pa.Array, stop_words: Sequence[str] | None):
    """Each row's terms: its array, or with stop words what `terms` finds in its text."""
    if stop_words is None:
        yield from (found or () for found in column.to_pylist())
        return
    word, stop = re.compile(r"\w\w+", re.ASCII), frozenset(stop_words)
    for text in column.to_pylist():
        words = [w for w in word.findall(text or "") if w not in stop]
        yield words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _summary(limit: int, stop_words: Sequence[str] | None = None):
    """Misra and Gries' summary of a task's terms: (term, low, null), each true
    count being between low and low plus the task's error; (null, null, error)."""
    def run(batches):
        seen, error = Counter(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for found in _lists(batch.column(0).slice(i, 256), stop_words):
                    seen.update(found)
                if len(seen) > 4 * limit:
                    cut = nlargest(limit + 1, seen.values())[-1]
                    seen, error = Counter({t: n - cut for t, n in seen.items() if n > cut}), error + cut
        yield pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.string()), pa.array([*seen.values(), None], pa.int64()), pa.array([None] * len(seen) + [error], pa.int64())], ["term", "low", "error"])
    return run


def _exact(candidates, stop_words: Sequence[str] | None = None):
    """(term, n, df) of a task, for the candidates alone."""
    def run(batches):
        known, n, df = candidates.value, Counter(), Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for found in _lists(batch.column(0).slice(i, 256), stop_words):
                    mine = Counter(filter(known.__contains__, found))
                    n.update(mine)
                    df.update(mine.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["term", "n", "df"])
    return run


def heavy_terms(found: DataFrame, size: int, counters: int | None = None, stop_words: Sequence[str] | None = None) -> DataFrame:
    """(term, n, df) of the `size` terms of the highest count, exact, from one
    column of arrays of terms, or with stop words from one of texts.

    A first pass keeps a summary of at most 4 * `counters` terms a task, so what
    is shuffled follows tasks and counters, not distinct terms. Summed up, no
    term is counted too low by more than the tasks' errors; terms that could
    reach the last place by that are counted in a second pass. Where terms
    outside all summaries could, the counters are too few and are made four
    times as many. Ties are in order of terms."""
    spark, limit = found.sparkSession, counters or COUNTERS * size
    while True:
        sums = found.mapInArrow(_summary(limit, stop_words), "term string, low long, error long").groupBy("term").agg(F.sum("low").alias("low"), F.sum("error").alias("error")).persist()
        try:
            error = sums.filter("term is null").agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]  # one row
            top = [r["low"] for r in sums.filter("term is not null").orderBy(F.desc("low")).select("low").limit(size).collect()]  # `size` rows
            last = top[-1] if len(top) == size else 0
            if error == 0 or error < last:
                near = sums.filter((F.col("term").isNotNull()) & (F.col("low") >= last - error)).select("term")
                candidates = spark.sparkContext.broadcast({r["term"] for r in near.collect()} if error else {r["term"] for r in sums.filter("term is not null").orderBy(F.desc("low"), "term").limit(size).collect()})  # at most what the summaries hold
                break
        finally:
            sums.unpersist()
        limit *= 4
    exact = found.mapInArrow(_exact(candidates, stop_words), "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return exact.orderBy(F.desc("n"), "term").limit(size)


def fit_vocabulary(texts: DataFrame, text: str, size: int = 100, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(term, idf) of the `size` terms with the highest count in the corpus.
    Texts are made once for both passes over them, and terms found in the tasks."""
    kept = texts.select(text).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        top = heavy_terms(kept, size, stop_words=stop_words)
        total = kept.agg(F.count(F.lit(1)).alias("docs"))
        rows = top.join(F.broadcast(total)).select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")).collect()  # `size` rows; total is one
    finally:
        kept.unpersist()
    return texts.sparkSession.createDataFrame(rows, "term string, idf double")


def term_weights(text: Column, idf: dict[str, float], stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """[(term, weight)] of a text over a fitted vocabulary: counts times idf,
    scaled to length 1. An expression over the row alone."""
    if not idf:
        return F.slice(F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("weight"))), 1, 0)
    table = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])
    known = F.filter(terms(text, stop_words), lambda t: t.isin(*idf))
    raw = once(known, lambda k: F.transform(F.array_distinct(k), lambda t: F.struct(t.alias("term"), (F.size(F.filter(k, lambda x: x == t)) * F.element_at(table, t)).alias("w"))))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    return once(raw, lambda r: once(norm(r), lambda n: F.transform(r, lambda t: F.struct(t["term"].alias("term"), (t["w"] / n).alias("weight")))))


def weigh_terms(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(key, term, weight) for each text's terms of the vocabulary, which has a
    set size and comes to the driver; no shuffle."""
    idf = {r["term"]: r["idf"] for r in vocabulary.orderBy("term").collect()}
    return texts.select(key, F.inline(term_weights(F.col(text), idf, stop_words)))


def commit_code(patches: DataFrame, limit: int = 2000) -> DataFrame:
    """(repo, commit, code): the first characters of each new file, by path."""
    piece = F.struct(F.col("path"), F.substring("new_text", 1, limit).alias("t"))
    some = patches.filter("new_text is not null").groupBy("repo", "commit").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return some.select("repo", "commit", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("code"))


def hash_embedding(text: Column, offset: int = 0, width: int = 8) -> Column:
    """`width` bytes of the text's SHA-256 from byte offset / 2 on, each over 255."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.conv(F.substring(digest, i * 2 + 1 + offset, F.lit(2)), 16, 10).cast("double") / 255)

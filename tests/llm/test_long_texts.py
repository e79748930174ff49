"""A text of 5 MB, its copy and a longer version through all operators."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commitgrain.llm import bpe_codec, exact_dedup, fingerprints, line_quality, mixing, ngram_join, ordinal_quality, parse_dedup, sentence_spans, spelling, token_counts, warc_zstd

SCHEMA = "doc_id long, text string, source string"
END = "Zz zzz zzzz, as nothing before it was, ends what is new here."


@pytest.fixture(scope="module")
def long():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyé") for _ in range(rng.randint(2, 10))) for _ in range(60_000)]
    out, size = [], 0
    while size < 5_000_000:
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(10, 16))) + (".\n" if rng.random() < 0.1 else ". "))
        size += len(out[-1].encode())
    return out


@pytest.fixture(scope="module")
def docs(spark, long):
    text = "".join(long)
    return spark.createDataFrame([(1, text, "a"), (2, text + END, "b"), (3, "Short, and like nothing else.", "b"), (4, text, "b")], SCHEMA).repartition(2).persist()


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_copies_go_and_what_is_new_stays(docs, long):
    text = "".join(long)
    exact = rows(exact_dedup.exact_dedup(docs))
    assert {i: r["keep_id"] for i, r in exact.items()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert exact[4]["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text).encode()).hexdigest()
    spans = rows(sentence_spans.span_dedup(docs))
    assert {i: (r["n_sentences"], r["n_removed"]) for i, r in spans.items()} == {1: (len(long), 0), 2: (len(long) + 1, len(long)), 3: (1, 0), 4: (len(long), len(long))}
    assert (spans[1]["text"], spans[2]["text"], spans[4]["text"]) == (text, END, "")
    bytes_ = rows(parse_dedup.parse_dedup(docs))
    n = len(text.encode())
    assert {i: (r["n_removed"], r["n_spans"]) for i, r in bytes_.items()} == {1: (0, 0), 2: (n, 1), 3: (0, 0), 4: (n, 1)}
    assert bytes_[2]["kept_sha256"] == hashlib.sha256(END.encode()).hexdigest()


def test_links_and_fingerprints(docs, long):
    words = "".join(long).split()
    joined = rows(ngram_join.jaccard_join(docs))
    assert joined[1]["n_shingles"] == len(set(zip(words, words[1:], words[2:], words[3:])))
    assert {i: r["component_id"] for i, r in joined.items()} == {1: 1, 2: 1, 3: 3, 4: 1}
    marks = rows(fingerprints.fingerprints(docs))
    assert marks[1]["fingerprint"] == marks[4]["fingerprint"] and marks[1]["n_chars"] == len("".join(long)) and marks[1]["near_next"] > marks[2]["near_next"]


def test_counts_and_grades(docs, long):
    text = "".join(long)
    n = len(text.split())
    lines = rows(line_quality.line_rules(docs))
    assert (lines[1]["n_words"], lines[1]["n_repeat_words"], lines[1]["base_failed"]) == (n, 0, False)
    mixed = rows(mixing.pareto_mix(docs))
    assert mixed[1]["size"] == n and all(r["taken"] <= 3 * r["size"] for r in mixed.values())
    graded = ordinal_quality.ordinal_quality(docs, docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade")))
    assert sorted(rows(graded)) == [1, 2, 3, 4]
    assert sum(r["n"] for r in spelling.spelling_variants(docs).select("n").collect()) > 0


def test_tokens(docs, long):
    text = "".join(long)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    assert rows(token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")))[1]["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    coded = rows(bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")))
    ids = library.encode(text, add_special_tokens=False).ids
    assert coded[1]["n_tokens"] == len(ids) and coded[4]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_archives(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a/"), "doc_id").alias("url"), F.col("text").alias("html"))
    got = rows(warc_zstd.pages_through_archives(pages), "page_id")
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 4), 2: ("response", None), 3: ("response", None), 4: ("response", None)}

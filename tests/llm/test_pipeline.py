"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from commitgrain.llm import mixing, ordinal_quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").distinct().collect()}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, names = docs.schema, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "mix", "encode"]
    kept = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encode":
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema]
    start, good, exact, near = (texts(kept[k]) for k in ("start", "quality", "exact", "near"))

    ratings = ordinal_quality.graded(spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r["doc_id"] for r in ordinal_quality.ordinal_quality(kept["start"], ratings).filter("kept").collect()}
    assert set(good) == judged and len(good) < len(start)
    grade = {r["doc_id"]: r["grade"] for r in ratings.collect()}
    clean = [i for i, g in grade.items() if g == 2]
    assert np.mean([i in good for i in clean]) > 0.95

    first = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", good[i]), i)
    assert set(exact) == set(first.values())

    sets = {i: shingles(t) for i, t in exact.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(near) == {find(i) for i in sets}

    copies = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(kept["near"]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in kept["mix"].select("doc_id").collect()) == copies

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = kept["encode"].collect()
    assert Counter(r["doc_id"] for r in rows) == copies
    for r in rows:
        ids = lib.encode(near[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(near[r["doc_id"]].encode()).hexdigest()


def test_pipeline_takes_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, None, None, None), (3, "one good text of some words", "en", None, 9), (3, "one good text of some words", "en", None, 9)],
                                spark.read.parquet(f"{SF}/documents.parquet").schema)
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            n = out.count()
            if name != "encode":
                assert out.columns == odd.columns
                assert n <= 3 * max(df.count(), 1)
    assert corpus_pipeline.STAGES[2][1](spark, odd, SF).filter(F.col("doc_id") == 3).count() == 2


def test_mix_stage_counts_repeated_rows_once(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(i // 2, f"text {i % 3} of some words " * (i % 7 + 1), "en", "ab"[i % 2], i) for i in range(60)] + [(None, "no id at all", "en", None, i) for i in range(20)] + [(99, None, None, "a", 1)]
    docs = spark.createDataFrame(rows + rows[:9], schema)
    want = Counter()
    for r in mixing.pareto_mix(docs).collect():
        want[r["doc_id"], r["source"], r["text_md5"]] += r["copies"]
    out = corpus_pipeline.mix(spark, docs.withColumn("key", F.lit("clash")).repartition(3), SF)
    assert out.columns == [*docs.columns, "key"]
    assert Counter((r["doc_id"], r["source"], hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in out.collect()) == +want
    assert set(out.select("n_chars").distinct().toPandas()["n_chars"]) <= set(range(61))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["keep_id", "keep_sha", "kept", "key", "row", "gone", "digest", "number", "sha", "component_id"]
PROSE = " ".join(f"word{i}" for i in range(40))
OTHER = " ".join(f"thing{i * i}" for i in range(40))


def near_ids(spark, rows, stage=2):
    df = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.STAGES[stage][1](spark, df, SF)
    assert out.columns == df.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_near_drops_texts_not_ids(spark):
    rows = [(1, PROSE, "en", "a", 1), (5, PROSE + " more", "en", "a", 1), (5, OTHER, "en", "a", 1)]
    assert near_ids(spark, rows) == [(1, PROSE), (5, OTHER)]
    # equal rows go or stay together
    assert near_ids(spark, rows + rows) == [(1, PROSE), (1, PROSE), (5, OTHER), (5, OTHER)]


def test_near_keeps_one_of_copies_without_ids(spark):
    rows = [(None, PROSE, "en", "a", 1), (None, PROSE + " more", "en", "a", 1), (None, OTHER, "en", "a", 1), (None, None, "en", "a", 1)]
    kept = near_ids(spark, rows)
    assert len(kept) == 3 and (None, OTHER) in kept and (None, None) in kept
    assert near_ids(spark, [*rows, (9, PROSE + " again", "en", "a", 1)]) == sorted([(9, PROSE + " again"), (None, OTHER), (None, None)], key=str)


def test_stages_pass_clashing_columns(spark):
    rows = [(1, PROSE, "en", "a", 1), (2, PROSE, "en", None, 1), (3, PROSE + " more", "en", "b", 1), (4, OTHER, "en", "b", 1), (5, "", None, "a", 0), (6, None, None, "a", 0), (7, " ".join(f"z{i}" for i in range(40_000)), "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"mine-{c}") for c in CLASH})
    want = {"quality": None, "exact": [1, 3, 4, 5, 7], "near": [1, 4, 5, 6, 7], "mix": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (df, df.limit(0)):
            out = stage(spark, some, SF)
            assert out.columns == df.columns
            got = out.collect()
            assert all(r[c] == f"mine-{c}" for r in got for c in CLASH)
            if want[name] is not None and some is df:
                assert sorted(r["doc_id"] for r in got) == want[name], name
    encoded = corpus_pipeline.encode(spark, df, SF).collect()
    assert sorted(r["doc_id"] for r in encoded) == [1, 2, 3, 4, 5, 6, 7]

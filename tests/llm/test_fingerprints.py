"""Fingerprints against a plain-Python version."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitgrain.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["near_edited", "near_next", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]


def plain_counts(data):
    out = [0] * fp.BUCKETS
    for i in range(len(data)):
        for second, third in fp.TRIPLETS:
            if i + third < len(data):
                out[int(fp.TABLES[0][data[i]]) ^ int(fp.TABLES[second][data[i + second]]) ^ int(fp.TABLES[third][data[i + third]])] += 1
    return out


def plain_digest(text):
    data = text.encode()
    c = plain_counts(data)
    q = sorted(c)
    q1, q2, q3 = q[63], q[127], q[191]
    codes = [(x > q1) + (x > q2) + (x > q3) for x in c]
    body = bytes(codes[i] * 64 + codes[i + 1] * 16 + codes[i + 2] * 4 + codes[i + 3] for i in range(0, 256, 4))
    ratios = (15 * q1 // q3) * 16 + 15 * q2 // q3 if q3 else 0
    return bytes([min(255, round(4 * np.log2(1 + len(data)))), ratios]).hex() + body.hex()


def plain_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    codes = lambda d: [v >> s & 3 for v in d[2:] for s in (6, 4, 2, 0)]
    score = sum([0, 1, 2, 6][abs(i - j)] for i, j in zip(codes(x), codes(y))) + min(64, 4 * abs(x[0] - y[0])) + 2 * (abs(x[1] // 16 - y[1] // 16) + abs(x[1] % 16 - y[1] % 16))
    return 1 - min(416, score) / 416


def plain(rows):
    rows = sorted(rows)
    out = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        own, other, following = plain_digest(text), plain_digest(new), plain_digest(after)
        out[doc] = (len(text), hashlib.sha256(new.encode()).hexdigest(), own, other, plain_likeness(own, other), plain_likeness(own, following))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    texts = ["", "a", "ab", "abc", "éé", "x" * 300, "日本語のテキスト" * 3, "\n\t", " ".join(rng.choice(vocab) for _ in range(3000))]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += texts[-5:] * 3
    ids = rng.sample(range(-50, 1000), len(texts))
    return list(zip(ids, texts))


def test_against_plain_python(spark, rows):
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "h", "part", "none", "digest", "body")})
    want = plain(rows)
    for n in (1, 5):
        got = fp.fingerprints(df.repartition(n)).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r["doc_id"]]
            assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == w[:4]
            assert (r["near_edited"], r["near_next"]) == pytest.approx(w[4:]) and 0 <= r["near_next"] <= 1


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fp.fingerprints(empty).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(7, "one lonely text of words", "en", None, 1)], SCHEMA)).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_next"]) for r in one] == [(7, 24, 1.0)]
    assert one[0]["edited_sha256"] == hashlib.sha256(b"one lonely text ofone lo").hexdigest()
    odd = [(None, None, None, None, None), (None, "no id", None, None, 1), (3, None, None, None, None), (3, "same text here", "x", None, 1), (3, "same text here", "x", None, 1), (4, "", "x", None, 1)]
    got = fp.fingerprints(spark.createDataFrame(odd, SCHEMA).repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t or "")) for i, t, *_ in odd)
    empty_digest = fp.fingerprint("")
    assert set(bytes.fromhex(empty_digest)) == {0} and {r["fingerprint"] for r in got if not r["n_chars"]} == {empty_digest}


def test_hot_id_and_long_text(spark):
    long = "long words of every kind " * 60_000  # 1.5 MB, many pieces
    rows = [(5, f"copy number {i % 40} of some text", "en", "a", 1) for i in range(400)] + [(6, long, "en", "a", 1), (7, long[:-1] + "!", "en", "a", 1)]
    got = fp.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(got) == 402
    six = next(r for r in got if r["doc_id"] == 6)
    assert six["n_chars"] == len(long) and six["near_next"] > 0.95 and six["fingerprint"] == fp.fingerprint(long)
    assert np.array_equal(fp.counts(long.encode()[: 3 * fp.PIECE]), plain_counts(long.encode()[: 3 * fp.PIECE]))


def test_likeness_tells_edits_from_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = fp.fingerprints(docs).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.98 * len(got)
    by_text = {}
    for r in got:
        by_text.setdefault((r["n_chars"], r["fingerprint"]), r)
    assert np.mean([r["near_edited"] for r in got]) > 0.65 > 0.45 > np.mean([r["near_next"] for r in got])

"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from commitgrain.llm import spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, every=97, times=2, near=None):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{w}".encode()) if doc is not None else 1
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    near = near(n) if near else {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def by_gaps(n):
    """Near words through the words with one letter taken out or left open."""
    at = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            at[w[:i] + "?" + w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for group in at.values():
        for a in group:
            near[a] |= group - {a}
    for w in n:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            if v in near:
                near[v].add(w)
                near[w].add(v)
    return {w: sorted(v) for w, v in near.items()}


def rows_of(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abÉé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["tesselate", "tessellate", "tessallate", "aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "prefix", "prefixx", "prefixed", "prefixes"]
    words = list(base)
    for w in base:  # variants at every kind of place
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :], w + "a", "b" + w]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 120))) for _ in range(80)] + [None, "", "12 ... 34", "x" * 3000 + " and " + "x" * 3000 + " y " + "x" * 2999 + "y", ("x" * 3000 + " ") * 2 + ("x" * 2999 + "y ") * 2]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, texts[1]), (7, texts[1])]
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], SCHEMA).withColumns({c: F.lit("clash") for c in ("word", "n", "id", "run", "p", "c", "near", "form")})
    for every, times in ((97, 2), (5, 3)):
        got = rows_of(spelling.spelling_variants(df.repartition(3), every=every, times=times))
        assert got == plain(rows, every, times) and len(got) > 100
    assert sum(r[3] is not None for r in got) > 20 and any(r[5] not in (r[0], r[3]) for r in got)  # chains of forms too


def test_empty_and_lone(spark):
    assert rows_of(spelling.spelling_variants(spark.createDataFrame([], SCHEMA))) == []
    lone = spark.createDataFrame([(i, "Lonely", "en", None, 1) for i in range(4)], SCHEMA)
    assert rows_of(spelling.spelling_variants(lone, every=10**9)) == [("lonely", 4, 0, None, None, "lonely")]


def test_all_kinds_of_places(spark):
    words = ["abcde", "abcdf", "abcdef", "xabcde", "abde", "abced", "bcdef", "aaaaa", "aaaaaa", "abxcde", "é", "éé", "a"]
    got = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted((r["word"], r["near"]) for r in got) == sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(spelling.spelling_variants(docs)) == plain(rows, near=by_gaps)

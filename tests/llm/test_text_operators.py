"""Brute-force versions of the training-data operators on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commitgrain.llm import _bytes as B
from commitgrain.llm import _bpe, bpe_codec, exact_dedup, line_quality, mixing, ngram_join, ordinal_quality, parse_dedup, sentence_spans, token_counts, warc_zstd
from commitgrain.llm._components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["digest", "size", "bucket", "row", "target", "kept", "rank", "hits", "recipe", "host"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocab) for _ in range(k)).capitalize() + "."
    body = lambda k: " ".join(sentence(rng.randint(4, 14)) for _ in range(k))
    shared = body(8)
    out = ["", None, " \t\n", "a", "One two.", "x" * 300, "ab" * 200, "The " * 150, "é" * 250, "#*$%&|<> " * 5, "line one is here\nline one is here\n\nother", body(400)]
    for _ in range(40):
        out.append(body(rng.randint(1, 30)))
    base = list(out[12:])
    out += [base[0], base[0], base[0].replace(" ", "  "), base[1] + "\n" + shared, shared + "\n" + base[2], base[3] + " " + shared + " " + base[4]]
    long = body(40)
    for _ in range(12):  # near copies of one text
        w = long.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, "en", [None, "b", "a", "ü"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def by_id(texts):
    return {i * 3 + 1: t or "" for i, t in enumerate(texts)}


ALL = {
    "spans": lambda d: sentence_spans.span_dedup(d), "exact": lambda d: exact_dedup.exact_dedup(d), "lines": lambda d: line_quality.line_rules(d), "mix": lambda d: mixing.pareto_mix(d),
    "parse": lambda d: parse_dedup.parse_dedup(d), "join": lambda d: ngram_join.jaccard_join(d), "tokens": lambda d: token_counts.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "codec": lambda d: bpe_codec.round_trip(d, public_tokenizers.path("byte_bpe_50k.json")),
    "quality": lambda d: ordinal_quality.ordinal_quality(d, d.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table_and_one_row_each(spark, docs, by_id, name):
    assert ALL[name](docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, None, None, None), (7, "same text", "x", None, 1), (7, "same text", "x", None, 1)], SCHEMA)
    assert ALL[name](odd).count() == 4
    assert sorted(r["doc_id"] for r in ALL[name](docs).select("doc_id").collect()) == sorted(by_id)


def test_exact(docs, by_id):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in by_id.items()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for mask in (2**64 - 1, 3):  # with two bits, nearly all chunks clash
        got = exact_dedup.exact_dedup(docs, mask=mask).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == {
            i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_exact_with_odd_ids(spark):
    rows = [(None, "one text"), (None, "another text"), (None, ""), (3, None), (3, "one  text"), (3, "another text"), (2, "another\ttext"), (None, "third"), (None, "third")]
    for mask in (2**64 - 1, 3, 0):
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), mask=mask).collect())
        groups = defaultdict(list)
        for i, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        assert got == Counter((i, least[t], len(groups[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in ((i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows))


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 122, 60_000).astype(np.uint8)
    cut = lambda x: {bytes(x[a:b]) for e in [exact_dedup.cut_points(x, np.array([0, len(x)]))] for a, b in zip(np.concatenate([[0], e[:-1]]), e)}
    a, b = cut(body), cut(np.concatenate([body[:7], body]))
    assert len(a & b) > 0.9 * len(a) and max(map(len, a)) <= 8192


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizers(spark, docs, by_id, name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    more = ["a<|endoftext|>b <|startoftext|>", "ΑΣ ΌΣΟΣ İstanbul", "it's we'll I'D\t\r\n 123", "日本語 🎉👨‍👩‍👧 é́ ẞ", "a" * 3000, " " * 40 + "x\n\n", "<|endoftext|><|end"]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    want = {i: lib.encode(t, add_special_tokens=False).ids for i, t in {**by_id, **{10_000 + i: t for i, t in enumerate(more)}}.items()}
    if name.startswith("word"):
        got = token_counts.token_counts(both, path, limit=50).collect()
        assert {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in got} == {i: (len(x), len(x) > 50) for i, x in want.items()}
    else:
        got = {r["doc_id"]: r for r in bpe_codec.round_trip(both, path, with_ids=True).collect()}
        for i, x in want.items():
            assert list(got[i]["ids"]) == x
            assert got[i]["ids_sha256"] == hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()


def test_tokens_of_every_letter():
    """Alone, in words and with marks: the library's tables decide, not Python's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, count = Tokenizer.from_file(path), token_counts.counter(path).count
    points = [chr(c) for c in (*range(0x20000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    blocks = [points[i : i + 128] for i in range(0, len(points), 128)]
    texts = [t for b in blocks for t in (" ".join(b), " ".join(f"Ab{c}" for c in b), " ".join(c + "\u0301" for c in b))]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert count(t) == len(e.ids), ascii(t)


def test_memo_keeps_two_generations():
    made = []
    memo = _bpe.Memo(lambda k: made.append(k) or k * 2, 8)
    for k in range(100):
        assert memo["hot"] == "hothot" and memo[k] == 2 * k
        assert len(memo) + len(memo.older) <= 8
    assert made.count("hot") == 1 and memo[0] == 0 and made.count(0) == 2


def base_counts(t):
    w = WORD.findall(t)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(runs)
    hit = {i + k for i, r in enumerate(runs) if n[r] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_line_rules(spark, docs, by_id):
    got = {r["doc_id"]: r for r in line_quality.line_rules(docs).collect()}
    for i, t in by_id.items():
        c = base_counts(t)
        assert tuple(got[i][k] for k in line_quality.COUNTS) == c
        assert got[i]["base_failed"] == (c[0] < 20 or 100 * c[4] > 30 * c[0])
    common = "This very line is on all of the pages of one host"
    rows = [(i, common + "\n" + " ".join(f"w{i}x{j}" for j in range(k)), "h" if i < 40 else "g") for i, k in [(i, 60 if i % 2 else 8) for i in range(50)]]
    got = {r["doc_id"]: r for r in line_quality.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), least_docs=20, least_words=15).collect()}
    assert all(got[i]["removed_words"] == (12 if i < 40 else 0) for i in got)
    assert all(got[i]["kept"] == (i >= 40 or bool(i % 2)) for i in got)


def test_clean_lines(spark):
    common = "This very  line is on all pages of one host"
    rows = [(i, f"{common if i % 2 else common.upper()}\nbody {i} {'word ' * i}é\n\n{common}" + "\n" * (i % 3), "h" if i < 30 else None) for i in range(35)] + [(90, None, "h"), (91, common, "g"), (92, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("gone", F.lit("clash"))
    got = {r["doc_id"]: r for r in line_quality.clean_lines(df.repartition(3), least_words=5).collect()}
    plain = lambda x: " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in x).split())
    for i, t, h in rows:
        lines = re.findall(r"[^\n]*\n|[^\n]+", t or "")
        assert got[i]["text"] == "".join(x for x in lines if h != "h" or plain(x) != plain(common))
    judged = {r["doc_id"]: r["kept"] for r in line_quality.line_rules(df, least_words=5).collect()}
    assert judged == {i: r["kept"] for i, r in got.items()} and set(judged.values()) == {True, False}
    edge = spark.createDataFrame([(i, common + f" \n{'own ' * 30}{i}", "h") for i in range(20)], "doc_id long, text string, source string")
    assert line_quality.line_rules(edge).agg(F.sum("removed_lines")).first()[0] == 0  # in just as many documents as the limit


def test_mix_meets_targets(docs, by_id):
    for ceiling in (3.0,):
        rows = mixing.pareto_mix(docs, ceiling=ceiling).join(docs.select("doc_id", "source"), "doc_id").collect()
        size = {r["doc_id"]: len(WORD.findall(by_id[r["doc_id"]])) for r in rows}
        assert all(r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
        per = defaultdict(lambda: [0, 0])
        for r in rows:
            per[r["source"]][0] += r["size"]
            per[r["source"]][1] += r["taken"]
        order = sorted(per, key=lambda s: (s is None, s))
        weight, left, stopped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), {}
        while True:
            level = (sum(v[0] for v in per.values()) - sum(stopped.values())) / sum(weight[s] for s in left)
            over = {s for s in left if level * weight[s] > 3 * per[s][0]}
            if not over:
                break
            stopped |= {s: 3 * per[s][0] for s in over}
            left -= over
        want = {s: stopped.get(s, level * weight[s]) for s in order}
        longest = max(size.values())
        for r in rows:
            assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == per[r["source"]][0]
        assert all(abs(per[s][1] - want[s]) <= longest / 2 for s in order)
    again = {r["doc_id"]: r["taken"] for r in mixing.pareto_mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mix_draws_with_the_odds_it_states(spark):
    """600 sources of like documents are 200 draws with each of three targets."""
    sizes = [3, 5, 9, 14, 20, 33, 47, 60, 75, 90, 120, 150, 180, 240, 300, 420]
    rows = [(s * 100 + j, f"s{s:03}", "w " * n) for s in range(600) for j, n in enumerate(sizes)]
    got = mixing.pareto_mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)).withColumn("again", F.col("copies") - F.floor(F.col("target") / F.col("source_size")))
    each = got.groupBy(F.round(F.col("target") / F.col("source_size"), 6).alias("ratio"), "size").agg(F.avg("p").alias("p"), F.stddev_pop("p").alias("same"), F.avg("again").alias("share"), F.count("*").alias("n")).collect()
    assert len(each) == 3 * len(sizes) and all(r["n"] == 200 and r["same"] < 1e-9 for r in each)
    for ratio in {r["ratio"] for r in each}:
        mine = sorted((r for r in each if r["ratio"] == ratio), key=lambda r: r["size"])
        assert sum(r["p"] * r["size"] for r in mine) == pytest.approx((ratio % 1) * sum(sizes), rel=1e-4)  # the expected words are what is left
        assert mine[0]["p"] < mine[-1]["p"]
        assert np.mean([abs(r["share"] - r["p"]) for r in mine]) < 0.06 and all(abs(r["share"] - r["p"]) < 0.16 for r in mine)
        assert np.corrcoef([r["share"] for r in mine], [r["p"] for r in mine])[0, 1] > 0.8
    near = got.groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")).alias("miss")).agg(F.max("miss")).first()[0]
    assert near <= max(sizes) / 2


def test_mix_with_odd_ids(spark):
    rng = random.Random(4)
    words = lambda k: " ".join(rng.choice("abcdef") * 3 for _ in range(k))
    rows = [(None, s, words(rng.randint(5, 80))) for s in "ab" for _ in range(60)] + [(7, s, words(rng.randint(5, 80))) for s in ("c", None) for _ in range(60)] + [(8, "d", "one two three")] * 90 + [(9, "d", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    runs = [mixing.pareto_mix(df.repartition(n)) for n in (1, 5)]
    got = [Counter(tuple(r) for r in m.select("doc_id", "source", "size", "copies").collect()) for m in runs]
    assert got[0] == got[1] and got[0].total() == len(rows)
    for r in runs[0].groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest"), F.count("*").alias("n")).collect():
        assert abs(r["taken"] - r["target"]) <= r["longest"]
    assert runs[0].filter("taken > 3 * size").count() == 0


def without_repeats(rows):
    """Brute force: (doc_id, digest, text) in order -> what is cut from each."""
    seen, out = set(), {}
    for i, digest, t in sorted(set(rows)):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone) if not g)
        out[i, digest] = len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest()
    return out


@pytest.mark.parametrize("hot", [parse_dedup.HOT, 2])
def test_parse_dedup(spark, docs, by_id, hot):
    rng = random.Random(9)
    word = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    shared, edge = word(40), word(9)
    extra = [(5_000 + i, f"{word(rng.randint(3, 30))} {shared} {word(rng.randint(0, 30))}") for i in range(60)]  # a passage in every document
    extra += [(7_000, "A" + shared[:212] + word(60)), (7_000, shared[:212] + word(90) + shared), (7_000, word(50) * 3), (7_000, word(50) * 3)]  # an id with several texts
    extra += [(7_001, edge * 12), (7_002, "zz" + edge * 9), (7_003, "x" * 5_000), (7_004, "y" + "x" * 4_000), (7_005, word(12_000) + shared + "\0" * 150 + word(3_000) + "\0" * 400)]
    extra += [extra[3], extra[-1]]  # rows that repeat
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).repartition(5)
    keyed = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    want = without_repeats([tuple(r) for r in keyed.collect()])
    got = parse_dedup.parse_dedup(df, hot=hot).collect()
    results = Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got)
    assert results == Counter((r["doc_id"], want[r["doc_id"], r["digest"]]) for r in keyed.collect())
    assert sum(r["n_removed"] > 0 for r in got) > 60


def test_parse_dedup_without_ids(spark):
    long = " ".join(f"word{i}" for i in range(100))
    got = parse_dedup.parse_dedup(spark.createDataFrame([(None, long), (None, long), (1, long), (2, "a " + long)], "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == Counter([(None, 0), (None, 0), (1, 0), (2, len(long))])


def test_sentence_spans(docs, by_id):
    got = {r["doc_id"]: r for r in sentence_spans.span_dedup(docs).collect()}
    first = {}
    plans = {}
    for i in sorted(by_id):
        raw, plain = sentence_spans.sentences(by_id[i])
        n = [len(p.split()) for p in plain]
        assert "".join(raw) == by_id[i]
        some = {(a, b) for a in range(len(n)) for b in range(a + 1, len(n) + 1) if sum(n[a:b]) >= 20 and (b - a > 1 or n[a] >= 50)}
        least = [(a, b) for a, b in some if not any((a, c) in some for c in range(a + 1, b)) or not any((c, b) in some for c in range(a + 1, b))]
        plans[i] = raw, plain, sorted(least)
        for a, b in sorted(least):
            first.setdefault(tuple(plain[a:b]), (i, a))
    for i, (raw, plain, least) in plans.items():
        gone = {k for a, b in least if first[tuple(plain[a:b])] != (i, a) for k in range(a, b)}
        assert got[i]["text"] == "".join(r for k, r in enumerate(raw) if k not in gone), i
        assert (got[i]["n_sentences"], got[i]["n_removed"]) == (len(raw), len(gone))
    assert any(r["n_removed"] for r in got.values())


def test_sentence_spans_without_ids(spark):
    run = " ".join(f"One of the sentences that says {w} in a row of ten words." for w in ("this", "that"))
    rows = [(None, f"{run} Then. {run}"), (None, f"{run} Then. {run}"), (4, f"Else. {run}"), (4, f"{run} Then. {run}"), (9, run)]
    got = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, h1 string")
    got = sorted((r["doc_id"] or 0, r["n_sentences"], r["n_removed"], r["text"]) for r in sentence_spans.span_dedup(got).collect())
    once = f"{run} Then. "
    assert got == [(0, 5, 2, once), (0, 5, 2, once), (4, 3, 0, f"Else. {run}"), (4, 5, 2, once), (9, 2, 2, "")]


def shingle_set(t, k=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k=4, pct=85):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(docs, by_id):
    for k, pct in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(docs, k=k, pct=pct).collect()}
        assert got == brute_components(by_id, k, pct)
        assert len({c for _, c in got.values()}) < len(got) - 10


def test_jaccard_join_with_null_ids(spark):
    base = [f"word{i}" for i in range(200)]
    near = lambda *at: " ".join("new" + w if i in at else w for i, w in enumerate(base))
    far = " ".join(f"other{i}" for i in range(200))
    variants = [near(150 + i) for i in range(4)]  # all near each other: whatever leads, each is a member or a leader once
    for nameless in range(4):
        rows = [(None if i == nameless else i + 1, t) for i, t in enumerate(variants)] + [(9, far), (None, far + " end"), (None, variants[nameless])]
        got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        first = min(i for i, _ in rows if i is not None)
        assert got == Counter([(i, 9 if t.startswith(far) else first) for i, t in rows])
    # two documents that only a row without an id brings together, and rows without ids alone
    chain = [near(), near(*range(60, 70)), near(*range(60, 80))]
    rows = [(5, chain[0]), (None, chain[1]), (3, chain[2]), (None, far), (None, far + " end")]
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(5, 3), (None, 3), (3, 3), (None, None), (None, None)])


def linked_groups(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_tree_links_connect_what_is_similar():
    rng = np.random.default_rng(3)
    weight = rng.integers(0, 255, ngram_join.CELLS).astype(np.uint8)
    for turn in range(40):
        base = np.unique(rng.integers(0, 2**62, 150).astype(np.uint64))
        sets = []
        for _ in range(40):
            gone = rng.random(len(base)) < rng.choice([0, 0.02, 0.07, 0.1, 0.2])
            sets.append(np.unique(np.concatenate([base[~gone], rng.integers(0, 2**62, rng.integers(0, 12)).astype(np.uint64)])))
        sets += [base, base[:140], base[:128], base[:1], sets[0], np.unique(rng.integers(0, 2**62, 60).astype(np.uint64))]
        n = len(sets)
        similar = [(a, b) for a in range(n) for b in range(a) for o in [len(np.intersect1d(sets[a], sets[b]))] if 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o)]
        got = ngram_join.tree_links(sets, np.arange(n), 85, weight)
        assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in similar}
        assert linked_groups(n, got) == linked_groups(n, similar) and len(got) == n - len(set(linked_groups(n, similar)))
        label = rng.integers(0, 6, n)  # what is known to be connected already
        known = [(int(np.flatnonzero(label == label[i])[0]), i) for i in range(n)]
        assert linked_groups(n, known + ngram_join.tree_links(sets, label.copy(), 85, weight)) == linked_groups(n, known + similar)


@pytest.mark.parametrize("block", [512, 6])
def test_jaccard_join_in_parts(spark, docs, by_id, monkeypatch, block):
    """Blocks above the bound, of near copies about the similarity."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    rng = random.Random(8)
    base = [f"word{i}" for i in range(160)]
    texts = {}
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([1, 4, 6, 7, 9])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts[i * 7 % 1000] = " ".join(w)
    for k, pct in ((4, 85), (5, 80)):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(df, k=k, pct=pct).collect()}
        assert got == brute_components(texts, k, pct)
        assert 1 < len({c for _, c in got.values()}) < len(texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_components_of_a_shuffled_chain(spark):
    chain = list(range(1000))
    random.Random(4).shuffle(chain)
    got = components(spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == dict.fromkeys(chain, 0)


def test_ordinal_model_learns_and_orders(spark):
    rng = random.Random(2)
    good, bad, worse = ["river", "stone", "cloud", "tree"], "spam", "filth"
    rows, grades = [], []
    for i in range(600):
        g = i % 3
        w = [rng.choice(good) + str(rng.randrange(50)) for _ in range(30)] + [bad] * (g < 2) + [worse] * (g < 1)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        grades.append((i, g))
    docs, ratings = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, grade int")
    w, t = ordinal_quality.fit_model(docs, ratings.filter("doc_id < 450"))
    assert all(np.diff(t) > 0) and (w <= 0).all()
    got = {r["doc_id"]: r for r in ordinal_quality.ordinal_quality(docs, ratings.filter("doc_id < 450")).collect()}
    held = range(450, 600)
    assert np.mean([got[i]["kept"] == (i % 3 == 2) for i in held]) > 0.95
    mean = [np.mean([got[i]["expected_grade"] for i in held if i % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert got == {r["doc_id"]: r for r in ordinal_quality.ordinal_quality(docs.repartition(3), ratings.filter("doc_id < 450")).collect()}
    none = ordinal_quality.ordinal_quality(docs, ratings.limit(0))
    assert none.filter("kept").count() == 600


def plain_grades(text, w, thresholds, least):
    """Features, sum, tails, expected grade and selection of one text."""
    m64 = 2**64 - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    def named(raw, seed):
        total = 0
        for j, b in enumerate(raw):
            total += (mix((b + 1 + seed * 1000003) & m64) | 1) * pow(B._BASE, j, 2**64)
        return mix((total + len(raw)) & m64)

    low = lambda raw: bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    found = [x.encode() for x in WORD.findall(text or "")]
    keys = {named(low(x)[:5], 22) for x in found} | {named(x[-3:], 23) for x in found}
    again = sum(low(a) == low(b) for a, b in zip(found, found[1:]))
    keys |= {part for part in (16, 8, 4, 2) if again * part >= len(found) >= part}
    eta = sum(float(w[i]) for i in {mix(x) >> 44 for x in keys})
    tails = [1 / (1 + np.exp(t - eta)) for t in thresholds]
    bound = least / (1 + np.exp(thresholds[-1]))
    return (sum(tails), tails[-1], bound, tails[-1] >= bound) if found else (0.0, 0.0, bound, False)


def test_ordinal_quality_against_plain_python(spark):
    rng = random.Random(6)
    good, rows = ["River", "stone", "clôud", "TREE"], []
    for i in range(300):
        g = i % 3
        w = [rng.choice(good) + str(rng.randrange(50)) for _ in range(rng.randint(1, 40))] + ["spam"] * (g < 2) + ["filth"] * (g < 1)
        rng.shuffle(w)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w), g))
    rows += [(900, None, None), (901, " \n", None), (902, "spam " * 60, None), (903, "River1 " * 9, None), (904, "x", None), (905, "River2 stone4 " * 40_000 + "filth", None), (0, "spam again", None)]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t, _ in rows], "doc_id long, text string, kept string, threshold double").repartition(3)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if g is not None and i], "doc_id long, grade int")
    w, t = ordinal_quality.fit_model(docs, ratings)
    assert len(t) == 2 and np.count_nonzero(w)
    got = ordinal_quality.ordinal_quality(docs, ratings).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in rows)
    want = defaultdict(list)
    for i, text, _ in rows:
        want[i].append(plain_grades(text, w, t, 0.8))
    for r in got:
        assert any(r["kept"] == k and (r["expected_grade"], r["tail_probability"], r["threshold"]) == pytest.approx((e, p, b), abs=1e-6) for e, p, b, k in want[r["doc_id"]]), r
    share = [np.mean([r["kept"] for r in got if r["doc_id"] < 300 and r["doc_id"] % 3 == g]) for g in range(3)]
    assert share[2] > 0.95 and max(share[:2]) < 0.05
    kept = ordinal_quality.select_good(docs, ratings)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    firsts = np.concatenate([[0], np.cumsum(rng.integers(1, 5, 30))])
    column, grades, share = rng.integers(0, 6, firsts[-1]), rng.integers(0, 3, 30), np.full(30, 1 / 30)
    f = lambda v: ordinal_quality.loss_and_slope(v, (column, firsts), grades, share, 2, 1e-3)
    x = rng.normal(size=8) * 0.5
    for i in range(8):
        e = np.eye(8)[i] * 1e-6
        assert f(x)[1][i] == pytest.approx((f(x + e)[0] - f(x - e)[0]) / 2e-6, abs=1e-5)


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "words and more " * 200 + "</p>"
    rows = [(1, "http://a/ b\r\nX: y", long), (5, None, long), (3, "u", long), (4, "u", "short"), (9, "u", "short"), (2, "u", None), (6, "u", "é" * 500), (7, "u", "é" * 500), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, archive string").repartition(2)
    got = {r["page_id"]: tuple(r)[1:] for r in warc_zstd.pages_through_archives(pages).collect()}
    last = {long: 5, "é" * 500: 7}
    for i, _, h in rows:
        b = (h or "").encode()
        to = last.get(h)
        want = (len(b), hashlib.sha1(b).hexdigest(), "response" if to in (None, i) else "revisit", None if to in (None, i) else to)
        assert got[i] == want
    many = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit(long), F.col("id").cast("string")).alias("html"))
    warc_zstd.write_archives(many, f"file://{tmp_path}/w").count()
    files = list((tmp_path / "w").glob("*.warc.zst"))
    assert files and all(int.from_bytes(f.read_bytes()[:4], "little") == warc_zstd.DICTIONARY_FRAME for f in files)
    back = warc_zstd.read_archives(spark, f"file://{tmp_path}/w")
    assert {r["page_id"]: bytes(r["payload"]) for r in back.select(warc_zstd.page_number("record_id").alias("page_id"), "payload").collect()} == {i: f"{long}{i}".encode() for i in range(300)}
    assert warc_zstd.pages_through_archives(pages.limit(0)).count() == 0


def test_every_archive_has_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    noise = lambda k: "".join(chr(rng.randrange(33, 0x2FF)) for _ in range(k))
    cases = {"one": [(1, "u", "tiny")], "empty": [(1, None, None)], "long": [(i, "u", noise(200_000)) for i in range(5)], "many": [(i, "u", f"<html>{i} some page of the site</html>" * 5) for i in range(200)]}
    for name, rows in cases.items():
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        warc_zstd.write_archives(pages, f"file://{tmp_path}/{name}").count()
        (file,) = (tmp_path / name).glob("*.warc.zst")
        assert int.from_bytes(file.read_bytes()[:4], "little") == warc_zstd.DICTIONARY_FRAME and int.from_bytes(file.read_bytes()[4:8], "little") > 0
        back = warc_zstd.read_archives(spark, f"file://{tmp_path}/{name}").select(warc_zstd.page_number("record_id").alias("i"), "payload").collect()
        assert {r["i"]: bytes(r["payload"]).decode() for r in back} == {i: h or "" for i, _, h in rows}


def test_warc_keeps_repeated_rows(spark, tmp_path, monkeypatch):
    long = "<p>" + "words and more " * 200 + "</p>"
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([(i, "u", f"{long}{i}") for i in range(20)], schema).coalesce(1)
    twins = spark.createDataFrame(spark.sparkContext.parallelize([(1, "u", "short")] * 2, 2), schema)
    for name, df in (("pages", pages), ("twins", twins)):
        df.write.parquet(f"{tmp_path}/{name}")
    pages, twins = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("pages", "twins"))
    for df in (pages.union(pages), twins):  # small files: the groups are broadcast and rows stay in their partitions
        assert df.rdd.getNumPartitions() == 2
        got = Counter(r["page_id"] for r in warc_zstd.pages_through_archives(df).collect())
        assert got == Counter(r["page_id"] for r in df.collect())
    # one task that fills several files with equal records
    places = []
    monkeypatch.setattr(warc_zstd, "FILE_BYTES", 1)
    monkeypatch.setattr(warc_zstd, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 3})())}))
    monkeypatch.setattr(warc_zstd, "write_file", lambda fs, folder, records, place: places.append(place) or (place, len(records)))
    batch = pa.record_batch({"page_id": [1, 1], "url": ["u", "u"], "html": pa.array([b"x", b"x"]), "sha1": [hashlib.sha1(b"x").hexdigest()] * 2, "refers": pa.array([None, None], pa.int64())})
    list(warc_zstd._writer("file:///tmp")([batch]))
    assert len(set(places)) == 2


def test_bad_archives():
    good = warc_zstd.encode_record("response", "urn:page:1", "u", hashlib.sha1(b"hello").digest(), b"hello")
    assert warc_zstd.decode_record(good)["payload"] == b"hello"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"hello", b"jello"), good.replace(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b""), good.replace(b"Content-Length: 5", b"Content-Length: 6"), good + b"x"):
        with pytest.raises(warc_zstd.BadArchive):
            warc_zstd.decode_record(bad)
    import zstandard

    whole = zstandard.ZstdCompressor().compress(good)
    assert len(list(warc_zstd.frames(memoryview(whole + whole)))) == 2
    for bad in (whole[:-3], whole + b"abc", b"\x5d\x2a\x4d\x18\xff\x00\x00\x00a"):
        with pytest.raises(warc_zstd.BadArchive):
            list(warc_zstd.frames(memoryview(bad)))


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"one two  one\ttwo one two", np.uint8)
    starts, ends, firsts = B.words(data, np.array([0, 12, 12, len(data)]))
    h = B.span_hashes(data, starts, ends)
    assert list(firsts) == [0, 3, 3, 6] and h[0] == h[2] == h[4] and h[1] == h[3] == h[5] != h[0]
    runs, at = B.windows(h, firsts, 2)
    assert list(at) == [0, 1, 3, 4] and runs[0] == runs[3] and runs[1] != runs[0]

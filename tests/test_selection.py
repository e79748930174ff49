"""Selection of percentiles, cross products and even windows, by brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitgrain.functions import text
from commitgrain.operators import gram, history, selection

PS = [0.0, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


def columns_of_all_kinds(n=900):
    rng = random.Random(8)
    return {
        "ties": [float(rng.randint(-3, 3)) for _ in range(n)], "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(n)], "normal": [rng.gauss(1e9, 1e-3) for _ in range(n)],
        "heavy": [rng.paretovariate(0.3) for _ in range(n)], "holes": [rng.random() if rng.random() < 0.3 else None for _ in range(n)], "none": [None] * n, "one": [7.5] * n,
        "odd": [rng.choice([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, 2.0]) for _ in range(n)], "powers": [2.0 ** rng.randint(-40, 40) * (1 - rng.choice((0, 2**-53))) for _ in range(n)],
    }


@pytest.mark.parametrize("pick,parts", [(10_000, 4096), (4, 8)])
def test_selection_is_percentile(spark, monkeypatch, pick, parts):
    monkeypatch.setattr(selection, "PICK", pick)
    monkeypatch.setattr(selection, "PARTS", parts)
    data = columns_of_all_kinds()
    names = list(data)
    rows = [(i % 3 if i % 7 else None, *v) for i, v in enumerate(zip(*data.values()))]
    df = spark.createDataFrame(rows, "column long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    for by in ([], ["column"]):
        if by:
            df, by = df.withColumnRenamed("column", "grp"), ["grp"]
        used = [c for c in names if c != "none"]
        want = {}
        for r in df.groupBy(*by).agg(*[F.percentile(c, F.array(*map(F.lit, PS))).alias(c) for c in used]).collect():
            for c in used:
                want[(*[r[b] for b in by], c)] = r[c]
        got = {(*[r[b] for b in by], r["column"]): r["q"] for r in selection.percentiles(df, names, PS, by).collect()}
        assert got.keys() == {k for k, v in want.items() if v is not None}
        for k in got:
            assert all(a == b or math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-15) for a, b in zip(got[k], want[k])), k
    assert selection.percentiles(df.limit(0), names, PS).count() == 0


def test_gram_is_pearson(spark):
    rng = np.random.default_rng(3)
    n, names = 500, [f"c{i}" for i in range(12)]
    x = rng.normal(size=(n, 12)) @ rng.normal(size=(12, 12)) + 1e6
    x[:, 3] = 5.0
    there = rng.random((n, 12)) < 0.9
    there[:, 4] = False
    rows = [tuple(float(v) if t else None for v, t in zip(a, b)) for a, b in zip(x, there)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    for parts in (1, 5):
        got = {(r["a"], r["b"]): r["r"] for r in gram.correlations(df.repartition(parts), names).collect()}
        assert len(got) == 66
        for i in range(12):
            for j in range(i + 1, 12):
                both = there[:, i] & there[:, j]
                if 3 in (i, j) or 4 in (i, j):
                    assert got[names[i], names[j]] is None
                else:
                    assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    wide = spark.range(200).select(*[(F.rand(i) * 10).alias(f"w{i}") for i in range(300)])
    assert gram.correlations(wide, wide.columns).count() == 300 * 299 // 2


@pytest.fixture(scope="module")
def commits(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        author = "bot" if i % 4 == 0 else rng.choice(["a", "b", None])
        second = rng.choice([0, 3600, 86_400, rng.randrange(90 * 86_400)])
        rows.append((rng.choice(["r", "s"]), f"c{i:04d}", "f", author, second, rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "repo string, commit string, filepath string, author_email string, s long, v long")
    return df.withColumn("canonical_datetime", F.timestamp_seconds("s")).repartition(4), rows


def test_even_windows(commits):
    df, rows = commits
    ties = ["commit", "filepath"]
    key = lambda r: (r[4], r[1])
    exp = {r["commit"]: r["e"] for r in history.prior_experience(df, ["repo", "author_email"], "canonical_datetime", ties, "e").collect()}
    act = {r["commit"]: r["a"] for r in history.recent_activity(df, ["author_email"], "canonical_datetime", ties, 1, "a").collect()}
    churn = {r["commit"]: r["c"] for r in history.recent_churn(df, ["author_email"], "canonical_datetime", ties, 30, "v", "v", "c").collect()}
    capped = {r["commit"]: r["k"] for r in history.capped_experience(df, last=50, out="k").collect()}
    assert len(exp) == len(act) == len(churn) == len(capped) == len(rows)
    order = {repo: sorted((r for r in rows if r[0] == repo), key=key) for repo in "rs"}
    for r in rows:
        mine = [q for q in rows if q[3] == r[3] and key(q) < key(r)]
        assert exp[r[1]] == sum(q[0] == r[0] for q in mine)
        assert act[r[1]] == sum(q[4] >= r[4] - 86_400 for q in mine)
        assert churn[r[1]] == sum(2 * q[5] for q in mine if q[4] >= r[4] - 30 * 86_400)
        at = order[r[0]].index(r)
        assert capped[r[1]] == sum(q[3] == r[3] for q in order[r[0]][max(0, at - 50) : at])


def test_no_window_over_a_whole_author(commits):
    """Windows over keys alone see the table of buckets only, in which a key's
    rows are summed before."""
    df, _ = commits
    out = history.recent_activity(history.prior_experience(df, ["repo", "author_email"], "canonical_datetime", ["commit"]), ["author_email"], "canonical_datetime", ["commit"], 7)
    plan = out._jdf.queryExecution().analyzed().toString()
    for line in plan.split("\n"):
        if "Window [" in line:
            parts = re.search(r"windowspecdefinition\((.*?) ASC", line)[1]
            assert "_b#" in parts or "_before" in line or "_sum" in line, line


def test_rows_without_a_time_come_first(spark):
    df = spark.createDataFrame([("u", None, "a"), ("u", None, "b"), ("u", 5, "c")], "k string, s long, t string").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["e"] for r in history.prior_experience(df, ["k"], "ts", ["t"], "e").orderBy("t").collect()] == [0, 1, 2]
    assert [r["a"] for r in history.recent_activity(df, ["k"], "ts", ["t"], 1, "a").orderBy("t").collect()] == [0, 1, 0]


def test_terms_are_found_in_tasks_from_texts_made_once(spark):
    """Texts give the terms that arrays of them give, and are made in one pass."""
    texts = spark.range(40).select(F.concat_ws(" ", F.lit("the alpha be_ta x"), F.concat(F.lit("w"), F.col("id") % 7), F.when(F.col("id") % 3 == 0, "café alpha")).alias("t")).unionByName(spark.sql("select cast(null as string) t"))
    want = text.heavy_terms(texts.select(text.terms(F.col("t")).alias("terms")), 9).collect()
    assert text.heavy_terms(texts, 9, stop_words=text.STOP_WORDS).collect() == want
    made = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda t: (made.add(1), t)[1])
    assert len(text.fit_vocabulary(texts.repartition(2).select(mark("t").alias("t")), "t", 9).collect()) == 9
    assert made.value == 41

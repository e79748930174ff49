"""Whitening against exact sums in plain Python and a library's eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitgrain.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(vectors, components=32):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > d * np.finfo(float).eps * e[0]).sum()))
    centred = np.array([[float(Fraction(n * a - t, n)) for a, t in zip(r, s)] for r in x])
    return n, [sum((n * a - t) ** 2 for a, t in zip(r, s)) for r in x], centred @ q[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def check(rows, got, good):
    n, deviation, white, explained = plain([v for _, v in good])
    assert len(got) == len(good) * white.shape[1]
    at = {i: k for k, (i, _) in enumerate(good)}
    table = np.zeros_like(white)
    for r in got:
        k = at[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation[k])
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) and r["identity_error"] <= 1e-9
        table[k, r["component"] - 1] = r["whitened"]
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * sign).max() < 1e-8
    assert np.abs(table.T @ table / n - np.eye(white.shape[1])).max() < 1e-9


def test_against_exact_sums(spark):
    rng = np.random.default_rng(4)
    for width, n in ((5, 40), (40, 90)):
        v = rng.normal(size=(n, width)) * np.linspace(1, 4, width) + 3
        good = [(i * 3, v[i].tolist()) for i in range(n)]
        bad = [(1, None), (4, [None] + [0.0] * (width - 1)), (7, [float("nan")] * width), (10, [float("inf")] + [1.0] * (width - 1)), (13, [1.0]), (16, [])]
        df = spark.createDataFrame([(i, x, 0) for i, x in good + bad], SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "n", "component", "place", "amount", "width")})
        for parts in (1, 4):
            check(df, w.whiten(df.repartition(parts)).collect(), good)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert w.whiten(make([])).count() == 0 and w.whiten(make([(1, None, 0)])).count() == 0
    assert w.whiten(make([(1, [1.0, 2.0], 0)])).count() == 0 and w.whiten(make([(1, [1.0, 2.0], 0)] * 5)).count() == 0
    # repeated and null ids count as rows; a dimension without variance has no component
    got = w.whiten(make([(1, [1.0, 5.0], 0), (1, [1.0, 5.0], 0), (None, [3.0, 5.0], 0), (2, [4.0, 5.0], None)])).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == [("1", 1, 4), ("1", 1, 4), ("2", 1, 4), ("None", 1, 4)]
    assert np.var([r["whitened"] for r in got]) == pytest.approx(1)
    with pytest.raises(Exception, match="too large"):
        w.whiten(make([(1, [1e300], 0), (2, [0.0], 0)])).collect()


def test_large_entries_stay_exact():
    y = np.array([[2.0**30 + 1, -3.0], [2.0**27 - 1, 2.0**29]])
    want = [sum(int(r[i]) * int(r[j]) for r in y) for i, j in ((0, 0), (0, 1), (1, 1))]
    assert w.exact_products(y).tolist() == want
    small = np.random.default_rng(2).integers(-5000, 5000, (700, 4)).astype(float)
    assert w.exact_products(small).tolist() == [int(x) for x in (small.T @ small)[np.triu_indices(4)]]


@pytest.mark.parametrize("kind", ["random", "clusters", "graded", "rank", "diagonal", "same"])
def test_divide_and_conquer(kind):
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    d = {"random": rng.random(24), "clusters": np.repeat([5.0, 1.0, 0.0], 8), "graded": 10.0 ** -np.arange(24), "rank": np.r_[1.0, 2.0, np.zeros(22)], "diagonal": np.arange(24.0), "same": np.full(24, 2.0)}[kind]
    a = np.diag(d) if kind == "diagonal" else q @ np.diag(d) @ q.T
    e, v = w.eigen(a)
    assert np.abs(e - np.sort(d)[::-1]).max() < 1e-13 * max(d) * 10 and np.abs(v.T @ v - np.eye(24)).max() < 1e-13
    assert np.abs((a + a.T) / 2 @ v - v * e).max() < 1e-13 * max(d) * 10
    if kind == "random":
        u = w.polar_factor(a - np.eye(24) * 0.5)
        assert np.abs(u @ u - np.eye(24)).max() < 1e-13


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in table.collect()]
    check(table, w.whiten(table).collect(), rows)

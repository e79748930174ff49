"""Hand cases: ties, bounds, nulls, empty tables, fit and apply kept apart."""

import math
import re

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Observation
from pyspark.sql import functions as F

from commitgrain.functions import patches, text
from commitgrain.operators import cells, embed, evaluate, features, history, hygiene, models, profile
from commitgrain.sources import tables


def commits(spark, rows):
    return spark.createDataFrame(rows, "repo string, commit string, filepath string, author_email string, canonical_datetime timestamp, loc_added long, loc_deleted long")


def at(day, hour=0):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


def test_windows_with_ties_and_exact_bound(spark):
    c = commits(spark, [("r", "a", "f", "u", at(0), 1, 0), ("r", "b", "f", "u", at(0), 2, 0), ("r", "c", "f", "u", at(30), 4, 0), ("r", "d", "f", "u", at(30, 1), 8, 0)])
    got = history.recent_churn(c, ["repo", "author_email"], "canonical_datetime", ["commit", "filepath"], 30)
    assert {r["commit"]: r["recent_churn"] for r in got.collect()} == {"a": 0, "b": 1, "c": 3, "d": 4}
    got = history.recent_activity(c, ["author_email"], "canonical_datetime", ["commit", "filepath"], 30)
    assert {r["commit"]: r["author_recent_activity_pre"] for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 1}


def test_window_does_not_depend_on_partitions(spark):
    rows = [("r", f"{i:03}", "f", f"u{i % 3}", at(i % 40, i % 2), i, i % 5) for i in range(200)]
    run = lambda n: {r["commit"]: r["recent_churn"] for r in history.recent_churn(commits(spark, rows).repartition(n), ["repo", "author_email"], "canonical_datetime", ["commit"], 7).collect()}
    assert run(1) == run(7)


def test_root_commit_has_no_gap(spark):
    meta = spark.createDataFrame([("r", "a", at(1), []), ("r", "b", at(0), ["a"]), ("r", "c", at(2), ["missing"])], "repo string, commit string, canonical_datetime timestamp, parents array<string>")
    assert {r["commit"]: r[2] for r in history.seconds_since_parent(meta).collect()} == {"a": None, "b": -86400, "c": None}


def test_filters(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, -1.0)], "k int, v double")
    assert [r["k"] for r in hygiene.drop_invalid(df, {"v": lambda c: c >= 0}).collect()] == [1]
    assert hygiene.invalid_counts(df, {"v": lambda c: c >= 0}).first()["dropped"] == 2
    with pytest.raises(ValueError):
        hygiene.drop_invalid(df, {"w": lambda c: c > 0})
    with pytest.raises(ValueError):
        hygiene.only_repos(df.withColumn("repo", F.lit("a")), ["b"], spark.createDataFrame([("a",)], "repo string"))
    with pytest.raises(ValueError):
        hygiene.require_columns(df, ["x"])


@pytest.mark.parametrize(("patch", "want"), [("@@ -1,2 +3,2 @@", [3, 4]), ("@@ -1 +7 @@ x", [7]), ("@@ -1,2 +9,0 @@", []), ("no header", []), ("@@ -1 +1 @@\n@@ -5,2 +6,2 @@", [1, 6, 7])])
def test_hunk_lines(spark, patch, want):
    assert spark.createDataFrame([(patch,)], "p string").select(patches.changed_lines(F.col("p"))).first()[0] == want


def test_patch_counts(spark):
    p = "--- a\n+++ b\n@@ -1,2 +1,3 @@\n+todo Retry\n x\n-y\n+try"
    df = spark.createDataFrame([(p,)], "p string")
    r = df.select(patches.added_lines(F.col("p")), patches.deleted_lines(F.col("p")), patches.hunks(F.col("p")), patches.token_counts(F.col("p"))["try"]).first()
    assert tuple(r) == (2, 1, 1.0, 2)


def test_message_cleaning_keeps_its_side_effects(spark):
    df = spark.createDataFrame([("Fixes #12: added a.cpp http://x/y\r\ngit-svn-id: z",)], "m string")
    assert df.select(text.clean_message(F.col("m"))).first()[0] == "fixes    a pp"
    cases = {"See www.example.org/x": "see www example org x", "A\tB\n\nC": "a\tb\n\nc", "x git-svn-id: a\rb\nc": "x \nc", "ÉTÉ 12 #7 deadbeef https://u/v w": "t" + " " * 8 + "w"}
    for raw, want in cases.items():
        assert spark.createDataFrame([(raw,)], "m string").select(text.clean_message(F.col("m"))).first()[0] == want


def test_buckets_are_left_closed(spark):
    edges = {"loc_added": {-1.0: None, 0.0: "very_small", 2.9: "very_small", 3.0: "small", 6.0: "medium", 9.9: "medium", 10.0: "large", 19.9: "large", 20.0: "very_large", 1e9: "very_large", None: None},
             "author_exp_pre": {-0.1: None, 0.0: "junior", 0.9: "junior", 1.0: "mid", 4.9: "mid", 5.0: "senior", 1e9: "senior", None: None}}
    for name, want in edges.items():
        df = spark.createDataFrame([(x,) for x in want], f"{name} double")
        assert [r[1] for r in features.bucketize(df).collect()] == list(want.values())
        hot = features.one_hot(features.bucketize(df)).drop(name)
        assert hot.columns == [f"{name}_bucket_{x}" for x in dict.fromkeys(v for v in want.values() if v)]
        assert [sum(r) for r in hot.collect()] == [v is not None for v in want.values()]


def test_fit_ignores_what_it_is_applied_to(spark, tmp_path):
    train = spark.createDataFrame([(float(i), 1.0, i) for i in range(10)], "x double, one double, tok long")
    fitted = features.fit(train, ["x", "one"], ["tok"])
    assert fitted.constant == ["one"]
    fitted.save(spark, f"{tmp_path}/f")
    again = features.Fitted.load(spark, f"{tmp_path}/f")
    assert again == fitted
    out = again.transform(spark.createDataFrame([(1e9, 5.0, 3), (None, 5.0, 0)], "x double, one double, tok long")).collect()
    assert out[0]["x"] == pytest.approx(math.log1p(fitted.limits["x"][1]))
    assert out[1]["x"] is None and "one" not in out[0].asDict()


def test_missing_token_column(spark):
    with pytest.raises(ValueError):
        features.token_ratios(spark.createDataFrame([(1,)], "loc_added int"), ["todo"])
    assert features.derive(spark.createDataFrame([(1,)], "loc_added int")).columns == ["loc_added"]
    out = features.token_ratios(spark.createDataFrame([(2, 3)], "todo int, fixme int"), ["todo", "fixme"])
    assert out.columns == ["todo", "fixme", "line_token_total"] and out.first()[2] == 5


def test_subsets_share_what_train_gave(spark, tmp_path):
    words = ["parser", "socket", "cache", "loader"]
    rows = [(i, float(i % 9), i % 3, f"{words[i % 4]} {words[(i + 1) % 4]} the {'fix ' * (i % 2)}", [float(i % 5), float(i % 7), 1.0], [float(i % 2), float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x double, tok int, message string, code_embed array<double>, msg_embed array<double>")
    at_ = f"{tmp_path}/f"
    run = lambda d, subset: features.transform_subset(d, subset, at_, ["x"], ["tok"])
    train = run(df, "train")
    assert {"k", "x", "tok", "tfidf_fix", "tfidf_parser socket", "code_emb_0", "code_emb_2", "msg_emb_1"} <= set(train.columns) and not {"message", "code_embed", "msg_embed"} & set(train.columns)
    other = run(df.filter("k = 3"), "val")
    assert other.columns == train.columns and other.collect() == train.filter("k = 3").collect()
    norm = sum(v * v for c, v in other.first().asDict().items() if c.startswith("tfidf_"))
    assert norm == pytest.approx(1)
    unseen = run(df.filter("k = 3").withColumn("message", F.lit("unknown words")), "test").first().asDict()
    assert all(v == 0 for c, v in unseen.items() if c.startswith("tfidf_"))
    with pytest.raises(ValueError):
        run(df, "holdout")


def test_approximate_percentiles(spark):
    df = spark.range(1, 2001).select((F.col("id") % 1000).cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    exact, close = (profile.outlier_report(df, ["x"], ["g"], approx=a).orderBy("g").collect() for a in (None, 10_000))
    for a, b in zip(exact, close):
        assert b["median"] == pytest.approx(a["median"], abs=2) and b["outliers"] == a["outliers"] and b["mean"] == a["mean"]
    assert profile.describe(df, {"x": F.col("x")}, approx=10_000).first()["p50"] == pytest.approx(499.5, abs=2)


def test_rows_are_rechecked(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "v double")
    assert hygiene.drop_invalid(df, {"v": lambda c: c >= 0}, recheck=True).count() == 1
    answers = iter([lambda c: F.lit(True), lambda c: c >= 0])  # a rule that does not hold what it lets through
    with pytest.raises(ValueError):
        hygiene.drop_invalid(df, {"v": lambda c: next(answers)(c)}, recheck=True)


def test_constant_and_empty_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert profile.correlations(df, ["a", "b"]).first()["r"] is None
    assert profile.target_correlations(df, ["a"], "b").count() == 0
    assert [r["column"] for r in profile.constant_columns(df, ["a", "b"]).collect()] == ["a"]
    empty = df.limit(0)
    assert profile.duplicate_key_rows(empty, ["a"]).first()[0] == 0
    assert profile.describe(empty, {"a": F.col("a")}).first()["mean"] is None


def test_one_class_scores(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 1, 0.9)], "model string, y int, score double")
    assert evaluate.roc_auc(df).first()["auc"] is None
    assert evaluate.best_mcc_threshold(df).first()["mcc"] == 0
    assert evaluate.best_f_threshold(df).first()["threshold"] == 0.2
    r = {x["class"]: x for x in evaluate.report(evaluate.classify(df, 0.5)).collect()}
    assert r["0"]["precision"] == 0 and r["1"]["recall"] == 0.5 and r["1"]["support"] == 2


def test_auc_is_the_rank_sum(spark):
    rows = [("m", i % 3 == 0 and 1 or 0, (i * 7 % 11) / 10) for i in range(60)]
    auc = evaluate.roc_auc(spark.createDataFrame(rows, "model string, y int, score double")).first()["auc"]
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    assert auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


def test_pca_is_centred_and_orthogonal(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7), float(i % 3)]) for i in range(40)], "k int, e array<double>")
    model = embed.fit_pca(df, "e", 2)
    out = embed.apply_pca(df, model, "e", "pc")
    m = out.agg(F.avg("pc_0"), F.avg("pc_1"), F.corr("pc_0", "pc_1"), F.var_pop("pc_0"), F.var_pop("pc_1")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1]) < 1e-9 and abs(m[2]) < 1e-9 and m[3] >= m[4]
    assert 0 < embed.explained_variance(model) <= 1
    with pytest.raises(ValueError):
        embed.explained_variance(None)
    with pytest.raises(ValueError):
        embed.width_of(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "e array<double>"), "e")


def test_components_by_an_eigensolver(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 3
    y = [int(i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist(), c) for i, (v, c) in enumerate(zip(x, y))], "k int, code_embed array<double>, msg_embed array<double>, label int")

    def components(rows, k):
        at, vectors = np.linalg.eigh(np.cov(rows.T))
        vectors = vectors[:, ::-1][:, :k]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(k)])
        return (x if rows.shape[1] == 6 else rows) @ vectors - rows.mean(0) @ vectors, at[::-1][:k].sum() / at.sum()

    model = embed.fit_pca(df.filter("k % 5 <> 0"), "code_embed", 4)
    train = x[[i for i in range(200) if i % 5]]
    want, explained = components(train, 4)
    got = embed.apply_pca(df, model, "code_embed", "pc").orderBy("k").select(*[f"pc_{i}" for i in range(4)]).toPandas().to_numpy()
    assert got == pytest.approx(want, abs=1e-9) and embed.explained_variance(model) == pytest.approx(explained)
    fitted = features.fit(df.filter("k % 5 <> 0"), [], [], arrays=features.ARRAYS)  # 60 and 80 of 6 places
    both = fitted.transform(df).orderBy("k").toPandas()
    assert both[[f"code_emb_{i}" for i in range(6)]].to_numpy() == pytest.approx(components(train, 6)[0], abs=1e-9)
    assert np.abs(both[[f"msg_emb_{i}" for i in range(6)]].to_numpy()) == pytest.approx(np.abs(components(train, 6)[0]), abs=1e-9)
    flat = embed.apply_pca(df, embed.fit_pca(df, "code_embed", 2), "code_embed", "pc").select("k", "label", F.array("pc_0", "pc_1").alias("pc"))
    p, far = components(x, 2)[0], lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).mean()
    zero, one = p[[c == 0 for c in y]], p[[c == 1 for c in y]]
    assert tuple(embed.class_distances(flat, "k", "pc", "label").first()) == pytest.approx((far(zero, one), far(zero, zero), far(one, one)))


@pytest.mark.parametrize("rows", [1, 2, 32])
def test_token_means_do_not_depend_on_batches(spark, rows):
    def model():
        def states(ids, mask):
            assert ids.shape == mask.shape and len(ids) <= rows and mask.any(0).all() and mask.shape[1] <= 5
            return np.where(mask, ids, 1_000_000)[:, :, None] * np.array([1.0, -2.0])  # padding would show

        return lambda text: [len(w) for w in text.split()], states

    texts = ["a bb ccc", "", None, " ", "dddd", " ".join("x" * k for k in range(1, 14)), "a bb ccc", "ee ee ee ee ee"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    for whole in (False, True):
        got = {r["k"]: r["embedding"] for r in embed.embed_texts(df, "k", "t", embed.token_means(model, 5, rows, whole)).collect()}
        for i, text in enumerate(texts):
            sizes = [len(w) for w in (text or "").split()][: None if whole else 5]
            assert got[i] == pytest.approx([np.mean(sizes), -2 * np.mean(sizes)] if sizes else [])


def test_structure_of_changed_functions(spark):
    old = "def f(a):\n    return a\n"
    new = "def f(a):\n    if a and a > 1:\n        return 1\n    return a\n"
    p = spark.createDataFrame([("r", "c", "x.py", "@@ -1,2 +1,4 @@", old, new), ("r", "c", "y.md", "@@ -1 +1 @@", old, new), ("r", "d", "z.py", "@@ -1 +1 @@", None, "def (")],
                              "repo string, commit string, path string, patch string, old_text string, new_text string")
    got = {r["commit"]: tuple(r)[2:] for r in embed.structural_delta(p).collect()}
    assert got["c"][1:] == (2, 4) and got["c"][0] > 0 and got["d"] == (0, 0, 0)
    gone = p.limit(1).withColumns({"new_text": F.lit(None).cast("string"), "path": F.lit("gone.py")})
    assert embed.structural_delta(gone).count() == 0  # a file that is gone does not count
    shrunk = p.filter("path = 'x.py'").withColumns({"old_text": F.col("new_text"), "new_text": F.col("old_text")})
    assert embed.structural_delta(shrunk).first()["max_func_change"] == 2  # the new side's function
    code = "def f(a):\n    for i in a:\n        pass\n    else:\n        pass\n    b = [x for x in a if x if not x]\n    match a:\n        case 1:\n            pass\n        case 2:\n            pass\n"
    assert embed._structure(code, {1})[1] == 1 + 2 + 3 + 2


def test_versions_and_resume(spark, tmp_path):
    at_ = f"{tmp_path}/v"
    assert tables.latest_version(spark, at_) is None
    spark.range(1).write.parquet(f"{tmp_path}/odd/version=x")
    assert tables.latest_version(spark, f"{tmp_path}/odd") is None
    assert [tables.write_next(spark.range(n), at_) for n in (3, 5)] == [1, 2]
    assert tables.read_latest(spark, at_).count() == 5


def test_split_is_stable_and_complete(spark):
    df = spark.range(1000)
    a = {r["id"]: r["is_test"] for r in models.split(df.repartition(1), ["id"]).collect()}
    assert a == {r["id"]: r["is_test"] for r in models.split(df.repartition(5), ["id"]).collect()}
    assert 120 < sum(a.values()) < 280


def test_refine_and_importance(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i % 7), i % 2) for i in range(200)], "k int, good double, noise double, label int")
    model = models.fit(df, ["good", "noise"], models.random_forest(5, 3, "all"))
    imp = models.permutation_importance(model, df, ["k"])
    assert imp.first()["feature"] == "good" and models.refine(imp, 0.1) == ["good"]


def test_importance_scores_all_features_from_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCK_ROWS", 30)
    df = spark.createDataFrame([(i, float(i % 2), float(i % 7), float(i), i % 2) for i in range(200)], "k int, good double, noise double, place double, label int")
    names = ["good", "noise", "place"]
    rows = models.permuted(df, names, ["k"], 2)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    got = {}
    for r in rows.collect():
        got.setdefault(r["feature"], []).append((r["label"], *r["features"].toArray()))
    want = sorted((i % 2, i % 2, i % 7, i) for i in range(200))
    assert sorted(got[-1]) == want
    for i, name in enumerate(names):
        assert len(got[i]) == 400
        kept = lambda r, i=i: (r[0], *[x for j, x in enumerate(r[1:]) if j != i])
        assert sorted(map(kept, got[i])) == sorted([kept(w) for w in want] * 2)  # only the feature changed rows
        assert sorted(r[1 + i] for r in got[i]) == sorted([w[1 + i] for w in want] * 2)
    assert sum(r[3] % 2 != r[0] for r in got[2]) > 100  # values came from other rows
    model = models.fit(df, names, models.random_forest(5, 3, "all"))
    imp = models.permutation_importance(model, df, ["k"])
    assert imp.first()["feature"] == "good" and imp.count() == 3
    # brute force over the same rows
    acc = {i: sum(p["prediction"] == p["label"] for p in model.stages[1].transform(rows.filter(F.col("feature") == i)).collect()) / len(got[i]) for i in got}
    for r in imp.collect():
        assert r["importance"] == pytest.approx(acc[-1] - acc[names.index(r["feature"])])
    assert models.permutation_importance(model, df.limit(0), ["k"]).count() == 0


def test_patience_ends_at_the_round_a_loop_finds(spark):
    df = spark.createDataFrame([(i, (i * 37 % 101) / 101, (i * 53 % 97) / 97, int((i * 37 % 101) + (i * 7919 % 83) > 90)) for i in range(600)], "k int, a double, b double, label int")
    train, held, names = df.filter("k % 3 <> 0"), df.filter("k % 3 = 0"), ["a", "b"]
    made = models.boosted_trees(3000, 3, 0.3)
    model = models.fit_with_patience(train, names, made, held, patience=5, first=4)
    whole = models.fit(train, names, made.copy({made.maxIter: 32}))
    losses = []
    for k in range(1, 33):  # each prefix by itself
        margin = models.truncated(whole.stages[1], k).transform(whole.stages[0].transform(held)).select("label", "rawPrediction").collect()
        losses.append(sum(2 * math.log1p(math.exp(-2 * (2 * r["label"] - 1) * r["rawPrediction"][1])) for r in margin) / len(margin))
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        if i - best >= 5:
            break
    assert model.stages[1].getNumTrees == best + 1 < 27
    a, b = (sorted((r["k"], r["score"]) for r in models.predict(m, held).select("k", "score").collect()) for m in (model, models.PipelineModel([whole.stages[0], models.truncated(whole.stages[1], best + 1)])))
    assert a == b
    assert models.best_round([3, 2, 2, 2, 1], 2) == (2, True) and models.best_round([3, 2, 1], 2) == (3, False) and models.best_round([1.0], 1) == (1, False)


def test_pruned_forest_is_the_tree_cut_by_hand(spark, tmp_path):
    node = "struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
    leaf = lambda i, n: (i, float(i), 0.1, [float(n), 0.0], n, -1.0, -1, -1, (-1, [], -1))
    inner = lambda i, n, a, b: (i, float(i), 0.2, [n / 2, n / 2], n, 0.5, a, b, (0, [0.5], -1))
    tree = [inner(0, 100, 1, 6), inner(1, 9, 2, 3), leaf(2, 4), inner(3, 5, 4, 5), leaf(4, 2), leaf(5, 3), inner(6, 91, 7, 8), leaf(7, 40), leaf(8, 51)]
    table = spark.createDataFrame([(0, n) for n in tree] + [(1, leaf(0, 3))], f"treeID int, nodeData {node}")
    got = lambda least: [(r["treeID"], r["nodeData"]["rawCount"], r["nodeData"]["leftChild"], r["nodeData"]["rightChild"], r["nodeData"]["split"]["featureIndex"]) for r in models.prune_nodes(table, least).orderBy("treeID", "nodeData.id").collect()]
    assert got(5) == [(0, 100, 1, 6, 0), (0, 9, 2, 3, 0), (0, 4, -1, -1, -1), (0, 5, 4, 5, 0), (0, 2, -1, -1, -1), (0, 3, -1, -1, -1), (0, 91, 7, 8, 0), (0, 40, -1, -1, -1), (0, 51, -1, -1, -1), (1, 3, -1, -1, -1)]
    assert got(6) == [(0, 100, 1, 4, 0), (0, 9, 2, 3, 0), (0, 4, -1, -1, -1), (0, 5, -1, -1, -1), (0, 91, 5, 6, 0), (0, 40, -1, -1, -1), (0, 51, -1, -1, -1), (1, 3, -1, -1, -1)]
    assert got(101) == [(0, 100, -1, -1, -1), (1, 3, -1, -1, -1)]
    df = spark.createDataFrame([(i, float(i % 13), float(i % 7), int(i % 13 > i % 7)) for i in range(400)], "k int, a double, b double, label int")
    whole = models.fit(df, ["a", "b"], models.random_forest(4, 8))
    few, none = models.pruned(whole.stages[1], [40, 10_000])
    assert few.totalNumNodes < whole.stages[1].totalNumNodes and none.totalNumNodes == 4
    ready = whole.stages[0].transform(df)
    assert few.transform(ready).filter("prediction = label").count() > 300
    table.unpersist()


def test_leaves_keep_their_shares(spark):
    """Leaves of one class side by side stay apart: scores are those of the means."""
    df = spark.createDataFrame([(i, float(i % 13), float(i % 7), int((i * 7919) % 100 < 5 + 3 * (i % 13)), 1.0 + i % 3) for i in range(600)], "k int, a double, b double, label int, w double")
    for made in (models.random_forest(1, 3, "all").setBootstrap(False), models.random_forest(3, 4, "all", min_rows=3, weight="w").setBootstrap(False)):
        model = models.fit(df, ["a", "b"], made)
        means = RandomForestRegressor(labelCol="label", numTrees=made.getNumTrees(), maxDepth=made.getMaxDepth(), featureSubsetStrategy="all", minInstancesPerNode=made.getMinInstancesPerNode(), seed=models.SEED, bootstrap=made.getBootstrap())
        means = means.setWeightCol("w") if made.isDefined("weightCol") else means
        with models.dealt(df, ["a", "b"], made, ["k"]) as ready:
            want = {r["k"]: r["prediction"] for r in means.fit(ready).transform(ready).collect()}
        got = models.predict(model, df).collect()
        assert [r["score"] for r in got] == pytest.approx([want[r["k"]] for r in got])
        assert all(r["predicted"] == (r["score"] > 0.5) for r in got if abs(r["score"] - 0.5) > 1e-9)
        assert model.stages[1].numClasses == 2 and not model.stages[1].hasSummary and sum(model.stages[1].featureImportances) == pytest.approx(1)
    one = models.predict(models.fit(df.withColumn("label", F.lit(0)), ["a"], models.random_forest(2, 2)), df).agg(F.max("score"), F.max("predicted")).first()
    assert tuple(one) == (0.0, 0)
    with pytest.raises(ValueError, match="0 and 1"):
        models.fit(df.withColumn("label", F.lit(2)), ["a"], models.random_forest(2, 2))


def test_cross_validation_and_search(spark):
    df = spark.createDataFrame([(i, float(i % 2) + (i % 10 == 0), float(i % 7), i % 2) for i in range(300)], "k int, x double, noise double, label int")
    rows = models.cross_validate(df, ["x", "noise"], models.boosted_trees(3, 2), ["k"], 3, validation=df.filter("k < 30"))
    got = {r["fold"]: r for r in rows.collect()}
    assert set(got) == {-1, 0, 1, 2} and got[-1]["auc"] == pytest.approx(sum(got[k]["auc"] for k in range(3)) / 3) and got[-1]["auc"] > 0.8
    # each fold again by hand
    folded = models.with_folds(df, ["k"], 3)
    forest = models.random_forest(3, 2)
    plain = {r["fold"]: r for r in models.cross_validate(df, ["x", "noise"], forest, ["k"], 3).collect()}
    for k in range(3):
        p = models.predict(models.fit(folded.filter(F.col("fold") != k), ["x", "noise"], forest), folded.filter(F.col("fold") == k)).collect()
        tp, fp, fn = (sum(r["label"] == a and r["predicted"] == b for r in p) for a, b in ((1, 1), (0, 1), (1, 0)))
        assert (plain[k]["precision"], plain[k]["recall"]) == (pytest.approx(tp / (tp + fp)), pytest.approx(tp / (tp + fn)))
    best = models.grid_search(df, ["x", "noise"], forest, {"maxDepth": [1, 2], "numTrees": [1, 3]}, ["k"], 2).collect()
    assert len(best) == 4 and [r["score"] for r in best] == sorted((r["score"] for r in best), reverse=True)
    sizes = lambda g: math.prod(len(v) for v in g.values())
    assert sizes(models.FOREST_GRID) == 36 and sizes(models.BOOSTED_GRID) == 48


def test_mcc_evaluator(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 4
    df = spark.createDataFrame([(float(y), float(p)) for y, p in pairs], "label double, prediction double")
    assert models.MccEvaluator().evaluate(df) == pytest.approx((6 * 4 - 3 * 2) / math.sqrt(9 * 8 * 7 * 6))


def test_scores_below_zero_count(spark):
    df = spark.createDataFrame([("m", 0, -0.5), ("m", 0, -0.1), ("m", 1, 0.7), ("m", 0, 0.8)], "model string, y int, score double")
    best = evaluate.best_mcc_threshold(df).first()
    assert best["mcc"] == pytest.approx((1 * 2 - 1 * 0) / math.sqrt(2 * 1 * 3 * 2))


def test_commits_count_once(spark):
    c = commits(spark, [("r", "a", "f", "u", at(0), 1, 0), ("r", "a", "g", "u", at(0), 2, 0), ("r", "b", "f", "u", at(1), 4, 0), ("r", "b", "g", "u", at(1), 8, 0)])
    got = history.recent_churn(c, ["repo", "author_email"], "canonical_datetime", ["commit", "filepath"], 30, distinct_commits=True)
    assert {(r["commit"], r["filepath"]): r["recent_churn"] for r in got.collect()} == {("a", "f"): 0, ("a", "g"): 0, ("b", "f"): 1, ("b", "g"): 1}


def test_forests_after_a_session_has_observed(spark):
    """A session that observes metrics cannot send what holds the session."""
    rows = spark.createDataFrame([(i, i % 7 / 7, i * 31 % 11 / 11, int(i % 7 > 3)) for i in range(300)], "id long, a double, b double, label int")
    before = models.fit(rows, ["a", "b"], models.random_forest(5, 3))
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 300
    assert models.predict(before, rows).filter("predicted = label").count() > 290
    after = models.fit(rows, ["a", "b"], models.random_forest(5, 3))
    assert not after.stages[1].hasSummary
    assert models.predict(after, rows).filter("predicted = label").count() > 290
    assert models.cross_validate(rows, ["a", "b"], models.random_forest(5, 3), ["id"], 2).count() == 3
    assert models.permutation_importance(after, rows, ["id"]).first()["feature"] == "a"
    assert models.grid_search(rows, ["a", "b"], models.random_forest(5, 3), {"maxDepth": [1, 3]}, ["id"], 2).count() == 2


def test_trees_are_fitted_to_cells(spark, monkeypatch):
    """What a tree reads follows the bins of the rows, not their number."""
    df = spark.range(3000).selectExpr("id", "cast(id % 5 as double) a", "cast(id % 4 as double) b", "cast(id % 5 + id * 7 % 3 > 3 as int) label")
    seen, fit = [], RandomForestRegressor.fit

    def counted(self, dataset, *rest):
        seen.append(dataset.count())
        return fit(self, dataset, *rest)

    monkeypatch.setattr(RandomForestRegressor, "fit", counted)
    for made in (models.random_forest(3, 3), models.boosted_trees(3, 2)):
        seen.clear()
        good = models.predict(models.fit(df, ["a", "b"], made), df).filter("predicted = label").count()
        assert good > 2300 and len(seen) == 3 and max(seen) <= 40


def test_draws_of_a_cell_are_those_of_its_rows(spark):
    """Sums of a row's draws: mean and variance of Poisson's or the binomial."""
    held = spark.range(400).selectExpr("cast(cast(id as string) as binary) code", "1.0D label", "1.0D weight", "100L rows")
    for rate, repeats, mean, variance in ((1.0, True, 100, 100), (0.8, False, 80, 16)):
        got = [x for r in held.select(cells.draws(7, rate, repeats).alias("d")).collect() for x in r["d"]]
        assert sum(got) / len(got) == pytest.approx(mean, rel=0.01)
        assert sum((x - mean) ** 2 for x in got) / len(got) == pytest.approx(variance, rel=0.15)
        again = held.repartition(7).select("code", cells.draws(7, rate, repeats).alias("d"))
        assert sorted(x for r in again.collect() for x in r["d"]) == sorted(got)


def test_importance_counts_cells_before_it_scores(spark, monkeypatch):
    """As many rows are scored as there are cells, and a row crosses once."""
    monkeypatch.setattr(models, "BLOCK_ROWS", 100)
    df = spark.range(3000).selectExpr("id", "cast(id % 5 as double) a", "cast(if(id % 4 = 3, null, id % 4) as double) b", "cast(id % 5 + id * 7 % 3 > 3 as int) label")
    model, seen = models.fit(df, ["a", "b"], models.random_forest(3, 3)), []
    whole = type(model.stages[1]).transform

    def counted(self, dataset, *rest):
        seen.append(dataset.count())
        return whole(self, dataset, *rest)

    rows = models.permuted(df.withColumn("b", F.coalesce("b", F.lit(math.nan))), ["a", "b"], ["id"], 2)
    acc = {r["feature"]: r["acc"] for r in model.stages[1].transform(rows).groupBy("feature").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc")).collect()}
    monkeypatch.setattr(type(model.stages[1]), "transform", counted)
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(model, df, ["id"]).collect()}
    assert got["a"] == pytest.approx(acc[-1] - acc[0]) and got["b"] == pytest.approx(acc[-1] - acc[1])
    assert len(seen) == 1 and seen[0] <= 3 * 40
    seen.clear()
    cells_of = models.predict_cells(model, df)
    assert seen[0] <= 40
    monkeypatch.undo()
    want = {(r["label"], r["predicted"], r["score"]): r["count"] for r in models.predict(model, df).groupBy("label", "predicted", "score").count().collect()}
    assert {(r["label"], r["predicted"], r["score"]): r["rows"] for r in cells_of.groupBy("label", "predicted", "score").agg(F.sum("rows").alias("rows")).collect()} == want


def test_blocks_are_mixed_whole_wherever_batches_end(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cells, "TASK_ROWS", 7)
    rng = np.random.default_rng(1)
    table = pa.table({"block": np.repeat(np.arange(9), 11), "k0": rng.integers(0, 1 << 62, 99), "x0": rng.random(99), "x1": rng.random(99), "label": (rng.random(99) > 0.5).astype("f8")})
    total = lambda size: sorted((k, sum(r["rows"] for r in rows if (r["label"], r["feature"], r["code"]) == k)) for rows in [[r for b in cells.mix([[0.3, 0.6], [0.5]], 1)(iter(table.to_batches(size))) for r in b.to_pylist()]] for k in {(r["label"], r["feature"], r["code"]) for r in rows})
    assert total(5) == total(13) == total(99) and sum(n for _, n in total(5)) == 3 * 99


def test_folds_and_grids_are_scored_by_cells(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "cast(id % 5 as double) a", "cast(id % 4 as double) b", "cast(id % 5 + id * 7 % 3 > 3 as int) label")
    seen, whole = [], RandomForestClassificationModel.transform

    def counted(self, dataset, *rest):
        seen.append(dataset.count())
        return whole(self, dataset, *rest)

    monkeypatch.setattr(RandomForestClassificationModel, "transform", counted)
    models.cross_validate(df, ["a", "b"], models.random_forest(2, 2), ["id"], 2)
    models.grid_search(df, ["a", "b"], models.random_forest(2, 2), {"maxDepth": [1, 2]}, ["id"], 2)
    assert len(seen) == 6 and max(seen) <= 40


def test_losses_of_held_cells_are_those_of_rows(spark):
    df = spark.range(900).selectExpr("id", "cast(id % 5 as double) a", "cast(id * 7 % 11 as double) b", "cast(id % 5 + id * 7 % 3 > 3 as int) label", "1.0D + id % 3 w")
    made, train, held = models.boosted_trees(4, 2, weight="w"), df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    both = models.number_columns(train, ["a", "b"], made).unionByName(models.number_columns(held, ["a", "b"], made, F.lit(True)))
    found = cells.Cells(both, 32)
    run = models.CellBoosting(found, made)
    run.run(4)
    with models.dealt(held, ["a", "b"], made) as rows:
        assert run.losses() == pytest.approx(run.model().evaluateEachIteration(rows)) and found.held.count() < 200 < rows.count()
    run.close()
    found.close()


def test_trailing_sums_take_one_exchange(spark):
    rows = [("r", f"c{i:03}", "f", None if i % 5 == 0 else f"u{i % 2}", None if i % 31 == 0 else at(i * 7 % 40, i % 3), i, None if i % 4 == 0 else 1) for i in range(200)]
    c = commits(spark, rows).persist()
    got = history.recent_activity(c, ["author_email"], "canonical_datetime", ["commit", "filepath"], 7)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    key = lambda r: (r[4], r[1])
    for r in got.collect():
        if r["canonical_datetime"] is None:
            want = sum(o[4] is None and o[3] == r["author_email"] and o[1] < r["commit"] for o in rows)
        else:
            want = sum(o[4] is not None and o[3] == r["author_email"] and key(o) < (r["canonical_datetime"], r["commit"]) and (r["canonical_datetime"] - o[4]).total_seconds() <= 7 * 86400 for o in rows)
        assert r["author_recent_activity_pre"] == want
    first = history.prior_experience(c.filter("canonical_datetime is not null"), ["repo", "author_email"], "canonical_datetime", ["commit", "filepath"])
    for r in first.collect():
        assert r["author_exp_pre"] == sum(o[4] is not None and o[3] == r["author_email"] and key(o) < (r["canonical_datetime"], r["commit"]) for o in rows)
    c.unpersist()

"""Queries over feature transforms, models and evaluation (F, M, E)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgrain.operators import evaluate, features, history, models, stages
from commitgrain.plans import fixtures as fx
from commitgrain.plans.fixtures import KEYS, sql
from commitgrain.sources.tables import work_dir

NUM = ["qty", "price", "disc", "tax"]
D = 6
KEY = ["k1", "k2", "price"]


def rounded(df, *names, d=D):
    return df.withColumns({c: F.round(c, d) for c in names})


def train(n: DataFrame) -> DataFrame:
    return n.filter("k1 % 5 <> 0")


def table(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with two token columns."""
    return fx.numbers(spark, d).withColumns({"todo": F.pmod("k1", F.lit(4)), "fixme": F.col("k2").cast("long"), "same": F.lit(7.0)})


def f1(spark, d):
    n = fx.numbers(spark, d)
    return rounded(features.winsorize(n, train(n), NUM).groupBy("grp").agg(*[F.min(c).alias(f"{c}_min") for c in NUM], *[F.max(c).alias(f"{c}_max") for c in NUM], F.count("disc").alias("n")), *[f"{c}_{m}" for c in NUM for m in ("min", "max")])


def f2(spark, d):
    fitted = features.Fitted({"qty": (float("-inf"), float("inf"))}, ["disc"])  # without fences
    return rounded(fitted.transform(fx.numbers(spark, d)).select("k1", "k2", "price", "qty", "disc"), "qty", "disc")


def f3(spark, d):
    return rounded(features.variances(table(spark, d), ["qty", "tax", "same"]), "variance", d=4)


def f4(spark, d):
    n = fx.numbers(spark, d)
    return features.quantile_flag(n, train(n), "price").groupBy("grp").agg(F.sum("extreme_churn_flag").alias("flagged"), F.count(F.lit(1)).alias("n"))


def f8(spark, d):
    """Fitted on one part, saved, loaded and applied to the other."""
    t, at = table(spark, d), work_dir(spark, "f8")
    features.fit(train(t), ["qty", "price", "tax", "same"], ["todo", "fixme"]).save(spark, at)
    out = features.Fitted.load(spark, at).transform(t.filter("k1 % 5 = 0"))
    return rounded(out.drop("ts", "disc"), "qty", "price", "tax", "todo", "fixme")


#: The columns of `numbers` that stand for those of the stages.
STAGED = {"qty": "loc_added", "disc": "loc_deleted", "tax": "author_exp_pre", "price": "author_recent_activity_pre"}


def f8_stages(spark, d):
    """All stages in one model: fitted on one part, saved, loaded, applied."""
    t = table(spark, d).withColumn("paid", F.col("price")).withColumnsRenamed(STAGED).drop("ts")
    at = work_dir(spark, "f8-stages")
    stages.preprocessing([*STAGED.values(), "same"], ["todo", "fixme"], interactions=["loc_added", "author_exp_pre"]).fit(train(t)).write().save(at)
    out = PipelineModel.load(at).transform(t.filter("k1 % 5 = 0"))
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double" and c != "paid"])


def engineered(spark, d):
    c = history.prior_experience(fx.commits(spark, d), ["repo", "author_email"], "canonical_datetime", ["commit", "filepath"])
    return history.recent_activity(c, ["author_email"], "canonical_datetime", ["commit", "filepath"], 7)


def f9(spark, d):
    return rounded(features.derive(engineered(spark, d)).select(*KEYS, "loc_churn_ratio", "activity_per_exp"), "loc_churn_ratio", "activity_per_exp")


def f10(spark, d):
    return features.bucketize(engineered(spark, d).withColumn("loc_added", F.col("loc_added") - 1)).select(*KEYS, "loc_added_bucket", "author_exp_pre_bucket")


def f11(spark, d):
    c = features.one_hot(features.bucketize(engineered(spark, d).withColumn("loc_added", F.col("loc_added") - 1)))
    return c.select(*KEYS, *[x for x in c.columns if "_bucket_" in x])


def f12(spark, d):
    t = table(spark, d).withColumn("loc_added", F.col("qty"))
    return rounded(features.token_ratios(t, ["todo", "fixme"]).select(*KEY, "line_token_total", "todo_ratio", "fixme_ratio"), "todo_ratio", "fixme_ratio")


def f13(spark, d):
    return rounded(features.interactions(fx.numbers(spark, d), ["qty", "disc", "tax"]).select(*KEY, "qty_x_disc", "qty_x_tax", "disc_x_tax"), "qty_x_disc", "qty_x_tax", "disc_x_tax")


def small(spark, d):
    """All rows without nulls in the discount, and a fold of ten for each."""
    return models.with_folds(fx.numbers(spark, d).withColumn("disc", F.coalesce("disc", F.lit(0.0))), KEY, 10)


def forest():
    return models.random_forest(10, 5)


def counted(scored):
    """Rows and mean score by label and prediction."""
    return scored.groupBy("label", "predicted").agg(F.sum("rows").alias("n"), (F.sum(F.col("score") * F.col("rows")) / F.sum("rows")).alias("score"))


def m2(spark, d):
    n = models.split(small(spark, d), KEY)
    model = models.fit(n.filter("is_test = 0"), NUM, models.random_forest(100, 10))
    return counted(models.predict_cells(model, n.filter("is_test = 1")))


def m3(spark, d):
    n = models.with_weights(small(spark, d))
    model = models.fit_with_patience(n.filter("fold <> 0"), NUM, models.boosted_trees(weight="weight"), n.filter("fold = 0"))
    return counted(models.predict_cells(model, n))


def m5(spark, d):
    return models.cross_validate(small(spark, d).drop("fold"), NUM, models.random_forest(5, 4), KEY, 3)


def m6(spark, d):
    return models.grid_search(small(spark, d).drop("fold"), NUM, models.random_forest(5, 4), {"maxDepth": [2, 4], models.MIN_SPLIT: [2, 5, 10]}, KEY, 2)


def m7(spark, d):
    return models.grid_search(small(spark, d).drop("fold"), NUM, models.boosted_trees(5, 3), {"stepSize": [0.05, 0.1]}, KEY, 2, "auc")


def m8(spark, d):
    n = small(spark, d)
    return models.permutation_importance(models.fit(n, NUM, forest()), n, KEY)


def m9(spark, d):
    n = small(spark, d)
    names = models.refine(m8(spark, d), 0.0) or NUM
    model = models.fit(n, names, forest())
    return models.predict_cells(model, n, []).groupBy("predicted").agg(F.sum("rows").alias("n"), F.lit(len(names)).alias("features"))


def m10(spark, d):
    n = small(spark, d)
    return models.predict(models.fit(n, NUM, forest()), n).select(*KEY, "predicted", "score")


def m11(spark, d):
    n, at = small(spark, d), work_dir(spark, "m11")
    models.save(models.fit(n, NUM, forest()), at)
    model = models.load(at)
    return models.predict(model, n.select(*KEY, *[c for c in models.model_columns(model) if c not in KEY])).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


#: Columns with fewer values than Spark has bins, so that it tries every cut.
STEPS = ["disc", "tax", "line", "half"]


def steps(spark, d):
    return small(spark, d).drop("fold").withColumns({"line": F.col("k2").cast("double"), "half": F.floor(F.col("qty") / 2).cast("double")})


def one_tree(depth):
    """A forest of one tree over all rows and columns: nothing is left to chance."""
    return models.random_forest(1, depth, "all").setBootstrap(False)


def m2_tree(spark, d):
    """Fitted on one part, saved, loaded, applied to all."""
    n, at = models.split(steps(spark, d), ["k1", "k2"]), work_dir(spark, "m2-tree")
    models.save(models.fit(n.filter("is_test = 0"), STEPS, one_tree(2)), at)
    return rounded(models.predict(models.load(at), n).select(*KEY, "is_test", "predicted", "score"), "score")


def m3_rounds(spark, d):
    n = models.split(steps(spark, d), ["k1", "k2"])
    model = models.fit(n.filter("is_test = 0"), STEPS, models.boosted_trees(2, 2, sample=1.0, features="all"))
    return rounded(models.predict(model, n).select(*KEY, "is_test", "predicted", "score"), "score")


def m5_trees(spark, d):
    return rounded(models.cross_validate(steps(spark, d), STEPS, one_tree(2), ["k1", "k2"], 3), "auc", "precision", "recall", "f1")


def m6_depths(spark, d):
    return rounded(models.grid_search(steps(spark, d), STEPS, one_tree(2), {"maxDepth": [1, 2]}, ["k1", "k2"], 2), "score")


def scores(spark, d):
    return fx.predictions(spark, d)


def e1(spark, d):
    return evaluate.classify(scores(spark, d), 0.6)


def e2(spark, d):
    return rounded(evaluate.roc_curve(scores(spark, d)), "fpr", "tpr")


def e3(spark, d):
    return rounded(evaluate.roc_auc(scores(spark, d)), "auc")


def e4(spark, d):
    return rounded(evaluate.pr_curve(scores(spark, d)), "precision", "recall")


def e56(beta):
    return lambda spark, d: rounded(evaluate.best_f_threshold(scores(spark, d), beta), "threshold", "f")


def e7(spark, d):
    return rounded(evaluate.best_mcc_threshold(scores(spark, d)), "threshold", "mcc")


def e8(spark, d):
    return rounded(evaluate.report(e1(spark, d)), "precision", "recall", "f1")


def e9(spark, d):
    r = evaluate.evaluate_models(scores(spark, d))
    return rounded(r, *[c for c in r.columns if c != "model"])


CURVE = """c AS (SELECT model, score AS threshold, sum(count(*) FILTER (y = 1)) OVER w AS tp, sum(count(*) FILTER (y = 0)) OVER w AS fp, sum(count(*) FILTER (y = 1)) OVER e AS pos, sum(count(*) FILTER (y = 0)) OVER e AS neg
    FROM predictions GROUP BY model, score WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY model))"""
PR = f"{CURVE}, pr AS (SELECT model, threshold, tp / (tp + fp) AS p, tp / nullif(pos, 0) AS r FROM c)"
FB = lambda b: f"SELECT model, threshold, round({1 + b * b} * p * r / ({b * b} * p + r + 1e-10), 12) AS f FROM pr QUALIFY row_number() OVER (PARTITION BY model ORDER BY f DESC, threshold) = 1"
MCC = """g AS (SELECT model, k / 99.0 AS threshold, count(*) FILTER (y = 1 AND score >= k / 99.0 - 1e-10) AS tp, count(*) FILTER (y = 0 AND score >= k / 99.0 - 1e-10) AS fp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
    FROM predictions, range(100) r(k) GROUP BY model, k),
    m AS (SELECT model, threshold, round(coalesce((tp * (neg - fp)::DOUBLE - fp * (pos - tp)::DOUBLE) / nullif(sqrt((tp + fp)::DOUBLE * pos * neg * (pos - tp + neg - fp)), 0), 0), 12) AS mcc FROM g QUALIFY row_number() OVER (PARTITION BY model ORDER BY mcc DESC, threshold) = 1)"""
AUC = """SELECT model, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rk FROM predictions) GROUP BY model"""
REPORT = lambda src: f"""SELECT model, unnest([{{'class': '1', 'precision': p1, 'recall': r1, 'f1': f1, 'support': pos}}, {{'class': '0', 'precision': p0, 'recall': r0, 'f1': f0, 'support': neg}},
    {{'class': 'accuracy', 'precision': acc, 'recall': acc, 'f1': acc, 'support': pos + neg}}, {{'class': 'macro', 'precision': (p0 + p1) / 2, 'recall': (r0 + r1) / 2, 'f1': (f0 + f1) / 2, 'support': pos + neg}},
    {{'class': 'weighted', 'precision': (p0 * neg + p1 * pos) / (pos + neg), 'recall': (r0 * neg + r1 * pos) / (pos + neg), 'f1': (f0 * neg + f1 * pos) / (pos + neg), 'support': pos + neg}}], max_depth := 2) FROM
    (SELECT model, tp + fn AS pos, tn + fp AS neg, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
     coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0, (tp + tn) / (tp + tn + fp + fn) AS acc FROM
     (SELECT model, count(*) FILTER (y = 1 AND q = 1) AS tp, count(*) FILTER (y = 0 AND q = 1) AS fp, count(*) FILTER (y = 1 AND q = 0) AS fn, count(*) FILTER (y = 0 AND q = 0) AS tn FROM {src} GROUP BY model))"""  # noqa: E731
LIMITS = lambda c, s="numbers": f"SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {s} WHERE k1 % 5 <> 0"
CLIP = lambda c: f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT lo FROM l_{c})), (SELECT hi FROM l_{c})) END"
K = 'repo, "commit", filepath'
ENGINEERED = """x AS (SELECT *, row_number() OVER (PARTITION BY repo, author_email ORDER BY canonical_datetime, "commit", filepath) - 1 AS e,
    count(*) OVER (PARTITION BY author_email ORDER BY canonical_datetime RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY author_email, canonical_datetime ORDER BY "commit", filepath ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM commits)"""
BUCKETS = """CASE WHEN l < 0 THEN NULL WHEN l < 3 THEN 'very_small' WHEN l < 6 THEN 'small' WHEN l < 10 THEN 'medium' WHEN l < 20 THEN 'large' ELSE 'very_large' END AS loc_added_bucket,
    CASE WHEN e < 1 THEN 'junior' WHEN e < 5 THEN 'mid' ELSE 'senior' END AS author_exp_pre_bucket"""
LABELS = {"loc_added": ("very_small", "small", "medium", "large", "very_large"), "author_exp_pre": ("junior", "mid", "senior")}

#: Bucket edges and labels, as fixed values of the features; the last is open.
EDGES = {"loc_added": (0, 3, 6, 10, 20), "author_exp_pre": (0, 1, 5)}
HOT = ", ".join(f"coalesce(CAST({c} >= {a} AND {c} < {b} AS INT), 0) AS {c}_bucket_{x}" for c, e in EDGES.items() for a, b, x in zip(e, (*e[1:], "'inf'::DOUBLE"), LABELS[c]))
STAGES = f"""WITH {', '.join(f'l_{c} AS ({LIMITS(c)})' for c in STAGED)},
    x AS (SELECT k1, k2, grp, label, price AS paid, {', '.join(f'ln(1 + {CLIP(c)}) AS {n}' for c, n in STAGED.items())}, ln(1 + k1 % 4) AS todo, ln(1 + k2) AS fixme FROM numbers WHERE k1 % 5 = 0),
    y AS (SELECT *, loc_added / (loc_deleted + 1) AS loc_churn_ratio, author_recent_activity_pre / (author_exp_pre + 1) AS activity_per_exp, todo + fixme AS line_token_total,
        todo / (loc_added + 1) AS todo_ratio, fixme / (loc_added + 1) AS fixme_ratio, loc_added * author_exp_pre AS loc_added_x_author_exp_pre FROM x)
    SELECT k1, k2, grp, label, paid, {HOT}, {', '.join(f'round({c}, 6) AS {c}' for c in (*STAGED.values(), 'todo', 'fixme', 'loc_churn_ratio', 'activity_per_exp', 'line_token_total', 'todo_ratio', 'fixme_ratio', 'loc_added_x_author_exp_pre'))} FROM y"""

STEP_ROWS = """s AS (SELECT k1, k2, price, label, CAST('0x' || substring(md5(k1 || '|' || k2 || '|42'), 1, 8) AS BIGINT) AS number,
    [coalesce(disc, 0), tax, k2, floor(qty / 2)]::DOUBLE[] AS f FROM numbers)"""


def tree(source, depth, name):
    """Tables that end in `name`: source (model, train, f, t) with leaf, the mean
    t of a row's leaf in a tree that cuts each node where squares fall most."""
    out = [f"{name}_0 AS (SELECT *, 1 AS node FROM {source})"]
    for k in range(depth):
        out.append(f"""{name}_v{k} AS (SELECT model, node, i, f[i] AS cut, count(*) AS n, sum(t) AS s FROM {name}_{k}, range(1, 5) r(i) WHERE train GROUP BY ALL),
    {name}_c{k} AS (SELECT model, node, i, cut, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER e AS n2, sum(s) OVER e AS s2 FROM {name}_v{k} WINDOW w AS (PARTITION BY model, node, i ORDER BY cut), e AS (PARTITION BY model, node, i)),
    {name}_b{k} AS (SELECT model, node, i, cut FROM {name}_c{k} WHERE n < n2 QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY s * s / n + (s2 - s) * (s2 - s) / (n2 - n) DESC, i, cut) = 1),
    {name}_{k + 1} AS (SELECT a.* EXCLUDE (node), coalesce(2 * node + CAST(f[i] > cut AS INT), 2 * node) AS node FROM {name}_{k} a LEFT JOIN {name}_b{k} USING (model, node))""")
    out.append(f"{name} AS (SELECT * EXCLUDE (node), avg(t) FILTER (train) OVER (PARTITION BY model, node) AS leaf FROM {name}_{depth})")
    return ",\n    ".join(out)


FOLDS = lambda k: f"x AS (SELECT model, label AS y, label::DOUBLE AS t, f, number % {k} <> model AS train FROM s, range({k}) r(model))"
TRAIN = "x AS (SELECT 0 AS model, *, label::DOUBLE AS t, number % 100 >= 20 AS train FROM s)"
ROUNDS = f"""x AS (SELECT 0 AS model, *, 2.0::DOUBLE * label - 1 AS t, number % 100 >= 20 AS train FROM s), {tree('x', 2, 'one')},
    y AS (SELECT * EXCLUDE (leaf, t), leaf AS one, 4 * t / (1 + exp(2 * t * leaf)) AS t FROM one), {tree('y', 2, 'two')}"""
MEAN_MCC = lambda name, depth: f"""SELECT 'maxDepth={depth}' AS setting, avg(mcc) AS score FROM (SELECT model, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM
    (SELECT model, count(*) FILTER (y = 1 AND leaf > 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND leaf > 0.5)::DOUBLE AS fp, count(*) FILTER (y = 1 AND leaf <= 0.5)::DOUBLE AS fn, count(*) FILTER (y = 0 AND leaf <= 0.5)::DOUBLE AS tn FROM {name} WHERE NOT train GROUP BY model))"""  # noqa: E731

QUERIES = {
    "f1_winsorize": (f1, sql("numbers", f"WITH {', '.join(f'l_{c} AS ({LIMITS(c)})' for c in NUM)} SELECT grp, {', '.join(f'round(min({CLIP(c)}), 6) AS {c}_min, round(max({CLIP(c)}), 6) AS {c}_max' for c in NUM)}, count(disc) AS n FROM numbers GROUP BY grp")),
    "f2_log1p": (f2, sql("numbers", "SELECT k1, k2, price, round(ln(1 + qty), 6) AS qty, round(ln(1 + disc), 6) AS disc FROM numbers")),
    "f3_variances": (f3, sql("numbers", """SELECT 'qty' AS "column", round(var_pop(qty), 4) AS variance FROM numbers UNION ALL SELECT 'tax', round(var_pop(tax), 4) FROM numbers UNION ALL SELECT 'same', 0.0""")),
    "f4_quantile_flag": (f4, sql("numbers", "WITH l AS (SELECT quantile_cont(price, 0.95) AS q FROM numbers WHERE k1 % 5 <> 0) SELECT grp, CAST(sum(CAST(price > q AS INT)) AS BIGINT) AS flagged, count(*) AS n FROM numbers, l GROUP BY grp")),
    "f8_fit_apply": (f8, sql("numbers", f"""WITH {', '.join(f'l_{c} AS ({LIMITS(c)})' for c in ('qty', 'price', 'tax'))} SELECT k1, k2, grp, label, {', '.join(f'round(ln(1 + {CLIP(c)}), 6) AS {c}' for c in ('qty', 'price', 'tax'))},
        round(ln(1 + k1 % 4), 6) AS todo, round(ln(1 + k2), 6) AS fixme FROM numbers WHERE k1 % 5 = 0""")),
    "f8_stages": (f8_stages, sql("numbers", STAGES)),
    "f9_derived": (f9, sql("commits", f"WITH {ENGINEERED} SELECT {K}, round(loc_added / (loc_deleted + 1), 6) AS loc_churn_ratio, round(a / (e + 1), 6) AS activity_per_exp FROM x")),
    "f10_buckets": (f10, sql("commits", f"WITH {ENGINEERED} SELECT {K}, {BUCKETS} FROM (SELECT *, loc_added - 1 AS l FROM x)")),
    "f11_one_hot": (f11, sql("commits", f"WITH {ENGINEERED} SELECT {K}, " + ", ".join(f"coalesce(CAST({c}_bucket = '{x}' AS INT), 0) AS {c}_bucket_{x}" for c, ls in LABELS.items() for x in ls)
        + f" FROM (SELECT *, {BUCKETS} FROM (SELECT *, loc_added - 1 AS l FROM x))")),
    "f12_ratios": (f12, sql("numbers", "SELECT k1, k2, price, k1 % 4 + k2 AS line_token_total, round(k1 % 4 / (qty + 1), 6) AS todo_ratio, round(k2 / (qty + 1), 6) AS fixme_ratio FROM numbers")),
    "f13_interactions": (f13, sql("numbers", "SELECT k1, k2, price, round(qty * disc, 6) AS qty_x_disc, round(qty * tax, 6) AS qty_x_tax, round(disc * tax, 6) AS disc_x_tax FROM numbers")),
    "m2_forest": (m2, None), "m3_boosted": (m3, None), "m5_cross_validate": (m5, None), "m6_grid_forest": (m6, None), "m7_grid_boosted": (m7, None),
    "m8_importance": (m8, None), "m9_refine": (m9, None), "m10_predict": (m10, None), "m11_save_load": (m11, None),
    "m2_tree": (m2_tree, sql("numbers", f"""WITH {STEP_ROWS}, {TRAIN}, {tree('x', 2, 'one')} SELECT k1, k2, price, CAST(NOT train AS INT) AS is_test, CAST(leaf > 0.5 AS INT) AS predicted, round(leaf, 6) AS score FROM one""")),
    "m3_rounds": (m3_rounds, sql("numbers", f"""WITH {STEP_ROWS}, {ROUNDS} SELECT k1, k2, price, CAST(NOT train AS INT) AS is_test, CAST(one + 0.1 * leaf > 0 AS INT) AS predicted, round(1 / (1 + exp(-2 * (one + 0.1 * leaf))), 6) AS score FROM two""")),
    "m5_trees": (m5_trees, sql("numbers", f"""WITH {STEP_ROWS}, {FOLDS(3)}, {tree('x', 2, 'one')}, predictions AS (SELECT model, y, leaf AS score, CAST(leaf > 0.5 AS INT) AS q FROM one WHERE NOT train),
        a AS ({AUC}), r AS ({REPORT('predictions')}), e AS (SELECT model AS fold, auc, precision, recall, f1 FROM a JOIN r USING (model) WHERE r."class" = '1')
        SELECT CAST(fold AS INT) AS fold, round(auc, 6) AS auc, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM e UNION ALL SELECT -1, round(avg(auc), 6), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM e""")),
    "m6_depths": (m6_depths, sql("numbers", f"""WITH {STEP_ROWS}, {FOLDS(2)}, {tree('x', 1, 'low')}, {tree('x', 2, 'high')}, g AS ({MEAN_MCC('low', 1)} UNION ALL {MEAN_MCC('high', 2)}) SELECT setting, round(score, 6) AS score FROM g""")),
    "e1_classify": (e1, sql("predictions", "SELECT *, CAST(score >= 0.6 AS INT) AS predicted FROM predictions")),
    "e2_roc": (e2, sql("predictions", f"WITH {CURVE} SELECT model, threshold, round(fp / nullif(neg, 0), 6) AS fpr, round(tp / nullif(pos, 0), 6) AS tpr FROM c UNION ALL SELECT DISTINCT model, NULL, 0.0, 0.0 FROM c")),
    "e3_auc": (e3, sql("predictions", f"SELECT model, round(auc, 6) AS auc FROM ({AUC})")),
    "e4_pr": (e4, sql("predictions", f"WITH {PR} SELECT model, threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM pr UNION ALL SELECT DISTINCT model, NULL, 1.0, 0.0 FROM pr")),
    "e5_best_f1": (e56(1), sql("predictions", f"WITH {PR} SELECT model, round(threshold, 6) AS threshold, round(f, 6) AS f FROM ({FB(1)})")),
    "e6_best_f2": (e56(2), sql("predictions", f"WITH {PR} SELECT model, round(threshold, 6) AS threshold, round(f, 6) AS f FROM ({FB(2)})")),
    "e7_best_mcc": (e7, sql("predictions", f"WITH {MCC} SELECT model, round(threshold, 6) AS threshold, round(mcc, 6) AS mcc FROM m")),
    "e8_report": (e8, sql("predictions", f"""WITH s AS (SELECT *, CAST(score >= 0.6 AS INT) AS q FROM predictions), r AS ({REPORT('s')}) SELECT model, "class", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r""")),
    "e9_models": (e9, sql("predictions", f"""WITH {PR}, a AS ({AUC}), f1 AS ({FB(1)}), f2 AS ({FB(2)}), {MCC}, s AS (SELECT p.*, CAST(score >= threshold AS INT) AS q FROM predictions p JOIN f2 USING (model)), r AS ({REPORT('s')})
        SELECT model, round(auc, 6) AS auc, round(f1.threshold, 6) AS f1_threshold, round(f1.f, 6) AS f1, round(f2.threshold, 6) AS f2_threshold, round(f2.f, 6) AS f2, round(m.threshold, 6) AS mcc_threshold, round(m.mcc, 6) AS mcc, round(r.f1, 6) AS weighted_f1
        FROM a JOIN f1 USING (model) JOIN f2 USING (model) JOIN m USING (model) JOIN r USING (model) WHERE r."class" = 'weighted'""")),
}

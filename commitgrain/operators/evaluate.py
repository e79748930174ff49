"""Evaluation of scores, for all models side by side.

Input has model, y (0 or 1) and score. Rows are first counted by model and
score, so what runs through a window is distinct scores, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-10


def classify(df: DataFrame, threshold: float) -> DataFrame:
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _count(of: Column, rows: str | None) -> Column:
    """How many rows are so; with `rows`, a column says how many each row is."""
    return F.count_if(of) if rows is None else F.coalesce(F.sum(F.when(of, F.col(rows))), F.lit(0).cast("long"))


def score_counts(df: DataFrame, rows: str | None = None) -> DataFrame:
    return df.groupBy("model", "score").agg(_count(F.col("y") == 1, rows).alias("p"), _count(F.col("y") == 0, rows).alias("n"))


def cumulated(df: DataFrame, rows: str | None = None) -> DataFrame:
    """(model, threshold, tp, fp, pos, neg) at each distinct score."""
    return _cumulated(score_counts(df, rows))


def _cumulated(counts: DataFrame) -> DataFrame:
    down = Window.partitionBy("model").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("model")
    return counts.select("model", F.col("score").alias("threshold"), F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("neg"))


def roc_curve(df: DataFrame) -> DataFrame:
    """(model, threshold, fpr, tpr), with the start (0, 0) at a null threshold."""
    c = cumulated(df)
    points = c.select("model", "threshold", F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))
    start = c.select("model").distinct().select("model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(df: DataFrame, rows: str | None = None) -> DataFrame:
    """(model, auc) by trapezoids: tied scores count a half."""
    c = cumulated(df, rows)
    w = Window.partitionBy("model").orderBy(F.desc("threshold"))
    area = (F.col("fp") - F.coalesce(F.lag("fp").over(w), F.lit(0))) * (F.col("tp") + F.coalesce(F.lag("tp").over(w), F.lit(0))) / 2
    return c.select("model", "pos", "neg", area.alias("area")).groupBy("model").agg(F.try_divide(F.sum("area"), F.first("pos") * F.first("neg")).alias("auc"))


def pr_curve(df: DataFrame) -> DataFrame:
    """(model, threshold, precision, recall), with the end (1, 0) at a null threshold."""
    c = cumulated(df)
    points = c.select("model", "threshold", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "pos").alias("recall"))
    end = c.select("model").distinct().select("model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def best_f_threshold(df: DataFrame, beta: int = 1) -> DataFrame:
    """(model, threshold, f): the largest F-beta, at its lowest threshold."""
    b = beta * beta
    p, r = F.col("precision"), F.col("recall")
    f = F.round((1 + b) * p * r / (b * p + r + TINY), 12)
    each = pr_curve(df).filter("threshold is not null").select("model", "threshold", f.alias("f"))
    return each.groupBy("model").agg(F.max_by(F.struct("threshold", "f"), F.struct("f", -F.col("threshold"))).alias("b")).select("model", "b.threshold", "b.f")


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    return F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


def best_mcc_threshold(df: DataFrame, steps: int = 100) -> DataFrame:
    """(model, threshold, mcc) over `steps` thresholds from 0 to 1; the lowest of the best.

    Scores fall into steps + 1 cells, those below 0 into a cell of their own,
    so one small table of cumulated counts a model serves all thresholds."""
    return _best_mcc(score_counts(df), steps)


def _best_mcc(counts: DataFrame, steps: int = 100) -> DataFrame:
    cells = F.broadcast(counts.sparkSession.range(-1, steps).select(F.col("id").alias("k")))  # steps + 1 rows
    cell = F.greatest(F.lit(-1), F.least(F.floor(F.col("score") * (steps - 1) + TINY), F.lit(steps - 1))).cast("long")
    n = counts.groupBy("model", cell.alias("k")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    full = n.select("model").distinct().join(cells).join(n, ["model", "k"], "left").na.fill(0, ["p", "n"])
    up = Window.partitionBy("model").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("model")
    c = full.select("model", "k", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("neg"))
    m = F.round(mcc(F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp"), F.col("neg") - F.col("fp")), 12)
    each = c.filter("k >= 0").select("model", (F.col("k") / (steps - 1)).alias("threshold"), m.alias("mcc"))
    return each.groupBy("model").agg(F.max_by(F.struct("threshold", "mcc"), F.struct("mcc", -F.col("threshold"))).alias("b")).select("model", "b.threshold", "b.mcc")


def report(df: DataFrame, predicted: str = "predicted", rows: str | None = None) -> DataFrame:
    """(model, class, precision, recall, f1, support) for 0, 1, accuracy, macro
    and weighted averages; 0 where a ratio has no base."""
    y, p = F.col("y"), F.col(predicted)
    c = df.groupBy("model").agg(*[_count((y == a) & (p == b), rows).alias(k) for k, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    part = {}
    for k, (a, b, d) in {"1": (tp, fp, fn), "0": (tn, fn, fp)}.items():
        part[k] = (ratio(a, a + b), ratio(a, a + d), ratio(2 * a, 2 * a + b + d), a + d)
    acc = ratio(tp + tn, n)
    lines = {**part, "accuracy": (acc, acc, acc, n), "macro": (*[(part["0"][i] + part["1"][i]) / 2 for i in range(3)], n),
            "weighted": (*[ratio(part["0"][i] * part["0"][3] + part["1"][i] * part["1"][3], n) for i in range(3)], n)}
    names = ("precision", "recall", "f1", "support")
    each = F.array(*[F.struct(F.lit(k).alias("class"), *[v.alias(m) for v, m in zip(vs, names)]) for k, vs in lines.items()])
    return c.select("model", F.explode(each).alias("r")).select("model", "r.class", "r.precision", "r.recall", "r.f1", F.col("r.support").cast("long").alias("support"))


def evaluate_models(df: DataFrame) -> DataFrame:
    """Per model: AUC, best F1, F2 and MCC with their thresholds, and the
    weighted F1 at the best F2 threshold, which is the one applied.

    Rows are counted by model and score once, in one pass over df; everything
    else comes from these counts, whose exchange Spark uses again."""
    counts = score_counts(df)
    w = Window.partitionBy("model").orderBy(F.desc("threshold"))
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    area = (fp - F.coalesce(F.lag(fp).over(w), F.lit(0))) * (tp + F.coalesce(F.lag(tp).over(w), F.lit(0))) / 2
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, pos)
    f = {b: F.round((1 + b * b) * precision * recall / (b * b * precision + recall + TINY), 12) for b in (1, 2)}
    points = _cumulated(counts).select("model", "threshold", "tp", "fp", "pos", "neg", area.alias("area"), *[x.alias(f"f{b}") for b, x in f.items()])
    best = lambda b: F.max_by(F.struct("threshold", f"f{b}", "tp", "fp"), F.struct(f"f{b}", -F.col("threshold")))
    one = points.groupBy("model").agg(F.try_divide(F.sum("area"), F.first("pos") * F.first("neg")).alias("auc"), best(1).alias("b1"), best(2).alias("b2"), F.first("pos").alias("pos"), F.first("neg").alias("neg"))
    m = _best_mcc(counts).toDF("model", "mcc_threshold", "mcc")
    part = lambda hit, wrong, n: F.coalesce(F.try_divide(2 * hit.cast("double"), hit + n + wrong), F.lit(0.0))  # noqa: E731  2tp / (2tp + fp + fn)
    yes, no = part(F.col("b2.tp"), F.col("b2.fp"), pos), part(neg - F.col("b2.fp"), pos - F.col("b2.tp"), neg)
    weighted = F.coalesce(F.try_divide(yes * pos + no * neg, pos + neg), F.lit(0.0))
    return one.join(m, "model").select("model", "auc", F.col("b1.threshold").alias("f1_threshold"), F.col("b1.f1").alias("f1"), F.col("b2.threshold").alias("f2_threshold"), F.col("b2.f2").alias("f2"),
                                       "mcc_threshold", "mcc", weighted.alias("weighted_f1"))

"""Splits, tree ensembles, cross-validation, tuning, importance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, closing, contextmanager
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasWeightCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitgrain.operators import cells, evaluate
from commitgrain.sources import tables

SEED = 42
#: Rows among which values change places, about: one row of an aggregation.
BLOCK_ROWS = 1 << 10
#: A setting of forests that Spark's do not have: rows that a node needs to be split.
MIN_SPLIT = "minRowsToSplit"
#: Spark's own limit, for trees without one.
DEEPEST = 30


def key_number(keys: Sequence[str], seed: int | str = SEED) -> Column:
    """A number from the row's key that no partitioning changes."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def split(df: DataFrame, keys: Sequence[str], test_pct: int = 20, seed: int = SEED, out: str = "is_test") -> DataFrame:
    return df.withColumn(out, (key_number(keys, seed) % 100 < test_pct).cast("int"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, balanced, scale_pos_weight): n / (classes * class size), and
    negatives over positives."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    pos, neg = (F.sum(F.when(F.col(label) == k, F.col("n")).otherwise(0)).over(every) for k in (1, 0))
    return n.select(label, "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("balanced"), F.try_divide(neg, pos).alias("scale_pos_weight"))


def with_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label).select(label, F.col("balanced").alias(out))), label)  # a row a class


NUMBERS = {"double", "float", "bigint", "int", "smallint", "tinyint", "boolean"}
#: Single trees that are fitted at a time.
AT_ONCE = 8
#: Trees of one fit over rows: each keeps two numbers a row.
GROUP = 10


def given(to, estimator, but: Sequence[str] = ()):
    """`to` with the settings that the estimator has too."""
    for p in to.params:
        if p.name not in but and estimator.hasParam(p.name) and estimator.isDefined(p.name):
            to.set(p, estimator.getOrDefault(p.name))
    return to


def weight_of(estimator) -> str | None:
    return (estimator.isDefined("weightCol") and estimator.getWeightCol()) or None


def check_labels(dataset: DataFrame, label: str) -> None:
    if dataset.filter(~F.col(label).isin(0, 1) | F.col(label).isNull()).limit(1).count():
        raise ValueError(f"{label} has other values than 0 and 1")


def width_of(dataset: DataFrame, features: str) -> int:
    first = dataset.select(F.size(vector_to_array(features))).first()
    if first is None:
        raise ValueError("no rows to fit")
    return first[0]


def vector_columns(dataset: DataFrame, estimator, held: Column | None = None) -> DataFrame:
    """Columns for cells of a table of feature vectors."""
    width, x = width_of(dataset, estimator.getFeaturesCol()), vector_to_array(estimator.getFeaturesCol())
    return cells.columns(dataset, [F.get(x, F.lit(i)) for i in range(width)], estimator.getLabelCol(), weight_of(estimator), held)


def reads_numbers(df: DataFrame, names: Sequence[str]) -> bool:
    return all(kind in NUMBERS or kind.startswith("decimal") for kind in (dict(df.dtypes)[n] for n in names))


def by_cells(df: DataFrame, names: Sequence[str], estimator) -> bool:
    """Whether rows need no vectors: the estimator reads cells, of numbers."""
    return isinstance(estimator, (LeafForest, CellBoosted)) and estimator.by_cells() and reads_numbers(df, names)


def number_columns(df: DataFrame, names: Sequence[str], estimator, held: Column | None = None) -> DataFrame:
    return cells.columns(df, [F.col(n) for n in names], estimator.getLabelCol(), weight_of(estimator), held)


def java_trees(made: Sequence):
    """An array of trees for the constructors of Spark's ensembles."""
    sc = SparkSession.active().sparkContext
    out = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(made))
    for i, tree in enumerate(made):
        out[i] = tree
    return out


def one_tree(estimator, seed: int, label: str) -> RandomForestRegressor:
    """A tree over cells: all of `weight`, nothing drawn."""
    tree = given(RandomForestRegressor(), estimator, ("impurity", "numTrees", "bootstrap", "subsamplingRate", "cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "predictionCol", "weightCol", "leafCol", "seed"))
    return tree.setNumTrees(1).setBootstrap(False).setSeed(seed).setLabelCol(label).setWeightCol("drawn")


class LeafForest(RandomForestClassifier):
    """A forest for labels 0 and 1 whose scores are the shares of its leaves.

    Spark's classifiers make one leaf of two that have the same larger class, so
    rows on both sides get one score. Forests of means do not, and for labels 0
    and 1 they find the same cuts, variance being half of Gini's impurity. So
    one of these is fitted, and its nodes get class counts for their moments.

    Trees are fitted to cells, each by itself: rows are read to find and count
    the cells, and no tree's draws are kept for a row. A minimum of rows and
    weights ask for single rows; there a few trees are fitted at a time."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        if self.by_cells():
            with closing(cells.Cells(vector_columns(dataset, self), self.getMaxBins())) as found:
                return self.fit_cells(found)
        check_labels(dataset, self.getLabelCol())
        return self._scored(self._of_rows(dataset), width_of(dataset, self.getFeaturesCol()))

    def by_cells(self) -> bool:
        return not weight_of(self) and self.getMinInstancesPerNode() == 1 and self.getOrDefault("minWeightFractionPerNode") == 0

    def fit_cells(self, found: cells.Cells) -> RandomForestClassificationModel:
        return self._scored(self._of_cells(found.fitted), found.width, found.cuts)

    def _scored(self, made: Sequence, width: int, cuts: list[list[float]] | None = None) -> RandomForestClassificationModel:
        """The forest of these trees of means, with class counts."""
        label, spark = self.getLabelCol(), SparkSession.active()
        forest = spark._jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(self.uid, java_trees(made), width)
        nothing = array_to_vector(F.array_repeat(F.lit(0.0), width))
        two = spark.range(0, 2, 1, 1).select(F.col("id").cast("double").alias(label), nothing.alias(self.getFeaturesCol()))
        if weight_of(self):
            two = two.withColumn(weight_of(self), F.lit(1.0))
        at = tables.work_dir(spark, "leaf-forest")
        forest.write().save(f"{at}/means")
        super()._fit(two).write().save(f"{at}/classes")
        class_nodes(spark.read.parquet(f"{at}/means/data"), cuts).write.mode("overwrite").parquet(f"{at}/classes/data")
        return RandomForestClassificationModel.load(f"{at}/classes")

    def _of_rows(self, dataset: DataFrame) -> list:
        out = []
        while len(out) < self.getNumTrees():
            means = given(RandomForestRegressor(), self, ("impurity",)).setNumTrees(min(GROUP, self.getNumTrees() - len(out))).setSeed(self.getSeed() + len(out))
            out += list(means.fit(dataset)._java_obj.trees())
        return out

    def _of_cells(self, fitted: DataFrame) -> list:
        out = []
        for start in range(0, self.getNumTrees(), cells.DRAWS):
            own = range(min(cells.DRAWS, self.getNumTrees() - start))
            if self.getBootstrap() or self.getSubsamplingRate() < 1:
                drawn = fitted.select("features", "label", cells.draws(self.getSeed() + start, self.getSubsamplingRate(), self.getBootstrap()).alias("draws")).persist()
                sample = lambda i, d=drawn: d.select("features", "label", F.get("draws", F.lit(i)).alias("drawn")).filter("drawn > 0")
            else:
                drawn, sample = None, lambda i: fitted.select("features", "label", F.col("rows").cast("double").alias("drawn"))
            fit_one = lambda i, n=start, s=sample: one_tree(self, self.getSeed() + n + i, "label").fit(s(i))._java_obj.trees()[0]
            with ThreadPool(AT_ONCE) as pool:
                out += pool.map(inheritable_thread_target(fitted.sparkSession)(fit_one), own)
            if drawn is not None:
                drawn.unpersist()
        return out


def class_nodes(nodes: DataFrame, cuts: list[list[float]] | None = None) -> DataFrame:
    """A saved node table (treeID, nodeData) of means of labels 0 and 1, whose
    moments are (count, sum, sum of squares), as that of classes. That of trees
    over cells gets values for bins, and rows for cells."""
    old = F.col("nodeData")
    count, ones = old["impurityStats"][0], old["impurityStats"][1]
    node = old.withField("impurityStats", F.array(count - ones, ones)).withField("prediction", (ones > count - ones).cast("double")).withField("impurity", old["impurity"] * 2)
    node = node.withField("gain", F.when(old["leftChild"] < 0, old["gain"]).otherwise(old["gain"] * 2))
    if cuts is not None:
        node = cells.with_values(node.withField("rawCount", F.round(count).cast("long")), cuts)
    return nodes.select("treeID", node.cast(nodes.schema["nodeData"].dataType).alias("nodeData"))


class CellBoosting:
    """Boosting for labels 0 and 1 over cells, round after round, with Spark's
    loss and steps. A row of the state is a cell with its margin so far."""

    def __init__(self, found: cells.Cells, estimator: GBTClassifier):
        self.estimator, self.spark, self.trees = estimator, found.every.sparkSession, []
        self.width, self.cuts, self.held = found.width, found.cuts, found.held
        self.state = found.fitted.withColumn("margin", F.lit(0.0))
        self.kept = [self.state]

    def run(self, rounds: int) -> None:
        """Rounds until there are so many."""
        rate, y = self.estimator.getSubsamplingRate(), F.col("label") * 2 - 1
        while len(self.trees) < rounds:
            k = len(self.trees)
            if k % cells.DRAWS == 0:
                number = cells.draws(self.estimator.getSeed() + k, rate, False) if rate < 1 else F.array_repeat(F.col("rows").cast("double"), cells.DRAWS)
                state = self.state.withColumn("draws", number)
                self._keep(state.checkpoint() if self.spark.sparkContext.getCheckpointDir() else state.localCheckpoint())
            target = (4 * y / (1 + F.exp(2 * y * F.col("margin")))) if k else y
            sample = self.state.select("features", target.alias("target"), (F.get("draws", F.lit(k % cells.DRAWS)) * F.col("weight")).alias("drawn")).filter("drawn > 0")
            tree = one_tree(self.estimator, self.estimator.getSeed() + k, "target").fit(sample)
            self.trees.append(tree._java_obj.trees()[0])
            step = self.estimator.getStepSize() if k else 1.0
            names = [c for c in self.state.columns if c != "margin"]
            self._keep(tree.transform(self.state).select(*names, (F.col("margin") + step * F.col("prediction")).alias("margin")).persist())

    def _keep(self, state: DataFrame) -> None:
        """The new state; of older ones, that which it is made from stays too."""
        self.state = state
        self.kept.append(state)
        if len(self.kept) > 2:
            self.kept.pop(0).unpersist()

    def _of_bins(self) -> GBTClassificationModel:
        steps = [1.0] + [self.estimator.getStepSize()] * (len(self.trees) - 1)
        whole = boosted_model(self.estimator.uid, self.trees, steps, self.width)
        return given(whole, self.estimator)

    def losses(self) -> list[float]:
        """The loss on the held rows after each round, from their cells."""
        whole = self._of_bins()
        for param, name in ((whole.featuresCol, "features"), (whole.labelCol, "label"), (whole.weightCol, "drawn")):
            whole.set(param, name)
        whole._transfer_params_to_java()
        return whole.evaluateEachIteration(self.held.select("features", "label", (F.col("rows") * F.col("weight")).alias("drawn")))

    def model(self) -> GBTClassificationModel:
        at, whole = tables.work_dir(self.spark, "boosted"), self._of_bins()
        whole._transfer_params_to_java()
        whole.write().save(f"{at}/bins")
        whole.write().save(f"{at}/values")
        nodes = self.spark.read.parquet(f"{at}/bins/data")
        node = cells.with_values(F.col("nodeData"), self.cuts).cast(nodes.schema["nodeData"].dataType)
        nodes.select("treeID", node.alias("nodeData")).write.mode("overwrite").parquet(f"{at}/values/data")
        return GBTClassificationModel.load(f"{at}/values")

    def close(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()


class CellBoosted(GBTClassifier):
    """Boosted trees for labels 0 and 1 fitted to cells; those that stop by rows
    marked for validation or ask for a minimum of rows are Spark's own."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        if not self.by_cells():
            return super()._fit(dataset)
        with closing(cells.Cells(vector_columns(dataset, self), self.getMaxBins())) as found:
            return self.fit_cells(found)

    def fit_cells(self, found: cells.Cells) -> GBTClassificationModel:
        with closing(CellBoosting(found, self)) as run:
            run.run(self.getMaxIter())
            return run.model()

    def by_cells(self) -> bool:
        return not self.isDefined("validationIndicatorCol") and self.getMinInstancesPerNode() == 1 and self.getOrDefault("minWeightFractionPerNode") == 0


def random_forest(trees: int = 300, depth: int = 20, features: str = "log2", min_rows: int = 1, weight: str | None = None) -> LeafForest:
    """Spark has no minimum rows to split a node, but one for its children."""
    rf = LeafForest(labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy=features, minInstancesPerNode=min_rows, seed=SEED)
    return rf.setWeightCol(weight) if weight else rf


def boosted_trees(rounds: int = 300, depth: int = 6, rate: float = 0.1, sample: float = 0.8, features: str = "0.8", validation: str | None = None, weight: str | None = None) -> GBTClassifier:
    """With `validation`, Spark itself stops by a tolerance of the loss on the
    rows that it marks; `fit_with_patience` stops after rounds without gain."""
    gbt = CellBoosted(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample, featureSubsetStrategy=features, seed=SEED)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.setWeightCol(weight) if weight else gbt


def assembler(names: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")


def without_summary(model):
    """The model without its training summary. A summary holds the session, and
    a model that holds it cannot be sent to tasks once the session observes
    metrics."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


@contextmanager
def dealt(df: DataFrame, names: Sequence[str], estimator, also: Sequence[str] = ()) -> Iterator[DataFrame]:
    """label, features and what the estimator reads besides, dealt to all tasks
    and kept for the passes of a fit, whatever files the rows come from."""
    read = [estimator.getOrDefault(p) for p in (estimator.getParam(n) for n in ("weightCol", "validationIndicatorCol") if estimator.hasParam(n)) if estimator.isDefined(p)]
    ready = assembler(names).transform(df).select("label", "features", *dict.fromkeys([*read, *also]))
    spark = df.sparkSession
    ready = ready.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).persist()
    try:
        yield ready
    finally:
        ready.unpersist()


def fit(df: DataFrame, names: Sequence[str], estimator) -> PipelineModel:
    """A fitted model that knows its columns, and keeps no training summary."""
    if by_cells(df, names, estimator):
        with closing(cells.Cells(number_columns(df, names, estimator), estimator.getMaxBins())) as found:
            return PipelineModel([assembler(names), without_summary(estimator.fit_cells(found))])
    with dealt(df, names, estimator) as ready:
        return PipelineModel([assembler(names), without_summary(estimator.fit(ready))])


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the least loss, whether `patience` rounds without a smaller
    one followed it). What comes after those rounds is not looked at."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boosted_model(uid: str, trees: Sequence, steps: Sequence[float], width: int) -> GBTClassificationModel:
    sc = SparkSession.active().sparkContext
    weights = sc._gateway.new_array(sc._jvm.double, len(steps))
    for i, step in enumerate(steps):
        weights[i] = step
    return GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, java_trees(trees), weights, width, 2))


def truncated(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble of the first `rounds` trees."""
    return boosted_model(model.uid, list(model._java_obj.trees()[:rounds]), model.treeWeights[:rounds], model.numFeatures)


def fit_with_patience(df: DataFrame, names: Sequence[str], estimator: GBTClassifier, validation: DataFrame, patience: int = 20, first: int = 50) -> PipelineModel:
    """A boosted ensemble that ends at the round with the least loss on the
    validation rows, once `patience` rounds have brought no smaller one.

    The losses of all prefixes of an ensemble come from one pass over the
    validation rows. Rounds depend on the seed and on the rounds before alone,
    so an ensemble of twice the rounds begins with the same trees: `first`
    rounds are fitted, then twice as many, until the patience is spent or the
    estimator's rounds are done. Over cells the rounds go on from those before."""
    if by_cells(df, names, estimator):
        both = number_columns(df, names, estimator).unionByName(number_columns(validation, names, estimator, F.lit(True)))
        with closing(cells.Cells(both, estimator.getMaxBins())) as found, closing(CellBoosting(found, estimator)) as run:
            best = patient(run.run, lambda: run.losses(), estimator.getMaxIter(), patience, first)
            return PipelineModel([assembler(names), truncated(run.model(), best)])
    with dealt(df, names, estimator) as ready, dealt(validation, names, estimator) as held:
        made = []
        best = patient(lambda rounds: made.append(estimator.copy({estimator.maxIter: rounds}).fit(ready)), lambda: made[-1].evaluateEachIteration(held), estimator.getMaxIter(), patience, first)
        return PipelineModel([assembler(names), truncated(made[-1], best)])


def patient(run: Callable[[int], None], losses: Callable[[], list[float]], most: int, patience: int, first: int) -> int:
    """The best round, after as many rounds as it takes to know it."""
    rounds = min(first, most)
    while True:
        run(rounds)
        best, spent = best_round(losses(), patience)
        if spent or rounds == most:
            return best
        rounds = min(2 * rounds, most)


def model_columns(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with predicted (0/1) and score, the probability of 1."""
    out = model.transform(df)
    return out.select(*df.columns, F.col("prediction").cast("int").alias("predicted"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def of_cells(model: PipelineModel, df: DataFrame) -> bool:
    """Whether the model is trees over numbers of df."""
    return isinstance(model.stages[1], (GBTClassificationModel, RandomForestClassificationModel)) and reads_numbers(df, model_columns(model))


def saved_cuts(model: PipelineModel) -> list[list[float]]:
    """The values at which the model's trees cut, by its saved node table."""
    spark, at = SparkSession.active(), tables.work_dir(SparkSession.active(), "cuts")
    model.stages[1].write().save(at)
    return cells.thresholds(spark.read.parquet(f"{at}/data"), len(model_columns(model)))


def predict_cells(model: PipelineModel, df: DataFrame, also: Sequence[str] = ("label",)) -> DataFrame:
    """(also, predicted, score, rows): what `predict` gives, counted. Rows
    between the same cuts of all trees are scored once, so trees are walked for
    cells and not for rows; columns of other kinds than numbers, and other
    models than trees', are scored row by row."""
    names, ensemble = model_columns(model), model.stages[1]
    if not of_cells(model, df):
        return predict(model, df).groupBy(*also, "predicted", "score").agg(F.count(F.lit(1)).alias("rows"))
    cuts = saved_cuts(model)
    counted = cells.coded(df.select(*cells.numbers([F.col(n) for n in names]), *[F.col(c).alias(f"also_{c}") for c in also]), cuts).groupBy("code", *[f"also_{c}" for c in also]).agg(F.count(F.lit(1)).alias("rows"))
    scored = ensemble.transform(counted.withColumn(ensemble.getFeaturesCol(), cells.values(F.col("code"), cuts)))
    return scored.select(*[F.col(f"also_{c}").alias(c) for c in also], F.col(ensemble.getPredictionCol()).cast("int").alias("predicted"), F.get(vector_to_array(ensemble.getProbabilityCol()), F.lit(1)).alias("score"), "rows")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_folds(df: DataFrame, keys: Sequence[str], folds: int = 10, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", (key_number(keys, seed) % folds).cast("int"))


def cross_validate(df: DataFrame, names: Sequence[str], estimator, keys: Sequence[str], folds: int = 10, validation: DataFrame | None = None, patience: int = 20) -> DataFrame:
    """(fold, auc, precision, recall, f1) of the positive class for each fold,
    and the means as fold -1. With validation, a boosted ensemble stops early
    by the loss on that one table in all folds."""
    df = with_folds(df, keys, folds).select(*dict.fromkeys([*names, "label", "fold", *([weight_of(estimator)] if weight_of(estimator) else [])])).persist()
    with ExitStack() as kept:
        kept.callback(df.unpersist)
        scored = None
        for k in range(folds):
            train = df.filter(F.col("fold") != k)
            model = fit(train, names, estimator) if validation is None else fit_with_patience(train, names, estimator, validation, patience)
            part = predict_cells(model, df.filter(F.col("fold") == k)).groupBy("predicted", "score", "label").agg(F.sum("rows").alias("rows"))
            part = part.select(F.lit(k).alias("model"), F.col("label").alias("y"), "predicted", "score", "rows").persist()
            kept.callback(part.unpersist)
            scored = part if scored is None else scored.unionByName(part)
        good = evaluate.report(scored, rows="rows").filter(F.col("class") == "1").select("model", "precision", "recall", "f1")
        each = evaluate.roc_auc(scored, "rows").join(good, "model").select(F.col("model").alias("fold"), "auc", "precision", "recall", "f1")
        rows = each.unionByName(each.agg(F.lit(-1).alias("fold"), *[F.avg(c).alias(c) for c in ("auc", "precision", "recall", "f1")])).collect()  # a row a fold
    return df.sparkSession.createDataFrame(rows, "fold int, auc double, precision double, recall double, f1 double")


#: The settings that a search tries by default.
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20], MIN_SPLIT: [2, 5, 10], "featureSubsetStrategy": ["sqrt", "log2"]}
BOOSTED_GRID = {"maxIter": [200, 300], "maxDepth": [4, 6, 8], "stepSize": [0.05, 0.1], "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "1.0"]}


class MccEvaluator(Evaluator, HasLabelCol, HasPredictionCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Matthews correlation of predictions; larger is better."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", weightCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        y, p = F.col(self.getLabelCol()), F.col(self.getPredictionCol())
        weight = F.col(weight_of(self)) if weight_of(self) else F.lit(1)
        n = dataset.agg(*[F.coalesce(F.sum(F.when((y == a) & (p == b), weight)), F.lit(0)).alias(k) for k, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
        return float(n.select(evaluate.mcc(*[F.col(k) for k in ("tp", "fp", "fn", "tn")])).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def prune_nodes(nodes: DataFrame, least: int) -> DataFrame:
    """A saved node table (treeID, nodeData) in which a node with fewer rows
    than `least` is a leaf of its own class counts; what was below it goes, and
    the rest is numbered anew in the same order. A tree is one group."""
    def walk(tree):
        tree = tree.sort_values("id")
        n, left, right = len(tree), tree["left"].to_numpy(), tree["right"].to_numpy()
        splits = (left >= 0) & (tree["rows"].to_numpy() >= least)
        alive = np.zeros(n, bool)
        alive[:1] = True
        for i in range(n):  # parents come before children
            if alive[i] and splits[i]:
                alive[left[i]] = alive[right[i]] = True
        number = np.cumsum(alive) - 1
        out = tree[["treeID", "id"]].assign(new=number, new_left=np.where(splits, number[left], -1), new_right=np.where(splits, number[right], -1))
        return out[alive]

    light = nodes.select("treeID", "nodeData.id", F.col("nodeData.rawCount").alias("rows"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"))
    places = light.groupBy("treeID").applyInPandas(walk, "treeID int, id int, new int, new_left int, new_right int")
    old, leaf = F.col("nodeData"), F.col("new_left") < 0
    gone = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = old.withField("id", F.col("new")).withField("leftChild", F.col("new_left")).withField("rightChild", F.col("new_right"))
    node = node.withField("gain", F.when(leaf, -1.0).otherwise(old["gain"])).withField("split", F.when(leaf, gone).otherwise(old["split"]))
    return nodes.withColumn("id", old["id"]).join(places, ["treeID", "id"]).select("treeID", node.cast(nodes.schema["nodeData"].dataType).alias("nodeData"))


def pruned(model: RandomForestClassificationModel, leasts: Sequence[int]) -> list[RandomForestClassificationModel]:
    """The forest with nodes of fewer rows than each of `leasts` as leaves, by
    its saved node table, which is written once for all of them."""
    spark, at = SparkSession.active(), tables.work_dir(SparkSession.active(), "forest")
    model.write().save(f"{at}/whole")
    out = []
    for least in leasts:
        to = f"{at}/least-{least}"
        model.write().save(to)
        prune_nodes(spark.read.parquet(f"{at}/whole/data"), least).write.mode("overwrite").parquet(f"{to}/data")
        out.append(RandomForestClassificationModel.load(to))
    return out


def grid_search(df: DataFrame, names: Sequence[str], estimator, grid: dict[str, Sequence] | None = None, keys: Sequence[str] = (), folds: int | None = None, metric: str | None = None, parallelism: int = 4) -> DataFrame:
    """(setting, score) for every combination, best first. By default a forest
    is searched over FOREST_GRID by mcc in 5 folds, a boosted ensemble over
    BOOSTED_GRID by auc in 3. Values of MIN_SPLIT share one fit: its trees are
    pruned by their nodes' rows. A maxDepth of None is as deep as Spark goes."""
    boosted = isinstance(estimator, GBTClassifier)
    grid = dict(grid or (BOOSTED_GRID if boosted else FOREST_GRID))
    folds, metric = folds or (3 if boosted else 5), metric or ("auc" if boosted else "mcc")
    judge = MccEvaluator(weightCol="rows") if metric == "mcc" else BinaryClassificationEvaluator(labelCol="label", numBins=0, weightCol="rows")
    leasts = grid.pop(MIN_SPLIT, None)
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    scores: dict[str, list[float]] = {}

    changed = lambda setting: estimator.copy({estimator.getParam(p): DEEPEST if p == "maxDepth" and v is None else v for p, v in setting.items()})
    df, jobs = with_folds(df, keys, folds), list(product(range(folds), settings))
    with ExitStack() as kept:
        if all(by_cells(df, names, changed(s)) for s in settings):
            columns = df.select(*dict.fromkeys([*names, "label", "fold", *([weight_of(estimator)] if weight_of(estimator) else [])])).persist()
            found = {}
            try:
                for k, bins in product(range(folds), {changed(s).getMaxBins() for s in settings}):
                    found[k, bins] = cells.Cells(number_columns(columns, names, estimator, F.col("fold") == k), bins)
                    kept.callback(found[k, bins].close)
            finally:
                columns.unpersist()
            # folds hold the same cells for all settings: the values of their bins and how many rows they are
            held = {f: c.held.select("label", "rows", cells.values(F.col("code"), c.cuts).alias(estimator.getFeaturesCol())) for f, c in found.items()}
            fitted = lambda k, made: (made.fit_cells(found[k, made.getMaxBins()]), held[k, made.getMaxBins()])
        else:
            ready = kept.enter_context(dealt(df, names, estimator, ["fold"])).withColumn("rows", F.lit(1))
            fitted = lambda k, made: (made.fit(ready.filter(F.col("fold") != k)), ready.filter(F.col("fold") == k))

        def run(job: tuple[int, dict]) -> list[tuple[str, float]]:
            k, setting = job
            model, rows = fitted(k, changed(setting))
            model = without_summary(model)
            found = [(setting, model)] if leasts is None else [(setting | {MIN_SPLIT: n}, m) for n, m in zip(leasts, pruned(model, leasts))]
            return [(", ".join(f"{p}={v}" for p, v in sorted(s.items())), float(judge.evaluate(m.transform(rows)))) for s, m in found]

        with ThreadPool(parallelism) as pool:
            for part in pool.imap_unordered(inheritable_thread_target(df.sparkSession)(run), jobs):
                for setting, score in part:
                    scores.setdefault(setting, []).append(score)
    rows = [(s, sum(sorted(v)) / len(v)) for s, v in scores.items()]
    return df.sparkSession.createDataFrame(rows, "setting string, score double").orderBy(F.desc("score"), "setting")


def permuted(df: DataFrame, names: Sequence[str], keys: Sequence[str], repeats: int, seed: str = "0") -> DataFrame:
    """(label, feature, features): each row once for each feature and repeat,
    with that feature from another row, and once as it is, for feature -1.

    Rows are dealt by md5 of their key into blocks of about BLOCK_ROWS; in a
    block the i-th row of one md5 order takes the value of the i-th row of
    another, each repeat by orders of its own. One exchange of the rows, however
    many features there are, in which each row is once. Keys should tell rows
    apart: rows of one key share a block."""
    n, orders = df.count(), [f"{r}{s}" for r in range(repeats) for s in "ab"]
    values = F.array(*[F.col(c).cast("double") for c in names])
    row = F.struct(*[key_number(keys, f"{seed}/{o}").alias(f"k{o}") for o in orders], values.alias("x"), F.col("label").alias("y"))
    each = df.groupBy(block_of(keys, n, seed).alias("block")).agg(F.collect_list(row).alias("rows"))
    by = lambda o: F.array_sort(F.transform("rows", lambda v: F.struct(v[f"k{o}"].alias("k"), v["x"].alias("x"), v["y"].alias("y"))))
    meet = lambda r: lambda a, b: F.struct(a["y"].alias("label"), F.lit(r).alias("r"), a["x"].alias("x"), b["x"].alias("z"))
    pair = each.select(F.explode(F.flatten(F.array(*[F.zip_with(by(f"{r}a"), by(f"{r}b"), meet(r)) for r in range(repeats)]))).alias("p"))
    mixed = pair.select("p.label", "p.x", "p.z", F.explode(F.sequence(F.when(F.col("p.r") == 0, -1).otherwise(0), F.lit(len(names) - 1))).alias("feature"))
    return mixed.select("label", "feature", array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("feature"), F.get("z", i)).otherwise(v))).alias("features"))


def block_of(keys: Sequence[str], n: int, seed: str) -> Column:
    return F.pmod(key_number(keys, f"{seed}/block"), F.lit(n // BLOCK_ROWS + 1))


def permuted_cells(df: DataFrame, names: Sequence[str], keys: Sequence[str], repeats: int, cuts: list[list[float]], seed: str = "0") -> DataFrame:
    """(label, feature, code, rows): what `permuted` gives, by the same orders
    of the same blocks, as bins between the cuts, and counted. A row crosses the
    exchange once; its copies are made and counted in the task of its block."""
    given = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    text = F.when(given, F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).alias("text")  # once for all numbers
    pair = lambda r: F.shiftleft(key_number(["text"], f"{seed}/{r}a"), 32).bitwiseOR(key_number(["text"], f"{seed}/{r}b"))
    rows = df.select(text, *cells.numbers([F.col(n) for n in names]), F.col("label").cast("double").alias("label"))
    rows = rows.select(block_of(["text"], df.count(), seed).alias("block"), *[pair(r).alias(f"k{r}") for r in range(repeats)], *rows.columns[1:])
    parts = rows.repartition("block").sortWithinPartitions("block").mapInArrow(cells.mix(cuts, repeats), "label double, feature int, code binary, rows long")
    return parts.groupBy("label", "feature", "code").agg(F.sum("rows").alias("rows"))


def permutation_importance(model: PipelineModel, df: DataFrame, keys: Sequence[str], repeats: int = 2, sample: int | None = None) -> DataFrame:
    """(feature, importance): mean loss of accuracy when the feature's values
    change rows. All features and repeats are scored from one exchange of the
    rows; they may be limited to the `sample` smallest key hashes, as the
    option is meant."""
    names = model_columns(model)
    base = df.select(*[k for k in keys if k not in names], "label", *names)
    if sample:
        base = base.orderBy(key_number(keys, "sample"), *keys).limit(sample)
    if of_cells(model, df):
        cuts = saved_cuts(model)
        counted = permuted_cells(base, names, keys, repeats, cuts)
        scored = model.stages[1].transform(counted.withColumn("features", cells.values(F.col("code"), cuts)))
    else:
        scored = model.stages[1].transform(permuted(base, names, keys, repeats)).withColumn("rows", F.lit(1))
    right = F.sum(F.when(F.col("prediction") == F.col("label"), F.col("rows")).otherwise(0))
    rows = scored.groupBy("feature").agg((right / F.sum("rows")).alias("acc")).collect()  # a row a feature
    acc = {r["feature"]: r["acc"] for r in rows}
    out = [(n, acc[-1] - acc[i]) for i, n in enumerate(names)] if acc else []
    return df.sparkSession.createDataFrame(out, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def refine(importance: DataFrame, least: float = 1e-4) -> list[str]:
    """Features worth keeping; a row a feature comes to the driver."""
    return [r["feature"] for r in importance.filter(F.col("importance") > least).orderBy("feature").collect()]

"""The preprocessing as stages of one Spark ML pipeline (F8, then F9-F13).

`preprocessing(...)` lists the stages in their order: what comes after the
numbers acts on their clipped log1p values, buckets too. Fitted on one table it
is a `PipelineModel`, which is saved and loaded as any other; each stage writes
its own state, a table of one row, and models that it holds.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from commitgrain.functions import text
from commitgrain.operators import embed, features


class StateWriter(MLWriter):
    """Spark's metadata, the stage's state, and the models that it holds."""

    def __init__(self, stage: Saved):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.sparkSession.createDataFrame([(json.dumps(self.stage.state),)], "state string").coalesce(1).write.parquet(f"{path}/state")
        for name, model in self.stage.models.items():
            model.write().save(f"{path}/models/{name}")


class StateReader(MLReader):
    def __init__(self, cls: type[Saved]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Saved:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        state = json.loads(self.sparkSession.read.parquet(f"{path}/state").first()[0])  # one row
        stage = self.cls(**state)
        stage.models = {name: PipelineModel.load(f"{path}/models/{name}") for name in stage.holds()}
        return stage._resetUid(metadata["uid"])


class Saved(MLWritable, MLReadable):
    """A stage whose state is what JSON can hold, and pipeline models by name."""

    def __init__(self, **state: Any):
        super().__init__()
        self.state, self.models = state, {}

    def holds(self) -> Sequence[str]:
        return ()

    def write(self) -> MLWriter:
        return StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return StateReader(cls)


class Numbers(Saved, Estimator):
    """Quartile fences of `numbers`, log1p, constant ones out; log1p of `tokens`."""

    def _fit(self, dataset: DataFrame) -> NumbersModel:
        found = features.fit(dataset, self.state["numbers"], self.state["tokens"])
        return NumbersModel(limits={c: list(v) for c, v in found.limits.items()}, tokens=found.tokens, constant=found.constant)


class NumbersModel(Saved, Model):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.Fitted({c: tuple(v) for c, v in self.state["limits"].items()}, self.state["tokens"], self.state["constant"]).transform(dataset)


class Terms(Saved, Estimator):
    """tfidf_<term> of the text column's commonest terms, instead of it."""

    def _fit(self, dataset: DataFrame) -> TermsModel:
        found = features.fit(dataset, [], [], self.state["column"], terms=self.state.get("terms", 100), stop_words=self.state.get("stop_words", text.STOP_WORDS))
        return TermsModel(column=found.text, idf=found.idf, stop_words=found.stop_words)


class TermsModel(Saved, Model):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.Fitted({}, [], text=self.state["column"], idf=self.state["idf"], stop_words=self.state["stop_words"]).transform(dataset)


class Components(Saved, Estimator):
    """<prefix>_<i> of each array's principal components, instead of it;
    arrays: {column: [prefix, number]}."""

    def _fit(self, dataset: DataFrame) -> ComponentsModel:
        found = features.fit(dataset, [], [], arrays={c: tuple(v) for c, v in self.state["arrays"].items()})
        model = ComponentsModel(prefixes=found.prefixes)
        model.models = found.components
        return model


class ComponentsModel(Saved, Model):
    def holds(self) -> Sequence[str]:
        return list(self.state["prefixes"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for c, prefix in self.state["prefixes"].items():
            dataset = embed.apply_pca(dataset, self.models[c], c, prefix).drop(c)
        return dataset


class Derived(Saved, Transformer):
    """Derived columns whose inputs are there."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.derive(dataset)


class Buckets(Saved, Transformer):
    """0/1 columns of each bucket of the columns that have ranges."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.one_hot(features.bucketize(dataset))


class TokenRatios(Saved, Transformer):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.token_ratios(dataset, self.state["tokens"])


class Interactions(Saved, Transformer):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.interactions(dataset, self.state["columns"])


def preprocessing(numbers: Sequence[str], tokens: Sequence[str], message: str | None = None, arrays: dict[str, tuple[str, int]] | None = None, interactions: Sequence[str] = ()) -> Pipeline:
    """All stages in order; those without columns are left out. Another order is
    another list of stages."""
    stages: list[Any] = [Numbers(numbers=list(numbers), tokens=list(tokens))]
    if message is not None:
        stages.append(Terms(column=message))
    if arrays:
        stages.append(Components(arrays={c: list(v) for c, v in arrays.items()}))
    stages += [Derived(), Buckets()]
    if tokens:
        stages.append(TokenRatios(tokens=list(tokens)))
    if interactions:
        stages.append(Interactions(columns=list(interactions)))
    return Pipeline(stages=stages)


def explained(model: PipelineModel) -> dict[str, float]:
    """The part of each array's variance that its components explain."""
    return {c: embed.explained_variance(m) for s in model.stages if isinstance(s, ComponentsModel) for c, m in s.models.items()}


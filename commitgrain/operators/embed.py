"""Embedding columns: encoders, pooling, expansion, PCA."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitgrain.functions.patches import changed_lines
from commitgrain.functions.text import hash_embedding

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: Token ids of a text, and states (rows x tokens x width) of padded ids and their mask.
Tokenize = Callable[[str], Sequence[int]]
States = Callable[[np.ndarray, np.ndarray], np.ndarray]


def clean_array(c: str) -> Column:
    """array<double>; null becomes empty."""
    return F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>"))


def embed_texts(df: DataFrame, key: str, text: str, encoder_factory: Callable[[], Encoder] | None = None, out: str = "embedding", offset: int = 0) -> DataFrame:
    """(key, embedding) by an encoder built once a task and fed Arrow batches;
    without one, by the hash embedding, which stays in the JVM."""
    if encoder_factory is None:
        return df.select(key, hash_embedding(F.col(text), offset).alias(out))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_factory()
        for b in batches:
            yield pd.DataFrame({key: b[key], out: [list(map(float, v)) for v in encode(b[text].fillna("").tolist())]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {out} array<double>")


def token_means(model: Callable[[], tuple[Tokenize, States]], max_tokens: int = 512, rows: int = 32, whole: bool = False) -> Callable[[], Encoder]:
    """An encoder factory for `embed_texts` from a model of tokens: the mean of
    the states of a text's first `max_tokens` tokens.

    `model` is called once a task. With `whole`, texts go on in windows of
    `max_tokens`, and the mean is over all tokens of all windows. Windows run in
    order of their length, `rows` at a time, so that little is padding; padding
    is masked and does not count. A text without tokens has an empty array."""
    def factory() -> Encoder:
        tokenize, states = model()

        def encode(texts: Sequence[str]) -> list[Sequence[float]]:
            windows: list[tuple[int, np.ndarray]] = []
            for i, text in enumerate(texts):
                ids = np.asarray(tokenize(text), np.int64)
                for at in range(0, len(ids) if whole else min(len(ids), 1), max_tokens):
                    windows.append((i, ids[at : at + max_tokens]))
            windows.sort(key=lambda w: len(w[1]))
            sums: list[np.ndarray | None] = [None] * len(texts)
            counts = np.zeros(len(texts), np.int64)
            for at in range(0, len(windows), rows):
                some = windows[at : at + rows]
                longest = len(some[-1][1])
                mask = np.arange(longest) < np.array([len(ids) for _, ids in some])[:, None]
                padded = np.zeros(mask.shape, np.int64)
                padded[mask] = np.concatenate([ids for _, ids in some])
                totals = np.where(mask[:, :, None], np.asarray(states(padded, mask), np.float64), 0.0).sum(1)
                for (i, ids), total in zip(some, totals):
                    sums[i] = total if sums[i] is None else sums[i] + total
                    counts[i] += len(ids)
            return [[] if total is None else total / n for total, n in zip(sums, counts)]

        return encode

    return factory


def mean_pool(df: DataFrame, keys: Sequence[str], array: str, mask: str | None = None, out: str = "pooled") -> DataFrame:
    """Mean array of each key, place by place, weighted by the mask column."""
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    x = df.select(*keys, weight.alias("_m"), F.posexplode(array).alias("_pos", "_x"))
    each = x.groupBy(*keys, "_pos").agg(F.try_divide(F.sum(F.col("_x") * F.col("_m")), F.sum("_m")).alias("_v"))
    order = F.array_sort(F.collect_list(F.struct("_pos", "_v")))
    return each.groupBy(*keys).agg(F.transform(order, lambda s: s["_v"]).alias(out))


def width_of(df: DataFrame, array: str) -> int:
    """The one width of an array column; an error where widths differ."""
    r = df.agg(F.min(F.size(array)).alias("lo"), F.max(F.size(array)).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"{array} has widths from {r['lo']} to {r['hi']}")
    return r["hi"] or 0


def expand_array(df: DataFrame, array: str, prefix: str, width: int | None = None) -> DataFrame:
    """Columns prefix_0... instead of the array."""
    n = width_of(df, array) if width is None else width
    return df.select("*", *[F.get(array, F.lit(i)).alias(f"{prefix}_{i}") for i in range(n)]).drop(array)


def fit_pca(df: DataFrame, array: str, k: int) -> PipelineModel:
    """Centring and k principal components; rows with a null array do not count."""
    v = df.filter(F.col(array).isNotNull()).select(array_to_vector(F.col(array)).alias("_v"))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v)
    pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(v))
    return PipelineModel([centre, pca])


def apply_pca(df: DataFrame, model: PipelineModel, array: str, prefix: str) -> DataFrame:
    """Columns prefix_0...: components with the sign that makes each one's
    largest loading positive."""
    loadings = model.stages[1].pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(loadings.shape[1])]
    out = model.transform(df.withColumn("_v", array_to_vector(F.col(array)))).withColumn("_a", vector_to_array("_p"))
    return out.select(*df.columns, *[(F.get("_a", F.lit(i)) * s).alias(f"{prefix}_{i}") for i, s in enumerate(signs)])


def explained_variance(model: PipelineModel | None) -> float:
    """The part of the variance that all components of a fitted PCA explain."""
    if model is None:
        raise ValueError("the PCA is not fitted")
    return float(sum(model.stages[1].explainedVariance))


def class_distances(df: DataFrame, key: str, array: str, label: str, per_class: int = 2000) -> DataFrame:
    """(between, within_0, within_1): mean Euclidean distances over at most
    `per_class` rows a class, those with the smallest md5 of the key. Within
    counts the zero distance of each row to itself."""
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    some = df.select(label, key, array).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_class)
    a, b = some.select(F.col(label).alias("la"), F.col(array).alias("va")), some.select(F.col(label).alias("lb"), F.col(array).alias("vb"))
    d = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = a.crossJoin(F.broadcast(b)).select("la", "lb", d.alias("d"))  # per_class rows a class on each side
    mean = lambda p: F.avg(F.when(p, F.col("d")))
    return pairs.agg(mean((F.col("la") == 0) & (F.col("lb") == 1)).alias("between"), mean((F.col("la") == 0) & (F.col("lb") == 0)).alias("within_0"), mean((F.col("la") == 1) & (F.col("lb") == 1)).alias("within_1"))


def _decisions(node: ast.AST) -> int:
    """Ways that a node adds to those through its function."""
    if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
        return 1 + bool(node.orelse)
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.Try):
        return bool(node.orelse)
    return int(isinstance(node, (ast.If, ast.IfExp, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.match_case)))


def _structure(source: str | None, lines: set[int]) -> tuple[int, int, int]:
    """Nodes, decision points + 1 and longest span of functions that touch lines."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return 0, 0, 0
    nodes = complexity = longest = 0
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and any(f.lineno <= i <= (f.end_lineno or f.lineno) for i in lines):
            inner = list(ast.walk(f))
            nodes += 1 + len(inner)  # a module of its own
            complexity += 1 + sum(map(_decisions, inner))
            longest = max(longest, (f.end_lineno or f.lineno) - f.lineno + 1)
    return nodes, complexity, longest


def structural_delta(patches: DataFrame) -> DataFrame:
    """(repo, commit, ast_delta, complexity_delta, max_func_change) over .py
    files that are still there: sums of absolute differences between both
    sides' changed functions, and the longest changed function of the new side."""
    py = patches.filter(F.col("path").endswith(".py") & F.col("new_text").isNotNull()).select("repo", "commit", "old_text", "new_text", changed_lines(F.col("patch")).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for old, new, lines in zip(b.old_text, b.new_text, b.lines):
                touched = set() if lines is None else set(map(int, lines))
                o, n = _structure(old, touched), _structure(new, touched)
                rows.append((abs(n[0] - o[0]), abs(n[1] - o[1]), n[2]))
            yield pd.DataFrame({"repo": b["repo"], "commit": b["commit"]} | {c: [r[i] for r in rows] for i, c in enumerate(("a", "c", "m"))})

    each = py.mapInPandas(run, "repo string, commit string, a long, c long, m long")
    return each.groupBy("repo", "commit").agg(F.sum("a").alias("ast_delta"), F.sum("c").alias("complexity_delta"), F.max("m").alias("max_func_change"))

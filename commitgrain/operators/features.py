"""Feature transforms: fitted on one table, applied to others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgrain.functions import text
from commitgrain.operators import embed, profile

#: Bucket edges and labels, components of each embedding, and derived columns.
BUCKETS = {
    "loc_added": [(0, 3, "very_small"), (3, 6, "small"), (6, 10, "medium"), (10, 20, "large"), (20, float("inf"), "very_large")],
    "author_exp_pre": [(0, 1, "junior"), (1, 5, "mid"), (5, float("inf"), "senior")],
}
ARRAYS = {"code_embed": ("code_emb", 60), "msg_embed": ("msg_emb", 80)}
DERIVED: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "loc_churn_ratio": (["loc_added", "loc_deleted"], lambda: F.col("loc_added") / (F.col("loc_deleted") + 1)),
    "activity_per_exp": (["author_recent_activity_pre", "author_exp_pre"], lambda: F.col("author_recent_activity_pre") / (F.col("author_exp_pre") + 1)),
}


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))


@dataclass
class Fitted:
    """Parameters of all steps: fences of numbers and which of them are
    constant, tokens, a text with its terms, and arrays with their components."""

    limits: dict[str, tuple[float, float]]
    tokens: list[str]
    constant: list[str] = field(default_factory=list)
    text: str | None = None
    idf: dict[str, float] = field(default_factory=dict)
    stop_words: list[str] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)
    components: dict[str, PipelineModel] = field(default_factory=dict, compare=False)

    def transform(self, df: DataFrame) -> DataFrame:
        """Clipped and log1p numbers without constant ones, log1p tokens,
        tfidf_<term> for the text, <prefix>_<i> for each array; other columns
        pass. A projection without a shuffle."""
        new = {c: F.log1p(clip(F.col(c).cast("double"), lo, hi)) for c, (lo, hi) in self.limits.items()}
        out = df.withColumns(new | {t: F.log1p(F.col(t).cast("double")) for t in self.tokens}).drop(*self.constant)
        if self.text is not None:
            weights = F.map_from_entries(text.term_weights(text.clean_message(F.coalesce(F.col(self.text), F.lit(""))), self.idf, self.stop_words))
            out = out.withColumn("_weights", weights)
            out = out.withColumns({f"tfidf_{t}": F.coalesce(F.try_element_at("_weights", F.lit(t)), F.lit(0.0)) for t in self.idf}).drop("_weights", self.text)
        for c, prefix in self.prefixes.items():
            out = embed.apply_pca(out, self.components[c], c, prefix).drop(c)
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        data = [("number", c, lo, hi, c in self.constant, None) for c, (lo, hi) in self.limits.items()] + [("token", t, None, None, False, None) for t in self.tokens]
        data += [("text", self.text, None, None, False, None)] * (self.text is not None) + [("term", t, x, None, False, None) for t, x in self.idf.items()]
        data += [("stop", w, None, None, False, None) for w in self.stop_words] + [("array", c, None, None, False, p) for c, p in self.prefixes.items()]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "place int, kind string, name string, lo double, hi double, constant boolean, prefix string")

    def save(self, spark: SparkSession, path: str) -> None:
        self.rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        for c, model in self.components.items():
            model.write().overwrite().save(f"{path}/components/{c}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        rows = spark.read.parquet(f"{path}/columns").orderBy("place").collect()  # a row a column, term or stop word
        of = lambda kind: [r for r in rows if r["kind"] == kind]
        prefixes = {r["name"]: r["prefix"] for r in of("array")}
        return cls({r["name"]: (r["lo"], r["hi"]) for r in of("number")}, [r["name"] for r in of("token")], [r["name"] for r in rows if r["constant"]],
                   next((r["name"] for r in of("text")), None), {r["name"]: r["lo"] for r in of("term")}, [r["name"] for r in of("stop")],
                   prefixes, {c: PipelineModel.load(f"{path}/components/{c}") for c in prefixes})


def fit(train: DataFrame, numbers: Sequence[str], tokens: Sequence[str], message: str | None = None, arrays: dict[str, tuple[str, int]] | None = None,
        terms: int = 100, stop_words: Sequence[str] = text.STOP_WORDS, approx: int | None = None) -> Fitted:
    """Quartile fences of the numbers, then which are constant after them; the
    terms of the message with the highest counts; for each array (column: prefix
    and number) its principal components, fewer where the array is narrower."""
    limits = {r["column"]: (r["lo"], r["hi"]) for r in profile.fences(train, list(numbers), approx=approx).collect()} if numbers else {}  # a row a column
    out = Fitted(limits, list(tokens))
    if numbers:
        spread = variances(out.transform(train), list(numbers)).filter("variance = 0 or variance is null").collect()
        out.constant = sorted(r["column"] for r in spread)
    if message is not None:
        clean = train.select(text.clean_message(F.coalesce(F.col(message), F.lit(""))).alias("clean"))
        found = text.fit_vocabulary(clean, "clean", terms, stop_words).orderBy("term").collect()  # `terms` rows
        out.text, out.idf, out.stop_words = message, {r["term"]: r["idf"] for r in found}, list(stop_words)
    for c, (prefix, k) in (arrays or {}).items():
        out.prefixes[c] = prefix
        out.components[c] = embed.fit_pca(train, c, min(k, embed.width_of(train.filter(F.col(c).isNotNull()), c)))
    return out


def transform_subset(df: DataFrame, subset: str, path: str, numbers: Sequence[str], tokens: Sequence[str], message: str | None = "message",
                     arrays: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """`train` is fitted, saved under path and transformed; `test` and `val`
    take what path has; any other subset is an error."""
    if subset not in ("train", "test", "val"):
        raise ValueError(f"unknown subset: {subset}")
    if subset == "train":
        fit(df, numbers, tokens, message, ARRAYS if arrays is None else arrays).save(df.sparkSession, path)
    return Fitted.load(df.sparkSession, path).transform(df)


def variances(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.agg(*[F.var_pop(c).alias(c) for c in names]).unpivot([], list(names), "column", "variance")


def winsorize(df: DataFrame, fitted_on: DataFrame, names: Sequence[str], approx: int | None = None) -> DataFrame:
    limits = {r["column"]: (r["lo"], r["hi"]) for r in profile.fences(fitted_on, list(names), approx=approx).collect()}
    return df.withColumns({c: clip(F.col(c).cast("double"), *limits[c]) for c in names})


def quantile_flag(df: DataFrame, fitted_on: DataFrame, name: str, q: float = 0.95, out: str = "extreme_churn_flag", approx: int | None = None) -> DataFrame:
    """1 above the quantile that fitted_on has."""
    limit = F.broadcast(profile.quantiles(fitted_on, [name], [q], approx=approx).agg(F.max(F.get("q", F.lit(0))).alias("_limit")))  # one row
    return df.join(limit).withColumn(out, F.coalesce((F.col(name) > F.col("_limit")).cast("int"), F.lit(0))).drop("_limit")


def derive(df: DataFrame, rules: dict[str, tuple[list[str], Callable[[], Column]]] = DERIVED) -> DataFrame:
    """Derived columns whose inputs are there; others are skipped."""
    return df.withColumns({k: f() for k, (needs, f) in rules.items() if set(needs) <= set(df.columns)})


def bucket(value: Column, ranges: Sequence[tuple[float, float, str]]) -> Column:
    """The label of the range [from, to) that holds value, else null."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(sorted(ranges)):
        inside = value >= lo if hi == float("inf") else (value >= lo) & (value < hi)
        out = F.when(inside, label).otherwise(out)
    return out


def bucketize(df: DataFrame, ranges: dict[str, Sequence[tuple[float, float, str]]] = BUCKETS) -> DataFrame:
    return df.withColumns({f"{c}_bucket": bucket(F.col(c), r) for c, r in ranges.items() if c in df.columns})


def one_hot(df: DataFrame, ranges: dict[str, Sequence[tuple[float, float, str]]] = BUCKETS) -> DataFrame:
    """0/1 columns for all labels of each bucket column, which goes."""
    new = {f"{c}_bucket_{label}": F.coalesce((F.col(f"{c}_bucket") == label).cast("int"), F.lit(0)) for c, r in ranges.items() if f"{c}_bucket" in df.columns for _, _, label in r}
    return df.withColumns(new).drop(*[f"{c}_bucket" for c in ranges])


def token_ratios(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """The tokens' total, and their ratios to added lines where those are there."""
    if missing := [t for t in tokens if t not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    total = sum((F.col(t) for t in tokens[1:]), F.col(tokens[0]))
    ratios = {f"{t}_ratio": F.col(t) / (F.col("loc_added") + 1) for t in tokens} if "loc_added" in df.columns else {}
    return df.withColumns({"line_token_total": total} | ratios)


def interactions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(names, 2)})

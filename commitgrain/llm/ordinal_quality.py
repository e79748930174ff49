"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(x . w - t_k), with one weight for each hashed feature
of the text, shared by all grades, and thresholds t_1 <= t_2 <= ... The
expected grade is the sum of these tail probabilities; documents are selected
by the tail probability of the best grade.

Weights are demerits, at most 0: a fault of a text cannot be made up for by
much ordinary text around it, so long documents are judged as short ones are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgrain.llm import _bytes as B
from commitgrain.llm._common import columns

#: Hashed features: two to this power.
BITS = 20
#: Bytes of a word that its two features take.
HEAD, TAIL = 5, 3
#: Labelled documents that the fit takes at most; where there are more, those
#: with the smallest hash of their id.
MAX_ROWS = 8000
SCORED = "doc_id long, expected_grade double, tail_probability double, threshold double, kept boolean"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document and their firsts: the first
    HEAD bytes of lower-cased words, the last TAIL bytes of words, and whether
    a 16th, an 8th, a quarter, half of the words repeat the one before."""
    starts, ends, firsts = B.words(data, offsets)
    docs = B.owner(firsts)
    low = B.LOWER[data]
    whole = B.span_hashes(low, starts, ends, seed=21)
    heads = B.span_hashes(low, starts, np.minimum(ends, starts + HEAD), seed=22)
    tails = B.span_hashes(data, np.maximum(starts, ends - TAIL), ends, seed=23)
    again = docs[1:][(whole[1:] == whole[:-1]) & (docs[1:] == docs[:-1])]
    count, n = np.bincount(again, minlength=len(offsets) - 1), np.diff(firsts)
    keys, docs = [heads, tails], [docs, docs]
    for part in (16, 8, 4, 2):
        much = np.flatnonzero((count * part >= n) & (n >= part))
        keys.append(np.full(len(much), part, np.uint64))
        docs.append(much)
    keys, docs = np.concatenate(keys), np.concatenate(docs).astype(np.int64)
    both = np.unique((docs << BITS) | (B.mix(keys) >> np.uint64(64 - BITS)).astype(np.int64))
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(offsets)))


def shares(index: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The weight of each document in the fit. Copies and near copies share
    three minimum hashes of their features, and together weigh 1."""
    full = np.flatnonzero(np.diff(firsts))
    key = np.zeros((len(firsts) - 1, 3), np.uint64)
    for j in range(3):
        if len(full):
            key[full, j] = np.minimum.reduceat(B.mix(index.astype(np.uint64) + np.uint64((j + 1) << 40)), firsts[full])
    _, group, size = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    return 1 / size[group.ravel()]


def screened(index: np.ndarray, firsts: np.ndarray, grades: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Features whose frequency differs between grades by z deviations: 3.5 for
    up to 400 documents, 5 from 4000 on, between them by the logarithm; fewer
    documents name fewer features by chance."""
    n, size = share.sum(), 1 << BITS
    z = float(np.clip(3.5 + 1.5 * np.log10(max(n, 1) / 400), 3.5, 5.0))
    own, each = np.repeat(grades, np.diff(firsts)), np.repeat(share, np.diff(firsts))
    df = np.bincount(index, each, size)
    score = np.zeros(size)
    for g in np.unique(grades):
        p = share[grades == g].sum() / n
        spread = np.sqrt(np.maximum(df * p * (1 - p) * (1 - df / n), 1e-9))
        score = np.maximum(score, np.abs(np.bincount(index[own == g], each[own == g], size) - df * p) / spread)
    return np.flatnonzero((score >= z) & (df >= min(8, 4 + n / 1000, n / 20)) & (df < n))


def loss_and_slope(params: np.ndarray, x: tuple[np.ndarray, np.ndarray], grades: np.ndarray, share: np.ndarray, top: int, penalty: float) -> tuple[float, np.ndarray]:
    """Weighted negative log-likelihood of the cumulative-link model, and its
    gradient. params: the first threshold, logarithms of the steps between
    thresholds, then the root of each feature's demerit, whose sum is the
    penalty."""
    column, firsts = x
    n, shape, root = len(grades), params[:top], params[top:]
    eta = B.per_doc(-(root * root)[column], firsts)
    steps = np.exp(shape[1:])
    t = np.concatenate([shape[:1], shape[0] + np.cumsum(steps)])
    tail = 1 / (1 + np.exp(np.clip(t[None] - eta[:, None], -40, 40)))  # P(grade >= k), k = 1...
    up = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
    row = np.arange(n)
    p = np.maximum(up[row, grades] - up[row, grades + 1], 1e-12)
    slope = up * (1 - up)
    below, above = slope[row, grades] / p * share, slope[row, grades + 1] / p * share
    d_t = np.bincount(grades, below, top + 2) - np.bincount(grades + 1, above, top + 2)
    d_t = d_t[1 : top + 1]
    after = np.cumsum(d_t[::-1])[::-1]  # what a shift of this and all later thresholds does
    d_w = np.bincount(column, np.repeat(above - below, np.diff(firsts)), len(root))
    return float(-np.log(p) @ share + penalty * (root @ root)), np.concatenate([after[:1], after[1:] * steps, 2 * root * (penalty - d_w)])


def minimise(f, start: np.ndarray, steps: int = 150, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a halving line search."""
    x, (value, slope), past = start, f(start), []
    for _ in range(steps):
        d, alphas = -slope, []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(alphas)):
            d = d + s * (a - r * (y @ d))
        step, down = (1.0 if past else min(1.0, 1 / max(np.abs(slope).sum(), 1e-12))), slope @ d
        while step > 1e-10:
            new = x + step * d
            new_value, new_slope = f(new)
            if new_value <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            return x
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


#: Distance between thresholds at the start of the fit.
ROOM = 15.0
#: Root of each demerit at the start: so small that ordinary texts start as good.
START = 0.03


def fit(index: np.ndarray, firsts: np.ndarray, grades: np.ndarray, penalty: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all hashed features (0 where screened out) and thresholds."""
    top = int(grades.max())
    share = shares(index, firsts)
    kept = screened(index, firsts, grades, share)
    share = share / share.sum()
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    column = place[index]
    inside = column >= 0
    x = column[inside], B.running(inside.astype(np.int64))[firsts]
    tails = np.clip([share[grades >= k].sum() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    t = np.sort(-np.log(tails / (1 - tails)))
    t = np.minimum(t, -2.0) - ROOM * np.arange(top - 1, -1, -1)  # demerits only go down: leave room for each grade
    start = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2)), np.full(len(kept), START)])
    best = minimise(lambda v: loss_and_slope(v, x, grades, share, top, penalty), start)
    w = np.zeros(1 << BITS)
    w[kept] = -best[top:] ** 2
    return w, np.concatenate([best[:1], best[0] + np.cumsum(np.exp(best[1:top]))])


def score(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected grade, probability of the best grade, and whether there is a
    word at all, of each document."""
    index, firsts = features(data, offsets)
    eta = B.per_doc(w[index].astype(np.float64), firsts)
    tail = 1 / (1 + np.exp(np.clip(thresholds[None] - eta[:, None], -40, 40)))
    return tail.sum(1), tail[:, -1], np.diff(firsts) > 0


def limit(thresholds: np.ndarray, least: float) -> float:
    """`least` times the probability of the best grade of a document without
    any demerit."""
    return float(least / (1 + np.exp(np.clip(thresholds[-1], -40, 40))))


def _featured(batches):
    for batch in batches:
        for rows, data, offsets in B.slices(batch, "text"):
            index, firsts = features(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), B.list_column(index.astype(np.int32), firsts, pa.int32())], ["doc_id", "grade", "features"])


def _fitted(batches):
    rows = [(doc, grade, f.values.to_numpy()) for b in batches for doc, grade, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
    rows.sort(key=lambda r: (*r[:2], r[2].tobytes()))  # the sample is bounded; in order, the fit is the same in every run
    grades = np.array([r[1] for r in rows], np.int64)
    if not len(set(grades)) > 1:  # nothing to tell apart
        w, t = np.zeros(1 << BITS), np.array([-30.0])
    else:
        firsts = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
        w, t = fit(np.concatenate([r[2] for r in rows]).astype(np.int64), firsts, grades)
    yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([t.astype("<f8").tobytes()], pa.binary())], ["weights", "thresholds"])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from the labels quality and toxic: a point for good
    quality and a point for not being toxic, so 0, 1 or 2. A document with
    several labels takes the worst of each; labels with a null do not count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").na.drop()
    one = known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return one.select("doc_id", ((F.col("q") >= 1).cast("int") + (F.col("t") < 1).cast("int")).alias("grade"))


def sample(ratings: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit_model(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from docs and ratings (doc_id, grade). The fit
    takes the features of max_rows labelled documents at most to one task; the
    model it sends back has a fixed size. Unlabelled input gives a model that
    keeps all."""
    base = columns(docs, key, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    chosen = F.broadcast(sample(ratings, max_rows))  # max_rows rows of two numbers
    rows = base.join(chosen, "doc_id").select("doc_id", "grade", "text")
    got = rows.mapInArrow(_featured, "doc_id long, grade int, features array<int>").repartition(1).mapInArrow(_fitted, "weights binary, thresholds binary").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), np.array([-30.0])
    return np.frombuffer(got[0]["weights"], "<f4"), np.frombuffer(got[0]["thresholds"], "<f8")


def ordinal_quality(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text",
                    least: float = 0.8, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row a document: doc_id, expected_grade, tail_probability (of the
    best grade), threshold (`least` times that of a document without demerits,
    so few labels do not reject the ordinary), kept (with a word, and
    tail_probability at least threshold).

    Every document is scored over its whole text. Null and wordless texts are
    not kept, with grade 0 and probability 0; repeated ids give a row each; an
    empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, ratings, key=key, text=text, max_rows=max_rows))

    def run(batches):
        w, t = model.value
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text"):
                expected, tail, full = score(data, offsets, w, t)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.where(full, expected, 0.0)), pa.array(np.where(full, tail, 0.0)), pa.array(np.full(len(tail), limit(t, least))), pa.array(full & (tail >= limit(t, least)))],
                                                 ["doc_id", "expected_grade", "tail_probability", "threshold", "kept"])

    base = columns(docs, key, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(run, SCORED)


def select_good(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.8, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that `ordinal_quality` keeps."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, ratings, key=key, text=text, max_rows=max_rows))

    def run(batches):
        w, t = model.value
        for batch in batches:
            for rows, data, offsets in B.slices(batch, text):
                _, tail, full = score(data, offsets, w, t)
                yield rows.filter(pa.array(full & (tail >= limit(t, least))))

    return docs.mapInArrow(run, docs.schema)

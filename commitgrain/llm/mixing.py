"""Mixing sources to target weights by Pareto order sampling.

All of it is DataFrame expressions. A source's target is its share by weight
of all words, stopped at `ceiling` times its own words; what is over is shared
again by weight until no source is above (the "water level" below). Each
document of a source comes as many whole times as target / source words has
ones; those copies are certain. What is left of the target is drawn: every
document may come once more, with an inclusion probability p whose odds grow
with the document's size to the power `power`, so that longer documents are
likelier to come again; one factor for each source makes the expected words of
the draw what is left. The draw is Pareto order sampling: documents are ranked
by odds(u) / odds(p), u being a random number from the document's id and text,
and the lowest ranks are taken until their words fill what is left. The size of
the sample is thus fixed in words; the last step takes the single further
document that brings the sum nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitgrain.llm._common import WORD, columns, stored

#: Cells of the rank's histogram for each source.
CELLS = 1 << 16
#: Bounds of a factor's logarithm, and how often the interval is halved.
LIMIT, STEPS = 200.0, 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(tag: Column) -> Column:
    """A number in (0, 1) from the first digits of a digest."""
    return (F.conv(F.substring(tag, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def size_class(size: Column) -> Column:
    """Binary digits of a size less one: documents of one class share p."""
    return F.length(F.bin(size)) - 1


def factor(classes: Column, rest: Column, power: float) -> Column:
    """The logarithm to base 2 of the factor c for which the sum of words * p
    over [(class, words)] is rest, where p / (1 - p) = c * 2 ** (class * power).
    Halving an interval STEPS times finds it."""
    def words(log: Column) -> Column:
        odds = lambda k: F.pow(F.lit(2.0), log + k["class"] * F.lit(power))
        return F.aggregate(classes, F.lit(0.0), lambda s, k: s + k["words"] * odds(k) / (1 + odds(k)))

    def half(at: Column, _: Column) -> Column:
        mid = (at["lo"] + at["hi"]) / 2
        low = words(mid) < rest
        return F.struct(F.when(low, mid).otherwise(at["lo"]).alias("lo"), F.when(low, at["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(-LIMIT).alias("lo"), F.lit(LIMIT).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, half, lambda at: (at["lo"] + at["hi"]) / 2)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ceiling: float = 3.0) -> DataFrame:
    """(source, source_size) with one row a source -> also weight and target.

    The weights follow the order of all sources, so one row a source passes
    through one task. Sources by code point, null last, get the weights in turn. The level L
    solves sum(min(ceiling * size, L * weight)) = sum(size): with sources in
    order of ceiling * size / weight, it is the first whose level does not
    pass its own bound.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    one = sizes.withColumn("weight", w).withColumn("bound", ceiling * F.col("source_size") / F.col("weight"))
    by_bound = Window.orderBy("bound", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    one = one.withColumn("stopped", F.coalesce(F.sum(ceiling * F.col("source_size")).over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    one = one.withColumn("open", F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing)))
    one = one.withColumn("level", (F.sum("source_size").over(everything) - F.col("stopped")) / F.col("open"))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("bound"), F.col("level"))).over(everything), F.max("bound").over(everything))
    return one.select("source", "source_size", "weight", F.least(ceiling * F.col("source_size"), level * F.col("weight")).alias("target"))


def pareto_mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
               weights: tuple[float, ...] = (5.0, 2.0, 1.0), ceiling: float = 3.0, power: float = 0.5, seed: str = "mix-1") -> DataFrame:
    """One row a document: doc_id, source, text_md5, number, size, source_size,
    target, p, copies, taken.

    Null text is empty; a text without words has size 0 and only the whole
    copies. A null source is a source of its own, a null id an id like others;
    an empty table gives an empty table. Rows that repeat an id are documents
    of their own, told apart by their text and, where that is equal too, by a
    number from 1 on: such rows are counted before the shuffle and come apart
    again after it. The random number depends on id, text and number alone, so
    reruns agree whatever the partitions; equal ranks stand in order of it.

    Nothing gathers a source in one task: documents are first summed into
    CELLS cells of their rank, the running sum over a source's cells finds the
    one in which the sample fills up, and only that cell is put in order.
    """
    base = columns(docs, key, source, text).toDF("doc_id", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.md5(F.col("text").cast("binary")).alias("text_md5"), word_count(F.col("text")).alias("size"))
    base = base.groupBy("doc_id", "source", "text_md5", "size").agg(F.count(F.lit(1)).alias("rows"))
    base = base.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")
    tag = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_md5", F.col("number").cast("string"), F.lit(seed)).cast("binary"))
    base = stored(base.withColumn("tag", tag), "mix-sizes")
    sizes = base.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    each = sizes.groupBy("source").agg(F.sum("words").alias("source_size"), F.array_sort(F.collect_list(F.struct("class", "words"))).alias("classes"))
    plan = targets(each.select("source", "source_size"), weights, ceiling)
    plan = plan.join(each.select(F.col("source").alias("of"), "classes"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio).cast("long")).withColumn("rest", F.col("target") - F.floor(ratio) * F.col("source_size"))
    plan = plan.withColumn("factor", F.when(F.col("rest") > 0, factor(F.col("classes"), F.col("rest"), power))).drop("classes")
    plan = stored(plan, "mix-targets")
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    ranked = base.alias("d").join(plan.alias("t"), same).select("d.*", "t.source_size", "t.target", "t.whole", "t.rest", "t.factor", unit(F.col("d.tag")).alias("u"))
    odds = F.when(F.col("size") > 0, F.pow(F.lit(2.0), F.col("factor") + size_class(F.col("size")) * F.lit(power)))
    ranked = ranked.withColumn("p", F.coalesce(odds / (1 + odds), F.lit(0.0))).withColumn("rank", F.col("u") / (1 - F.col("u")) / odds)
    # rank / (1 + rank) is increasing too, and lies in (0, 1)
    ranked = ranked.withColumn("cell", F.when(F.col("rank").isNotNull(), F.least(F.lit(CELLS - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS)).cast("int")))
    cells = ranked.filter("cell is not null").groupBy("source", "cell", "rest").agg(F.sum("size").alias("cell_size"))
    along = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("cell_size").over(along))
    filled = (cells.filter(F.col("upto") > F.col("rest")).groupBy("source")
              .agg(F.min("cell").alias("edge"), F.min(F.col("upto")).alias("edge_upto"), F.min_by("cell_size", "cell").alias("edge_size")))
    filled = stored(filled.select("source", "edge", (F.col("edge_upto") - F.col("edge_size")).alias("below")), "mix-edges")
    marked = (ranked.alias("r").join(filled.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")), "left")
              .select("r.*", F.col("f.edge"), F.col("f.below")))
    in_edge = Window.partitionBy("source").orderBy("rank", "tag").rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.filter(F.col("cell") == F.col("edge")).withColumn("sum", F.col("below") + F.sum("size").over(in_edge))
    inside = (F.col("sum") <= F.col("rest")).cast("int")
    # what the documents taken in order leave open, at most one document wide
    gaps = (edge.withColumn("inside", inside).groupBy("source")
            .agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("inside") == 1, F.col("sum"))), F.max("below"))).alias("gap")))
    gaps = stored(gaps, "mix-gaps")
    head = marked.filter(F.col("cell").isNull() | F.col("edge").isNull() | (F.col("cell") != F.col("edge")))
    head = head.withColumn("extra", F.when(F.col("cell").isNull(), 0).when(F.col("edge").isNull(), 1).otherwise((F.col("cell") < F.col("edge")).cast("int")))
    keep = ["doc_id", "text_md5", "number", "source", "size", "source_size", "target", "p", "whole", "extra", "rank", "tag"]
    drawn = head.select(*keep).unionByName(edge.withColumn("extra", inside).select(*keep))
    left = (drawn.filter("extra = 0 and rank is not null").alias("r")
            .join(gaps.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.*", "g.gap"))
    miss = F.abs(F.col("size") - F.col("gap"))
    last = left.filter(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "tag")).alias("pick"))
    last = stored(last.select("source", F.col("pick.tag").alias("pick")), "mix-last")
    done = drawn.alias("r").join(last.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left")
    picked = F.coalesce((F.col("r.tag") == F.col("l.pick")).cast("int"), F.lit(0))
    copies = F.col("r.whole") + F.greatest(F.col("r.extra"), picked)
    return done.select("r.doc_id", "r.source", "r.text_md5", "r.number", "r.size", "r.source_size", "r.target", "r.p", copies.cast("long").alias("copies"),
                       (copies * F.col("r.size")).cast("long").alias("taken"))

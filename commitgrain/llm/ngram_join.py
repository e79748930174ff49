"""N-gram Jaccard join over prefix trees.

Every document is the set of its k-word shingles, kept in one global order:
rarest first, by a fixed-size sketch of all shingles' frequencies, then by
hash. Two sets that reach the similarity share `least` shingles among the first
n - ceil(similarity * n) + least of each, so only these fronts are exchanged.

1. Equal sets are one class, represented by its smallest document.
2. Each shingle of a front names lists of sets, one for each band of sizes and
   the next larger one; the smallest set of a list leads it. A set joins the
   blocks of the leaders of its lists, so sets of like size with a common
   shingle in front meet in a block. Copies of a text share most of their
   leaders. Blocks in which a set has a few chance shingles it leaves, as long
   as these are together less than half of `least`: two sets that both do so
   still have a block in common if they share `least`.
3. A block builds the prefix tree of its sets and walks it once for all of
   them: a node's overlap with every set is counted once for the sets below it,
   and a set leaves a subtree as soon as the shingles that remain, on either
   side, cannot reach the overlap that the smallest set below would need, or
   when links found so far connect it to all that is below. A block sends a
   spanning forest of its links, never its pairs.
4. A block above its bounds is dealt into parts, with a few sets that are in
   all parts. What the links have not brought together then meets part by part:
   sets outside the block's largest component with each other and with it.

Trees hold the sets from their frequent end, where copies share the most.
Shingles that only one set of a block has stay out of the tree; they count in
the set's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitgrain.llm import _bytes as B
from commitgrain.llm._common import columns, partitions, stored
from commitgrain.llm._components import components

#: Cells of the frequency sketch, 8 MB on the driver and 1 MB in each worker,
#: and how they travel.
CELLS, CHUNK = 1 << 20, 1 << 13
#: Bounds of a part of a block: sets, and shingles in all of them.
BLOCK, BLOCK_TOKENS = 512, 1 << 20
#: Sets of a block that are in all of its parts, about.
HUBS = 16
SETS = "doc_id long, n int, c1 long, c2 long, counts binary"


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and firsts."""
    low = B.LOWER[data]
    starts, ends, firsts = B.words(low, offsets)
    hashes = B.span_hashes(low, starts, ends, seed=5)
    runs, at = B.windows(hashes, firsts, k)
    docs = B.owner(firsts)[at]
    counts = np.diff(firsts)
    for n in range(1, k):  # too few words: all of them are the one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.full(len(short), n, np.uint64)
            for j in range(n):
                total += hashes[firsts[short] + j] * np.uint64(2 * j + 3)
            runs, docs = np.concatenate([runs, B.mix(total)]), np.concatenate([docs, short])
    order = np.lexsort((runs, docs))
    runs, docs = runs[order], docs[order]
    head = np.ones(len(runs), bool)
    head[1:] = (runs[1:] != runs[:-1]) | (docs[1:] != docs[:-1])
    runs, docs = runs[head], docs[head]
    return runs, np.searchsorted(docs, np.arange(len(offsets)))


def class_ids(sets: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each document's set."""
    return tuple(B.mix(B.per_doc(B.mix(sets ^ np.uint64(salt)), firsts) + np.diff(firsts).astype(np.uint64)).view(np.int64) for salt in (0x51ED270B, 0xA24BAED4963EE407))


def cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def _sets(k: int):
    names = [c.split()[0] for c in SETS.split(", ")]

    def run(batches):
        sketch = np.zeros(CELLS, np.int64)
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text"):
                sets, firsts = shingles(data, offsets, k)
                sketch += np.bincount(cell(sets), minlength=CELLS)
                none = pa.nulls(rows.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(firsts).astype(np.int32)), *map(pa.array, class_ids(sets, firsts)), none], names)
        part = TaskContext.get().partitionId()
        for i in range(CELLS // CHUNK):  # rows of n = -1 carry the sketch: chunk and task in place of the digests
            if (piece := sketch[i * CHUNK : (i + 1) * CHUNK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int32()), pa.array([i], pa.int64()), pa.array([part], pa.int64()), pa.array([narrow(piece)], pa.binary())], names)
    return run


def narrow(counts: np.ndarray) -> bytes:
    """Counts of a chunk in as few bytes each as the largest takes."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // CHUNK}").astype(np.int64)


def _summed(table: pa.Table) -> pa.Table:
    total = sum(widened(x.as_buffer()) for x in table.column("counts"))
    return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "counts": pa.array([narrow(total)], pa.binary())})


def frequencies(found: DataFrame) -> np.ndarray:
    """The tasks' sketches, summed 64 at a time, as steps of a logarithmic
    scale: CELLS numbers from 0 to 255."""
    parts = found.filter("n < 0").select(F.col("c1").alias("chunk"), F.col("c2").alias("part"), "counts")
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // 64)
        parts = parts.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("chunk", "part").applyInArrow(_summed, "chunk long, part long, counts binary")
        if tasks <= 1:
            break
    out = np.zeros(CELLS, np.int64)
    for r in parts.toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = widened(r["counts"])
    return np.minimum(np.log2(1 + out) * 6, 255).astype(np.uint8)


def least_shared(n: np.ndarray, pct: int) -> np.ndarray:
    """Shingles that the fronts of a set of n and of any larger one that
    reaches it have in common."""
    return 1 + (n - (pct * n + 99) // 100 + 1) // 4


def front_length(n: np.ndarray, pct: int) -> np.ndarray:
    return np.minimum(n, n - (pct * n + 99) // 100 + least_shared(n, pct))


def _fronts(weight, pct: int, k: int):
    """(tok, c1): the front of each set, one of equal sets in a slice."""
    def run(batches):
        for batch in batches:
            for _, data, offsets in B.slices(batch, "text", 2 * B.SLICE_BYTES):
                sets, firsts = shingles(data, offsets, k)
                c1, _ = class_ids(sets, firsts)
                n = np.diff(firsts)
                docs = B.owner(firsts)
                sets = sets[np.argsort(docs * 256 + weight.value[cell(sets)], kind="stable")]
                first = np.zeros(len(n), bool)
                first[np.unique(c1, return_index=True)[1]] = True
                length = np.where(first & (n > 0), front_length(n, pct), 0)
                doc = np.repeat(np.arange(len(n)), length)
                tok = sets[firsts[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)]
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(c1[doc])], ["tok", "c1"])
    return run


def _packed_sets(k: int):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in B.slices(batch, "text"):
                sets, firsts = shingles(data, offsets, k)
                c1, _ = class_ids(sets, firsts)
                wanted = rows.column(0).fill_null(0).to_numpy()
                mine = pa.array((c1 == wanted) | rows.column(0).is_null().to_numpy(zero_copy_only=False))  # an id may stand for several texts
                packed = pa.array([sets[firsts[i] : firsts[i + 1]].tobytes() for i in range(len(firsts) - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c1), packed], ["c1", "tokens"]).filter(mine)
    return run


def token_sets(base: DataFrame, touched: DataFrame, k: int) -> DataFrame:
    """(c1, tokens) of the touched classes, from their representatives' texts.
    Classes of rows without an id are found among those rows, by digest. Both
    sides grow with the corpus, so they are always dealt by id and never sent
    whole to all tasks."""
    reps = touched.select("c1", F.col("rep").alias("doc_id"))
    named = base.hint("merge").join(reps, "doc_id").select("c1", "text").mapInArrow(_packed_sets(k), "c1 long, tokens binary").dropDuplicates(["c1"])
    nameless = base.filter("doc_id is null").select(F.lit(None).cast("long").alias("c1"), "text").mapInArrow(_packed_sets(k), "c1 long, tokens binary")
    nameless = nameless.join(reps.filter("doc_id is null").select("c1"), "c1", "left_semi").dropDuplicates(["c1"])
    return stored(named.unionByName(nameless), "token-sets")


def tree_links(sets: list[np.ndarray], label: np.ndarray, pct: int, weight: np.ndarray) -> list[tuple[int, int]]:
    """Places (a, b) of sets that are similar: enough links to connect all that
    are connected, given that equal labels already are."""
    size = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    names, token = np.unique(tokens, return_inverse=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, weight[cell(names)]))[::-1]] = np.arange(len(names))
    token, owner = rank[token], np.repeat(np.arange(len(sets)), size)
    while True:  # leave out what only one set has, then sets that cannot reach any other
        many = np.bincount(token, minlength=len(names))[token] > 1
        able = 100 * np.bincount(owner[many], minlength=len(sets)) >= pct * size
        keep = many & able[owner]
        if keep.all():
            break
        token, owner = token[keep], owner[keep]
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    some = np.unique(owner)
    if len(some) < 2:
        return []
    cuts = np.searchsorted(owner, np.append(some, len(sets)))
    paths = [token[cuts[i] : cuts[i + 1]].astype(">i4") for i in range(len(some))]
    by_path = sorted(range(len(some)), key=lambda i: paths[i].tobytes())
    paths, some = [paths[i].astype(np.int64) for i in by_path], some[by_path]
    n, length, label = size[some], np.array([len(p) for p in paths]), np.unique(label[some], return_inverse=True)[1]
    common = np.zeros(len(paths), np.int64)  # shingles at the root's side that a path shares with the one before
    for i in range(1, len(paths)):
        m = min(length[i - 1], length[i])
        differs = np.flatnonzero(paths[i - 1][:m] != paths[i][:m])
        common[i] = differs[0] if len(differs) else m
    owner, token = np.repeat(np.arange(len(paths)), length), np.concatenate(paths)
    placed = owner * len(names) + token  # increasing
    by_token = np.argsort(token, kind="stable")
    holders, firsts = owner[by_token], np.searchsorted(token[by_token], np.arange(len(names) + 1))
    links: list[tuple[int, int]] = []
    stack = [(0, len(paths), 0, np.zeros(len(paths), np.int64), np.arange(1, len(paths)))]
    while stack:  # the node of paths lo...hi at a depth, its overlaps with all sets, and the sets that may reach some of its own
        lo, hi, depth, overlap, live = stack.pop()
        to = int(length[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
        live = live[live > lo]
        if (label[lo:hi] == label[lo]).all():
            live = live[label[live] != label[lo]]
        if not len(live):
            continue
        run = paths[lo][depth:to]
        if len(run):
            count = firsts[run + 1] - firsts[run]
            at = np.arange(count.sum()) + np.repeat(firsts[run] - (np.cumsum(count) - count), count)
            overlap = overlap + np.bincount(holders[at], minlength=len(paths))
        if to:
            used = np.searchsorted(placed, live * len(names) + paths[lo][to - 1], "right") - (np.cumsum(length) - length)[live]
            reach = overlap[live] + np.minimum(length[live] - used, length[lo:hi].max() - to)
            live = live[reach >= -(-pct * (n[live] + n[lo:hi].min()) // (100 + pct))]
            if not len(live):
                continue
        if hi - lo == 1:
            for x in live:  # what is left has the overlap
                if label[x] != label[lo]:
                    links.append((int(some[lo]), int(some[x])))
                    label[label == label[x]] = label[lo]
            continue
        borders = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == to)), hi]
        stack += [(int(a), int(b), to, overlap, live) for a, b in zip(borders, borders[1:])]
    return links


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect the same places, each from the first of its group."""
    head: dict[int, int] = {}

    def top(x: int) -> int:
        while head.setdefault(x, x) != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for x, y in links:
        x, y = sorted((top(x), top(y)))
        head[y] = x
    return [(top(x), x) for x in sorted(head) if top(x) != x]


def _linked(weight, pct: int):
    """Parts of blocks -> links (a, b) between class ids."""
    def run(table: pa.Table) -> pa.Table:
        part, c1, comp = (table.column(c).to_numpy() for c in ("part", "c1", "comp"))
        tokens = table.column("tokens").combine_chunks()
        order = np.lexsort((c1, part))
        new = np.ones(len(order), bool)
        new[1:] = (part[order][1:] != part[order][:-1]) | (c1[order][1:] != c1[order][:-1])
        order = order[new]
        cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=part[order[0]] - 1)), len(order))
        a, b = [], []
        for i, j in zip(cuts, cuts[1:]):
            mine = order[i:j]
            if j - i > 1:
                found = tree_links([np.frombuffer(tokens[int(r)].as_buffer(), np.uint64) for r in mine], comp[mine], pct, weight.value)
                for x, y in stars(found):  # c1 rises in a part: the first of a star is its smallest
                    a.append(c1[mine[x]])
                    b.append(c1[mine[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def linked(parts: DataFrame, sets: DataFrame, tokens: int, weight, pct: int) -> DataFrame:
    """(part, c1, comp) -> links. Several parts share an Arrow group; a part
    has at most about BLOCK_TOKENS shingles unless one set has more."""
    groups = max(partitions(parts.sparkSession), int(tokens / BLOCK_TOKENS) + 1)
    rows = parts.join(sets, "c1").select(F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int").alias("group"), "part", "c1", "comp", "tokens")
    return rows.groupBy("group").applyInArrow(_linked(weight, pct), "a long, b long")


def _parts(count: Column, tokens: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK, tokens / BLOCK_TOKENS)).cast("int")


def _within(number: Column) -> Column:
    return F.pmod(F.xxhash64("c1"), number).cast("int")


def memberships(common: DataFrame, able: DataFrame) -> DataFrame:
    """(c1, rep, n, block): the blocks that each set joins. A band is as wide as
    the similarity lets sizes differ, so sets that link are of one band or of
    neighbours, and meet at the lower one's."""
    placed = common.join(able.select("c1", "band"), "c1").select("tok", "c1", "band", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("low"))
    led = placed.groupBy("tok", "low").agg(F.min("c1").alias("lead"), F.max("c1").alias("last"), F.min("band").alias("least_band")).filter("lead < last and least_band = low")
    each = placed.select("tok", "c1", "low").join(led.select("tok", "low", "lead"), ["tok", "low"]).groupBy("c1", "low", "lead").agg(F.count(F.lit(1)).alias("k")).join(able, "c1")
    one = Window.partitionBy("c1", "low")
    upto = F.sum("k").over(one.orderBy("k", "lead").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumns({"upto": upto, "all": F.sum("k").over(one)}).filter("all >= least and 2 * upto >= least")
    return each.select("c1", "rep", "n", F.xxhash64("lead", "low").alias("block"))


def rest_of_blocks(member: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Parts in which the sets of large blocks meet that links have not brought
    together yet, and how many shingles all of them have. The sets outside a
    block's largest component are dealt to R parts and that component to K;
    each of the R meets all R + K."""
    known = stored(member.join(roots, member["c1"] == roots["node"], "left").select("block", "c1", "n", F.coalesce("root", "c1").alias("comp")), "labelled")
    one = known.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"))
    plan = one.groupBy("block").agg(F.max_by(F.struct("comp", "k", "t"), F.struct("k", "comp")).alias("main"), F.sum("k").alias("k"), F.sum("t").alias("t"))
    rest_k, rest_t = F.col("k") - F.col("main.k"), F.col("t") - F.col("main.t")
    plan = plan.select("block", F.col("main.comp").alias("main"), _parts(2 * rest_k, 2 * rest_t).alias("r"), _parts(2 * F.col("main.k"), 2 * F.col("main.t")).alias("m"), rest_t.alias("rest_t"), F.col("main.t").alias("main_t"))
    plan = stored(plan.filter("r > 0"), "rest-plan")
    inside = F.col("comp") == F.col("main")
    mine = F.when(inside, F.col("r") + _within(F.col("m"))).otherwise(_within(F.col("r")))
    others = F.sequence(F.lit(0), F.when(inside, F.col("r")).otherwise(F.col("r") + F.col("m")) - 1)
    met = known.join(plan, "block").select("block", "c1", "comp", mine.alias("i"), F.explode(others).alias("j"))
    tokens = plan.agg(F.coalesce(F.sum(F.expr("rest_t * (r + m) + main_t * r")), F.lit(0))).first()[0]
    return met.select("c1", "comp", F.xxhash64("block", F.least("i", "j"), F.greatest("i", "j")).alias("part")), int(tokens)


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 4, pct: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Null and wordless texts have an empty set, link with nothing and are their
    own component. Documents of fewer than k words have the one shingle of all
    their words. Sets of equal content always link; a similarity of exactly
    pct % links. Rows that repeat an id are further members of that document's
    classes; a row without an id links others and takes the component's id,
    null where no document has one. An empty table gives an empty table.
    Shingles are 64-bit hashes; classes are told apart by 128 bits.

    Hot shingles are summed in tasks before the shuffle; the way back is an
    equi-join, which adaptive execution splits where a shingle is hot.
    """
    spark = docs.sparkSession
    base = columns(docs, key, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(base.mapInArrow(_sets(k), SETS), "sets")
    each = found.filter("n >= 0").select("doc_id", "n", "c1", "c2")
    classes = stored(each.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    weight = spark.sparkContext.broadcast(frequencies(found))
    fronts = stored(base.select("text").mapInArrow(_fronts(weight, pct, k), "tok long, c1 long"), "fronts")
    lists = fronts.groupBy("tok").agg(F.min("c1").alias("lead"), F.max("c1").alias("last")).filter("lead < last").select("tok")
    common = stored(fronts.join(lists, "tok"), "common-fronts")
    # a set with fewer common shingles in front than its smallest partner asks for has no link
    able = common.groupBy("c1").agg(F.count(F.lit(1)).alias("shared")).join(classes, "c1").withColumn("m", F.expr(f"({pct} * n + 99) div 100"))
    able = able.withColumn("least", F.expr(f"1 + (m - ({pct} * m + 99) div 100 + 1) div 4")).filter("shared >= least")
    able = able.select("c1", "rep", "n", "least", F.floor(F.log("n") / math.log(100 / (pct - 0.01))).cast("int").alias("band"))
    member = memberships(common, able)
    blocks = member.groupBy("block").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("tokens")).filter("count > 1").withColumn("parts", _parts(F.col("count"), F.col("tokens")))
    member = stored(member.join(blocks, "block"), "members")
    sets = token_sets(base, member.select("c1", "rep").distinct(), k)
    in_all = (F.col("parts") > 1) & (F.pmod(F.xxhash64("c1", F.lit(1)), F.ceil(F.col("count") / HUBS)) == 0)
    places = F.when(in_all, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_within(F.col("parts"))))
    parts = member.select("c1", F.col("c1").alias("comp"), "block", F.explode(places).alias("p")).select("c1", "comp", F.xxhash64("block", "p").alias("part"))
    total = member.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("parts"), F.lit(0))).first()
    links = stored(linked(parts, sets, total[0], weight, pct), "links-1")
    if total[1] > 1:
        parts, tokens = rest_of_blocks(member.filter("parts > 1"), components(links))
        links = links.unionByName(stored(linked(parts, sets, tokens, weight, pct), "links-2"))
    # classes whose smallest document is the same go together
    same = classes.filter("rep is not null").groupBy("rep").agg(F.min("c1").alias("b"), F.max("c1").alias("hi")).filter("b < hi").select("rep", "b")
    links = links.unionByName(classes.join(same, "rep").select(F.col("c1").alias("a"), "b"))
    # from classes to their smallest documents; a class of rows without an id links others all the same
    roots = components(links)
    smallest = roots.join(classes, roots["node"] == classes["c1"]).groupBy("root").agg(F.min("rep").alias("smallest"))
    ids = classes.join(roots, classes["c1"] == roots["node"], "left").join(smallest, "root", "left").select("c1", "c2", F.coalesce("smallest", "rep").alias("component_id"))
    done = each.join(ids, ["c1", "c2"], "left")
    return done.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

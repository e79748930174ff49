"""Spelling variants by a relational trie frontier.

The words' trie is a table of edges (node, letter, child), made level by level:
a node is a beginning that at least two words share and at which they part, so
its children are as long as what all words below have in common, and an edge to
one word alone carries that word. States (word, position, node, edits) walk
down it, all words at once, a join a level. A state without an edit is a word
on its own path; where its node has another edge, it leaves the path by one
edit, putting that edge's letter in place of its own or before it. From there
on it must follow its own letters to a word. Taking a letter out is the same
pair seen from the longer word. A level is written to the shared folder before
the next one reads it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitgrain.llm._common import columns, forget, stored

#: Letters of a run, and those that get lower case.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Stands before words that are spelt backwards; no letter.
BACKWARD = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, key: str, text: str, every: int = 97, chars: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of letters in lower case, where `every` divides the
    crc32 of "<id>:<run>" less the letter at that number modulo the length;
    of at least `chars` letters and `least` occurrences. A row without an id
    loses no letters. Occurrences are summed in each task before the shuffle."""
    base = columns(docs, key, text).toDF("id", "text").select(F.col("id").cast("string").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = base.select("id", F.translate("run", UPPER, LOWER).alias("w"))
    hashed = low.select("w", F.crc32(F.encode(F.concat("id", F.lit(":"), "w"), "utf-8")).alias("h"))
    at = F.pmod("h", F.length("w")).cast("int")
    word = F.when(F.pmod("h", F.lit(every)) == 0, F.concat(F.col("w").substr(F.lit(1), at), F.col("w").substr(at + 2, F.length("w")))).otherwise(F.col("w"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _common(a: Column, b: Column) -> Column:
    """The beginning that two different words share."""
    part = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    return a.substr(F.lit(1), part.cast("int") - 1)


def _edges(alive: DataFrame) -> DataFrame:
    """The edges below the nodes of a level: (p, c) with the number of words
    under the child, the child itself, which is what those words have in
    common, and the shortest's and longest's lengths. A node has an edge a letter;
    the first and last word in order have in common what all have."""
    e = alive.filter(F.length("word") > F.length("p")).groupBy("p", F.col("word").substr(F.length("p") + 1, F.lit(1)).alias("c"))
    e = e.agg(F.count(F.lit(1)).alias("under"), F.min("word").alias("first"), F.max("word").alias("last"), F.min(F.length("word")).alias("short"), F.max(F.length("word")).alias("long"))
    child = F.when(F.col("under") == 1, F.col("first")).otherwise(_common(F.col("first"), F.col("last")))
    return e.select("p", "c", "under", child.alias("child"), "short", "long")


def _step(moved: DataFrame) -> DataFrame:
    """What becomes of states (word, position, p, c, ...) that take an edge,
    position being the word's letters used up with c: the child's letters after
    c must be the word's next ones. Those that cannot end in a word of the right
    length go; one that has reached a word is done; others wait for the next
    level with near null."""
    after = F.col("child").substr(F.length("p") + 2, F.length("child"))
    target = F.length("word") + F.length("p") + 1 - F.col("position")  # the length of a word that this state can end in
    moved = moved.filter((target >= F.col("short")) & (target <= F.col("long"))).withColumn("after", after)
    moved = moved.filter(F.col("word").substr(F.col("position") + 1, F.length("after")) == F.col("after")).withColumn("position", F.col("position") + F.length("after"))
    ended = F.col("position") == F.length("word")
    near = F.when(ended, F.col("child"))
    good = F.when(ended, F.length("child") == F.col("short")).otherwise(F.col("under") > 1)
    return moved.filter(good).select("word", "position", F.col("child").alias("node"), near.alias("near"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) for all pairs of words that differ by one code point
    inserted, deleted or replaced, in both directions. words has distinct
    `word`s, which are in the trie forwards and, behind a mark, backwards: a
    state makes an edit only where as many letters lie before it as after it,
    since any pair has such a place in one of the two directions. There nodes
    have few edges, while each word would take nearly every edge of the first
    levels. (Of places at which the same letter may be put in, the walk takes
    the last in its direction, so what is early forwards is late backwards.)
    The walk ends at the first level at which no beginning is shared
    and no state waits."""
    both = words.select("word").unionByName(words.select(F.concat(F.lit(BACKWARD), F.reverse("word")).alias("word")))
    alive, states, levels = stored(both.withColumn("p", F.lit("")), "trie"), None, []
    while True:
        edges, at = _edges(alive), F.length("p")
        backward = F.startswith("word", F.lit(BACKWARD)).cast("int")
        own = alive.select("word", "p", F.col("word").substr(at + 1, F.lit(1)).alias("own"))  # '' at the word's end
        before, length = at - backward, F.length("word") - backward  # letters before the edit, and of the word
        late = own.filter(2 * before >= length - 1)
        left = late.join(edges, "p").filter((F.col("c") != F.col("own")) & (F.col("c") != BACKWARD))
        insert = F.when(2 * before >= length, F.array(at)).otherwise(F.array().cast("array<int>"))
        replace = F.when((F.col("own") != "") & (F.col("c") > F.col("own")), F.array(at + 1)).otherwise(F.array().cast("array<int>"))
        moved = left.select("word", F.explode(F.concat(insert, replace)).alias("position"), "p", "c", "under", "child", "short", "long")
        if states is not None:
            went = states.select("word", F.col("position") + 1, F.col("node").alias("p"), F.col("word").substr(F.col("position") + 1, F.lit(1)).alias("c")).toDF("word", "position", "p", "c")
            moved = moved.unionByName(went.join(edges, ["p", "c"]).select(*moved.columns))
        level = stored(_step(moved), "frontier")
        levels.append(level)
        shared = edges.filter("under > 1").select("p", F.col("c").alias("own"), "child")
        following = stored(own.join(shared, ["p", "own"]).select("word", F.col("child").alias("p")), "trie")
        forget(alive)
        alive, states = following, level.filter("near is null")
        if states.isEmpty() and alive.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    ahead = lambda w: F.when(F.startswith("word", F.lit(BACKWARD)), F.reverse(F.substring(w, 2, 1 << 30))).otherwise(F.col(w)).alias(w)
    found = found.filter("near is not null").select(ahead("word"), ahead("near"))
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Chains
    have at most `longest` links; each round doubles what a row has followed."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(longest, 1)))):
        following = stored(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("to")), "root", "left").select("word", F.coalesce("to", "root").alias("root")), "roots")
        at = following
    return at


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", every: int = 97, chars: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """One row a word: word, n, n_near, form, form_n, root.

    Words come from `vocabulary`. A word's form is its near word of largest n,
    of equal ones the first in code-point order, where that n is at least
    `times` its own; else null, as form_n. root follows forms to the last word
    and is the word itself without a form. Null and empty texts have no words;
    texts and words are taken whole, of any length; repeated rows count each
    time; an empty table gives an empty table; other columns are not read.

    Levels are as many as the nodes on the trie's longest path, at which words
    part, however long the words are. A node's edges are at most as many as there are letters, so a hot
    node is a hot key of an equi-join with few rows on the other side, which
    adaptive execution splits or, where a level's edges are few, broadcasts. A
    form has at least twice its word's n, so chains are no longer than the
    logarithm of the largest n.
    """
    words = stored(vocabulary(docs, key, text, every, chars, least), "vocabulary")
    most = words.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]  # one row
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    found = words.join(best, "word", "left")
    has = F.coalesce(-F.col("b.m") >= times * F.col("n"), F.lit(False))
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("b.near")).alias("form"), F.when(has, -F.col("b.m")).alias("form_n")), "forms")
    last = roots(found.filter("form is not null"), int(math.log(max(most / least, 1), times)) + 1)
    return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

"""Queries over patches, messages, term weights and embeddings (T, F5-F7, A26-A28, J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitgrain.functions import patches as pt
from commitgrain.functions import text as tx
from commitgrain.operators import embed, features, profile
from commitgrain.plans import fixtures as fx
from commitgrain.plans.fixtures import sql
from commitgrain.sources import tables
from commitgrain.sources.tables import work_dir

ROUND = 6


def t1(spark, d):
    p = fx.patches(spark, d).filter("old_text is not null and new_text is not null")
    c = F.col("patch")
    return p.groupBy("repo", "commit").agg(F.sum(pt.added_lines(c)).alias("loc_added"), F.sum(pt.deleted_lines(c)).alias("loc_deleted"), F.count(F.lit(1)).alias("files_changed"), F.sum(pt.hunk_marks(c)).alias("hunks_count"))


def t2(spark, d):
    return fx.patches(spark, d).groupBy("repo", "commit").agg(F.sum(pt.hunks(F.col("patch"))).alias("hunks"))


def t3(spark, d):
    p = fx.patches(spark, d).withColumns(pt.token_counts(F.col("patch")))
    return p.groupBy("repo", "commit").agg(*[F.sum(t).alias(t) for t in pt.TOKENS])


def ascii_messages(spark, d):
    return fx.messages(spark, d).withColumn("message", F.regexp_replace("message", r"[^\x00-\x7F]", " "))


def t4(spark, d):
    return fx.messages(spark, d).select("doc_id", *[c.alias(k) for k, c in tx.message_flags(F.col("message")).items()])


def t5(spark, d):
    extra = F.concat(F.lit("Fix #12 in a.py http://x.y/z deadbeef\ngit-svn-id: 77\n"), F.col("message"))
    return ascii_messages(spark, d).select("doc_id", tx.clean_message(extra).alias("clean"))


def t6(spark, d):
    m = tables.dealt(ascii_messages(spark, d)).withColumn("clean", tx.clean_message(F.col("message")))
    return tx.weigh_terms(m, "doc_id", "clean", tx.fit_vocabulary(m.filter("doc_id % 5 <> 0"), "clean")).withColumn("weight", F.round("weight", ROUND))


def f8_text(spark, d):
    """The text branch of the fitted transformer, learnt from the train rows,
    saved, loaded and applied to all."""
    at, m = work_dir(spark, "f8-text"), tables.dealt(ascii_messages(spark, d).select("doc_id", "message"))
    features.fit(m.filter("doc_id % 5 <> 0"), [], [], "message").save(spark, at)
    out = features.Fitted.load(spark, at).transform(m)
    long = out.unpivot(["doc_id"], [f"`{c}`" for c in out.columns if c != "doc_id"], "term", "weight").filter("weight > 0")
    return long.select("doc_id", F.regexp_replace("term", "^tfidf_", "").alias("term"), F.round("weight", ROUND).alias("weight"))


def f8_arrays(spark, d):
    """The array branches: as many components as asked for or as there are places."""
    at, v = work_dir(spark, "f8-arrays"), fx.vectors(spark, d).withColumnRenamed("embedding", "code_embed").withColumn("msg_embed", F.reverse("code_embed"))
    features.fit(v.filter("vec_id % 5 <> 0"), [], [], arrays=features.ARRAYS).save(spark, at)
    return features.Fitted.load(spark, at).transform(v)


def t7(spark, d):
    two = F.concat(F.col("patch"), F.lit("\n@@ -3 +7 @@ x\n+y\n@@ -1,2 +9,0 @@"))
    return fx.patches(spark, d).select("doc_id", F.array_join(pt.changed_lines(two), ",").alias("lines"))


def t8(spark, d):
    """The texts as Python functions, an `if` for each line; every third line
    came with the change, and each seventh file is gone."""
    body = lambda parts: F.concat(F.lit("def f(a):\n"), F.array_join(F.transform(parts, lambda x: F.concat(F.lit("    if a > "), F.length(x).cast("string"), F.lit(":\n        a += 1"))), "\n"), F.lit("\n    return a\n"))
    p, lines = fx.patches(spark, d), F.split("new_text", "\n")
    before = F.when(F.col("old_text").isNotNull(), body(F.filter(lines, lambda x, i: i % 3 != 2)))
    return embed.structural_delta(p.withColumns({"new_text": F.when(F.col("doc_id") % 7 != 0, body(lines)), "old_text": before}))


def t9(spark, d):
    some = lambda line, n: F.repeat(F.lit(line), (F.col("doc_id") % n).cast("int"))
    defs = F.concat(F.col("patch"), some("\n+def f():", 4), some("\n-def g():", 3), some("\n+class A:", 5), some("\n-class B:", 2))
    return fx.patches(spark, d).select("doc_id", pt.definition_delta(defs).alias("delta"), pt.longest_changed_line(F.col("patch")).alias("longest"))


def t10(spark, d):
    return tx.commit_code(fx.patches(spark, d))


def hashed(spark, d, offset):
    return fx.table(spark, d, "documents").select("doc_id", tx.hash_embedding(F.col("text"), offset).alias("e"))


def places(df, *keys, array="e"):
    return df.select(*keys, F.posexplode(array).alias("pos", "x")).withColumn("x", F.round("x", ROUND))


def t11(spark, d):
    return places(hashed(spark, d, 0), "doc_id").unionByName(places(hashed(spark, d, 16), "doc_id").withColumn("pos", F.col("pos") + 100))


def t12(spark, d):
    return places(embed.embed_texts(fx.table(spark, d, "documents"), "doc_id", "text", out="e"), "doc_id")


def t12_python(spark, d):
    """The same through an encoder in Python, as a real one would run."""
    def factory():
        import hashlib

        return lambda texts: [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]

    return places(embed.embed_texts(fx.table(spark, d, "documents"), "doc_id", "text", factory, "e"), "doc_id")


def words_model():
    """Words as tokens, with bytes of each word's md5 as its states."""
    import hashlib
    import re

    import numpy as np

    memo = {}

    def number(word):
        if len(memo) > 1 << 20:
            memo.clear()
        if word not in memo:
            memo[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return memo[word]

    tokenize = lambda text: [number(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return tokenize, lambda ids, mask: (ids[:, :, None] >> np.array([24, 16, 8, 0]) & 255) / 255


def t12_tokens(whole):
    """Means of token states: of the first 512 tokens, or of all of them."""
    return lambda spark, d: places(embed.embed_texts(tables.dealt(fx.table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", embed.token_means(words_model, whole=whole), "e"), "doc_id")


def t13(spark, d):
    e = fx.vectors(spark, d).withColumn("grp", F.col("vec_id") % 20).withColumn("mask", F.col("vec_id") % 3)
    return places(embed.mean_pool(e, ["grp"], "embedding", "mask", "e"), "grp")


def t14(spark, d):
    e = fx.vectors(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    return e.select("vec_id", F.size(embed.clean_array("embedding")).alias("size"))


def w7(spark, d):
    c = fx.patches(spark, d).select("doc_id", F.posexplode(pt.line_contexts(F.col("patch"))).alias("k", "context"))
    return c.select("doc_id", "k", F.md5(F.col("context").cast("binary")).alias("context"))


def f5(spark, d):
    return embed.expand_array(fx.vectors(spark, d), "embedding", "emb").select("vec_id", "label", *[F.round(f"emb_{i}", ROUND).alias(f"emb_{i}") for i in (0, 1, 31, 63)])


def f6(spark, d):
    v = fx.vectors(spark, d)
    train = v.filter("vec_id % 5 <> 0")
    return embed.apply_pca(v, embed.fit_pca(train, "embedding", 60), "embedding", "code_emb")


def f6_rotation(spark, d):
    """All components of each row: whatever their signs, their squares add up to
    the squared distance from the mean, and weighed by the variance that each
    explains (and by its square) to forms of the covariance."""
    v = fx.vectors(spark, d)
    train = v.filter("vec_id % 5 <> 0")
    model = embed.fit_pca(train, "embedding", embed.width_of(train, "embedding"))
    parts = model.stages[1].explainedVariance.toArray().tolist()
    out = embed.apply_pca(v, model, "embedding", "pc")
    form = lambda power: F.round(sum(F.pow(f"pc_{i}", F.lit(2)) * x**power for i, x in enumerate(parts)), ROUND)
    return out.select("vec_id", form(0).alias("distance"), form(1).alias("spread"), form(2).alias("spread_2"))


def f7(spark, d):
    model = embed.fit_pca(fx.vectors(spark, d), "embedding", 60)
    return fx.vectors(spark, d).agg(F.count(F.lit(1)).alias("n"), F.lit(embed.explained_variance(model)).alias("explained"))


def j8(spark, d):
    return embed.class_distances(fx.vectors(spark, d), "vec_id", "embedding", "label").select(*[F.round(c, ROUND).alias(c) for c in ("between", "within_0", "within_1")])


def a26(spark, d):
    return profile.dimension_histograms(fx.vectors(spark, d), "embedding")


def a27(spark, d):
    s = profile.shape(fx.vectors(spark, d), {"norm": profile.norm(F.col("embedding"))})
    return s.select("column", "n", *[F.round(c, 4).alias(c) for c in ("skew", "kurtosis", "mean", "std")])


def a28(spark, d):
    v = fx.vectors(spark, d)
    model = embed.fit_pca(v, "embedding", 2)
    flat = embed.apply_pca(v, model, "embedding", "pc").select("vec_id", "label", F.array("pc_0", "pc_1").alias("pc"))
    return embed.class_distances(flat, "vec_id", "pc", "label").withColumn("explained", F.lit(embed.explained_variance(model)))


def occ(text, part):
    return f"CAST((length({text}) - length(replace({text}, {part}, ''))) / {len(part.replace(chr(39), '').replace('chr(10) || ', 'n'))} AS BIGINT)"


NL = "chr(10) || "
ADDED = f"lower(array_to_string(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), chr(10)))"
STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
ASCII = r"regexp_replace(message, '[^\x00-\x7F]', ' ', 'g')"


def cleaned(message):
    out = f"lower({message})"
    for pattern, to in (*tx.CLEANING, (r"^\s+|\s+$", "")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


TERMS = f"""m AS (SELECT doc_id, list_filter(regexp_extract_all({cleaned(ASCII)}, '\\w\\w+'), lambda w: w NOT IN ({STOPS})) AS w FROM messages),
    t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM m)"""
EMB = lambda first: f"CAST('0x' || substring(sha256(text), {first} + 2 * pos, 2) AS INT) / 255.0"
Q = "SELECT"
TOKEN_MEANS = lambda part: f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'){part}) AS w FROM documents)
    SELECT doc_id, CAST(pos AS INT) AS pos, round(avg(CAST('0x' || substring(md5(w), 1 + 2 * pos, 2) AS INT) / 255.0), {ROUND}) AS x FROM w, range(4) r(pos) GROUP BY ALL"""  # noqa: E731

#: Nodes of the function without a branch, and of each branch.
NODES, EACH = 7, 11
TFIDF = sql("messages", f"""WITH {TERMS}, train AS (SELECT * FROM t WHERE doc_id % 5 <> 0), n AS (SELECT count(*) AS n FROM messages WHERE doc_id % 5 <> 0),
        v AS (SELECT term, count(*) AS c, count(DISTINCT doc_id) AS df FROM train GROUP BY term ORDER BY c DESC, term LIMIT 100),
        w AS (SELECT doc_id, term, count(*) * (ln((1 + any_value(n)) / (1 + any_value(df))) + 1) AS w FROM t JOIN v USING (term), n GROUP BY doc_id, term)
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), {ROUND}) AS weight FROM w""")

QUERIES = {
    "t1_churn": (t1, sql("patches", f"""SELECT repo, "commit", CAST(sum({occ('patch', NL + "'+'")} - {occ('patch', NL + "'+++'")}) AS BIGINT) AS loc_added,
        CAST(sum({occ('patch', NL + "'-'")} - {occ('patch', NL + "'---'")}) AS BIGINT) AS loc_deleted, count(*) AS files_changed, CAST(sum({occ('patch', "'@@'")}) AS BIGINT) AS hunks_count
        FROM patches WHERE old_text IS NOT NULL GROUP BY repo, "commit" """)),
    "t2_hunks": (t2, sql("patches", f"""SELECT repo, "commit", sum({occ('patch', "'@@'")} / 2.0) AS hunks FROM patches GROUP BY repo, "commit" """)),
    "t3_tokens": (t3, sql("patches", f"""WITH a AS (SELECT repo, "commit", {ADDED} AS a FROM patches) SELECT repo, "commit", {', '.join(f"CAST(sum({occ('a', chr(39) + t + chr(39))}) AS BIGINT) AS {t}" for t in pt.TOKENS)} FROM a GROUP BY repo, "commit" """)),
    "t4_flags": (t4, sql("messages", "SELECT doc_id, CAST(length(message) AS INT) AS msg_len, CAST(contains(lower(message), 'fix') AS INT) AS has_fix_kw, CAST(contains(lower(message), 'bug') AS INT) AS has_bug_kw FROM messages")),
    "t5_clean": (t5, sql("messages", f"""SELECT doc_id, {cleaned("('Fix #12 in a.py http://x.y/z deadbeef' || chr(10) || 'git-svn-id: 77' || chr(10) || " + ASCII + ")")} AS clean FROM messages""")),
    "t6_tfidf": (t6, TFIDF), "f8_text": (f8_text, TFIDF), "f8_arrays": (f8_arrays, None),
    "t7_lines": (t7, sql("patches", r"""WITH h AS (SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS s, unnest(c) AS c FROM
        (SELECT doc_id, regexp_extract_all(p, '(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 1) AS s, regexp_extract_all(p, '(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 2) AS c
         FROM (SELECT doc_id, patch || chr(10) || '@@ -3 +7 @@ x' || chr(10) || '+y' || chr(10) || '@@ -1,2 +9,0 @@' AS p FROM patches))),
        r AS (SELECT doc_id, k, unnest(range(CAST(s AS BIGINT), CAST(s AS BIGINT) + CAST(coalesce(nullif(c, ''), '1') AS BIGINT))) AS line FROM h)
        SELECT doc_id, string_agg(line, ',' ORDER BY k, line) AS lines FROM r GROUP BY doc_id""")),
    # a function of k branches: NODES + EACH * k nodes, 1 + k ways, 2 + 2 * k lines
    "t8_structure": (t8, sql("patches", f"""WITH x AS (SELECT repo, "commit", len(l) AS k, CASE WHEN old_text IS NOT NULL THEN len(l) - len(l) // 3 END AS o
        FROM (SELECT *, string_split(new_text, chr(10)) AS l FROM patches) WHERE path LIKE '%.py' AND doc_id % 7 <> 0)
        SELECT repo, "commit", CAST(sum(coalesce({EACH} * (k - o), {NODES} + {EACH} * k)) AS BIGINT) AS ast_delta, CAST(sum(coalesce(k - o, 1 + k)) AS BIGINT) AS complexity_delta, max(2 + 2 * k) AS max_func_change
        FROM x GROUP BY repo, "commit" """)),
    "t9_definitions": (t9, sql("patches", f"""WITH p AS (SELECT *, patch || repeat(chr(10) || '+def f():', doc_id % 4) || repeat(chr(10) || '-def g():', doc_id % 3) || repeat(chr(10) || '+class A:', doc_id % 5)
        || repeat(chr(10) || '-class B:', doc_id % 2) AS p FROM patches)
        SELECT doc_id, {occ('p', NL + "'+def '")} - {occ('p', NL + "'-def '")} + {occ('p', NL + "'+class '")} - {occ('p', NL + "'-class '")} AS delta, CAST(list_max(list_transform(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '+') OR starts_with(x, '-')), lambda x: length(x))) AS INT) AS longest FROM p""")),
    "t10_code": (t10, sql("patches", """SELECT repo, "commit", string_agg(substring(new_text, 1, 2000), chr(10) ORDER BY path, substring(new_text, 1, 2000)) AS code FROM patches GROUP BY repo, "commit" """)),
    "t11_hash": (t11, f"SELECT doc_id, CAST(pos AS INT) AS pos, round({EMB(1)}, {ROUND}) AS x FROM documents, range(8) r(pos) UNION ALL SELECT doc_id, CAST(pos + 100 AS INT), round({EMB(17)}, {ROUND}) FROM documents, range(8) r(pos)"),
    "t12_embed": (t12, f"SELECT doc_id, CAST(pos AS INT) AS pos, round({EMB(1)}, {ROUND}) AS x FROM documents, range(8) r(pos)"),
    "t12_embed_python": (t12_python, f"SELECT doc_id, CAST(pos AS INT) AS pos, round({EMB(1)}, {ROUND}) AS x FROM documents, range(8) r(pos)"),
    "t12_token_means": (t12_tokens(False), TOKEN_MEANS("[:512]")), "t12_token_windows": (t12_tokens(True), TOKEN_MEANS("")),
    "t13_pool": (t13, sql("vectors", f"""WITH x AS (SELECT vec_id % 20 AS grp, vec_id % 3 AS m, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM vectors)
        SELECT grp, CAST(pos AS INT) AS pos, round(sum(v * m) / nullif(sum(m), 0), {ROUND}) AS x FROM x GROUP BY ALL""")),
    "t14_arrays": (t14, sql("vectors", "SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN CAST(len(embedding) AS INT) ELSE 0 END AS size FROM vectors")),
    "w7_contexts": (w7, sql("patches", """WITH l AS (SELECT doc_id, string_split(patch, chr(10)) AS l FROM patches),
        i AS (SELECT doc_id, l, unnest(list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '+') AND NOT starts_with(l[i], '+++'))) AS i FROM l)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS k, md5(array_to_string(l[greatest(i - 3, 1):i + 3], chr(10))) AS context FROM i""")),
    "f5_expand": (f5, sql("vectors", f"SELECT vec_id, label, {', '.join(f'round(embedding[{i + 1}], {ROUND}) AS emb_{i}' for i in (0, 1, 31, 63))} FROM vectors")),
    "f6_pca": (f6, None),
    "f6_rotation": (f6_rotation, sql("vectors", f"""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM vectors),
        m AS (SELECT pos, avg(v) AS m FROM x WHERE vec_id % 5 <> 0 GROUP BY pos), c AS (SELECT vec_id, pos, v - m AS c FROM x JOIN m USING (pos)),
        k AS (SELECT a.pos AS i, b.pos AS j, sum(a.c * b.c) AS k FROM c a JOIN c b USING (vec_id) WHERE vec_id % 5 <> 0 GROUP BY ALL), t AS (SELECT sum(k) AS t FROM k WHERE i = j),
        y AS (SELECT vec_id, i AS pos, sum(k * c) AS y FROM c JOIN k ON j = pos GROUP BY ALL)
        SELECT vec_id, round(sum(c * c), {ROUND}) AS distance, round(sum(c * y) / any_value(t), {ROUND}) AS spread, round(sum(y * y) / any_value(t * t), {ROUND}) AS spread_2 FROM c JOIN y USING (vec_id, pos), t GROUP BY vec_id""")),
    "f7_explained": (f7, None),
    "j8_distances": (j8, sql("vectors", f"""WITH s AS (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) <= 2000),
        p AS (SELECT a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM s a, s b)
        SELECT round(avg(d) FILTER (la = 0 AND lb = 1), {ROUND}) AS between, round(avg(d) FILTER (la = 0 AND lb = 0), {ROUND}) AS within_0, round(avg(d) FILTER (la = 1 AND lb = 1), {ROUND}) AS within_1 FROM p""")),
    "a26_dimensions": (a26, sql("vectors", """WITH x AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, unnest(embedding) AS v FROM vectors),
        p AS (SELECT pos FROM range(64) r(pos) QUALIFY row_number() OVER (ORDER BY md5(pos || '42')) <= 3),
        e AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM x WHERE pos IN (SELECT pos FROM p) GROUP BY pos)
        SELECT pos, CAST(least(floor((v - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM x JOIN e USING (pos) GROUP BY ALL""")),
    "a27_norm": (a27, sql("vectors", """WITH v AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS v FROM vectors), m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM v)
        SELECT 'norm' AS "column", count(*) AS n, round(avg(pow((v - m) / s, 3)), 4) AS skew, round(avg(pow((v - m) / s, 4)) - 3, 4) AS kurtosis, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std FROM v, m""")),
    "a28_pca_classes": (a28, None),
}

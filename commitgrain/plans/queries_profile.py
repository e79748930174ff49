"""Queries over audits and profiles (A, P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitgrain.operators import profile as pf
from commitgrain.plans import fixtures as fx
from commitgrain.plans.fixtures import sql

NUM = ["qty", "price", "disc", "tax"]
D = 6


def rounded(df, *names, d=D):
    return df.withColumns({c: F.round(c, d) for c in names})


def n(spark, d):
    return fx.numbers(spark, d)


def msg_len(df):
    return df.withColumn("msg_len", F.length("message"))


def each(f, names=NUM):
    return " UNION ALL ".join(f(c) for c in names)


def quart(c, by=""):
    return f"quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3"


def describe_sql(name, expr, source, by=""):
    g = f"{by}, " if by else ""
    return f"""SELECT {g}'{name}' AS "column", count({expr}) AS count, round(avg({expr}), {D}) AS mean, round(stddev_samp({expr}), {D}) AS std, CAST(min({expr}) AS DOUBLE) AS min,
        round(quantile_cont({expr}, 0.25), {D}) AS p25, round(quantile_cont({expr}, 0.5), {D}) AS p50, round(quantile_cont({expr}, 0.75), {D}) AS p75, CAST(max({expr}) AS DOUBLE) AS max FROM {source} {'GROUP BY ' + by if by else ''}"""


def described(df):
    return rounded(df, "mean", "std", "p25", "p50", "p75")


def shape_sql(c, log=False):
    v = f"ln(1 + {c})" if log else c
    return f"""SELECT '{c}' AS "column", count(v) AS n, avg(pow((v - m) / s, 3)) AS g, avg(pow((v - m) / s, 4)) - 3 AS k, avg(v) AS mean, stddev_samp(v) AS std
        FROM (SELECT {v} AS v FROM numbers) x, (SELECT avg({v}) AS m, nullif(stddev_pop({v}), 0) AS s FROM numbers) y"""


def report_sql(c, by=""):
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON TRUE")
    return f"""SELECT {g}'{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
        round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), {D}) AS share, round(any_value(q1 - 1.5 * (q3 - q1)), {D}) AS lo, round(any_value(q3 + 1.5 * (q3 - q1)), {D}) AS hi,
        round(any_value(median), {D}) AS median, round(any_value(q3 - q1), {D}) AS iqr, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std
        FROM numbers JOIN (SELECT {g}{quart(c)} FROM numbers {'GROUP BY ' + by if by else ''}) q {on} {'GROUP BY ' + by if by else ''}"""


def reported(df):
    return rounded(rounded(df, "share", "lo", "hi", "median", "iqr"), "mean", "std", d=4)


def p5(spark, d):
    v = fx.vectors(spark, d)
    from commitgrain.operators.embed import expand_array

    v = v.withColumns({"embedding": F.when(F.col("vec_id") % 7 != 0, F.transform("embedding", lambda x: F.when(x > 0, x).otherwise(0.0))), "repo": F.when(F.col("label") == 1, "one")})
    wide = expand_array(v, "embedding", "code_emb", 64).withColumn("tfidf_x", F.nullif(F.col("vec_id") % 4, F.lit(1)))
    p = pf.family_profile(wide, [c for c in wide.columns if c != "vec_id"])
    return rounded(p.withColumn("names", F.array_join("names", ",")), "null_share", "zero_share")


def a1(spark, d):
    return pf.null_counts(n(spark, d), NUM)


def a2(spark, d):
    return pf.duplicate_key_rows(n(spark, d), ["k1", "k2"])


def a3(spark, d):
    return rounded(pf.value_shares(n(spark, d), F.col("label"), ["grp"]), "share")


def a4(spark, d):
    return rounded(pf.value_shares(fx.commits(spark, d), F.col("repo")), "share")


def a5(spark, d):
    return rounded(pf.range_scan(n(spark, d), NUM), "mean", "median", d=4)


def a6(spark, d):
    return rounded(pf.negative_shares(n(spark, d).withColumns({c: F.col(c) - v for c, v in (("qty", 10), ("disc", 0.05))}), ["qty", "disc"]), "share")


def a7(spark, d):
    return rounded(pf.outlier_scan(n(spark, d), "price"), "p999", d=4)


def a8(spark, d):
    return pf.not_binary(n(spark, d).withColumn("flag", F.when(F.col("disc") > 0.05, 2).when(F.col("disc") > 0.02, 1)), ["label", "flag"])


def a9(spark, d):
    e = fx.vectors(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, None).when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return pf.array_sizes(e, "embedding")


def a10(spark, d):
    return pf.time_audit(fx.commits(spark, d), "canonical_datetime")


def a11(spark, d):
    return pf.constant_columns(n(spark, d).withColumns({"one": F.lit(1.0), "holes": F.when(F.col("qty") > 9, 3.0)}), [*NUM, "one", "holes"])


def a12(spark, d):
    return described(pf.describe(fx.messages(spark, d), {"message": F.length("message")}))


def a12_empty(spark, d):
    return rounded(pf.empties(fx.messages(spark, d), F.length(F.trim(F.regexp_replace("message", "[a-zA-Z]", "")))), "share")


def a13(spark, d):
    return described(pf.describe(fx.patches(spark, d), {"lines": F.size(F.split("patch", "\n"))}))


def a14(spark, d):
    return pf.not_positive(fx.messages(spark, d), F.length("message") - 20)


def a15(spark, d):
    from commitgrain.functions.patches import added_lines, deleted_lines, occurrences

    c = F.col("patch")
    return described(pf.describe(fx.patches(spark, d), {"gap": occurrences(c, "\n") - added_lines(c) - deleted_lines(c)}))


def a16(spark, d):
    return described(pf.describe(n(spark, d), {c: F.col(c) for c in NUM}, ["grp"]))


def a17(spark, d):
    return rounded(pf.shape(n(spark, d), {c: F.col(c) for c in NUM}), "skew", "kurtosis", "mean", "std", d=3)


def a18(spark, d):
    return rounded(pf.sample_shape(n(spark, d), {c: F.log1p(c) for c in NUM}), "skew", "kurtosis", d=3)


def a19(spark, d):
    return reported(pf.outlier_report(n(spark, d), NUM))


def a20(spark, d):
    return reported(pf.outlier_report(n(spark, d), NUM, ["label"]))


def a21(spark, d):
    return rounded(pf.zero_shares(n(spark, d), ["qty", "tax"]), "median", "iqr", "zero_share")


def a22(spark, d):
    return rounded(pf.correlations(n(spark, d), NUM), "r")


def a23(spark, d):
    return rounded(pf.target_correlations(n(spark, d), NUM, "label", 0.0001, 3), "r")


def a24(bins):
    return lambda spark, d: rounded(pf.class_overlap(n(spark, d), "price", "label", bins), "overlap")


def a25(spark, d):
    return pf.histogram(n(spark, d), NUM)


def a29(spark, d):
    return rounded(pf.bad_by_group(fx.commits(spark, d), F.col("loc_added") < 2, "repo"), "share")


def a30(spark, d):
    return pf.table_profile(n(spark, d).select("k1", "grp", "qty", "disc"))


def a31(spark, d):
    return pf.repeated_keys(n(spark, d), ["k1", "k2"])


def overlap_sql(bins):
    return sql("numbers", f"""WITH e AS (SELECT min(price) AS lo, max(price) AS hi, {bins} AS k FROM numbers), b AS (SELECT least(floor((price - lo) / (hi - lo) * k), k - 1) AS bin, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM numbers, e GROUP BY 1)
        SELECT round(sum(least(a / ta, b / tb)), 6) AS overlap FROM b, (SELECT sum(a) AS ta, sum(b) AS tb FROM b) t""")


QUERIES = {
    "p5_families": (p5, sql("vectors", """WITH e AS (SELECT vec_id % 7 <> 0 AS there, list_filter(embedding, lambda x: x <= 0) AS z FROM vectors)
        SELECT 'structural' AS family, CAST(1 AS BIGINT) AS columns, 'label' AS names, round(count(*) FILTER (label IS NULL) / count(*), 6) AS null_share, round(count(*) FILTER (label = 0) / count(*), 6) AS zero_share FROM vectors
        UNION ALL SELECT 'embedding', 64, (SELECT string_agg('code_emb_' || i, ',' ORDER BY 'code_emb_' || i) FROM range(64) r(i)), round(count(*) FILTER (NOT there) / count(*), 6), round(sum(len(z)) FILTER (there) / (64 * count(*)), 6) FROM e
        UNION ALL SELECT 'tfidf', 1, 'tfidf_x', round(count(*) FILTER (vec_id % 4 = 1) / count(*), 6), round(count(*) FILTER (vec_id % 4 = 0) / count(*), 6) FROM vectors
        UNION ALL SELECT 'categorical', 1, 'repo', round(count(*) FILTER (label <> 1) / count(*), 6), 0.0 FROM vectors""")),
    "a1_nulls": (a1, sql("numbers", """SELECT 'disc' AS "column", count(*) - count(disc) AS nulls FROM numbers HAVING count(*) > count(disc)""")),
    "a2_key_duplicates": (a2, sql("numbers", "SELECT count(*) - count(DISTINCT (k1, k2)) AS duplicates FROM numbers")),
    "a3_label_shares": (a3, sql("numbers", "SELECT grp, label AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 6) AS share FROM numbers GROUP BY grp, label")),
    "a4_value_shares": (a4, sql("commits", "SELECT repo AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM commits GROUP BY repo")),
    "a5_ranges": (a5, sql("numbers", each(lambda c: f"""SELECT '{c}' AS "column", min({c}) AS min, round(median({c}), 4) AS median, round(avg({c}), 4) AS mean, max({c}) AS max FROM numbers"""))),
    "a6_negatives": (a6, sql("numbers", """SELECT 'qty' AS "column", count(*) FILTER (qty - 10 < 0) AS negatives, round(count(*) FILTER (qty - 10 < 0) / count(qty), 6) AS share FROM numbers
        UNION ALL SELECT 'disc', count(*) FILTER (disc - 0.05::DOUBLE < 0), round(count(*) FILTER (disc - 0.05::DOUBLE < 0) / count(disc), 6) FROM numbers""")),
    "a7_outlier_scan": (a7, sql("numbers", "SELECT count(*) FILTER (price < 0) AS negatives, round(quantile_cont(price, 0.999), 4) AS p999, min(price) AS min, max(price) AS max FROM numbers")),
    "a8_binary": (a8, sql("numbers", """SELECT 'label' AS "column", count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS invalid FROM numbers
        UNION ALL SELECT 'flag', count(*) FILTER (disc IS NULL OR disc > 0.05::DOUBLE OR disc <= 0.02::DOUBLE) FROM numbers""")),
    "a9_array_sizes": (a9, sql("vectors", "SELECT CAST(CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 3 ELSE len(embedding) END AS INT) AS size, count(*) AS n FROM vectors GROUP BY 1")),
    "a10_times": (a10, sql("commits", "SELECT count(*) - count(canonical_datetime) AS nulls, min(canonical_datetime) AS first, max(canonical_datetime) AS last FROM commits")),
    "a11_constant": (a11, sql("numbers", each(lambda c: f"""SELECT '{c[0]}' AS "column" FROM numbers HAVING count(DISTINCT {c[1]}) = 1""", [*zip(NUM, NUM), ("one", "qty * 0 + 1"), ("holes", "CASE WHEN qty > 9 THEN 3 END")]))),
    "a12_lengths": (a12, sql("messages", describe_sql("message", "length(message)", "messages"))),
    "a12_empty": (a12_empty, sql("messages", "WITH x AS (SELECT length(trim(regexp_replace(message, '[a-zA-Z]', '', 'g'), ' ')) AS n FROM messages) SELECT count(*) FILTER (n = 0) AS empty, round(count(*) FILTER (n = 0) / count(*), 6) AS share FROM x")),
    "a13_sizes": (a13, sql("patches", describe_sql("lines", "len(string_split(patch, chr(10)))", "patches"))),
    "a14_not_positive": (a14, sql("messages", "SELECT count(*) FILTER (length(message) <= 20) AS not_positive FROM messages")),
    "a15_diff_gap": (a15, sql("patches", """WITH x AS (SELECT (length(patch) - length(replace(patch, chr(10), ''))) - ((length(patch) - length(replace(patch, chr(10) || '+', ''))) // 2 - (length(patch) - length(replace(patch, chr(10) || '+++', ''))) // 4)
        - ((length(patch) - length(replace(patch, chr(10) || '-', ''))) // 2 - (length(patch) - length(replace(patch, chr(10) || '---', ''))) // 4) AS gap FROM patches) """ + describe_sql("gap", "gap", "x"))),
    "a16_describe": (a16, sql("numbers", each(lambda c: describe_sql(c, c, "numbers", "grp")))),
    "a17_shape": (a17, sql("numbers", f"""WITH s AS ({each(shape_sql)}) SELECT "column", n, round(g, 3) AS skew, round(k, 3) AS kurtosis, round(mean, 3) AS mean, round(std, 3) AS std FROM s""")),
    "a18_sample_shape": (a18, sql("numbers", f"""WITH s AS ({each(lambda c: shape_sql(c, True))}) SELECT "column", round(g * sqrt(n::DOUBLE * (n - 1)) / (n - 2), 3) AS skew,
        round(((n + 1) * k + 6) * (n - 1) / ((n - 2)::DOUBLE * (n - 3)), 3) AS kurtosis FROM s""")),
    "a19_outliers": (a19, sql("numbers", each(report_sql))),
    "a20_outliers_by_label": (a20, sql("numbers", each(lambda c: report_sql(c, "label")))),
    "a21_zero_shares": (a21, sql("numbers", each(lambda c: f"""SELECT '{c}' AS "column", median({c}) AS median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, min({c}) AS min, max({c}) AS max, round(count(*) FILTER ({c} = 0) / count({c}), 6) AS zero_share FROM numbers""", ["qty", "tax"]))),
    "a22_correlations": (a22, sql("numbers", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM numbers" for i, a in enumerate(NUM) for b in NUM[i + 1 :]))),
    "a23_target": (a23, sql("numbers", f"""WITH c AS ({each(lambda c: f"SELECT '{c}' AS col, corr({c}, label) AS r FROM numbers")}) SELECT col AS "column", round(r, 6) AS r FROM c WHERE abs(r) >= 0.0001 ORDER BY abs(r) DESC, col LIMIT 3""")),
    "a24_overlap": (a24(30), overlap_sql("30")),
    "a24_overlap_auto": (a24("auto"), overlap_sql("""(SELECT ceil((max(price) - min(price)) / least((max(price) - min(price)) / (log2(count(*)) + 1),
        2 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / pow(count(*), 1 / 3.0))) FROM numbers WHERE price IS NOT NULL)""")),
    "a25_histogram": (a25, sql("numbers", each(lambda c: f"""SELECT '{c}' AS "column", CAST(least(floor(({c} - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM numbers, (SELECT min({c}) AS lo, max({c}) AS hi FROM numbers) e WHERE {c} IS NOT NULL GROUP BY 2"""))),
    "a29_bad_groups": (a29, sql("commits", "SELECT repo, count(*) FILTER (loc_added < 2) AS n, round(count(*) FILTER (loc_added < 2) / sum(count(*)) OVER (), 6) AS share FROM commits GROUP BY repo QUALIFY n > 0")),
    "a30_profile": (a30, sql("numbers", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS present, count(*) - count({c}) AS nulls, '{t}' AS type FROM numbers""" for c, t in (("k1", "bigint"), ("grp", "string"), ("qty", "double"), ("disc", "double"))))),
    "a31_repeated": (a31, sql("numbers", "SELECT k1, k2, count(*) AS n FROM numbers GROUP BY k1, k2 HAVING count(*) > 1 ORDER BY n DESC, k1, k2 LIMIT 5")),
}

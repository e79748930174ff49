"""Queries over sources, rows, joins and windows (S, P, J, U, W, M1, M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgrain.operators import features, history, hygiene, models
from commitgrain.plans import fixtures as fx
from commitgrain.plans.fixtures import KEYS, sql
from commitgrain.sources import tables
from commitgrain.sources.tables import work_dir
from commitgrain.streaming.resume import process_new_files

REPOS = ["click", "view"]


def experience(spark: SparkSession, d: str) -> DataFrame:
    c = history.prior_experience(fx.commits(spark, d), ["repo", "author_email"], "canonical_datetime", ["commit", "filepath"])
    c = history.recent_activity(c, ["author_email"], "canonical_datetime", ["commit", "filepath"], 7)
    return history.recent_churn(c, ["repo", "author_email"], "canonical_datetime", ["commit", "filepath"], 7)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    c = features.bucketize(features.derive(experience(spark, d)))
    g = c.groupBy("repo", F.coalesce("author_exp_pre_bucket", F.lit("none")).alias("bucket"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recent_churn"), 4).alias("mean_churn"), F.round(F.avg("activity_per_exp"), 4).alias("mean_activity"))


def s1(spark, d):
    return tables.size_report(tables.load(spark, f"{d}/events.parquet"))


def s2(spark, d):
    at = work_dir(spark, "s2")
    tables.save(fx.commits(spark, d).select(*KEYS, "loc_added"), at)
    return tables.load(spark, at, "repo string, commit string, filepath string, loc_added long").groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum("loc_added").alias("loc_added"))


def s3(spark, d):
    at = work_dir(spark, "s3")
    tables.save(fx.commits(spark, d).select("repo", "loc_deleted"), f"{at}/in/a/b")
    for _ in range(2):  # the second finds its target and does nothing
        tables.convert_tree(spark, f"{at}/in", f"{at}/out")
    return spark.read.orc(f"{at}/out").groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum("loc_deleted").alias("loc_deleted"))


def s4(spark, d):
    at, c = work_dir(spark, "s4"), fx.commits(spark, d).select(*KEYS, "event_id")
    tables.write_next(c.filter("event_id % 2 = 0"), at)
    tables.write_next(c.filter("event_id % 3 = 0"), at)
    return tables.read_latest(spark, at).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


def s5(spark, d):
    at, m = work_dir(spark, "s5"), fx.messages(spark, d)
    tables.append_cache(m.withColumn("message", F.concat(F.lit("old "), F.col("message"))), at, 1)
    tables.append_cache(m.filter("doc_id % 2 = 0"), at, 2)
    return tables.read_cache(spark, at)


def s6(spark, d):
    return hygiene.inducing_commits(fx.labels_map(spark, d))


def s7(spark, d):
    return tables.head(fx.commits(spark, d).select(*KEYS), KEYS, 100)


def s8(spark, d):
    at = work_dir(spark, "s8")
    fx.commits(spark, d).select(*KEYS, "loc_added").repartition(4).write.parquet(f"{at}/in")
    schema = "repo string, commit string, filepath string, loc_added long"
    for _ in range(2):  # the second run finds nothing left to do
        process_new_files(spark, f"{at}/in", schema, f"{at}/out", f"{at}/state", lambda b: b.filter("loc_added >= 5"), 2).awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum("loc_added").alias("loc_added"))


def p1(spark, d):
    c = fx.commits(spark, d)
    return hygiene.only_repos(c, REPOS, c.select("repo").distinct()).select(*KEYS)


def p2(spark, d):
    return hygiene.drop_columns(fx.commits(spark, d), ["event_id", "author_email", "canonical_datetime", "nothing"])


RULES = {"loc_added": lambda c: c >= 3, "disc": lambda c: c > 0}


def p3(spark, d):
    return hygiene.drop_invalid(fx.numbers(spark, d), {"disc": lambda c: c >= 0.05, "tax": lambda c: c < 0.06}).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").cast("long").alias("qty"))


def p3_counts(spark, d):
    return hygiene.invalid_counts(fx.numbers(spark, d), {"disc": lambda c: c >= 0.05, "tax": lambda c: c < 0.06})


def p4(spark, d):
    return hygiene.drop_missing(fx.numbers(spark, d), ["disc", "tax"]).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def p6(spark, d):
    return hygiene.require_columns(fx.commits(spark, d), ["repo", "commit", "loc_added"])


def p7(spark, d):
    c = fx.commits(spark, d).withColumn("filepath", F.when(F.col("event_id") % 4 == 0, F.regexp_replace("filepath", "src/", "")).otherwise(F.replace("filepath", F.lit("/"), F.lit("\\"))))
    return hygiene.flat_paths(c)


def p8(spark, d):
    from commitgrain.operators.profile import value_shares

    return value_shares(fx.commits(spark, d), hygiene.extension(F.col("filepath"))).select(F.col("value").alias("extension"), "n", F.round("share", 6).alias("share"))


def u1(spark, d):
    c = fx.commits(spark, d).withColumn("commit", F.substring("commit", 1, 2)).select(*KEYS, "event_id", "loc_added")
    return hygiene.append_rows(c.filter("event_id % 3 <> 0"), c.filter("event_id % 3 = 0").drop("loc_added"), KEYS, ["event_id"])


def u2(spark, d):
    return hygiene.first_of(fx.messages(spark, d), ["repo", "commit"], ["doc_id"])


def u3(spark, d):
    return hygiene.duplicates(fx.numbers(spark, d).select("k1", "k2", "qty", "price"), ["k1", "k2"])


def u4(spark, d):
    n = fx.numbers(spark, d).select("k1", "k2", "price")
    return hygiene.new_duplicates(n.filter("price < 50000"), n, ["k1", "k2"])


def u5(spark, d):
    c = fx.commits(spark, d)
    one = lambda x: x.groupBy("repo").agg(F.sum("loc_added").alias("total"))
    return hygiene.stack_reports({"even": one(c.filter("event_id % 2 = 0")), "odd": one(c.filter("event_id % 2 = 1"))})


def j1(spark, d):
    c = fx.commits(spark, d)
    return hygiene.attach_features(c.select(*KEYS, "author_email"), c.filter("event_id % 3 = 0").select(*KEYS, "loc_added"), KEYS)


def j2(spark, d):
    c = fx.commits(spark, d)
    return hygiene.not_done(c.select(*KEYS), c.filter("event_id % 3 = 0"), KEYS)


def j3(spark, d):
    return hygiene.label_rows(fx.commits(spark, d).select(*KEYS), hygiene.inducing_commits(fx.labels_map(spark, d)))


def j4(spark, d):
    return hygiene.attach_messages(fx.message_keys(spark, d), hygiene.first_of(fx.messages(spark, d), ["repo", "commit"], ["doc_id"])).withColumn("message", F.md5(F.col("message").cast("binary")))


def j5(spark, d):
    return hygiene.work_list(fx.message_keys(spark, d), fx.messages(spark, d))


def j6(spark, d):
    meta = fx.commits(spark, d).select("repo", "commit", "canonical_datetime").join(fx.parents(spark, d), ["repo", "commit"])
    return history.seconds_since_parent(meta)


def j7(spark, d):
    c = fx.commits(spark, d)
    meta = c.filter("event_id % 9 <> 0").withColumn("author_email", F.when(F.col("event_id") % 11 != 0, F.col("author_email")))
    return hygiene.attach_authors(c.select(*KEYS), meta)


def w1(spark, d):
    return history.prior_experience(fx.commits(spark, d), ["repo", "author_email"], "canonical_datetime", ["commit", "filepath"]).select(*KEYS, "author_exp_pre")


def w2(days, scope):
    return lambda spark, d: history.recent_activity(fx.commits(spark, d), scope, "canonical_datetime", ["commit", "filepath"], days).select(*KEYS, "author_recent_activity_pre")


def w3(days):
    return lambda spark, d: history.recent_churn(fx.commits(spark, d), ["repo", "author_email"], "canonical_datetime", ["commit", "filepath"], days).select(*KEYS, F.col("recent_churn").cast("long").alias("recent_churn"))


def w4(spark, d):
    return history.seconds_since_file_change(fx.commits(spark, d)).select(*KEYS, "seconds_since_file_change")


def w5(spark, d):
    return history.earlier_file_churn(fx.commits(spark, d)).select(*KEYS, "earlier_file_churn")


def w6(last):
    return lambda spark, d: history.capped_experience(fx.commits(spark, d), last=last).select(*KEYS, "author_exp_capped")


def m1(spark, d):
    return models.split(fx.commits(spark, d).select(*KEYS), KEYS)


def m4(spark, d):
    return models.class_weights(fx.numbers(spark, d)).select("label", "n", F.round("balanced", 6).alias("balanced"), F.round("scale_pos_weight", 6).alias("scale_pos_weight"))


_peers = lambda value, days, by: f"""
    SELECT repo, "commit", filepath, CAST({value} OVER (PARTITION BY {by} ORDER BY canonical_datetime RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW) - {value} OVER
    (PARTITION BY {by}, canonical_datetime ORDER BY "commit", filepath ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)"""  # noqa: E731
_churn = "sum(loc_added + loc_deleted)"
K = 'repo, "commit", filepath'


def _capped(last: int) -> str:
    return sql("commits", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY canonical_datetime, "commit", filepath) AS k FROM commits)
        SELECT {K}, count(*) OVER (PARTITION BY repo, author_email ORDER BY k RANGE BETWEEN {last} PRECEDING AND 1 PRECEDING) AS author_exp_capped FROM n""")


QUERIES = {
    "flagship": (flagship, sql("commits", f"""
        WITH x AS (SELECT *, row_number() OVER (PARTITION BY repo, author_email ORDER BY canonical_datetime, "commit", filepath) - 1 AS e,
            count(*) OVER (PARTITION BY author_email ORDER BY canonical_datetime RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY author_email, canonical_datetime ORDER BY "commit", filepath ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a,
            {_churn} OVER (PARTITION BY repo, author_email ORDER BY canonical_datetime RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) - {_churn} OVER (PARTITION BY repo, author_email, canonical_datetime ORDER BY "commit", filepath ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM commits)
        SELECT repo, CASE WHEN e < 1 THEN 'junior' WHEN e < 5 THEN 'mid' ELSE 'senior' END AS bucket, count(*) AS n,
            round(avg(r), 4) AS mean_churn, round(avg(a / (e + 1)), 4) AS mean_activity FROM x GROUP BY ALL""")),
    "s1_load": (s1, "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM events"),
    "s2_save": (s2, sql("commits", "SELECT repo, count(*) AS n, CAST(sum(loc_added) AS BIGINT) AS loc_added FROM commits GROUP BY repo")),
    "s3_convert": (s3, sql("commits", "SELECT repo, count(*) AS n, CAST(sum(loc_deleted) AS BIGINT) AS loc_deleted FROM commits GROUP BY repo")),
    "s4_versions": (s4, sql("commits", "SELECT repo, count(*) AS n, max(event_id) AS last_event FROM commits WHERE event_id % 3 = 0 GROUP BY repo")),
    "s5_cache": (s5, sql("messages", """WITH a AS (SELECT 1 AS b, repo, "commit", 'old ' || message AS message FROM messages UNION ALL SELECT 2, repo, "commit", message FROM messages WHERE doc_id % 2 = 0)
        SELECT repo, "commit", message FROM a QUALIFY row_number() OVER (PARTITION BY repo, "commit" ORDER BY b DESC, message DESC) = 1""")),
    "s6_inducing": (s6, sql("labels_map", 'SELECT DISTINCT repo, inducing AS "commit" FROM labels_map WHERE inducing IS NOT NULL')),
    "s7_head": (s7, sql("commits", f"SELECT {K} FROM commits ORDER BY {K} LIMIT 100")),
    "s8_stream": (s8, sql("commits", "SELECT repo, count(*) AS n, CAST(sum(loc_added) AS BIGINT) AS loc_added FROM commits WHERE loc_added >= 5 GROUP BY repo")),
    "p1_only_repos": (p1, sql("commits", f"SELECT {K} FROM commits WHERE repo IN ('click', 'view')")),
    "p2_drop_columns": (p2, sql("commits", f"SELECT {K}, loc_added, loc_deleted FROM commits")),
    "p3_drop_invalid": (p3, sql("numbers", "SELECT grp, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM numbers WHERE disc >= 0.05 AND tax < 0.06 GROUP BY grp")),
    "p3_invalid_counts": (p3_counts, sql("numbers", """SELECT 'disc' AS rule, count(*) - count(*) FILTER (disc >= 0.05) AS dropped FROM numbers
        UNION ALL SELECT 'tax', count(*) - count(*) FILTER (tax < 0.06) FROM numbers""")),
    "p4_drop_missing": (p4, sql("numbers", "SELECT grp, count(*) AS n FROM numbers WHERE disc IS NOT NULL AND tax IS NOT NULL GROUP BY grp")),
    "p6_require_columns": (p6, sql("commits", 'SELECT repo, "commit", loc_added FROM commits')),
    "p7_flat_paths": (p7, sql("commits", "SELECT DISTINCT replace(filepath, 'src/', '') AS filepath FROM commits WHERE event_id % 4 = 0")),
    "p8_extension": (p8, sql("commits", "SELECT string_split(filepath, '.')[-1] AS extension, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM commits GROUP BY 1")),
    "u1_append": (u1, sql("commits", f"""WITH c AS (SELECT repo, substring("commit", 1, 2) AS "commit", filepath, event_id, loc_added FROM commits)
        SELECT {K}, event_id, CASE WHEN event_id % 3 <> 0 THEN loc_added END AS loc_added FROM c
        QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, event_id DESC) = 1""")),
    "u2_first": (u2, sql("messages", 'SELECT repo, "commit", message, doc_id FROM messages QUALIFY row_number() OVER (PARTITION BY repo, "commit" ORDER BY doc_id) = 1')),
    "u3_duplicates": (u3, sql("numbers", "SELECT k1, k2, qty, price FROM numbers QUALIFY count(*) OVER (PARTITION BY k1, k2) > 1")),
    "u4_new_duplicates": (u4, sql("numbers", """SELECT k1, k2, price FROM numbers QUALIFY count(*) OVER (PARTITION BY k1, k2) > 1 EXCEPT ALL
        SELECT k1, k2, price FROM numbers WHERE price < 50000 QUALIFY count(*) OVER (PARTITION BY k1, k2) > 1""")),
    "u5_stack": (u5, sql("commits", "SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, repo, CAST(sum(loc_added) AS BIGINT) AS total FROM commits GROUP BY ALL")),
    "j1_attach_features": (j1, sql("commits", f"SELECT {K}, author_email, loc_added FROM commits WHERE event_id % 3 = 0")),
    "j2_not_done": (j2, sql("commits", f"SELECT {K} FROM commits WHERE event_id % 3 <> 0")),
    "j3_label": (j3, sql("commits labels_map", f"""SELECT {K}, CAST(EXISTS (SELECT 1 FROM labels_map l WHERE l.repo = c.repo AND l.inducing = c."commit") AS INT) AS label FROM commits c""")),
    "j4_messages": (j4, sql("messages message_keys", """WITH m AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY repo, "commit" ORDER BY doc_id) = 1)
        SELECT d.repo, d."commit", d.doc_id, md5(coalesce(m.message, '')) AS message FROM message_keys d LEFT JOIN m USING (repo, "commit")""")),
    "j5_work_list": (j5, sql("messages message_keys", 'SELECT DISTINCT repo, "commit" FROM message_keys d WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.repo = d.repo AND m."commit" = d."commit")')),
    "j6_parent_gap": (j6, sql("commits parents", """SELECT c.repo, c."commit", CAST(epoch(c.canonical_datetime) - epoch(p.canonical_datetime) AS BIGINT) AS time_since_last_change
        FROM commits c JOIN parents x USING (repo, "commit") LEFT JOIN commits p ON p.repo = c.repo AND p."commit" = x.parent""")),
    "j7_authors": (j7, sql("commits", f"SELECT {K}, author_email, canonical_datetime FROM commits WHERE event_id % 9 <> 0 AND event_id % 11 <> 0")),
    "w1_experience": (w1, sql("commits", f'SELECT {K}, row_number() OVER (PARTITION BY repo, author_email ORDER BY canonical_datetime, "commit", filepath) - 1 AS author_exp_pre FROM commits')),
    "w2_activity_30": (w2(30, ["author_email"]), sql("commits", _peers("count(*)", 30, "author_email") + " AS author_recent_activity_pre FROM commits")),
    "w2_activity_7_repo": (w2(7, ["repo", "author_email"]), sql("commits", _peers("count(*)", 7, "repo, author_email") + " AS author_recent_activity_pre FROM commits")),
    "w3_churn_30": (w3(30), sql("commits", _peers(_churn, 30, "repo, author_email") + " AS recent_churn FROM commits")),
    "w3_churn_7": (w3(7), sql("commits", _peers(_churn, 7, "repo, author_email") + " AS recent_churn FROM commits")),
    "w4_file_gap": (w4, sql("commits", f'SELECT {K}, CAST(epoch(canonical_datetime) - epoch(lag(canonical_datetime) OVER (PARTITION BY repo, filepath ORDER BY canonical_datetime, "commit")) AS BIGINT) AS seconds_since_file_change FROM commits')),
    "w5_file_churn": (w5, sql("commits", f'SELECT {K}, CAST(coalesce({_churn} OVER (PARTITION BY repo, filepath ORDER BY canonical_datetime, "commit" ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING), 0) AS BIGINT) AS earlier_file_churn FROM commits')),
    "w6_capped": (w6(10_000), _capped(10_000)),
    "w6_capped_200": (w6(200), _capped(200)),
    "m1_split": (m1, sql("commits", f"""SELECT {K}, CAST(CAST('0x' || substring(md5(repo || '|' || "commit" || '|' || filepath || '|42'), 1, 8) AS BIGINT) % 100 < 20 AS INT) AS is_test FROM commits""")),
    "m4_weights": (m4, sql("numbers", """SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS balanced,
        round(sum(CASE WHEN label = 0 THEN count(*) ELSE 0 END) OVER () / sum(CASE WHEN label = 1 THEN count(*) ELSE 0 END) OVER (), 6) AS scale_pos_weight FROM numbers GROUP BY label""")),
}

"""Views of the given tables as commits, patches, labels, messages and so on,
once as DataFrames and once as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["repo", "commit", "filepath"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_of(c: Column) -> Column:
    return F.md5(c.cast("string").cast("binary"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("repo"), md5_of(F.col("event_id")).alias("commit"),
        F.concat(F.lit("src/f"), (F.col("event_id") % 20).cast("string"), F.when(F.col("event_id") % 7 == 0, ".pyi").otherwise(".py")).alias("filepath"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x")).alias("author_email"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("canonical_datetime"),
        F.floor("value").cast("long").alias("loc_added"), (F.col("event_id") % 50).cast("long").alias("loc_deleted"), "event_id")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, commit, parents): the commit before in the repo, or for each
    tenth the one after."""
    w = Window.partitionBy("repo").orderBy("event_id")
    c = commits(spark, sf_dir).select("repo", "commit", "event_id")
    p = F.when(F.col("event_id") % 10 == 0, F.lead("commit").over(w)).otherwise(F.lag("commit").over(w))
    return c.select("repo", "commit", F.when(p.isNull(), F.array().cast("array<string>")).otherwise(F.array(p)).alias("parents"))


def labels_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("repo").orderBy("event_id")
    c = commits(spark, sf_dir).select("repo", "commit", "event_id", F.lag("commit").over(w).alias("prev"))
    return c.filter("event_id % 5 = 0").select("repo", F.col("commit").alias("fix_commit"), F.when(F.col("event_id") % 15 != 0, F.array("prev")).alias("inducing"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo"), F.md5(F.col("text").cast("binary")).alias("commit"), F.col("text").alias("message"), "doc_id")


def message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, commit, doc_id): two commits for each document, of which only the
    first has a message."""
    d = table(spark, sf_dir, "documents")
    both = F.array(F.md5(F.col("text").cast("binary")), md5_of(F.col("doc_id")))
    return d.select(F.col("source").alias("repo"), F.explode(both).alias("commit"), "doc_id")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda x, i: F.concat(F.element_at(F.array(F.lit("+"), F.lit(" "), F.lit("-")), (i % 3 + 1).cast("int")), x, F.when(i % 4 == 0, " try TODO").otherwise("")))
    n = F.size(lines).cast("string")
    return d.select(
        F.col("source").alias("repo"), F.md5(F.col("text").cast("binary")).alias("commit"),
        F.concat(F.lit("src/d"), (F.col("doc_id") % 9).cast("string"), F.when(F.col("doc_id") % 5 == 0, ".md").otherwise(".py")).alias("path"),
        F.concat(F.lit("@@ -1,"), n, F.lit(" +1,"), n, F.lit(" @@\n"), F.array_join(marked, "\n")).alias("patch"),
        F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("old_text"), F.col("text").alias("new_text"), "doc_id")


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_returnflag").alias("grp"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc"), F.col("l_tax").alias("tax"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") % 2).cast("int").alias("label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    salted = lab.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), F.col("doc_id").alias("row_id"), F.col("quality").alias("y"))
    digits = F.conv(F.substring(F.md5(F.concat(F.col("row_id").cast("string"), F.col("model")).cast("binary")), 1, 8), 16, 10).cast("long")
    return salted.select("model", "row_id", "y", F.round((digits % 100) / 99 * 0.7 + 0.3 * F.col("y"), 6).alias("score"))


#: The same as SQL.
CTE = {
    "commits": """commits AS (SELECT event_type AS repo, md5(CAST(event_id AS VARCHAR)) AS "commit",
        'src/f' || event_id % 20 || CASE WHEN event_id % 7 = 0 THEN '.pyi' ELSE '.py' END AS filepath, 'u' || user_id || '@x' AS author_email,
        CAST(date_trunc('hour', ts) AS TIMESTAMP) AS canonical_datetime, CAST(floor(value) AS BIGINT) AS loc_added, CAST(event_id % 50 AS BIGINT) AS loc_deleted, event_id FROM events)""",
    "parents": """parents AS (SELECT repo, "commit", CASE WHEN event_id % 10 = 0 THEN lead("commit") OVER w ELSE lag("commit") OVER w END AS parent
        FROM commits WINDOW w AS (PARTITION BY repo ORDER BY event_id))""",
    "labels_map": """labels_map AS (SELECT repo, "commit" AS fix_commit, CASE WHEN event_id % 15 <> 0 THEN prev END AS inducing FROM
        (SELECT *, lag("commit") OVER (PARTITION BY repo ORDER BY event_id) AS prev FROM commits) WHERE event_id % 5 = 0)""",
    "messages": """messages AS (SELECT source AS repo, md5(text) AS "commit", text AS message, doc_id FROM documents)""",
    "message_keys": """message_keys AS (SELECT source AS repo, unnest([md5(text), md5(CAST(doc_id AS VARCHAR))]) AS "commit", doc_id FROM documents)""",
    "patches": r"""patches AS (SELECT source AS repo, md5(text) AS "commit", 'src/d' || doc_id % 9 || CASE WHEN doc_id % 5 = 0 THEN '.md' ELSE '.py' END AS path,
        '@@ -1,' || len(l) || ' +1,' || len(l) || ' @@' || chr(10) || array_to_string(list_transform(l, lambda x, i: ['+', ' ', '-'][CAST((i - 1) % 3 + 1 AS INT)] || x || CASE WHEN (i - 1) % 4 = 0 THEN ' try TODO' ELSE '' END), chr(10)) AS patch,
        CASE WHEN doc_id % 11 <> 0 THEN text END AS old_text, text AS new_text, doc_id FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))""",
    "numbers": """numbers AS (SELECT l_orderkey AS k1, l_linenumber AS k2, l_returnflag AS grp, l_shipdate AS ts, l_quantity AS qty, l_extendedprice AS price,
        nullif(l_discount, 0) AS disc, l_tax AS tax, CAST(l_linestatus = 'F' AS INT) AS label FROM lineitem)""",
    "vectors": "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label % 2 AS label FROM embeddings)",
    "predictions": """predictions AS (SELECT model, doc_id AS row_id, quality AS y,
        round((CAST('0x' || substring(md5(doc_id || model), 1, 8) AS BIGINT) % 100) / 99.0 * 0.7 + 0.3 * quality, 6) AS score FROM labels, (VALUES ('a'), ('b')) m(model))""",
}
NEEDS = {"parents": ["commits"], "labels_map": ["commits"]}


def sql(views: str, query: str) -> str:
    """The query after the common table expressions it names."""
    names: list[str] = []
    for v in views.split():
        for x in [*NEEDS.get(v, []), v]:
            if x not in names:
                names.append(x)
    first = "WITH " + ",\n".join(CTE[n] for n in names)
    body = query.strip()
    return f"{first}, {body[5:]}" if body.upper().startswith("WITH ") else f"{first}\n{body}"

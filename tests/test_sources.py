"""Arrow files, resuming by row, heavy terms and cleaning beyond ASCII."""

import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from commitgrain.functions import text
from commitgrain.sources.feather import read_feather
from commitgrain.streaming.resume import process_new_rows

SF = "/root/testdata/sf0.001"


def test_feather_is_parquet(spark, tmp_path):
    rows = [{"id": i, "x": None if i % 5 == 0 else i / 3, "s": None if i % 7 == 0 else f"é{i}", "v": None if i % 4 == 0 else [float(i), None], "d": i % 2 == 0} for i in range(100)]
    table = pa.Table.from_pylist(rows)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    feather.write_feather(table.slice(0, 60), str(tmp_path / "in" / "a.feather"), compression="lz4", chunksize=25)
    with pa.OSFile(str(tmp_path / "in" / "deep" / "b.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table.slice(60), max_chunksize=40)
    (tmp_path / "in" / "note.txt").write_text("no table")
    df = read_feather(spark, str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() == 4  # a record batch each
    df.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.asDict() for r in back.collect()), key=lambda r: r["id"]) == rows
    some = read_feather(spark, f"file://{tmp_path}/in", ["s", "id"])
    assert some.columns == ["s", "id"] and {(r["id"], r["s"]) for r in some.collect()} == {(r["id"], r["s"]) for r in rows}
    with pytest.raises(Exception, match="nowhere"):
        read_feather(spark, str(tmp_path / "nowhere")).count()


def test_rows_come_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    make = lambda ids: spark.createDataFrame([(i, None if i % 10 == 0 else i % 3, f"row {i}") for i in ids], "id long, part int, t string")
    fail = {"once": True}

    def step(df):
        out = df.withColumn("size", F.length("t"))
        if fail["once"]:
            fail["once"] = False
            out.write.mode("overwrite").partitionBy("part").parquet(str(tmp_path / "half"))  # work that is lost
            raise RuntimeError("killed")
        return out

    run = lambda: process_new_rows(spark, source, "id long, part int, t string", target, checkpoint, step, ["id", "part"], buckets=4, files_a_batch=1).awaitTermination()
    make(range(50)).coalesce(1).write.parquet(source)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    make(range(50)).coalesce(1).write.mode("append").parquet(source)  # the same file again
    make(range(40, 80)).coalesce(1).write.mode("append").parquet(source)  # shares rows
    make([80, 80, 81]).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = spark.read.parquet(target)
    assert Counter(r["id"] for r in got.collect()) == Counter(range(82))
    assert {c for c in got.columns} == {"id", "part", "t", "size", "bucket", "batch"}


@pytest.mark.parametrize("counters", [None, 30])
def test_heavy_terms_are_the_full_count(spark, counters):
    rng = random.Random(6)
    vocab = [f"t{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    docs = [rng.choices(vocab, weights, k=rng.randint(0, 80)) for _ in range(600)] + [None, []]
    n, df = Counter(t for d in docs for t in d or ()), Counter(t for d in docs for t in set(d or ()))
    want = sorted(n, key=lambda t: (-n[t], t))[:20]
    found = spark.createDataFrame([(d,) for d in docs], "terms array<string>").repartition(5)
    got = text.heavy_terms(found, 20, counters).collect()
    assert [(r["term"], r["n"], r["df"]) for r in got] == [(t, n[t], df[t]) for t in want]
    flat = spark.createDataFrame([([f"u{i}"],) for i in range(500)], "terms array<string>").repartition(2)
    assert [r["term"] for r in text.heavy_terms(flat, 3, 2).collect()] == ["u0", "u1", "u10"]  # ties all along: counters grow
    assert text.heavy_terms(found.limit(0), 20).count() == 0


def test_cleaning_beyond_ascii(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").filter("text is not null")
    extra = spark.createDataFrame([("éabcd deadbeef über#12 cafe1 ñ.py　Ünï",), ("Привет abcdé https://x.y/é z",)], "text string")
    for r in docs.unionByName(extra).select("text", text.clean_message(F.col("text")).alias("clean")).collect():
        want = r["text"].lower()
        for pattern, to in text.CLEANING:
            want = re.sub(pattern, to, want)
        assert r["clean"] == want.strip()

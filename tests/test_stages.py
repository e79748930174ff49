"""The preprocessing as one saved pipeline."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from commitgrain.operators import features, stages


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, i % 23, i % 5, i % 11, i % 7, i % 3, i % 2, 4.0, f"fix the parser of module {i % 4}", [float(i % 3), float(i % 5), i / 10], [float(i % 4), 1.0, float(-i)]) for i in range(120)]
    return spark.createDataFrame(rows, "k int, loc_added int, loc_deleted int, author_exp_pre int, author_recent_activity_pre int, todo int, fixme int, same double, message string, code_embed array<double>, msg_embed array<double>")


def test_saved_pipeline_is_the_functions_in_order(spark, table, tmp_path):
    numbers, tokens = ["loc_added", "loc_deleted", "author_exp_pre", "author_recent_activity_pre", "same"], ["todo", "fixme"]
    arrays = {"code_embed": ("code_emb", 2), "msg_embed": ("msg_emb", 2)}
    train, rest = table.filter("k < 80"), table.filter("k >= 80")
    made = stages.preprocessing(numbers, tokens, "message", arrays, ["loc_added", "author_exp_pre", "todo"])
    model = made.fit(train)
    model.write().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    assert [type(s).__name__ for s in back.stages] == ["NumbersModel", "TermsModel", "ComponentsModel", "Derived", "Buckets", "TokenRatios", "Interactions"]
    assert [s.uid for s in back.stages] == [s.uid for s in model.stages]
    got = back.transform(rest)
    want = features.fit(train, numbers, tokens, "message", arrays).transform(rest)
    want = features.interactions(features.token_ratios(features.one_hot(features.bucketize(features.derive(want))), tokens), ["loc_added", "author_exp_pre", "todo"])
    assert sorted(got.columns) == sorted(want.columns) and "same" not in got.columns and "loc_added_bucket_small" in got.columns
    assert got.select(*want.columns).orderBy("k").collect() == want.orderBy("k").collect()
    assert set(stages.explained(back)) == set(arrays)


def test_empty_table_and_missing_columns(spark, table):
    model = stages.preprocessing(["loc_added"], ["todo"]).fit(table)
    assert model.transform(table.limit(0)).count() == 0
    assert not [s for s in model.stages if isinstance(s, (stages.Terms, stages.ComponentsModel, stages.Interactions))]
    with pytest.raises(Exception, match="gone"):
        stages.preprocessing(["loc_added"], ["gone"]).fit(table).transform(table.select(F.col("k"), "loc_added"))

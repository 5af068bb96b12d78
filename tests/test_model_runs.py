import datetime as dt

import pytest
from clickcast.operators import model_runs as MR
from clickcast.operators import value_model as VM
from clickcast.schema import VALUE_FEATURES
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def labeled(spark):
    """Labels that a feature tells, so that more trees of more depth do better."""
    f = {c: F.lit(0.0) for c in VALUE_FEATURES} | {"view_count": (F.col("id") * 7 % 100).cast("double"), "add_count": (F.col("id") * 13 % 50).cast("double")}
    return spark.range(300).select(F.concat(F.lit("u"), "id").alias("user_id"), *[v.alias(c) for c, v in f.items()]).withColumn(
        "value_label", F.when(F.col("view_count") < 33, 0).when(F.col("add_count") < 20, 1).otherwise(2))


def test_promotion_and_rollback(spark, labeled, tmp_path):
    root, at = str(tmp_path), lambda h: dt.datetime(2024, 1, 1, h, tzinfo=dt.timezone.utc)
    with pytest.raises(LookupError):
        MR.champion(spark, root, "customer_value")
    MR.fit_value_model(labeled, root, num_trees=2, max_depth=1, run_id="weak", run_time=at(1))
    assert MR.champion(spark, root, "customer_value")[0] == "weak"
    MR.fit_value_model(labeled, root, num_trees=20, max_depth=5, run_id="strong", run_time=at(2))
    MR.fit_value_model(labeled, root, num_trees=2, max_depth=1, run_id="late", run_time=at(3))
    history = {r.run_id: r for r in MR.history(spark, root).collect()}
    assert history["strong"].metric > history["weak"].metric
    assert [history[r].promoted for r in ("weak", "strong", "late")] == [True, True, False]
    run, model = MR.champion(spark, root, "customer_value")
    assert run == "strong" and model.stages[-1].getNumTrees == 20

    users = spark.createDataFrame([("u1",), ("new",)], "id string")
    cart = spark.createDataFrame([("new", "p1"), ("new", "p2")], "user_id string, product_id string")
    assert [(r.user_id, r.champion_run) for r in MR.score_by_champion(users, labeled, cart, root).collect()] == [("new", "strong")]
    assert VM.unlabeled_rows(users, labeled, cart).select("add_count", "unique_sessions", "view_count").collect() == [(2.0, 1.0, 0.0)]

    MR.withdraw(spark, root, "strong")
    MR.withdraw(spark, root, "strong")
    assert MR.champion(spark, root, "customer_value")[0] == "weak"
    assert sorted(r.run_id for r in MR.runs(spark, root).collect()) == ["late", "weak"]
    with pytest.raises(ValueError):
        MR.withdraw(spark, root, "unknown")
    with pytest.raises(ValueError):
        MR.record(spark, root, "customer_value", model, 1.0, run_id="weak")


def test_runs_without_a_metric_and_of_other_models(spark, labeled, tmp_path):
    root = str(tmp_path)
    model, _ = VM.train_value_model(labeled, num_trees=2, max_depth=1)
    MR.record(spark, root, "a", model, None, run_id="none")
    MR.record(spark, root, "b", model, float("nan"), run_id="nan")
    MR.record(spark, root, "b", model, 0.1, run_id="b1")
    with pytest.raises(LookupError):
        MR.champion(spark, root, "a")
    assert MR.champion(spark, root, "b")[0] == "b1"

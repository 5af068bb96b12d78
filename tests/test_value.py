import pandas as pd

from clickcast.operators import value as V
from clickcast.plans import inputs as I
from conftest import SF_SMALL


def test_pct_rank_matches_pandas_with_ties(spark):
    vals = [3.0, 1.0, 1.0, 2.0, 5.0, 5.0, 5.0, -1.0, 0.0, 2.0] * 7 + [9.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, s double")
    got = V.pct_rank_average(df.repartition(5), "s", "p").toPandas().sort_values("k")
    exp = pd.Series(vals).rank(pct=True, method="average")
    assert (got["p"].round(12).tolist() == exp.round(12).tolist())


def test_running_total_by_group_spans_partitions(spark):
    from clickcast.functions.ranking import running_total
    rows = [(i, "ab"[i % 3 > 0], i % 5) for i in range(400)]
    got = running_total(spark.createDataFrame(rows, "k int, g string, n int"), ["k"], "n", "t", ["g"]).collect()
    sums = {"a": 0, "b": 0}
    want = {}
    for k, g, n in rows:
        want[k] = sums[g]
        sums[g] += n
    assert {r.k: r.t for r in got} == want


def test_split_is_stratified_exactly(spark):
    from clickcast.operators import value_model as VM
    lab = spark.createDataFrame([(str(i), 0 if i < 700 else 1 if i < 950 else 2) for i in range(1000)], "user_id string, value_label int")
    got = VM.with_rank(lab).withColumn("t", VM.held_out()).filter("t").groupBy("value_label").count().collect()
    assert {r.value_label: r["count"] for r in got} == {0: 140, 1: 50, 2: 10}


def test_labels_partition_users(spark):
    lab = V.customer_value(I.all_validated(spark, SF_SMALL)).toPandas()
    assert lab["user_id"].is_unique
    assert set(lab["value_label"]) <= {0, 1, 2}
    exp = lab["value_score"].rank(pct=True, method="average")
    want = exp.apply(lambda p: 0 if p <= 0.33 else (1 if p <= 0.66 else 2))
    assert (want.values == lab["value_label"].values).all()


def test_features_against_pandas(spark):
    ev = I.all_validated(spark, SF_SMALL)
    f = V.customer_value_features(ev).toPandas().set_index("user_id").sort_index()
    p = ev.select("user_id", "session_id", "event_time", "event_type", "product_id").toPandas()
    p = p[p.user_id.notna()]
    g = p.groupby("user_id")
    assert (g.size().sort_index() >= f["view_count"]).all()
    assert (g["session_id"].nunique().sort_index() == f["unique_sessions"]).all()
    assert (g["product_id"].nunique().sort_index() == f["unique_products"]).all()
    tx = (p.event_type == "transaction").groupby(p.user_id).sum().sort_index()
    assert (tx == f["transaction_count"]).all()
    snap = p.event_time.max()
    last_tx = p[p.event_type == "transaction"].groupby("user_id").event_time.max()
    days = ((snap - last_tx).dt.days).reindex(f.index).fillna(999).clip(upper=999).astype(int)
    assert (days == f["days_since_last_tx"]).all()

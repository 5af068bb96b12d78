import uuid

from clickcast import jobs
from clickcast.plans import inputs as I
from clickcast.plans.daily import REPORTS
from clickcast.sources.tables import shop_events, shop_products
from clickcast.streaming import ingest as SI
from clickcast.streaming import metrics as SM
from clickcast.streaming import notifier as SN
from conftest import SF_SMALL


def test_jobs_run_one_after_the_other(spark, tmp_path):
    SI.write_message_files(shop_events(spark, SF_SMALL), f"{tmp_path}/messages", files=4)
    jobs.main(["ingest", "--messages", f"{tmp_path}/messages", "--out", f"{tmp_path}/out", "--once"], spark)
    n = I.all_validated(spark, SF_SMALL).count()
    assert jobs.raw_events(spark, f"{tmp_path}/out/raw").count() == n
    total = SM.read_live_metric(spark, f"{tmp_path}/out/metrics", SM.BY_NAME["total_notifications"]).first()[0]
    assert total == I.notification_events(spark, SF_SMALL).count()
    letters = spark.read.parquet(f"{tmp_path}/out/rejected")
    assert n + letters.count() == shop_events(spark, SF_SMALL).count()
    run_date = jobs.main(["daily", "--raw", f"{tmp_path}/out/raw", "--out", f"{tmp_path}/daily"], spark)
    assert all(spark.read.json(f"{tmp_path}/daily/{r}/run_date={run_date}").count() > 0 for r in REPORTS)
    assert jobs.main(["export", "--raw", f"{tmp_path}/out/raw", "--out", f"{tmp_path}/csv"], spark) == n
    table = f"events_{uuid.uuid4().hex[:8]}"
    jobs.main(["compact", "--raw", f"{tmp_path}/out/raw", "--out", f"{tmp_path}/{table}", "--table", table, "--buckets", "4"], spark)
    assert spark.table(table).count() == n
    spark.sql(f"drop table {table}")


def test_jobs_of_features_rules_and_offers(spark, tmp_path):
    """The steps after ingest, each from the files of the one before."""
    root, users = str(tmp_path), "id,first_name,last_name,email,phone_number,region,country,hashed_password,is_deleted\n"
    SI.write_message_files(shop_events(spark, SF_SMALL), f"{root}/messages", files=6)
    jobs.main(["ingest", "--messages", f"{root}/messages", "--max-files", "3", "--out", f"{root}/in", "--checkpoint", f"{root}/ck", "--once",
               "--without", "activity", "dumps", "metrics"], spark)
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["raw", "raw_ids", "rejected"]
    raw = ["--raw", f"{root}/in/raw"]
    state = ["daily", *raw, "--state", f"{root}/state", "--out", f"{root}/daily"]
    days = [str(r[0]) for r in jobs.raw_events(spark, f"{root}/in/raw").select("event_date").distinct().orderBy("event_date").collect()]
    assert jobs.main([*state, "--first", days[0], "--as-of", days[-2]], spark) == days[-2]
    assert jobs.main([*state, "--as-of", days[-1]], spark) == days[-1]
    n = spark.read.json(f"{root}/daily/summary/run_date={days[-1]}").first()["total_events"]
    assert n == I.user_events(spark, SF_SMALL).count()

    jobs.main(["features", *raw, "--out", f"{root}/features"], spark)
    assert 0 <= jobs.main(["model", "--labels", f"{root}/features/parquet", "--out", f"{root}/model"], spark)["accuracy"] <= 1
    importance = spark.read.json(f"{root}/model/importance").agg({"importance": "sum"}).first()[0]
    assert abs(importance - 1) < 1e-3  # each is rounded to four digits
    jobs.main(["baskets", *raw, "--out", f"{root}/baskets"], spark)
    assert spark.read.option("header", True).csv(f"{root}/baskets").count() > 0
    jobs.main(["rules", *raw, "--out", f"{root}/rules", "--support", "0.01"], spark)
    jobs.main(["predict", "--rules", f"{root}/rules", "--out", f"{root}/predicted"], spark)
    held_out = {r.basket_id for r in spark.read.parquet(f"{root}/rules/baskets").filter("split = 'test'").collect()}
    assert {r.basket_id for r in spark.read.parquet(f"{root}/predicted").collect()} <= held_out
    shop_products(spark, SF_SMALL).write.parquet(f"{root}/products")
    jobs.main(["recommend", *raw, "--rules", f"{root}/rules", "--products", f"{root}/products", "--out", f"{root}/recs"], spark)
    assert spark.read.parquet(f"{root}/recs").count() > 0

    (tmp_path / "users.csv").write_text(users + "1,A,B,a@x.org,+1,E,UK,$2b$,false\n")
    jobs.main(["notify", "--messages", f"{root}/messages", "--labels", f"{root}/features/parquet", "--users", f"{root}/users.csv",
               "--out", f"{root}/offers", "--watermark", "3 days", "--once"], spark)
    offers = SN.read_offers(spark, f"{root}/offers").collect()
    model = ["model", "--labels", f"{root}/features/parquet", "--out", f"{root}/model", "--runs", f"{root}/runs"]
    for run, depth in (("shallow", "1"), ("deep", "5")):
        jobs.main([*model, "--run", run, "--trees", "5", "--depth", depth], spark)
    (tmp_path / "more_users.csv").write_text(users + "1,A,B,a@x.org,+1,E,UK,$2b$,false\n987654321,C,D,c@x.org,+1,E,UK,$2b$,false\n")
    score = ["score", "--runs", f"{root}/runs", "--labels", f"{root}/features/parquet", "--users", f"{root}/more_users.csv", *raw, "--out", f"{root}/scores"]
    jobs.main(score, spark)
    first = spark.read.parquet(f"{root}/scores").collect()
    assert "987654321" in {r.user_id for r in first} and len({r.champion_run for r in first}) == 1
    other = jobs.main(["rollback", "--runs", f"{root}/runs", "--run", first[0].champion_run], spark)
    assert {other, first[0].champion_run} == {"shallow", "deep"}
    jobs.main(score, spark)
    assert {r.champion_run for r in spark.read.parquet(f"{root}/scores").collect()} == {other}

    assert {r.email for r in offers if r.user_id == "1"} == {"a@x.org"} and all("unknown" in r.email for r in offers if r.user_id != "1")

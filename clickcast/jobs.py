"""Jobs from the command line, for spark-submit or ``python -m clickcast.jobs``.

    ingest     message stream -> raw events, dead letters, topic dumps, live metrics, activity
    notify     message stream and labels -> live offers, counters and gauges of carts
    daily      landed raw events -> the daily report as JSON; with --state by day partials
    export     landed raw events -> flat CSV
    compact    landed raw events -> a table bucketed by customer; with --changed few files of the days with new ones
    features   landed raw events -> value features, scores and labels per user (CSV); with --state by day partials
    model      labels -> a fitted value model, its held-out metrics and feature importances; with --runs recorded among the runs
    score      labels, users and landed raw events -> labels of the other users by the champion of the recorded runs
    rollback   withdraws a recorded run; prints the champion that the remaining ones give
    baskets    landed raw events -> session baskets (CSV)
    rules      landed raw events -> frequent itemsets and association rules (Parquet)
    predict    landed raw events and rules -> items predicted per basket
    recommend  landed raw events, rules and products -> recommendations per actor
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import carts as CT
from .operators import compaction as CO
from .operators import ingest as IG
from .operators import model_runs as MR
from .operators import recommend as RC
from .operators import rules as RU
from .operators import sessions as SS
from .operators import sinks as SK
from .operators import value as V
from .operators import value_model as VM
from .plans import daily, features_by_day, incremental
from .schema import (ABANDON_MINUTES, ACTIVITY_WINDOW, MIN_CONFIDENCE, MIN_SUPPORT, NUM_BUCKETS, TEST_FRACTION, TOPICS, TRIGGER_INTERVAL,
                     USER_TOPIC, WATERMARK_DELAY)
from .session import get_session, materialize
from .sources import files
from .streaming import ingest as SI
from .streaming import notifier as SN


def message_source(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.brokers:
        return files.read_kafka(spark, a.brokers, ",".join(TOPICS), a.starting_offsets)
    return files.read_message_files(spark, a.messages, a.max_files)


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    def on(name: str) -> str | None:
        return None if name in a.without else f"{a.out}/{name}"

    cfg = SI.StreamConfig(
        raw_events_path=f"{a.out}/raw", checkpoint_dir=a.checkpoint or f"{a.out}/_checkpoints", trigger_interval=a.trigger, available_now=a.once,
        watermark_delay=a.watermark, window_duration=a.window, activity_path=on("activity"), dump_path=on("dumps"), metrics_path=on("metrics"),
        reject_path=on("rejected"))
    products = files.read_products_csv(spark, a.products) if a.products else None
    if products is not None:
        products = products.select(F.col("product_id").alias("id"), F.col("product_category").alias("category"), F.col("product_price").alias("price"))
    for q in SI.start_ingest(spark, message_source(spark, a), cfg, products):
        q.awaitTermination()


def run_notify(spark: SparkSession, a: argparse.Namespace) -> None:
    live = SI.validated_streams(SI.watermarked_events(message_source(spark, a), a.watermark))[USER_TOPIC]
    users = files.read_users_csv(spark, a.users)
    labels = spark.read.parquet(a.labels).select("user_id", "value_label")
    SN.start_notifier(live, lambda: labels, users, a.out, a.checkpoint or f"{a.out}/_checkpoints", a.minutes, a.trigger, a.once).awaitTermination()


def raw_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(IG.KEYED_COLUMNS)


def run_daily(spark: SparkSession, a: argparse.Namespace) -> str:
    """With ``--state`` the days from ``--first`` to ``--as-of`` alone are read, and the report comes from
    the partials of all days run so far."""
    ev = raw_events(spark, a.raw)
    if not a.state:
        parts = IG.topic_split(ev)
        return daily.generate_report(*(parts[t] for t in TOPICS), a.out, as_of_date=a.as_of)
    if not (a.first or a.as_of):
        raise SystemExit("daily: --state needs --as-of, the day to run, or --first")
    last = a.as_of or str(ev.agg(F.max("event_date")).first()[0])
    incremental.update_days(ev, a.state, a.first or last, last)
    return incremental.write_report(spark, a.state, a.out, a.as_of)


def run_export(spark: SparkSession, a: argparse.Namespace) -> int:
    """Writes the export and returns its number of rows, counted while they are written."""
    ev = raw_events(spark, a.raw).withColumn("timestamp", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    seen = Observation("export")
    SK.flat_event_export(ev.observe(seen, F.count(F.lit(1)).alias("rows")), a.out)
    return seen.get["rows"]


def user_topic(spark: SparkSession, path: str) -> DataFrame:
    return IG.topic_split(raw_events(spark, path))[USER_TOPIC]


def run_features(spark: SparkSession, a: argparse.Namespace) -> None:
    """With ``--state`` the days from ``--first`` to ``--last`` alone are read, and the features come from the
    partials of all days run so far."""
    ev = raw_events(spark, a.raw)
    if a.state:
        if not a.first:
            raise SystemExit("--state needs --first, the first day to run")
        features_by_day.update_days(ev, a.state, a.first, a.last)
    labeled = materialize(features_by_day.customer_value(spark, a.state) if a.state else V.customer_value(ev))
    SK.write_csv(labeled, f"{a.out}/csv")
    labeled.write.mode("overwrite").parquet(f"{a.out}/parquet")


def run_model(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Fits on the labels that ``features`` wrote; returns the held-out metrics."""
    model, held_out = VM.train_value_model(spark.read.parquet(a.labels), num_trees=a.trees, max_depth=a.depth)
    model.write().overwrite().save(f"{a.out}/model")
    metrics = materialize(VM.classification_metrics(held_out))
    if a.runs:
        MR.record(spark, a.runs, a.name, model, metrics.first()["macro_f1"], f"trees={a.trees} depth={a.depth}", a.run)
    metrics.write.mode("overwrite").json(f"{a.out}/metrics")
    VM.feature_importance(model).write.mode("overwrite").json(f"{a.out}/importance")
    return metrics.first().asDict()


def run_score(spark: SparkSession, a: argparse.Namespace) -> None:
    labels, users = spark.read.parquet(a.labels), files.read_users_csv(spark, a.users)
    MR.score_by_champion(users, labels, CT.cart_contents(user_topic(spark, a.raw)), a.runs, a.name).write.mode("overwrite").parquet(a.out)


def run_rollback(spark: SparkSession, a: argparse.Namespace) -> str | None:
    """Returns the run that is champion now, None if there is none."""
    MR.withdraw(spark, a.runs, a.run)
    try:
        now = MR.champion(spark, a.runs, a.name)[0]
    except LookupError:
        now = None
    print(f"champion of {a.name}: {now}")
    return now


def run_baskets(spark: SparkSession, a: argparse.Namespace) -> None:
    SK.write_csv(SS.session_baskets(user_topic(spark, a.raw)), a.out)


def run_rules(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rules of the training baskets, as ``a.test`` of all baskets are held out."""
    split = RU.basket_split(materialize(SS.mining_baskets(user_topic(spark, a.raw))), test_fraction=a.test)
    itemsets = materialize(RU.frequent_itemsets(split.filter("split = 'train'"), min_support=a.support))
    itemsets.write.mode("overwrite").parquet(f"{a.out}/itemsets")
    RU.association_rules(itemsets, a.confidence).write.mode("overwrite").parquet(f"{a.out}/rules")
    split.write.mode("overwrite").parquet(f"{a.out}/baskets")


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rules"), spark.read.parquet(f"{path}/itemsets")


def run_predict(spark: SparkSession, a: argparse.Namespace) -> None:
    rules, itemsets = read_rules(spark, a.rules)
    held_out = spark.read.parquet(f"{a.rules}/baskets").filter("split = 'test'")
    RU.basket_predictions(held_out, rules, itemsets).write.mode("overwrite").parquet(a.out)


def run_recommend(spark: SparkSession, a: argparse.Namespace) -> None:
    rules, itemsets = read_rules(spark, a.rules)
    RC.recommend_for_all(user_topic(spark, a.raw), spark.read.parquet(a.products), rules, itemsets).write.mode("overwrite").parquet(a.out)


def run_compact(spark: SparkSession, a: argparse.Namespace) -> list[tuple[str, str]] | None:
    """With ``--changed`` returns the days that were rewritten."""
    if a.changed:
        return CO.compact(spark, a.raw, a.out, a.target_mb << 20)
    SK.bucketed_compaction(spark, raw_events(spark, a.raw), a.table, a.buckets, a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clickcast.jobs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--master", help="left to spark-submit if not given")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, *needed: str) -> argparse.ArgumentParser:
        s = jobs.add_parser(name)
        for n in (*needed, "out"):
            s.add_argument(f"--{n}", required=True)
        return s

    for name, needed in (("ingest", ()), ("notify", ("labels", "users"))):
        s = job(name, *needed)
        s.add_argument("--brokers", help="Kafka brokers; else --messages")
        s.add_argument("--starting-offsets", default="latest", help="of a first run: latest, earliest, or JSON")
        s.add_argument("--messages", help="folder of (topic, value) parquet files")
        s.add_argument("--max-files", type=int, help="files of --messages per batch")
        s.add_argument("--checkpoint", help="default: below --out")
        s.add_argument("--watermark", default=WATERMARK_DELAY)
        s.add_argument("--trigger", default=TRIGGER_INTERVAL)
        s.add_argument("--once", action="store_true", help="take what is there, then end")
        if name == "ingest":
            s.add_argument("--products", help="product CSV: adds category and price to the events")
            s.add_argument("--window", default=ACTIVITY_WINDOW, help="of the activity")
            s.add_argument("--without", nargs="*", default=[], choices=["activity", "dumps", "metrics", "rejected"])
        else:
            s.add_argument("--minutes", type=int, default=ABANDON_MINUTES)
    s = job("daily", "raw")
    s.add_argument("--as-of")
    s.add_argument("--state", help="folder of day partials: read the days to run alone")
    s.add_argument("--first", help="with --state: first day to run, default --as-of")
    job("export", "raw")
    s = job("compact", "raw")
    s.add_argument("--table", default="customer_events")
    s.add_argument("--buckets", type=int, default=NUM_BUCKETS)
    s.add_argument("--changed", action="store_true")
    s.add_argument("--target-mb", type=int, default=128, help="with --changed: megabytes of a file, about")
    s = job("features", "raw")
    s.add_argument("--state", help="folder of day partials")
    s.add_argument("--first", help="with --state: first day to run")
    s.add_argument("--last", help="with --state: last day to run, default --first")
    s = job("model", "labels")
    s.add_argument("--trees", type=int, default=VM.N_TREES)
    s.add_argument("--depth", type=int, default=VM.MAX_DEPTH)
    s.add_argument("--runs", help="folder of recorded runs")
    s.add_argument("--run", help="with --runs: id of this run")
    s.add_argument("--name", default="customer_value", help="with --runs: name of the model")
    s = job("score", "runs", "labels", "users", "raw")
    s.add_argument("--name", default="customer_value")
    s = jobs.add_parser("rollback")
    for n in ("runs", "run"):
        s.add_argument(f"--{n}", required=True)
    s.add_argument("--name", default="customer_value")
    job("baskets", "raw")
    s = job("rules", "raw")
    s.add_argument("--support", type=float, default=MIN_SUPPORT)
    s.add_argument("--confidence", type=float, default=MIN_CONFIDENCE)
    s.add_argument("--test", type=float, default=TEST_FRACTION)
    job("predict", "rules")
    job("recommend", "raw", "rules", "products")
    return p


RUN = {"ingest": run_ingest, "notify": run_notify, "daily": run_daily, "export": run_export, "compact": run_compact, "features": run_features,
       "model": run_model, "score": run_score, "rollback": run_rollback, "baskets": run_baskets, "rules": run_rules, "predict": run_predict, "recommend": run_recommend}


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    return RUN[args.job](spark or get_session(args.master, f"clickcast-{args.job}"), args)


if __name__ == "__main__":
    main()

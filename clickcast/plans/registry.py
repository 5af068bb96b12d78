"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each callable reads the driver tables (through the canonical views) and returns the
operator's result over the whole input; column names match the DuckDB oracle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import activity as AC
from ..operators import analytics as A
from ..operators import carts as CT
from ..operators import compaction as CO
from ..operators import catalog as CG
from ..operators import champion as CH
from ..operators import enrich as EN
from ..operators import ingest as IG
from ..operators import model_runs as MR
from ..operators import recommend as RC
from ..operators import report as RP
from ..operators import rules as RU
from ..operators import sessions as SS
from ..operators import sinks as SK
from ..operators import title_index as TI
from ..operators import value as V
from ..operators import value_model as VM
from ..schema import RECENT_INTERACTIONS, RECOMMEND_LIMIT, TOPICS, USER_TOPIC
from ..session import materialize, shared_dir
from ..sources import files as FS
from ..sources.files import read_message_files
from ..sources.tables import brand_baskets, shop_categories, shop_events, shop_products, shop_users, unclean_events
from ..streaming import carts as SCT
from ..streaming import ingest as SI
from ..streaming import metrics as SM
from ..streaming import notifier as SNT
from . import features_by_day as FD
from . import incremental as INC
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _ue(fn):
    return lambda s, d: fn(I.user_events(s, d))


# --- daily analytics -----------------------------------------------------------------
for _name in ["total_registered_customers", "total_anonymous_visitors", "total_customers",
              "total_events", "total_views", "total_add_to_cart", "total_purchases",
              "total_refunds", "events_by_type", "top_viewed_products", "top_cart_products",
              "top_purchased_products", "most_active_users", "most_active_visitors"]:
    QUERIES[_name] = _ue(getattr(A, _name))

QUERIES["recommendations_generated"] = lambda s, d: A.recommendations_generated(I.recommendation_events(s, d))
QUERIES["recommendation_event_counts"] = lambda s, d: A.recommendation_event_counts(I.recommendation_events(s, d))
QUERIES["notifications_generated"] = lambda s, d: A.notifications_generated(I.notification_events(s, d))
QUERIES["notification_counts"] = lambda s, d: A.notification_counts(I.notification_events(s, d))


@query("daily_summary")
def _daily_summary(s, d):
    return A.daily_summary_one_scan(I.all_validated(s, d))


def _incremental(s, d):
    """Folder of day partials made by three runs over a partitioned table of events: a backfill, the last
    day alone, and a day in the middle a second time, as after late events."""
    raw, state = scratch(s, "events_by_day"), scratch(s, "daily_state")
    SK.write_raw_events(I.all_validated(s, d), raw, mode="overwrite")
    ev = s.read.parquet(raw)
    lo, hi = ev.agg(F.min("event_date"), F.max("event_date")).first()
    half = lo + (hi - lo) / 2
    INC.update_days(ev.filter("id % 10 < 9"), state, lo, half)
    INC.update_days(ev, state, half, hi)
    INC.update_days(ev, state, lo, half)
    return state


@query("daily_summary_incremental")
def _daily_summary_incremental(s, d):
    return INC.summary(s, _incremental(s, d))


@query("most_active_incremental")
def _most_active_incremental(s, d):
    r = INC.report(s, _incremental(s, d))
    return r["most_active_users"]


@query("customer_value_features_incremental")
def _features_incremental(s, d):
    """Features from day partials: a first half that lacks a tenth of its events, the second half, then the
    first half again with its late events."""
    raw, state = scratch(s, "events_by_day"), scratch(s, "feature_state")
    SK.write_raw_events(I.all_validated(s, d), raw, mode="overwrite")
    ev = s.read.parquet(raw)
    lo, hi = ev.agg(F.min("event_date"), F.max("event_date")).first()
    half = lo + (hi - lo) / 2
    FD.update_days(ev.filter("id % 10 < 9"), state, lo, half)
    FD.update_days(ev, state, half, hi)
    FD.update_days(ev, state, lo, half)
    return _round_features(FD.customer_value_features(s, state))


@query("incremental_compaction")
def _incremental_compaction(s, d):
    """Events landed in two parts, compacted after each: the second run writes the days of the second part."""
    raw, out = scratch(s, "events_by_day"), scratch(s, "compacted")
    ev = I.landed(s, d)
    SK.write_raw_events(ev.filter("id % 3 > 0"), raw)
    CO.compact(s, raw, out)
    SK.write_raw_events(ev.filter("not coalesce(id % 3 > 0, false)"), raw)
    CO.compact(s, raw, out)
    return s.read.parquet(f"{out}/data").select(KEYED)


# --- ingest: decode, key, validate -------------------------------------------------------


KEYED = IG.KEYED_COLUMNS


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for a written intermediate."""
    return shared_dir(spark, f"scratch/{name}-{uuid.uuid4().hex[:12]}")


def _stacked(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """The parts one below the other, with their keys in column ``name``."""
    frames = [df.select(*[c for c in df.columns if c != "batch"], F.lit(k).alias(name)) for k, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


@query("kafka_rows")
def _kafka_rows(s, d):
    return IG.to_kafka_rows(shop_events(s, d))


@query("decode_events")
def _decode_events(s, d):
    return IG.key_events(IG.decode_events(IG.to_kafka_rows(shop_events(s, d)))).select(KEYED)


@query("event_time_date")
def _event_time_date(s, d):
    dec = IG.decode_events(IG.to_kafka_rows(shop_events(s, d)))
    return dec.select("id", IG.parse_event_time("timestamp").alias("event_time"),
                      F.to_date(IG.parse_event_time("timestamp")).alias("event_date"))


@query("customer_key")
def _customer_key(s, d):
    e = shop_events(s, d)
    return e.select("id", IG.customer_key().alias("customer_key"), IG.id_type().alias("id_type"))


@query("drop_unkeyed")
def _drop_unkeyed(s, d):
    return IG.key_events(unclean_events(s, d)).select(KEYED)


@query("topic_split")
def _topic_split(s, d):
    return _stacked(IG.topic_split(I.keyed_events(s, d)), "part")


@query("validate_common")
def _validate_common(s, d):
    return IG.known_events(IG.key_events(unclean_events(s, d))).select(KEYED)


@query("validate_user_events")
def _vu(s, d):
    return I.user_events(s, d).select(KEYED)


@query("validate_recommendation_events")
def _vr(s, d):
    return I.recommendation_events(s, d).select(KEYED)


@query("validate_notification_events")
def _vn(s, d):
    return I.notification_events(s, d).select(KEYED)


@query("reject_reasons")
def _reject_reasons(s, d):
    return IG.reject_reasons(IG.key_events(unclean_events(s, d)))


@query("topic_type_match")
def _topic_type_match(s, d):
    return IG.topic_type_match(IG.key_events(unclean_events(s, d))).select(KEYED)


@query("union_validated")
def _union_validated(s, d):
    return I.all_validated(s, d).select(KEYED)


@query("unclean_validated")
def _unclean_validated(s, d):
    """Validation over events with every fault: rows that must go do go."""
    return IG.validate_all(IG.key_events(unclean_events(s, d))).select(KEYED)


@query("malformed_messages")
def _malformed_messages(s, d):
    """Messages of unclean events, a share of them cut short: those decode to no event."""
    m = IG.to_kafka_rows(unclean_events(s, d))
    return IG.validate_all(IG.key_events(IG.decode_events(m.unionByName(_broken_messages(s, d))))).select(KEYED)


def _broken_messages(s, d):
    return IG.to_kafka_rows(shop_events(s, d).filter("id % 10 = 3")).select("topic", F.expr("left(value, 30)").alias("value"))


@query("enrich_with_products")
def _enrich(s, d):
    return EN.enrich_with_products(I.all_validated(s, d), shop_products(s, d)).select(
        "id", "topic", "product_id", "product_category", "product_price")


# --- sources and sinks round trips -----------------------------------------------------------
@query("products_csv_scan")
def _products_csv(s, d):
    path = scratch(s, "products_csv")
    p = shop_products(s, d)
    given = {"id": F.col("id"), "name": F.col("title"), "category": F.col("category"), "price": F.col("price")}
    p.select(*[given.get(c, F.lit(f"{c}, text")).alias(c) for c in FS.GENERATED_PRODUCTS]).write.option("header", True).csv(path)
    return FS.read_products_csv(s, path)


@query("parquet_scan")
def _parquet_scan(s, d):
    path = scratch(s, "raw_events")
    SK.write_raw_events(I.user_events(s, d), path, mode="overwrite")
    back = s.read.parquet(path)
    return back.select(KEYED)


@query("raw_events_sink")
def _raw_events_sink(s, d):
    path = scratch(s, "raw_events_pruned")
    SK.write_raw_events(I.all_validated(s, d), path, mode="overwrite")
    back = s.read.parquet(path)
    return back.select(KEYED)


@query("scan_or_empty")
def _scan_or_empty(s, d):
    present = scratch(s, "present")
    I.notification_events(s, d).select(KEYED).write.parquet(present)
    schema = s.read.parquet(present).schema
    missing = SK.read_parquet_or_empty(s, scratch(s, "missing"), schema)
    return SK.read_parquet_or_empty(s, present, schema).unionByName(missing).select(KEYED)


@query("events_csv_scan")
def _events_csv_scan(s, d):
    path = scratch(s, "events_csv")
    exp = I.user_events(s, d).withColumn(
        "timestamp", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    SK.flat_event_export(exp, path)
    return FS.read_events_csv(s, path)


@query("flat_event_export")
def _flat_event_export(s, d):
    path = scratch(s, "export")
    exp = I.user_events(s, d).withColumn(
        "timestamp", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    SK.flat_event_export(exp, path)
    return s.read.option("header", True).csv(path)


@query("bucketed_compaction")
def _bucketed(s, d):
    name = f"customer_events_bucketed_{uuid.uuid4().hex[:8]}"
    path = scratch(s, name)
    SK.bucketed_compaction(s, I.all_validated(s, d).select(KEYED), name, path=path)
    s.sql(f"drop table {name}")  # an external table: its files stay
    return s.read.parquet(path).select(KEYED)


@query("topic_dump_sink")
def _topic_dump(s, d):
    root = scratch(s, "dumps")
    for t, df in I.landed_branches(s, d).items():
        df.select(KEYED).write.parquet(f"{root}/{SI.DUMP_NAMES[t]}")
    return _stacked({n: s.read.parquet(f"{root}/{n}") for n in SI.DUMP_NAMES.values()}, "dump")


@query("seed_csv_load")
def _seed_csv(s, d):
    path = scratch(s, "users_csv")
    given = {"is_deleted": F.when(F.col("is_deleted"), " true").otherwise(" false")}
    given |= {c: F.col(c) for c in ("id", "first_name", "email", "region", "country")}
    u = shop_users(s, d).select(*[given.get(c, F.lit(f"a {c}")).alias(c) for c in FS.SEED_USERS])
    u.write.option("header", True).csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return FS.read_users_csv(s, path).filter(~F.col("is_deleted")).select("id", "email", "country")


@query("seed_events_scan")
def _seed_events(s, d):
    """The event seed's own layout: ids, no sessions, yes/no flags."""
    path = scratch(s, "seed_events")
    e = shop_events(s, d).withColumn("timestamp", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).withColumn(
        "is_recommended", F.when(F.col("is_recommended"), "yes").otherwise("no"))
    e.select(FS.SEED_EVENTS).write.option("header", True).csv(path)
    return FS.read_seed_events(s, path).drop("session_id")


@query("active_users_only")
def _active_users(s, d):
    return shop_users(s, d).filter(~F.col("is_deleted")).select("id", "email")


# --- sessions and customer value ------------------------------------------------------------


def r6(c):
    return F.round(F.col(c), 6).alias(c)


@query("session_basket")
def _session_basket(s, d):
    b = SS.session_baskets(I.user_events(s, d))
    return b.select("user_id", "session_id", "event_type", "has_transaction",
                    F.array_join("cart_product_id_list", ",").alias("cart_products"),
                    "total_cart_items", "total_session_events", "first_timestamp", "last_timestamp")


@query("logged_in_only")
def _logged_in_only(s, d):
    return SS.logged_in_only(I.all_validated(s, d)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"))


@query("derive_session_id")
def _derive_session_id(s, d):
    ev = SS.logged_in_only(I.user_events(s, d)).drop("session_id")
    return SS.derive_session_id(ev).select("id", "session_id")


@query("recover_user_from_session")
def _recover_user(s, d):
    # the CSV hop loses the user id of every row; it comes back from the session id
    ev = I.user_events(s, d).withColumn("user_id", F.lit(None).cast("string"))
    return SS.recover_user(ev).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


@query("normalise_product_id")
def _normalise_product_id(s, d):
    # a float-typed product column (as pandas reads it) prints as '69.0'
    ev = I.user_events(s, d).withColumn("product_id", F.col("product_id").cast("double").cast("string"))
    return ev.select("id", X.normalise_product_id("product_id").alias("product_id"))


@query("parse_basket")
def _parse_basket(s, d):
    b = SS.session_baskets(I.user_events(s, d)).filter(F.col("total_cart_items") > 0)
    # half the baskets as JSON text, half in a loose python-list style
    loose = F.concat(F.lit("["), F.array_join(F.transform("cart_product_id_list",
                                                          lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                     F.lit("]"))
    text = F.when(F.length("session_id") % 2 == 0, F.to_json("cart_product_id_list")).otherwise(loose)
    parsed = b.select("session_id", "user_id", X.parse_basket(text).alias("items"))
    return parsed.select("session_id", "user_id", F.array_join("items", ",").alias("items"))


def _value_events(s, d):
    return I.landed(s, d)


@query("customer_counts")
def _customer_counts(s, d):
    return V.customer_counts(_value_events(s, d)).drop("last_transaction_time")


@query("abandoned_cart_sessions")
def _abandoned_sessions(s, d):
    return V.abandoned_cart_sessions(_value_events(s, d))


@query("feature_left_merge")
def _feature_left_merge(s, d):
    ev = _value_events(s, d)
    c = V.customer_counts(ev).select("user_id", "total_events")
    a = V.abandoned_cart_sessions(ev)
    return (c.join(a, "user_id", "left")
             .select("user_id", F.coalesce("abandoned_cart_sessions", F.lit(0).cast("bigint"))
                     .alias("abandoned_cart_sessions")))


@query("last_tx_align")
def _last_tx_align(s, d):
    return V.customer_value_features(_value_events(s, d)).select("user_id", "days_since_last_tx")


_FEATURE_DOUBLES = ["conversion_rate", "removal_rate", "cart_abandon_rate", "recommendation_ctr",
                    "events_per_day"]


def _round_features(df):
    return df.select(*[r6(c) if c in _FEATURE_DOUBLES + ["value_score"] else F.col(c) for c in df.columns])


@query("customer_value_features")
def _features(s, d):
    return _round_features(V.customer_value_features(_value_events(s, d)))


@query("customer_value_score")
def _score(s, d):
    return V.value_score(V.customer_value_features(_value_events(s, d))).select("user_id", r6("value_score"))


@query("customer_value_label")
def _label(s, d):
    return V.customer_value(_value_events(s, d)).select("user_id", r6("value_score"), "value_label")


@query("pct_rank_average")
def _pct_rank(s, d):
    sc = V.value_score(V.customer_value_features(_value_events(s, d))).select("user_id", "value_score")
    return V.pct_rank_average(sc, "value_score", "pct_rank").select("user_id", r6("pct_rank"))


@query("value_label_summary")
def _label_summary(s, d):
    lab = V.customer_value(_value_events(s, d))
    return lab.groupBy("value_label").agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.min("value_score"), 6).alias("min_score"),
        F.round(F.max("value_score"), 6).alias("max_score"))


# --- itemsets, rules, predictions -------------------------------------------------------------


def _join(c, out=None):
    return F.array_join(c, ",").alias(out or c)


def _itemsets_out(fi):
    return fi.select(_join("items"), F.col("size").cast("bigint").alias("size"), "freq", r6("support"))


def _rules_out(r):
    return r.select(_join("antecedents"), _join("consequents"), r6("antecedent_support"),
                    r6("consequent_support"), r6("support"), r6("confidence"), r6("lift"),
                    r6("leverage"), r6("conviction"))


def session_mining_baskets(s, d):
    """Read by the itemsets and by every match, so validated and built once."""
    return materialize(SS.mining_baskets(I.user_events(s, d)))


@query("basket_split")
def _basket_split(s, d):
    return RU.basket_split(brand_baskets(s, d)).groupBy("split").agg(F.count(F.lit(1)).alias("baskets"))


@query("frequent_itemsets")
def _frequent_itemsets(s, d):
    return _itemsets_out(RU.frequent_itemsets(brand_baskets(s, d)))


@query("association_rules")
def _association_rules(s, d):
    return _rules_out(RU.association_rules(RU.frequent_itemsets(brand_baskets(s, d))))


@query("session_itemsets")
def _session_itemsets(s, d):
    return _itemsets_out(RU.frequent_itemsets(session_mining_baskets(s, d)))


@query("session_rules")
def _session_rules_query(s, d):
    return _rules_out(RU.association_rules(RU.frequent_itemsets(session_mining_baskets(s, d))))


def _session_predictions(s, d):
    b = session_mining_baskets(s, d)
    fi = RU.frequent_itemsets(b)
    return RU.basket_predictions(b, RU.association_rules(fi), fi)


@query("basket_predictions")
def _basket_predictions(s, d):
    p = _session_predictions(s, d)
    return p.groupBy("basket_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), ",").alias("predicted_items"))


@query("top_n_per_basket")
def _top_n(s, d):
    return _session_predictions(s, d).select("basket_id", "item", "rank")


@query("rule_subset_join")
def _rule_subset_join(s, d):
    b = session_mining_baskets(s, d)
    fi = RU.frequent_itemsets(b)
    m = RU.matching_rules(b, RU.rule_keys(RU.association_rules(fi), fi))
    return m.groupBy("basket_id").agg(F.count(F.lit(1)).alias("matched_rules"))


@query("rule_summary")
def _rule_summary(s, d):
    sp = RU.basket_split(brand_baskets(s, d))
    train = sp.filter(F.col("split") == "train")
    fi = RU.frequent_itemsets(train)
    rs = RU.rule_summary(fi, RU.association_rules(fi), sp)
    return rs.select("frequent_itemsets_count", "association_rules_count", r6("avg_lift"),
                     r6("avg_confidence"), r6("avg_support"), "train_transactions", "test_transactions")


HELD_OUT_SUPPORT = 0.005  # keeps some of the brand triples


def _train_rules(s, d):
    """Rules of the training baskets at a selective floor, their itemsets, and the other baskets."""
    sp = materialize(RU.basket_split(brand_baskets(s, d)))
    fi = RU.frequent_itemsets(sp.filter("split = 'train'"), min_support=HELD_OUT_SUPPORT)
    return RU.association_rules(fi), fi, sp.filter("split = 'test'")


@query("train_split_rules")
def _train_split_rules(s, d):
    return _rules_out(_train_rules(s, d)[0])


@query("heldout_predictions")
def _heldout_predictions(s, d):
    """Predictions for baskets that the rules were not made from."""
    rules, fi, test = _train_rules(s, d)
    return RU.basket_predictions(test, rules, fi).select("basket_id", "item", "rank")


@query("rules_sink")
def _rules_sink(s, d):
    path = scratch(s, "rules")
    rules = RU.association_rules(RU.frequent_itemsets(brand_baskets(s, d)))
    rules.orderBy(F.desc("lift")).write.parquet(path)
    return _rules_out(s.read.parquet(path))


# --- recommendations ----------------------------------------------------------------------------


def _session_rules(s, d):
    fi = RU.frequent_itemsets(session_mining_baskets(s, d))
    return RU.association_rules(fi), fi


def _seeds(s, d):
    return RC.recent_interactions(I.user_events(s, d))


@query("recent_interactions")
def _recent(s, d):
    return _seeds(s, d)


@query("recommend_for_users")
def _recommend(s, d):
    rules, fi = _session_rules(s, d)
    r = RC.recommend_for_all(I.user_events(s, d), shop_products(s, d), rules, fi)
    return r.select("actor", "id_type", "product_id", F.col("stage").cast("bigint").alias("stage"), "rank")


def _requests(ue):
    """The request table of the registered queries: actors whose number modulo 20 is 0 (visitors) or
    1 (users)."""
    return ue.filter("try_cast(regexp_extract(customer_key, '[0-9]+$', 0) as bigint) % 20 < 2").select(F.col("customer_key").alias("actor"), "id_type").distinct()


@query("co_occurrence")
def _co_occurrence(s, d):
    ue = I.landed_branches(s, d)[USER_TOPIC]
    return RC.co_occurrence(ue, _requests(ue))


@query("recommend_for_requests")
def _recommend_requests(s, d):
    ue = I.landed_branches(s, d)[USER_TOPIC]
    fi = RU.frequent_itemsets(SS.mining_baskets(ue))
    r = RC.recommend_for_requests(ue, _requests(ue), shop_products(s, d), RU.association_rules(fi), fi)
    return r.select("actor", "id_type", "product_id", F.col("stage").cast("bigint").alias("stage"), "rank")


@query("rule_stage_recommendations")
def _rule_stage(s, d):
    rules, fi = _session_rules(s, d)
    r = RC.rule_stage(_seeds(s, d), rules, fi, shop_products(s, d))
    return r.select("actor", "id_type", "product_id", F.col("pos").cast("bigint").alias("pos"))


_DEPTH = RECOMMEND_LIMIT + RECENT_INTERACTIONS + RECOMMEND_LIMIT


@query("category_popularity")
def _category_popularity(s, d):
    st = RC.category_stage(_seeds(s, d), shop_products(s, d), _DEPTH)
    return st.filter(F.col("pos") <= RECOMMEND_LIMIT).select(
        "actor", "id_type", "product_id", F.col("pos").cast("bigint").alias("pos"))


@query("global_popularity")
def _global_popularity(s, d):
    seeds = _seeds(s, d)
    st = RC.global_stage(seeds.select("actor", "id_type").distinct(), seeds, shop_products(s, d), _DEPTH)
    return st.filter(F.col("pos") <= RECOMMEND_LIMIT).select(
        "actor", "id_type", "product_id", F.col("pos").cast("bigint").alias("pos"))


@query("exclude_seen_anti")
def _exclude_seen(s, d):
    """Category suggestions without the actor's seeds and without products an earlier
    (rule) stage already chose, re-ranked, first ``limit``."""
    seeds = _seeds(s, d)
    rules, fi = _session_rules(s, d)
    chosen = RC.rule_stage(seeds, rules, fi, shop_products(s, d))
    st = RC.category_stage(seeds, shop_products(s, d), _DEPTH)
    st = st.join(chosen.select("actor", "id_type", "product_id"), ["actor", "id_type", "product_id"], "left_anti")
    w = Window.partitionBy("actor", "id_type").orderBy("pos")
    return (st.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= RECOMMEND_LIMIT)
              .select("actor", "id_type", "product_id", F.col("pos").cast("bigint").alias("pos")))


@query("exclude_current_product")
def _exclude_current(s, d):
    """Same-category suggestions next to the product an actor is looking at (its most
    recent one), without that product itself."""
    cur = _seeds(s, d).filter(F.col("pos") == 1).select("actor", "id_type", "product_id")
    sug = RC.category_stage(cur, shop_products(s, d), RECOMMEND_LIMIT + 1)
    return (RC.exclude_current_product(sug, cur).filter(F.col("pos") <= RECOMMEND_LIMIT)
              .select("actor", "id_type", "product_id", F.col("pos").cast("bigint").alias("pos")))


# --- daily report, carts and offers, catalogue, champion, activity -----------------------------

_REPORT_DOUBLES = ["total_revenue", "recommended_revenue", "recommender_ctr", "recommender_conversion"]


def _report(s, d):
    return RP.daily_report(I.user_events(s, d), shop_products(s, d))


def _report_out(r):
    return r.select("date", *[r6(c) for c in _REPORT_DOUBLES], "total_orders")


@query("daily_report")
def _daily_report(s, d):
    return _report_out(_report(s, d))


@query("recent_reports")
def _recent_reports(s, d):
    return _report_out(RP.recent_reports(_report(s, d), 30))


@query("insert_if_absent")
def _insert_if_absent(s, d):
    """A report table first built two weeks into the data, then topped up from all events:
    only dates not yet present are appended."""
    ue = I.user_events(s, d)
    cutoff = F.date_add(ue.agg(F.min("event_date")).scalar(), 14)
    path = scratch(s, "daily_reports")
    RP.daily_report(ue.filter(F.col("event_date") <= cutoff), shop_products(s, d)).write.parquet(path)
    existing = s.read.parquet(path)
    SK.insert_if_absent(_report(s, d), existing, "date").write.mode("append").parquet(path)
    return _report_out(s.read.parquet(path))


@query("revenue_join")
def _revenue_join(s, d):
    tx = I.user_events(s, d).filter(F.col("event_type") == "transaction").select("id", "product_id")
    p = shop_products(s, d).select(F.col("id").cast("string").alias("product_id"), "price")
    return tx.join(p, "product_id").select("id", "product_id", "price")


@query("abandoned_carts_batch")
def _abandoned_carts(s, d):
    return CT.abandoned_carts(I.landed_branches(s, d)[USER_TOPIC])


def _abandoned_and_labels(s, d):
    """Both sides of an offer from one validated table."""
    ev = I.landed(s, d)
    return CT.abandoned_carts(IG.topic_split(ev)[USER_TOPIC]), V.customer_value(ev).select("user_id", "value_label")


@query("cart_contents")
def _cart_contents(s, d):
    return CT.cart_contents(I.landed_branches(s, d)[USER_TOPIC])


@query("cart_product_join")
def _cart_product_join(s, d):
    return CT.cart_with_products(_cart_contents(s, d), shop_products(s, d)).select(
        "user_id", "product_id", "title", "price", "quantity")


@query("cart_totals")
def _cart_totals(s, d):
    return CT.cart_totals(CT.cart_with_products(_cart_contents(s, d), shop_products(s, d)))


@query("score_lookup")
def _score_lookup(s, d):
    abandoned, labels = _abandoned_and_labels(s, d)
    return abandoned.join(labels, "user_id", "left").select("user_id", "episode", "value_label")


@query("email_lookup")
def _email_lookup(s, d):
    ids = CT.abandoned_carts(I.landed_branches(s, d)[USER_TOPIC]).select("user_id").distinct()
    return CT.with_email(ids, shop_users(s, d))


@query("discount_offers")
def _discount_offers(s, d):
    abandoned, labels = _abandoned_and_labels(s, d)
    return CT.discount_offers(abandoned, labels, shop_users(s, d))


@query("notifier_counters")
def _notifier_counters(s, d):
    ue = I.landed_branches(s, d)[USER_TOPIC]
    return CT.notifier_counters(ue, CT.abandoned_carts(ue), CT.cart_contents(ue))


@query("product_search")
def _product_search(s, d):
    return CG.product_search(shop_products(s, d), "RED", page=2, limit=20).select(
        "id", "title", "category", "price", "total", "pages")


@query("product_search_indexed")
def _product_search_indexed(s, d):
    """Two pages of a frequent term, the second by the last id of the first, and whole short, longer
    and missing terms, from the postings."""
    path, products = scratch(s, "title-index"), shop_products(s, d)
    TI.write_title_index(products, path)
    postings = TI.read_title_index(s, path)
    first = materialize(TI.indexed_search(postings, products, "RED", limit=20))
    second = TI.indexed_search(postings, products, "RED", after=first.agg(F.max("id")).scalar(), limit=20)
    parts = [("first", first), ("second", second), *((t, TI.indexed_search(postings, products, t, limit=100)) for t in ("b", "Lu", "een l", "%ss%u%", "no such title"))]
    pages = [p.select(F.lit(n).alias("page"), "id", "title", "price", "total") for n, p in parts]
    return reduce(DataFrame.unionByName, pages)


@query("products_in_category")
def _products_in_category(s, d):
    p = shop_products(s, d)
    first_cat = p.orderBy("id").limit(1).select("category").scalar()
    return CG.products_in_category(p, first_cat, page=1, limit=20).select(
        "id", "title", "category", "price", "total", "pages")


@query("categories_sorted")
def _categories_sorted(s, d):
    return CG.categories_sorted(shop_categories(s, d))


@query("product_category_join")
def _product_category_join(s, d):
    return EN.product_with_category(shop_products(s, d), shop_categories(s, d)).select(
        "id", "title", "category_id", "category_name")


def _runs(s, d):
    r = _report(s, d)
    return r.unpivot(["date"], ["total_revenue", "recommender_ctr", "recommender_conversion"],
                     "model_name", "metric").select(
        "model_name", F.col("date").cast("string").alias("run_id"), F.col("date").alias("run_time"), "metric")


@query("champion_history")
def _champion_history(s, d):
    h = CH.champion_history(_runs(s, d))
    return h.select("model_name", "run_id", r6("metric"), "promoted", "champion_run")


@query("champion_selection")
def _champion_selection(s, d):
    return CH.current_champions(CH.champion_history(_runs(s, d)))


@query("customer_activity_batch")
def _activity(s, d):
    return AC.customer_activity(I.all_validated(s, d))


# --- streaming -----------------------------------------------------------------------------------

FILES_PER_TRIGGER = 10
CART_WATERMARK = "3 days"


def _message_stream(s, d):
    root = scratch(s, "stream")
    SI.write_message_files(shop_events(s, d), f"{root}/messages")
    return root, read_message_files(s, f"{root}/messages", max_files_per_trigger=FILES_PER_TRIGGER)


def _run(df, root, name, mode="append"):
    q = (df.writeStream.format("parquet").option("path", f"{root}/{name}")
         .option("checkpointLocation", f"{root}/_ck_{name}").outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _cart_stream(s, d):
    """Validated user events from files that overlap in time, in shuffled order, under a watermark that
    covers the disorder."""
    root = scratch(s, "stream")
    SI.write_message_files(shop_events(s, d), f"{root}/messages", shuffled=True)
    raw = read_message_files(s, f"{root}/messages", max_files_per_trigger=10)
    return root, SI.validated_streams(SI.watermarked_events(raw, CART_WATERMARK))[USER_TOPIC]


@query("abandoned_carts_stream")
def _abandoned_stream(s, d):
    """The abandonments known when the last watermark is reached."""
    root, events = _cart_stream(s, d)
    _run(SCT.with_ntz(SCT.abandoned_carts_stream(events)), root, "abandoned")
    return s.read.parquet(f"{root}/abandoned")


def _notifier(s, d):
    root, events = _cart_stream(s, d)
    labels = materialize(V.customer_value(I.all_validated(s, d)).select("user_id", "value_label"))
    SNT.start_notifier(events, lambda: labels, shop_users(s, d), f"{root}/notifier", f"{root}/_ck", available_now=True).awaitTermination()
    return f"{root}/notifier"


@query("discount_offers_stream")
def _discount_offers_stream(s, d):
    """Keyed carts, then stream-static joins with labels and users, up to the last watermark."""
    return SNT.read_offers(s, _notifier(s, d))


@query("notifier_gauges_stream")
def _notifier_gauges_stream(s, d):
    """Counters and the gauge of active carts, added up from what each batch left."""
    return SNT.current_gauges(s, _notifier(s, d))


@query("stream_dedupe")
def _stream_dedupe(s, d):
    root, raw = _message_stream(s, d)
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/_ck", available_now=True)
    for q in SI.start_ingest(s, raw, cfg):
        q.awaitTermination()
    return s.read.parquet(f"{root}/raw").select(KEYED)


def _unclean_ingest(s, d, broken: bool):
    """Root folder of an ingest over unclean events, null times and ids included."""
    root = scratch(s, "stream")
    SI.write_message_files(unclean_events(s, d), f"{root}/messages")
    if broken:
        _broken_messages(s, d).write.parquet(f"{root}/messages/broken")
    raw = read_message_files(s, f"{root}/messages", max_files_per_trigger=FILES_PER_TRIGGER)
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/_ck", available_now=True, reject_path=f"{root}/rejected")
    for q in SI.start_ingest(s, raw, cfg):
        q.awaitTermination()
    return root


@query("unclean_stream")
def _unclean_stream(s, d):
    """The ingest stream over unclean events: what survives, all columns."""
    return s.read.parquet(f"{_unclean_ingest(s, d, False)}/raw").select(KEYED)


@query("reject_stream")
def _reject_stream(s, d):
    """Every message of an ingest over unclean events and broken messages: accepted, or by its reason
    among the dead letters."""
    root = _unclean_ingest(s, d, True)
    kept = s.read.parquet(f"{root}/raw").select("topic", F.lit("accepted").alias("reason"))
    return (kept.unionByName(s.read.parquet(f"{root}/rejected").select("topic", "reason"))
            .groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("messages")))


@query("enriched_stream")
def _enriched_stream(s, d):
    """Stream-static join: the ingest stream with product category and price."""
    root, raw = _message_stream(s, d)
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/_ck", available_now=True)
    for q in SI.start_ingest(s, raw, cfg, products=shop_products(s, d)):
        q.awaitTermination()
    return s.read.parquet(f"{root}/raw").select("id", "topic", "product_id", "product_category", "product_price")


@query("topic_dump_stream")
def _topic_dump_stream(s, d):
    root, raw = _message_stream(s, d)
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/_ck", available_now=True,
                          dump_path=f"{root}/dumps")
    for q in SI.start_ingest(s, raw, cfg):
        q.awaitTermination()
    return _stacked({n: s.read.parquet(f"{root}/dumps/{n}").select(KEYED) for n in SI.DUMP_NAMES.values()}, "dump")


@query("customer_activity_stream")
def _activity_stream(s, d):
    """Append mode: only windows closed by the watermark (10 minutes) are emitted."""
    root, raw = _message_stream(s, d)
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/_ck", available_now=True,
                          activity_path=f"{root}/activity")
    for q in SI.start_ingest(s, raw, cfg):
        q.awaitTermination()
    return s.read.parquet(f"{root}/activity")


def _metric_query(m):
    def run(s, d):
        df = I.validated(s, d)[m.topic]
        out = SM.metric_frame(df, m)
        return out.select(*[F.col(c).cast("bigint").alias(c) if c == m.column else F.col(c) for c in out.columns])
    return run


for _m in SM.METRICS:
    QUERIES[_m.name] = _metric_query(_m)


# --- value model (rows-only checks: MLlib forests are not reproducible in SQL) ----------------


def _labeled(s, d):
    return V.customer_value(I.all_validated(s, d))


@query("value_model_train")
def _vm_train(s, d):
    _, pred = VM.train_value_model(_labeled(s, d))
    return pred.select("user_id", "value_label", F.col("prediction").cast("int").alias("prediction"))


@query("value_model_split")
def _vm_split(s, d):
    ranked = VM.with_rank(_labeled(s, d).select("user_id", "value_label"))
    return ranked.select("user_id", "value_label", VM.held_out().alias("is_test"))


@query("prediction_metrics")
def _prediction_metrics(s, d):
    """The metrics over predictions that SQL can rebuild: a label guessed from the transactions."""
    guess = F.when(F.col("transaction_count") >= 19, 2).when(F.col("transaction_count") >= 15, 1).otherwise(0)
    m = VM.classification_metrics(_labeled(s, d).withColumn("prediction", guess))
    return m.select(*[r6(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query("value_model_metrics")
def _vm_metrics(s, d):
    _, pred = VM.train_value_model(_labeled(s, d))
    return VM.classification_metrics(pred)


@query("value_model_cv")
def _vm_cv(s, d):
    return VM.cross_validate(_labeled(s, d))


@query("feature_importance")
def _vm_importance(s, d):
    model, _ = VM.train_value_model(_labeled(s, d))
    return VM.feature_importance(model)


@query("value_score_batch")
def _vm_score(s, d):
    lab = _labeled(s, d)
    model, _ = VM.train_value_model(lab)
    return VM.score_unlabeled(model, shop_users(s, d), lab, CT.cart_contents(I.user_events(s, d)))


@query("value_model_invariants")
def _vm_invariants(s, d):
    """What SQL can say of a fit whatever its trees: who is predicted, with which labels' support; the
    folds' sizes; that the importances are a share of each feature; who is scored, from which row.
    A prediction that is no label makes its row's value -1."""
    ev = I.landed(s, d)
    lab = materialize(V.customer_value(ev))
    model, pred = VM.train_value_model(lab)
    pred = materialize(pred.select("user_id", "value_label", "prediction"))
    valid = F.col("prediction").isin(0.0, 1.0, 2.0)
    row = lambda kind, key, value: (F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("bigint").alias("value"))
    support = VM.classification_metrics(pred).filter("support > 0")
    shares = VM.feature_importance(model).agg(F.count("feature").alias("n"), (F.abs(F.sum("importance") - 1) < 1e-3).alias("whole"))
    folds = VM.with_folds(lab.select("user_id", "value_label")).groupBy("_fold", "value_label").agg(F.count(F.lit(1)).alias("n"))
    scored = model.transform(VM.unlabeled_rows(shop_users(s, d), lab, CT.cart_contents(IG.topic_split(ev)[USER_TOPIC])))
    return reduce(DataFrame.unionByName, [
        pred.select(*row("predicted", F.col("user_id"), F.when(valid, F.col("value_label")).otherwise(-1))),
        support.select(*row("support", F.col("label"), F.col("support"))),
        shares.select(*row("features", F.lit("all"), F.when(F.col("whole"), F.col("n")).otherwise(-1))),
        folds.select(*row("fold", F.concat_ws("/", "_fold", "value_label"), F.col("n"))),
        scored.select(*row("scored", F.col("user_id"), F.when(valid, F.col("add_count")).otherwise(-1)))])


@query("champion_of_fits")
def _champion_of_fits(s, d):
    """Three fits recorded with their metrics; the champion, the one after its rollback, and the users
    that each scores. ``best`` says that the champion's metric is the best of the runs that count."""
    root = scratch(s, "model-runs")
    ev = I.landed(s, d)
    lab = materialize(V.customer_value(ev))
    for trees, depth in ((5, 1), (20, 5), (10, 3)):
        MR.fit_value_model(lab, root, num_trees=trees, max_depth=depth)
    users, cart = shop_users(s, d), CT.cart_contents(IG.topic_split(ev)[USER_TOPIC])
    out = []
    for when in ("fitted", "rolled back"):
        runs = materialize(MR.runs(s, root))
        run_id, _ = MR.champion(s, root, "customer_value")
        best = runs.agg(F.max("metric")).scalar() == runs.filter(F.col("run_id") == run_id).agg(F.max("metric")).scalar()
        n_runs = runs.agg(F.count(F.lit(1))).scalar()
        scored = materialize(MR.score_by_champion(users, lab, cart, root))
        out.append(scored.select(F.lit(when).alias("state"), n_runs.alias("n_runs"), best.alias("best"), "user_id",
                                 (F.col("champion_run") == run_id).alias("by_champion"), F.col("value_label").isin(0, 1, 2).alias("labeled")))
        MR.withdraw(s, root, run_id)
    return reduce(DataFrame.unionByName, out)


@query("kafka_source")
def _kafka_source(s, d):
    """The message source as a stream (a file stand-in for the broker: same (topic, value)
    rows), decoded and landed, then counted per topic."""
    root, raw = _message_stream(s, d)
    _run(IG.decode_events(raw), root, "decoded")
    return IG.key_events(s.read.parquet(f"{root}/decoded")).select(KEYED)


@query("metric_csv_sink")
def _metric_csv_sink(s, d):
    """An update-mode metric through the CSV sink: each batch writes the windows it touched, and
    the newest value of each window is read."""
    root, raw = _message_stream(s, d)
    m = SM.BY_NAME["views_per_minute"]
    br = SI.validated_streams(SI.watermarked_events(raw, "10 minutes"))
    q = SM.start_metric(SI.ntz_output(br[m.topic]), m, sink="csv", metrics_path=f"{root}/metrics",
                        checkpoint_dir=f"{root}/_ck", available_now=True)
    q.awaitTermination()
    schema = SM.metric_frame(I.validated(s, d)[m.topic], m).schema
    out = SM.read_metric_csv(s, f"{root}/metrics/{m.name}", schema, SM.metric_keys(m))
    return out.select("window_start", "window_end", F.col(m.column).cast("bigint").alias(m.column))


@query("feature_csv_sink")
def _feature_csv_sink(s, d):
    """Session baskets through CSV (the basket list as JSON text) and back."""
    path = scratch(s, "baskets_csv")
    SK.write_csv(SS.session_baskets(I.user_events(s, d)), path)
    back = s.read.option("header", True).csv(path)
    return back.select("user_id", "session_id",
                       F.array_join(X.parse_basket(F.col("cart_product_id_list")), ",").alias("cart_products"))


@query("json_report_sink")
def _json_report_sink(s, d):
    """The report job's JSON outputs, all read back as (report, run_date, row) with the row as JSON."""
    from . import daily as DL
    v = I.landed_branches(s, d)
    out = scratch(s, "report")
    rd = DL.generate_report(*(v[t] for t in TOPICS), out)
    parts = {}
    for name in DL.REPORTS:
        back = s.read.json(f"{out}/{name}/run_date={rd}").drop("run_date")
        text = F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(back.columns)])
        parts[name] = back.select(F.lit(str(rd)).alias("run_date"), text.alias("row"))
    return _stacked(parts, "report")


@query("live_metrics_job")
def _live_metrics_job(s, d):
    """Every live metric from one streaming query, read back as (metric, key, value) rows."""
    root, raw = _message_stream(s, d)
    v = SI.ntz_output(SI.validated_stream(SI.watermarked_events(raw, "10 minutes")))
    SM.start_metrics_job(v, f"{root}/metrics", f"{root}/_ck", available_now=True).awaitTermination()
    parts = {}
    for m in SM.METRICS:
        keys = SM.metric_keys(m)
        key = F.col(keys[0]).cast("string") if keys else F.lit("all")
        parts[m.name] = SM.read_live_metric(s, f"{root}/metrics", m).select(key.alias("k"), F.col(m.column).alias("value"))
    return _stacked(parts, "metric")

"""Cart state from the event log: contents, totals, abandonment episodes and offers.

Event-time semantics of the cart notifier: a logged-in user's cart gains a product on
add_to_cart, loses it on delete_from_cart, empties on transaction; every user event
refreshes the activity time; a non-empty cart idle for more than the threshold fires one
notification, re-armed by the next add_to_cart or transaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_present
from ..session import materialize
from ..schema import (ABANDON_MINUTES, COUPON_ALPHABET, COUPON_LENGTH, DEFAULT_DISCOUNT,
                      DEFAULT_TIER, DISCOUNT_BY_LABEL, TIER_BY_LABEL, UNKNOWN_EMAIL)


def _user_events(events: DataFrame) -> DataFrame:
    return events.filter(is_present("user_id")).select(
        "user_id", "id", "event_time", "event_type", "product_id")


def _after_last_transaction(ev: DataFrame) -> DataFrame:
    last_tx = (ev.filter(F.col("event_type") == "transaction").groupBy("user_id")
                 .agg(F.max(F.struct("event_time", "id")).alias("ltx")))
    j = ev.join(last_tx, "user_id", "left")
    return j.filter(F.col("ltx").isNull() | (F.struct("event_time", "id") > F.col("ltx"))).drop("ltx")


def cart_contents(events: DataFrame) -> DataFrame:
    """(user_id, product_id) in each user's cart after the last event: the product's
    last add/delete since the user's last transaction is an add. Aggregations only (no
    per-user window), so a very active user is combined map-side like any other."""
    ev = _after_last_transaction(_user_events(events))
    ad = ev.filter(F.col("event_type").isin("add_to_cart", "delete_from_cart") & is_present("product_id"))
    last = ad.groupBy("user_id", "product_id").agg(
        F.max(F.struct("event_time", "id", "event_type")).alias("l"))
    return last.filter(F.col("l.event_type") == "add_to_cart").select("user_id", "product_id")


def cart_with_products(cart: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines with the product title and price (left lookup: unknown product kept)."""
    p = products.select(F.col("id").cast("string").alias("product_id"), "title",
                        F.col("price").cast("double").alias("price"))
    return cart.join(p, "product_id", "left").withColumn("quantity", F.lit(1).cast("bigint"))


def cart_totals(lines: DataFrame) -> DataFrame:
    """Per user: items = sum of quantities, total = round(sum(price * quantity), 2),
    unknown price counted as 0."""
    return lines.groupBy("user_id").agg(
        F.sum("quantity").cast("bigint").alias("items"),
        F.round(F.sum(F.coalesce(F.col("price"), F.lit(0.0)) * F.col("quantity")), 2).alias("total"))


def _running(partition, order, col, offset=None):
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = F.sum(col).over(w)
    return r if offset is None else F.col(offset) + r


def _chunk_offsets(chunks: DataFrame, keys: list[str], cols: list[str], lead: dict | None = None) -> DataFrame:
    """For per-(keys, chunk) sums, the total of all earlier chunks of the same keys, and
    optionally a value of the next chunk (one window over chunk summaries: one row per
    chunk, never per event)."""
    order = Window.partitionBy(*keys).orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nxt = [F.lead(c).over(order).alias(a) for c, a in (lead or {}).items()]
    return chunks.select(*keys, "chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"off_{c}")
                                           for c in cols], *nxt)


def _fired(ev: DataFrame, minutes: int, snapshot) -> DataFrame:
    """First row per (user, episode) whose non-empty cart then stays idle too long."""
    idle_until = F.coalesce(F.col("next_t"), snapshot)
    fired = ev.filter((F.col("cart_size") > 0)
                      & (idle_until > F.col("event_time") + F.expr(f"INTERVAL {int(minutes)} MINUTES")))
    first = fired.groupBy("user_id", "episode").agg(
        F.min(F.struct("event_time", "id", "cart_size")).alias("f"))
    return first.select(
        "user_id", F.col("episode").cast("bigint").alias("episode"),
        F.col("f.event_time").alias("last_activity"),
        (F.col("f.event_time") + F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("notify_at"),
        F.col("f.cart_size").cast("bigint").alias("cart_size"))


def abandoned_carts(events: DataFrame, minutes: int = ABANDON_MINUTES, snapshot=None, chunk: str = "1 day") -> DataFrame:
    """One row per abandonment: user_id, episode, last_activity, notify_at, cart_size.

    epoch = transactions so far (the cart empties), episode = adds + transactions so far
    (the notification re-arms); a product's membership flips only when its previous
    add/delete in the epoch says so; the cart is idle when the user's next event (or the
    snapshot, default the latest event time) is more than ``minutes`` later.

    Skew-safe: a user's timeline is cut into time chunks. Running counts are prefix sums
    computed inside each (user, chunk) plus the totals of earlier chunks, which come from
    a window over chunk summaries; the next event time and a product's previous
    add/delete cross chunk borders the same way. No window ever orders all events of one
    user, so a user with a third of the events is spread over many tasks."""
    ev = _user_events(events)
    if snapshot is None:
        snapshot = ev.agg(F.max("event_time")).scalar()
    t = F.col("event_type")
    is_add = (t == "add_to_cart") & is_present("product_id")
    is_del = (t == "delete_from_cart") & is_present("product_id")
    ev = ev.select(
        "user_id", "id", "event_time", "event_type", "product_id",
        F.window("event_time", chunk)["start"].alias("chunk"),
        F.when(t == "transaction", 1).otherwise(0).alias("tx"),
        F.when(is_add | (t == "transaction"), 1).otherwise(0).alias("ep"),
        (is_add | is_del).alias("ad"))
    order = ["event_time", "id"]
    u, uc = ["user_id"], ["user_id", "chunk"]

    # epoch, episode and the next event time
    cs = ev.groupBy(*uc).agg(F.sum("tx").alias("tx"), F.sum("ep").alias("ep"),
                             F.min("event_time").alias("first_t"))
    offs = _chunk_offsets(cs, u, ["tx", "ep"], lead={"first_t": "next_chunk_t"})
    ev = ev.join(offs, uc)
    wc = Window.partitionBy(*uc).orderBy(*order)
    ev = materialize(ev.withColumn("epoch", _running(uc, order, "tx", "off_tx"))
                       .withColumn("episode", _running(uc, order, "ep", "off_ep"))
                       .withColumn("next_t", F.coalesce(F.lead("event_time").over(wc), F.col("next_chunk_t"))))

    # previous add/delete of the same product in the same epoch
    k = ["user_id", "epoch", "product_id"]
    ad = ev.filter("ad")
    last_in_chunk = ad.groupBy(*k, "chunk").agg(F.max(F.struct("event_time", "id", "event_type")).alias("l"))
    prev_chunk = last_in_chunk.select(
        *k, "chunk", F.lag("l.event_type").over(Window.partitionBy(*k).orderBy("chunk")).alias("prev_chunk_type"))
    ad = ad.join(prev_chunk, k + ["chunk"]).withColumn(
        "prev", F.coalesce(F.lag("event_type").over(Window.partitionBy(*k, "chunk").orderBy(*order)),
                           F.col("prev_chunk_type")))
    ev = ev.join(ad.select("user_id", "id", "prev"), ["user_id", "id"], "left")
    delta = (F.when(is_add & (F.coalesce(F.col("prev"), F.lit("")) != "add_to_cart"), 1)
              .when(is_del & (F.col("prev") == "add_to_cart"), -1).otherwise(0))
    ev = materialize(ev.withColumn("d", delta))

    # cart size = running sum of deltas since the epoch began (the transaction row)
    ds = ev.groupBy(*uc).agg(F.sum("d").alias("d"))
    ev = ev.join(_chunk_offsets(ds, u, ["d"]), uc).withColumn("s", _running(uc, order, "d", "off_d"))
    starts = ev.filter(F.col("tx") == 1).select("user_id", "epoch", F.col("s").alias("s0"))
    ev = ev.join(starts, ["user_id", "epoch"], "left").withColumn(
        "cart_size", F.col("s") - F.coalesce(F.col("s0"), F.lit(0)))

    return _fired(ev, minutes, snapshot)


def coupon_suffix(*keys) -> F.Column:
    """Deterministic ``COUPON_LENGTH`` characters from the alphabet, from an md5 of the keys
    (replaces a random draw so reruns give the same coupon)."""
    n = F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 12), 16, 10).cast("bigint")
    a = len(COUPON_ALPHABET)
    chars = [F.substring(F.lit(COUPON_ALPHABET),
                         (F.floor(n / F.lit(a ** i)) % a + 1).cast("int"), 1) for i in range(COUPON_LENGTH)]
    return F.concat(*chars)


def _lookup(mapping: dict, c, default):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def with_email(rows: DataFrame, users: DataFrame) -> DataFrame:
    """``rows`` (user_id, ...) with the email of the active user, else user_<id>@unknown.com."""
    known = users.filter(~F.col("is_deleted")).select(F.col("id").cast("string").alias("user_id"), "email")
    unknown = F.format_string(UNKNOWN_EMAIL.replace("{}", "%s"), F.col("user_id"))
    return rows.join(known, "user_id", "left").withColumn("email", F.coalesce("email", unknown))


def discount_offers(abandoned: DataFrame, labels: DataFrame, users: DataFrame) -> DataFrame:
    """Offer per abandonment: value label (left lookup), discount by label, tier name,
    email of an active user (else user_<id>@unknown.com) and a coupon code."""
    lab = labels.select("user_id", "value_label")
    j = with_email(abandoned.join(lab, "user_id", "left"), users)
    disc = _lookup(DISCOUNT_BY_LABEL, F.col("value_label"), DEFAULT_DISCOUNT)
    return j.select(
        "user_id", "episode", "notify_at", "value_label",
        disc.cast("bigint").alias("discount"),
        _lookup(TIER_BY_LABEL, F.col("value_label"), DEFAULT_TIER).alias("tier"),
        "email",
        F.concat(F.lit("SAVE"), disc.cast("string"), F.lit("-"),
                 coupon_suffix(F.col("user_id"), F.col("episode"))).alias("coupon"))


def notifier_counters(user_events: DataFrame, abandoned: DataFrame, cart: DataFrame) -> DataFrame:
    """The notifier's business counters: events processed (logged-in user events),
    abandonments, notifications sent (one per abandonment) and carts still non-empty."""
    return user_events.filter(is_present("user_id")).agg(F.count(F.lit(1)).alias("events_processed")).select(
        "events_processed",
        abandoned.agg(F.count(F.lit(1))).scalar().alias("cart_abandonments"),
        abandoned.agg(F.count(F.lit(1))).scalar().alias("notifications_sent"),
        cart.agg(F.count_distinct("user_id")).scalar().alias("active_carts"))

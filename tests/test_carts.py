import datetime as dt

from clickcast.operators import carts as CT
from clickcast.plans import inputs as I
from conftest import SF_SMALL

GAP = dt.timedelta(minutes=15)


def _fold(rows):
    """Sequential reference fold of the cart notifier, in event time."""
    by_user = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.event_time, r.id)):
        by_user.setdefault(r.user_id, []).append(r)
    snap = max(r.event_time for r in rows)
    fired, carts = set(), {}
    for u, evs in by_user.items():
        items, last, notified, episode = set(), None, False, 0
        for e in evs:
            if items and not notified and last is not None and e.event_time > last + GAP:
                fired.add((u, episode, last, len(items)))
                notified = True
            last = e.event_time
            if e.event_type == "add_to_cart" and e.product_id:
                items.add(e.product_id)
                notified, episode = False, episode + 1
            elif e.event_type == "delete_from_cart" and e.product_id:
                items.discard(e.product_id)
            elif e.event_type == "transaction":
                items.clear()
                notified, episode = False, episode + 1
        if items and not notified and snap > last + GAP:
            fired.add((u, episode, last, len(items)))
        carts[u] = set(items)
    return fired, carts


def test_abandonment_and_contents_match_sequential_fold(spark):
    ue = I.user_events(spark, SF_SMALL)
    rows = ue.filter("user_id is not null").select("user_id", "id", "event_time", "event_type", "product_id").collect()
    fired, carts = _fold(rows)
    assert fired
    for chunk in ["1 hour", "7 minutes", "1 day"]:  # chunk borders must not change the result
        got = {(r.user_id, r.episode, r.last_activity, r.cart_size)
               for r in CT.abandoned_carts(ue, chunk=chunk).collect()}
        assert got == fired, chunk
    cc = {}
    for r in CT.cart_contents(ue).collect():
        cc.setdefault(r.user_id, set()).add(r.product_id)
    assert cc == {u: s for u, s in carts.items() if s}


def test_offers_discount_and_coupon(spark):
    from clickcast.operators import value as V
    from clickcast.sources.tables import shop_users
    ue = I.user_events(spark, SF_SMALL)
    ab = CT.abandoned_carts(ue)
    offers = CT.discount_offers(ab, V.customer_value(I.all_validated(spark, SF_SMALL)), shop_users(spark, SF_SMALL))
    rows = offers.collect()
    assert len(rows) == ab.count()
    for r in rows:
        assert r.discount == {2: 3, 1: 8, 0: 15}.get(r.value_label, 5)
        assert r.coupon.startswith(f"SAVE{r.discount}-") and len(r.coupon.split("-")[1]) == 6
        assert r.email.endswith("@example.com") or r.email == f"user_{r.user_id}@unknown.com"
    again = {r.coupon for r in offers.collect()}
    assert again == {r.coupon for r in rows}

import json

from pyspark.sql import functions as F

from clickcast.operators import ingest as IG


def _msg(topic, **kw):
    base = {"id": 1, "topic": topic, "session_id": "u1-2024-01-01-s0", "visitor_id": "", "user_id": "1",
            "timestamp": "2024-01-01T00:00:00", "event_type": "view", "product_id": "5",
            "order_id_for_refund": None, "is_recommended": False}
    base.update(kw)
    return (topic, json.dumps(base))


def _keyed(spark, rows):
    raw = spark.createDataFrame(rows, "topic string, value string")
    return IG.key_events(IG.decode_events(raw))


def test_decode_key_and_blank_user(spark):
    rows = [_msg("user-events", id=1),
            _msg("user-events", id=2, user_id="", visitor_id="visitor_9"),
            _msg("user-events", id=3, user_id=None, visitor_id="visitor_8"),
            _msg("user-events", id=4, user_id="", visitor_id=""),        # no key at all
            ("user-events", "{not json")]                               # malformed
    k = {r.id: r for r in _keyed(spark, rows).collect()}
    assert set(k) == {1, 2, 3}
    assert (k[1].customer_key, k[1].id_type) == ("1", "user")
    assert (k[2].customer_key, k[2].id_type, k[2].user_id) == ("visitor_9", "visitor", None)
    assert k[3].customer_key == "visitor_8"


def test_validation_rules(spark):
    rows = [
        _msg("user-events", id=10, product_id=""),                     # missing product
        _msg("user-events", id=11, product_id="0"),
        _msg("user-events", id=12, product_id="-1"),
        _msg("user-events", id=13, product_id="abc"),
        _msg("user-events", id=14, event_type="refund_request"),       # refund without order
        _msg("user-events", id=15, event_type="refund_request", order_id_for_refund="ORD-1"),
        _msg("user-events", id=16, timestamp="junk"),                  # unparsable time
        _msg("user-events", id=17, event_type="recommendation_shown"), # type not on topic
        _msg("user-events", id=18, event_type="teleport"),             # unknown type
        _msg("user-events", id=19),
        _msg("user-events", id=19, product_id="6"),                    # duplicate id
        _msg("recommendation-actions", id=19, event_type="recommendation_shown"),  # same id, other topic
        _msg("user-events", id=20, event_type="teleport", timestamp="2024-01-01T00:00:00"),
        _msg("user-events", id=20, timestamp="2024-01-01T00:00:05"),   # first copy unknown -> consumed
    ]
    keyed = _keyed(spark, rows)
    v = IG.validated_branches(keyed)
    users = sorted(r.id for r in v["user-events"].collect())
    assert users == [15, 19]
    assert [r.product_id for r in v["user-events"].filter("id = 19").collect()] == ["5"]
    assert [r.id for r in v["recommendation-actions"].collect()] == [19]
    reasons = {(r.topic, r.reason): r.rejected for r in IG.reject_reasons(keyed).collect()}
    assert reasons[("user-events", "missing_product")] == 1
    assert reasons[("user-events", "bad_product_id")] == 3  # "0", "-1", "abc"
    assert reasons[("user-events", "refund_without_order")] == 1
    assert reasons[("user-events", "type_not_on_topic")] == 1
    assert reasons[("user-events", "unknown_event_type")] == 2
    assert reasons[("user-events", "duplicate_id")] == 2
    assert reasons[("user-events", "null_event_time")] == 1


def test_topic_type_match(spark):
    rows = [_msg("user-events", id=1), _msg("notification-events", id=2, event_type="view")]
    got = [r.id for r in IG.topic_type_match(_keyed(spark, rows)).collect()]
    assert got == [1]


def test_kafka_round_trip(spark):
    from clickcast.sources.tables import shop_events
    from conftest import SF_SMALL
    ev = IG.key_events(shop_events(spark, SF_SMALL)).select(IG.KEYED_COLUMNS)
    back = IG.key_events(IG.decode_events(IG.to_kafka_rows(shop_events(spark, SF_SMALL)))).select(IG.KEYED_COLUMNS)
    assert ev.exceptAll(back).count() == 0 and back.exceptAll(ev).count() == 0
    assert F is not None

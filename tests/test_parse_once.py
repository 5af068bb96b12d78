from clickcast.operators import ingest as IG
from clickcast.plans import registry as R
from clickcast.sources.tables import unclean_events
from conftest import SF_SMALL


def _parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_a_message_is_parsed_once(spark):
    messages = IG.to_kafka_rows(unclean_events(spark, SF_SMALL))
    assert _parses(IG.validate_all(IG.key_events(IG.decode_events(messages)))) == 1
    rows = spark.createDataFrame([("user-events", "{}")], "topic string, value string")
    assert _parses(IG.with_keys(IG.decode_messages(rows)).filter(IG.complete() & IG.accepted()).select(R.KEYED)) == 1


def test_odd_messages_keep_their_verdict(spark):
    values = ['{"id":1,"event_type":"view"}', None, '{"id":2,"to', "[]", '[{"id":3}]', "null", "", "  ", '{"id":"x"}', "5"]
    rows = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "topic string, value string")
    got = {r.topic: (r.id, r.raw_value, r.broken) for r in IG.decode_messages(rows).collect()}
    assert got == {str(i): (1 if i == 0 else None, v, i > 0) for i, v in enumerate(values)}
    assert {(r.topic, r.id) for r in IG.decode_events(rows).collect()} == {(str(i), 1 if i == 0 else None) for i in range(len(values))}

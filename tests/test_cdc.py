"""Change events: parsing, rules, current state, change feed, keyed table and streams."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quotaflow.operators import cdc, merge
from quotaflow.sinks.keyed import KeyedTable
from quotaflow.sources.messages import DEAD_LETTER_TOPICS, TOPICS, dead_letters, file_messages
from quotaflow.streaming import medallion
from quotaflow.streaming.alerts import p95_latency_stream

BASE = {
    "Id": "1", "AccountId": "a", "Amount": "10.005", "CloseDate": "2001-05-01", "Probability": "85.0", "DaysInCurrentStage__c": "7",
    "LastModifiedDate": "2001-05-01 10:00:00", "_EventType": "CREATE", "StageName": "Proposal",
}


def _raw(spark, texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "raw_json string, kafka_offset long")


def test_parse_opportunity(spark):
    texts = [
        json.dumps(BASE),
        json.dumps({**BASE, "Amount": "n/a", "CloseDate": "01.05.2001", "Probability": "85.9", "LastModifiedDate": "yesterday"}),
        '{"Id": "3", "AccountId":',
        json.dumps({"Id": None, "_EventType": "CREATE"}),
    ]
    rows = cdc.parse_events(_raw(spark, texts), "opportunity").orderBy("kafka_offset").collect()
    assert (rows[0]["amount"], rows[0]["probability"], rows[0]["close_date"]) == (Decimal("10.01"), 85, dt.date(2001, 5, 1))
    assert rows[0]["updated_at"] == dt.datetime(2001, 5, 1, 10)
    assert (rows[1]["amount"], rows[1]["close_date"], rows[1]["updated_at"], rows[1]["probability"]) == (None, None, None, 85)
    assert rows[2]["opportunity_id"] is None and rows[3]["opportunity_id"] is None
    assert len(rows[0]) == 19


def test_rules_drop_null_and_unknown(spark):
    texts = [json.dumps({**BASE, "_EventType": e}) for e in ("CREATE", "UNDELETE")] + [json.dumps({"Id": "9"}), json.dumps({"_EventType": "UPDATE"}), "broken"]
    parsed = cdc.parse_events(_raw(spark, texts), "opportunity")
    rules = cdc.quality_rules("opportunity")
    kept = cdc.keep_valid(parsed, rules)
    assert [r["kafka_offset"] for r in kept.collect()] == [0]
    report = {r["rule"]: (r["violations"], r["total_rows"]) for r in cdc.rule_report(parsed, rules).collect()}
    assert report == {"valid_opportunity_id": (2, 5), "valid_event_type": (3, 5)}
    from pyspark.sql import Observation

    watch = Observation("quality")
    rows = parsed.observe(watch, *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    rows.collect()
    assert watch.get == {"valid_opportunity_id": 2, "valid_event_type": 3}
    assert cdc.observed(parsed, rules).count() == 5
    accounts = cdc.keep_valid(cdc.parse_events(_raw(spark, texts), "account"), cdc.quality_rules("account"))
    assert accounts.count() == 3  # accounts have no event-type rule


EVENT = "entity_id string, event_type string, amount decimal(18,2), updated_at timestamp, kafka_offset long, health_score int"


def _events(seed=5, n=300):
    """Many events of few keys, one key owning half of them; ties, missing sequences and late deletes included."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for offset in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(12)}"
        at = None if rng.random() < 0.03 else start + dt.timedelta(hours=rng.randrange(60))
        kind = rng.choice(["CREATE", "UPDATE", "UPDATE", "DELETE"])
        rows.append((key, kind, Decimal(rng.randrange(1000)), at, offset, rng.randrange(100)))
    return rows


def _expected(rows, deletes=True):
    best = {}
    for r in rows:
        place = (r[3] is not None, r[3] or dt.datetime.min, r[4])
        if r[0] not in best or place > best[r[0]][0]:
            best[r[0]] = (place, r)
    return {k: r[4] for k, (_, r) in best.items() if not (deletes and r[1] == "DELETE")}


@pytest.mark.parametrize("deletes", [True, False])
def test_current_rows(spark, deletes):
    rows = _events()
    got = cdc.current_rows(spark.createDataFrame(rows, EVENT), "entity_id", deletes)
    assert {r["entity_id"]: r["kafka_offset"] for r in got.collect()} == _expected(rows, deletes)


@pytest.mark.parametrize("seed, fold_after, fold_every", [(1, None, 100), (2, 1, 100), (3, 2, 100), (4, None, 2), (5, None, 1)])
def test_keyed_table_any_arrival_order(spark, tmp_path, seed, fold_after, fold_every):
    rows = _events(seed)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    table = KeyedTable(spark, str(tmp_path / "t"), "entity_id", fold_every=fold_every)
    for batch_id in range(4):
        batch = spark.createDataFrame(shuffled[batch_id::4], EVENT)
        table.write_batch(batch, batch_id)
        table.write_batch(batch, batch_id)  # a repeated batch changes nothing
        if batch_id == fold_after:
            table.fold(batch_id, F.lit(dt.datetime(2024, 1, 2)))
    assert table.folded_until() == (3 if fold_every < 100 else -1 if fold_after is None else fold_after)
    current = table.current().collect()
    assert {r["entity_id"]: r["kafka_offset"] for r in current} == _expected(rows)
    assert len(current) == len(_expected(rows))


def test_fold_drops_only_old_tombstones(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "entity_id")
    rows = [("old", "DELETE", None, dt.datetime(2024, 1, 1), 1, 0), ("new", "DELETE", None, dt.datetime(2024, 1, 20), 2, 0)]
    table.write_batch(spark.createDataFrame(rows, EVENT), 0)
    table.fold(0, F.lit(dt.datetime(2024, 1, 21)))
    late = [("new", "UPDATE", None, dt.datetime(2024, 1, 19), 3, 0), ("old", "UPDATE", None, dt.datetime(2024, 1, 21), 4, 0)]
    table.write_batch(spark.createDataFrame(late, EVENT), 1)
    assert [r["entity_id"] for r in table.current().collect()] == ["old"]


def _write_messages(spark, folder, topic, values, first_offset=0):
    rows = [(v, topic, o % 3, o, dt.datetime(2024, 1, 1)) for o, v in enumerate(values, first_offset)]
    df = spark.createDataFrame(rows, "value string, topic string, partition int, offset long, timestamp timestamp")
    df.repartition(2).write.mode("append").json(f"{folder}/{topic}")


def test_medallion_stream_from_files(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    topic = TOPICS["opportunity"]
    _write_messages(spark, source, topic, [json.dumps({**BASE, "Id": str(i % 5), "LastModifiedDate": f"2001-05-{1 + i:02d} 00:00:00"}) for i in range(10)] + ["broken"])
    table = medallion.run_available(file_messages(spark, source, [topic], files_per_trigger=1), root, "opportunity")
    assert spark.read.parquet(f"{root}/bronze").count() == 11
    assert spark.read.parquet(f"{root}/silver").count() == 10
    assert {r["opportunity_id"]: r["kafka_offset"] for r in table.current().collect()} == {str(i): 5 + i for i in range(5)}
    # the next run takes only what is new: one delete and one event older than the state
    late = [json.dumps({**BASE, "Id": "0", "_EventType": "DELETE", "LastModifiedDate": "2001-06-01 00:00:00"}), json.dumps({**BASE, "Id": "1"})]
    _write_messages(spark, source, topic, late, 100)
    table = medallion.run_available(file_messages(spark, source, [topic]), root, "opportunity")
    assert {r["opportunity_id"]: r["kafka_offset"] for r in table.current().collect()} == {str(i): 5 + i for i in range(1, 5)}


def test_continuous_queries_start_and_stop(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    topic = TOPICS["account"]
    _write_messages(spark, source, topic, ['{"Id": "1", "Name": "A", "_EventType": "DELETE", "LastModifiedDate": "2001-05-01 00:00:00"}'])
    queries = medallion.start_continuous(file_messages(spark, source, [topic]), root, "account")
    for query in queries:
        query.processAllAvailable()
        query.stop()
    assert [r["name"] for r in medallion.gold_table(spark, root, "account").current().collect()] == ["A"]


def test_dead_letters_of_two_topics(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    topics = list(DEAD_LETTER_TOPICS.values())
    for topic in topics:
        _write_messages(spark, source, topic, ["bad"])
    medallion.append_stream(dead_letters(file_messages(spark, source, topics)), root, "dlq", once=True).awaitTermination()
    rows = spark.read.parquet(f"{root}/dlq").collect()
    assert sorted(r["topic"] for r in rows) == sorted(topics) and all(r["ingested_at"] for r in rows)


def test_latency_alert_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=m), 9000 if m < 60 else 100) for m in range(0, 240, 2)]
    spark.createDataFrame(rows, "ts timestamp, total_latency_ms int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, total_latency_ms int").parquet(str(tmp_path / "in"))
    query = p95_latency_stream(stream).writeStream.outputMode("complete").format("memory").queryName("p95").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["p95_ms"], r["alert"]) for r in spark.sql("SELECT * FROM p95 ORDER BY hour").collect()] == [(9000, True), (100, False), (100, False), (100, False)]


def test_upsert_and_feed(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k int, v string, x double")
    source = spark.createDataFrame([(2, "B", None), (4, "d", 4.0)], "k int, v string, x double")
    new = merge.upsert(old, source, "k")
    assert sorted(map(tuple, new.collect())) == [(1, "a", 1.0), (2, "B", None), (3, "c", 3.0), (4, "d", 4.0)]
    with pytest.raises(ValueError, match="several rows"):
        merge.upsert(old, source.unionByName(source), "k")
    newest = new.filter("k <> 1")
    feed = merge.change_feed(old, newest, "k")
    assert sorted((r["k"], r["change_type"]) for r in feed.collect()) == [(1, "delete"), (2, "update"), (4, "insert")]
    assert sorted(map(tuple, merge.apply_changes(old, feed, "k").collect())) == sorted(map(tuple, newest.collect()))

"""Streams that keep alerts and totals: batch by batch, with restarts, late rows and quiet keys."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotaflow.operators import merge
from quotaflow.plans import deals
from quotaflow.registry import live
from quotaflow.streaming import alerts, incremental, medallion

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


class Feed:
    """A folder that grows by batches; ``run`` starts the stream again from its checkpoint and takes what is new."""

    def __init__(self, spark, root, schema, name="in"):
        self.spark, self.path, self.schema = spark, f"{root}/{name}", schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return medallion.table_stream(self.spark, self.path)


TRACES = "trace_id string, agent_type string, total_latency_ms int, ts timestamp"


def test_sketches_count_what_is_in_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, TRACES)
    batches = [
        [("a", "x", 10, at(5)), ("b", "x", 20, at(50)), ("c", "y", 9000, at(10)), ("n", "x", None, at(5)), ("m", "x", 5, None)],
        [("d", "x", 30, at(58)), ("e", "x", 40, at(70)), ("f", "x", 1000, at(45))],  # the hour is still open
        [("g", "x", 1, at(200))],
        [("late", "x", 99_999, at(30)), ("h", "x", 2, at(201))],
    ]
    for rows in batches:
        feed.add(rows)
        alerts.sketch_stream(feed.stream(), str(tmp_path), once=True).awaitTermination()
    stored = alerts.stored_sketches(spark, str(tmp_path))
    hours = {(r.hour, r.agent_type): (r.calls, r.p95_ms, r.alert) for r in alerts.p95_alerts(stored, F.col("hour"), F.col("agent_type")).collect()}
    assert hours == {(at(0), "x"): (4, 1000, False), (at(60), "x"): (1, 40, False), (at(180), "x"): (2, 2, False), (at(0), "y"): (1, 9000, True)}
    assert [tuple(r) for r in alerts.p95_alerts(stored).collect()] == [(8, 9000, True)]
    assert [r.value for r in alerts.percentile_of(stored, 0.5).collect()] == [20]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 10, at(5))], TRACES)
    for _ in range(2):
        sketch = rows.groupBy("agent_type", F.lit(DAY).alias("hour")).agg(F.kll_sketch_agg_bigint(F.col("total_latency_ms").cast("long"), F.lit(alerts.SKETCH_K)).alias("sketch"), F.count("*").alias("calls"))
        alerts.append_batch(sketch, f"{tmp_path}/latency_sketches", 0)
    assert [r.calls for r in alerts.stored_sketches(spark, str(tmp_path)).collect()] == [1]


@pytest.mark.parametrize("parts", [1, 40])
def test_merged_sketches_keep_the_error_bound(spark, parts):
    n = 400_000
    values = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003))).alias("v"), (F.col("id") % parts).alias("part"))
    sketches = values.groupBy("part").agg(F.kll_sketch_agg_bigint("v", F.lit(alerts.SKETCH_K)).alias("sketch"), F.count("*").alias("calls"))
    for share in (0.5, 0.95, 0.99):
        found = alerts.percentile_of(sketches, share).first()
        below, to = values.agg(F.avg((F.col("v") < found.value).cast("int")), F.avg((F.col("v") <= found.value).cast("int"))).first()
        assert found.calls == n and below - alerts.RANK_ERROR <= share <= to + alerts.RANK_ERROR


MESSAGES = "kafka_partition int, kafka_offset long, ts timestamp, consumed boolean"


def silences(spark, root):
    return sorted((r.kafka_partition, r.since) for r in alerts.stored_silences(spark, str(root)).collect())


def test_a_partition_that_goes_quiet(spark, tmp_path):
    feed = Feed(spark, tmp_path, MESSAGES)

    def run(rows):
        feed.add(rows)
        alerts.lag_stream(feed.stream(), str(tmp_path), once=True).awaitTermination()
        return silences(spark, tmp_path)

    assert run([(0, 1, at(0), False), (1, 1, at(0), False), (0, 2, at(4), False), (0, 1, at(4), True)]) == []
    # nothing more comes from partition 0; time passes by partition 1
    assert run([(1, i, at(i), False) for i in range(2, 16)]) == []  # 15 less 10 minutes
    assert run([(1, 20, at(19.5), False)]) == [(0, at(4))]
    assert run([(0, 20_000, at(60), False)]) == [(0, at(4)), (1, at(19.5))]
    assert {(r.kafka_partition, r.lag, r.lag_alert) for r in alerts.stored_lags(spark, str(tmp_path)).collect()} == {(0, 19_999, True), (1, 21, False)}


def test_a_late_message_ends_a_silence(spark, tmp_path):
    feed = Feed(spark, tmp_path, MESSAGES)
    for rows in ([(0, 1, at(0), False), (0, 3, at(8), False)], [(0, 2, at(4), False)], [(1, 1, at(60), False)], [(0, 9, at(9), False)]):
        feed.add(rows)
        alerts.lag_stream(feed.stream(), str(tmp_path), once=True).awaitTermination()
    assert silences(spark, tmp_path) == [(0, at(8))]  # none after 0; the last message is too late to be seen


def test_silences_do_not_depend_on_batches(spark, tmp_path):
    rng, rows = random.Random(2), []
    for i in range(400):
        rows.append((rng.randrange(3), i, at(rng.random() * 1500), bool(i % 5 == 0)))
    rows += rows[:30] + [(None, 5, at(3), False), (2, 7, None, False)]
    rows.sort(key=lambda r: ((r[2] or DAY) + dt.timedelta(minutes=rng.random() * 9)))
    feed = Feed(spark, tmp_path, MESSAGES)
    for start in range(0, len(rows), 90):
        feed.add(rows[start : start + 90])
        alerts.lag_stream(feed.stream(), str(tmp_path), once=True).awaitTermination()
    newest, want = max(r[2] for r in rows if r[2]), []
    for partition in range(3):
        times = sorted({r[2] for r in rows if r[0] == partition and r[2]})
        ends = [*times[1:], newest - dt.timedelta(minutes=10)]
        want += [(partition, t) for t, later in zip(times, ends) if later - t > dt.timedelta(minutes=5)]
    assert silences(spark, tmp_path) == want


EVENTS = "entity_id string, updated_at timestamp, kafka_offset long, health_score int"


def falls(events):
    found, keys = set(), {e[0] for e in events}
    for key in keys:
        mine = sorted({(e[1] or dt.datetime.min, e[2], e[3]) for e in events if e[0] == key}, key=lambda e: e[:2])
        found |= {(key, b[1], b[2], a[2]) for a, b in zip(mine, mine[1:]) if a[2] is not None and b[2] is not None and b[2] < a[2]}
    return found


def test_falling_scores_whatever_the_order(spark, tmp_path):
    rng = random.Random(5)
    events = [(f"k{rng.randrange(4)}", at(i), i, rng.choice([None, *range(8)])) for i in range(120)] + [("k0", None, 500, 7), ("hot", at(0), 600, 3)]
    late = sorted(events, key=lambda e: (e[1] or DAY) + dt.timedelta(minutes=rng.random() * 60))
    feed, seen = Feed(spark, tmp_path, EVENTS), []
    for start in range(0, len(late), 31):
        part = late[start : start + 31] + late[:2]  # two are delivered again and again
        seen += part
        feed.add(part)
        incremental.health_stream(feed.stream(), str(tmp_path), once=True, horizon="2 hours").awaitTermination()
        assert {tuple(r) for r in incremental.stored_falls(spark, str(tmp_path)).collect()} == falls(seen)


def test_events_beyond_the_horizon_are_not_judged(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    for rows in ([("a", at(0), 1, 9), ("a", at(100), 2, 8), ("a", at(200), 3, 7), ("a", at(300), 4, 9)], [("a", at(50), 9, 1), ("a", at(250), 10, 5)]):
        feed.add(rows)
        incremental.health_stream(feed.stream(), str(tmp_path), once=True, horizon="1 hour").awaitTermination()
    got = {tuple(r) for r in incremental.stored_falls(spark, str(tmp_path)).collect()}
    assert got == {("a", 2, 8, 9), ("a", 3, 7, 8), ("a", 10, 5, 7)}  # 9 at minute 50 is not judged, and changes nothing


DEALS = "opportunity_id string, stage string, forecast_category string, amount decimal(18,2)"


def test_totals_after_each_batch(spark, tmp_path):
    rng = random.Random(8)
    stages, categories = ["Proposal", "Negotiation", "Closed Won", "Closed Lost", None], ["Commit", "Pipeline", "Best Case", None]
    version, path = {}, f"{tmp_path}/feed"
    for step in range(4):
        old = spark.createDataFrame([(k, *v) for k, v in version.items()], DEALS)
        for key in rng.sample(range(60), 25):
            if rng.random() < 0.2:
                version.pop(f"o{key}", None)
            else:
                version[f"o{key}"] = (rng.choice(stages), rng.choice(categories), None if rng.random() < 0.1 else DECIMAL(rng))
        if step == 3:
            version = {k: v for k, v in version.items() if v[1] != "Commit"}  # a category that empties
        new = spark.createDataFrame([(k, *v) for k, v in version.items()], DEALS)
        feed = merge.change_feed(old, new, "opportunity_id", keep_old=("stage", "forecast_category", "amount"))
        feed.coalesce(1).write.mode("append").parquet(path)
        incremental.totals_stream(medallion.table_stream(spark, path), str(tmp_path), once=True).awaitTermination()
        got = {r.forecast_category: (r.amount, r.deal_count) for r in incremental.stored_totals(spark, str(tmp_path)).collect()}
        known = new.where("stage IS NOT NULL")
        want = {r.forecast_category: (r.amount or 0, r.deal_count) for r in deals.by_category(known).collect()}
        assert got == want
        touched = {r.forecast_category for r in feed.where("change_type <> 'insert'").select("old_forecast_category").toDF("forecast_category").union(feed.select("forecast_category")).collect()}
        written = {r.forecast_category for r in spark.read.parquet(f"{tmp_path}/category_totals").where(f"batch_id = {step}").collect()}
        assert written <= touched


def DECIMAL(rng):
    import decimal

    return decimal.Decimal(rng.randrange(1, 100_000)) / 100


def test_reviews_join_what_still_arrives(spark, tmp_path):
    rated = Feed(spark, tmp_path, "trace_id string, rating int, comment string, ts timestamp", "rated")
    asked = Feed(spark, tmp_path, "trace_id string, query string, agent_type string, groundedness_score double, confidence_score double, ts timestamp", "asked")
    day = 24 * 60

    def run(answers, ratings):
        asked.add([(t, f"q{t}", "x", 0.5, 0.6, at(m)) for t, m in answers])
        rated.add([(t, r, f"c{t}", at(m)) for t, r, m in ratings])
        incremental.review_stream(rated.stream(), asked.stream(), str(tmp_path), once=True).awaitTermination()
        return sorted((r.trace_id, r.comment) for r in spark.read.parquet(f"{tmp_path}/reviews").collect()) if list(tmp_path.glob("reviews/*.parquet")) else []

    assert run([("a", 0), ("b", 10), ("g", 30)], [("b", 1, 20), ("a", 2, 5), ("early", 1, 30)]) == [("b", "cb")]
    # the rating came first; one within seven days, one at the border, one after
    assert run([("early", 25), ("d", day)], [("a", 1, 3 * day), ("g", 1, 7 * day + 30), (None, 1, day)]) == [("a", "ca"), ("b", "cb"), ("early", "cearly"), ("g", "cg")]
    assert run([("z", 9 * day), ("y", 9 * day)], [("d", 1, 8 * day + 1), ("y", 1, 9 * day - 5), ("z", 1, 9 * day + 5)]) == [("a", "ca"), ("b", "cb"), ("early", "cearly"), ("g", "cg"), ("z", "cz")]


def test_a_batch_has_a_file_for_each_task(spark, tmp_path):
    """However many tasks can run, each finds a file of the batch; the stream takes one batch's files at a time."""
    files = live._files(spark)
    assert files == max(2, spark.sparkContext.defaultParallelism)
    rows = spark.range(4000).selectExpr("id", "timestamp_seconds(id) AS ts")
    stream = live._stream(rows, F.col("ts"), str(tmp_path), "rows")
    assert len(list((tmp_path / "rows").glob("*.parquet"))) == live.BATCHES * files
    query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    query.awaitTermination()
    assert len(query.recentProgress) == live.BATCHES
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4000


def test_keys_without_a_fall_build_no_rows():
    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    events = pd.DataFrame({"updated_at": pd.to_datetime(["2024-01-01", "2024-01-02"]), "kafka_offset": [1, 2], "health_score": [5, 6]})
    state, run = State(), incremental._falls(7 * 86_400_000_000)
    assert list(run(("a",), iter([events]), state)) == [] and state.kept[2] == [5, 6]
    (found,) = run(("a",), iter([events.assign(health_score=[6, 5])]), State())
    assert found.to_dict("records") == [{"entity_id": "a", "kafka_offset": 2, "health_score": 5, "previous_score": 6, "degraded": True}]

"""Percentiles from the stored counts of a stream, against sorted lists."""

from pyspark.sql import functions as F
from quotaflow.streaming import alerts

from tests.test_live import TRACES, Feed, at


def test_percentiles_of_many_calls_are_exact(spark, tmp_path):
    feed, n = Feed(spark, tmp_path, TRACES), 20_011  # several times what a sketch keeps
    for hour in range(2):
        feed.add([(str(k), "xy"[k % 2], k * 7919 % 30_011 + hour, at(60 * hour + k % 60)) for k in range(n)])
        alerts.count_stream(feed.stream(), str(tmp_path), once=True).awaitTermination()
    counts = alerts.stored_counts(spark, str(tmp_path))

    def want(values):
        return len(values), sorted(values)[-(-95 * len(values) // 100) - 1]

    hours = {(h, a): [k * 7919 % 30_011 + h for k in range(n) if "xy"[k % 2] == a] for h in range(2) for a in "xy"}
    got = {(r.hour, r.agent_type): (r.calls, r.p95_ms) for r in alerts.exact_p95_alerts(counts, "hour", "agent_type").collect()}
    assert got == {(at(60 * h), a): want(values) for (h, a), values in hours.items()}
    whole = alerts.exact_p95_alerts(counts).first()
    assert (whole.calls, whole.p95_ms) == want([v for values in hours.values() for v in values]) and whole.alert


def test_late_missing_and_small_groups(spark, tmp_path):
    feed = Feed(spark, tmp_path, TRACES)
    batches = [
        [("a", "x", 10, at(5)), ("b", "x", 20, at(50)), ("n", "x", None, at(5)), ("m", "x", 5, None)],
        [("c", "x", 10, at(58)), ("d", None, 7, at(70))],
        [("g", "x", 1, at(200))],
        [("late", "x", 99_999, at(30)), ("h", "x", 2, at(201))],
    ]
    for rows in batches:
        feed.add(rows)
        alerts.count_stream(feed.stream(), str(tmp_path), once=True).awaitTermination()
    counts = alerts.stored_counts(spark, str(tmp_path))
    got = {(r.hour, r.agent_type): (r.calls, r.p95_ms) for r in alerts.exact_p95_alerts(counts, "hour", "agent_type").collect()}
    assert got == {(at(0), "x"): (3, 20), (at(60), None): (1, 7), (at(180), "x"): (2, 2)}
    assert [tuple(r) for r in alerts.exact_percentile_of(counts, "0.5", "agent_type").orderBy(F.col("agent_type")).collect()] == [(None, 1, 7), ("x", 5, 10)]

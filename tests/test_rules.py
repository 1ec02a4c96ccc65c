"""Alert rules as rows, search runs that know each other, and stored quality counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotaflow.operators import cdc
from quotaflow.plans import jobs as J
from quotaflow.plans import monitoring as M
from quotaflow.streaming import jobs, medallion, quality

TRACE = "ts timestamp_ntz, confidence_score double, groundedness_score double, input_tokens int, output_tokens int, sql_success boolean, total_latency_ms int"


def traces(spark):
    rows = [
        (dt.datetime(2024, 1, 1, 0, 10), 0.5, 0.9, 1_000_000, 0, True, 100),
        (dt.datetime(2024, 1, 1, 0, 50), 0.7, None, 0, 1_000_000, False, 300),
        (dt.datetime(2024, 1, 1, 5), None, 0.5, None, 2, True, None),
        (dt.datetime(2024, 1, 2, 3), 0.9, 0.9, 10, 10, None, 900),
    ]
    return spark.createDataFrame(rows, TRACE)


def fired(spark, *rules):
    rows = M.fired_rules(M.hourly_metrics(traces(spark)), spark.createDataFrame(list(rules), M.RULES)).collect()
    return {(r.rule, r.since): (r.value, r.fired) for r in rows}


def test_a_rule_added_as_a_row_fires(spark):
    day, next_day = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    assert fired(spark, ("c", "confidence", 24, "below", 0.7)) == {("c", day): (0.6, True), ("c", next_day): (0.9, False)}
    more = fired(spark, ("c", "confidence", 24, "below", 0.5), ("cost", "cost", 1, "above", 17.9), ("slow", "latency_ms", 48, "above", 400.0), ("n", "calls", 6, "above", 2.0))
    assert more[("cost", day)] == (18.0, True) and more[("cost", day + dt.timedelta(hours=5))] == (0.00003, False)
    slow = {k[1]: v for k, v in more.items() if k[0] == "slow"}
    assert sum(fired for _, fired in slow.values()) in (0, 1) and len(slow) in (1, 2)
    assert more[("n", day)] == (3.0, True) and ("n", day + dt.timedelta(hours=6)) not in more


def test_windows_without_a_value_do_not_fire(spark):
    got = fired(spark, ("f", "sql_failures", 1, "above", 0.2), ("c", "confidence", 1, "below", 1.0), ("none", "no_such_metric", 1, "above", 0.0), ("bad", "calls", 0, "above", 0.0))
    assert got[("f", dt.datetime(2024, 1, 1))] == (0.5, True) and got[("f", dt.datetime(2024, 1, 2, 3))] == (None, False)
    assert got[("c", dt.datetime(2024, 1, 1, 5))] == (None, False)
    assert {k[0] for k in got} == {"f", "c"}


ITEM = "query_idx int, response_no long, item_no int, title string, company string, url string"


def shown(*titles):
    return [(0, 0, i, t, "Acme", f"u{i}") for i, t in enumerate(titles)]


def test_three_runs(spark, tmp_path):
    root = str(tmp_path)
    runs = [shown("a", "A", "b"), shown("B", "c", "a", None), shown("d", "c", "C", None)]
    everything = None
    for run, rows in enumerate(runs):
        items = spark.createDataFrame(rows, ITEM)
        jobs.add_run(items, root, run, dt.datetime(2024, 1, 1 + run), ["query_idx", "response_no", "item_no"])
        jobs.job_stream(spark, root, once=True).awaitTermination()
        items = items.withColumn("run", F.lit(run))
        everything = items if everything is None else everything.unionByName(items)
        got = {(r.run, r.title, r.url) for r in spark.read.parquet(f"{root}/new_jobs").collect()}
        want = J.first_seen(everything, ["run", "query_idx", "response_no", "item_no"])
        assert got == {(r.run, r.title, r.url) for r in want.collect()}


def test_a_forgotten_job_is_new_again(spark, tmp_path):
    root = str(tmp_path)
    for run, day in enumerate((1, 5, 20, 40, 41)):
        jobs.add_run(spark.createDataFrame(shown("a"), ITEM), root, run, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), ["item_no"])
        jobs.job_stream(spark, root, once=True, memory="10 days").awaitTermination()
    runs = sorted(r.run for r in spark.read.parquet(f"{root}/new_jobs").collect())
    assert runs == [0, 4]  # day 40 moves the time to day 30, more than ten days after the first


RAW = "raw_json string, kafka_offset long, kafka_partition int, kafka_ts timestamp"


def event(i, **fields):
    body = {"Id": str(i), "Amount": "5", "_EventType": "UPDATE"} | fields
    return ("{" + ", ".join(f'"{k}": "{v}"' for k, v in body.items() if v is not None) + "}", i, 0, dt.datetime(2024, 1, 1))


def test_quality_of_each_batch_is_stored(spark, tmp_path):
    root, rows = str(tmp_path), []
    for batch, part in enumerate(([event(1), event(2, Id=None)], [event(3, Amount="-1"), event(4, _EventType="UNDELETE"), ("no json", 5, 0, None)], [event(6, Amount="x")])):
        rows += part
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(f"{root}/raw")
        listener = quality.QualityListener(spark, root, f"dq-{tmp_path.name}")
        spark.streams.addListener(listener)
        try:
            stream = quality.checked_rows(medallion.table_stream(spark, f"{root}/raw"), "opportunity")
            query = stream.writeStream.queryName(listener.name).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).format("parquet").start(f"{root}/out")
            query.awaitTermination()
            listener.wait(query)
        finally:
            spark.streams.removeListener(listener)
        parsed = cdc.parse_events(spark.createDataFrame(rows, RAW), "opportunity")
        want = {tuple(r) for r in cdc.rule_report(parsed, quality.all_rules("opportunity")).collect()}
        assert {tuple(r) for r in quality.stored_report(spark, root).collect()} == want
        assert spark.read.parquet(f"{root}/quality").where(f"batch_id = {batch}").first().total_rows == len(part)
    assert spark.read.parquet(f"{root}/out").count() == 3


def test_a_listener_that_sees_nothing_says_so(spark, tmp_path):
    listener = quality.QualityListener(spark, str(tmp_path), "other")

    class Query:
        lastProgress = type("P", (), {"batchId": 4})

    with pytest.raises(TimeoutError):
        listener.wait(Query, seconds=0.1)

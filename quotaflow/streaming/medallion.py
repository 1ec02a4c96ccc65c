"""Change events as a stream: raw rows -> typed valid rows -> current table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quotaflow import constants as C
from quotaflow.operators import cdc
from quotaflow.schemas import conform
from quotaflow.sinks.keyed import KeyedTable
from quotaflow.sources.messages import raw_events


def _start(stream: DataFrame, name: str, root: str, once: bool, sink=None) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", f"{root}/_checkpoints/{name}").queryName(name)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=C.CDC_TRIGGER)
    if sink is not None:
        return writer.foreachBatch(sink).start()
    return writer.format("parquet").outputMode("append").start(f"{root}/{name}")


def bronze(messages: DataFrame, root: str, name: str = "bronze", once: bool = False) -> StreamingQuery:
    """Raw rows of one topic, appended."""
    return _start(raw_events(messages), name, root, once)


def append_stream(rows: DataFrame, root: str, name: str, once: bool = False) -> StreamingQuery:
    return _start(rows, name, root, once)


def table_stream(spark: SparkSession, folder: str, schema=None, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table as a stream of the files that are added to it; with a schema it may still be empty."""
    reader = spark.readStream.schema(schema or spark.read.parquet(folder).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def silver_rows(raw: DataFrame, entity: str) -> DataFrame:
    rules = cdc.quality_rules(entity)
    return cdc.keep_valid(cdc.observed(cdc.parse_events(raw, entity), rules), rules)


def keyed_sink(stream: DataFrame, table: KeyedTable, root: str, name: str, once: bool = False) -> StreamingQuery:
    """Upsert a stream of typed events into a keyed table."""
    return _start(stream, name, root, once, table.write_batch)


def gold_table(spark: SparkSession, root: str, entity: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/gold", cdc.ENTITY_KEY[entity], deletes=cdc.ENTITY_DELETES[entity])


def run_available(messages: DataFrame, root: str, entity: str) -> KeyedTable:
    """Take all waiting messages through the three stages, then stop."""
    spark = messages.sparkSession
    bronze(messages, root, once=True).awaitTermination()
    append_stream(silver_rows(table_stream(spark, f"{root}/bronze"), entity), root, "silver", once=True).awaitTermination()
    table = gold_table(spark, root, entity)
    keyed_sink(table_stream(spark, f"{root}/silver"), table, root, "gold_sink", once=True).awaitTermination()
    return table


def gold_rows(table: KeyedTable, entity: str) -> DataFrame:
    """The current table in its declared columns."""
    return conform(table.current(), f"realtime.{entity}_current")


def start_continuous(messages: DataFrame, root: str, entity: str) -> list[StreamingQuery]:
    """The three stages as running queries with a 10 second trigger. Each reads what the one before it has written,
    so the layers cannot start at different places of the topic or disagree."""
    spark = messages.sparkSession
    raw = raw_events(messages)
    for name, schema in (("bronze", raw.schema), ("silver", silver_rows(raw, entity).schema)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{root}/{name}")
    first = bronze(messages, root)
    typed = silver_rows(table_stream(spark, f"{root}/bronze", raw.schema), entity)
    second = append_stream(typed, root, "silver")
    third = keyed_sink(table_stream(spark, f"{root}/silver", typed.schema), gold_table(spark, root, entity), root, "gold_sink")
    return [first, second, third]

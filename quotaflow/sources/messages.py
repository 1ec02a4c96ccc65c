"""Change-event topics: Kafka where the connector is deployed, JSON-line files with the same columns elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow import constants as C

# Topic names are a deployment matter; these are defaults.
TOPICS = {"opportunity": "crm.opportunity.cdc", "account": "crm.account.cdc"}
DEAD_LETTER_TOPICS = {"opportunity": "dlq.opportunity", "account": "dlq.account"}
MESSAGE = "value string, topic string, partition int, offset long, timestamp timestamp"


def kafka_messages(spark: SparkSession, topics: list[str], servers: str, **options: str) -> DataFrame:
    """Messages of the topics from now on; lost data is tolerated and a trigger is capped."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "latest")
        .option("failOnDataLoss", "false")
        .option("maxOffsetsPerTrigger", C.MAX_OFFSETS_PER_TRIGGER)
        .options(**options)
        .load()
    )


def file_messages(spark: SparkSession, folder: str, topics: list[str], files_per_trigger: int = 100) -> DataFrame:
    """Messages from JSON-line files, one folder per topic; each trigger takes a limited number of files."""
    pattern = f"{folder}/{{{','.join(topics)}}}" if len(topics) > 1 else f"{folder}/{topics[0]}"
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(pattern)


def raw_events(messages: DataFrame) -> DataFrame:
    """Bronze rows: the value as text plus its place in the topic."""
    return messages.select(
        F.col("value").cast("string").alias("raw_json"), F.col("offset").alias("kafka_offset"),
        F.col("partition").alias("kafka_partition"), F.col("timestamp").alias("kafka_ts"),
    )


def dead_letters(messages: DataFrame) -> DataFrame:
    """Dead-letter rows of all subscribed topics."""
    return messages.select(
        F.col("value").cast("string").alias("raw_json"), "topic", F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_ts"), F.current_timestamp().alias("ingested_at"),
    )

"""Keyed message log: source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "msg_id bigint, ts timestamp, topic string, key string, body string"


def read_messages(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    topic: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Messages of a log kept as Parquet files.

    ``streaming=True`` starts at the oldest file and resumes from the query's
    checkpoint, as a consumer group starts at the oldest offset and resumes from
    its commit. A missing key or body is an empty string, never NULL.
    """
    if streaming:
        reader = spark.readStream.schema(MESSAGE_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        reader = spark.read.schema(MESSAGE_SCHEMA)
    messages = reader.parquet(path)
    if topic is not None:
        messages = messages.where(F.col("topic") == topic)
    return messages.withColumns(
        {"key": F.coalesce("key", F.lit("")), "body": F.coalesce("body", F.lit(""))}
    )


def kafka_columns(sent: DataFrame, headers: str = "headers") -> DataFrame:
    """The columns a Kafka sink takes, partition chosen by the caller."""
    return sent.select(
        "topic",
        F.col("key").cast("binary").alias("key"),
        F.col("body").cast("binary").alias("value"),
        F.col(headers).alias("headers"),
        F.col("sent_partition").alias("partition"),
    )


def write_messages(sent: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write records under their topic and explicit partition, snappy compressed.

    Rows are dealt by topic and partition, so a task opens few files; a partition with a
    third of all rows is split over several tasks. Files have no order: with a ``seq`` or
    ``offset`` column a partition can be read back as it was sent.
    """
    (
        sent.withColumnRenamed("sent_partition", "partition")
        .hint("rebalance", "topic", "partition")
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy("topic", "partition")
        .parquet(path)
    )

"""The set each key is in, kept up to date by a stream of records and tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keytide.operators.message_sets import TAG_COLUMNS
from keytide.operators.routing import ON
from keytide.streaming.hot_keys import AVAILABLE_NOW

LATEST = (
    "topic string, key string, src_partition int, src_idx int, dest_partition int, dest_idx int,"
    " last_seq bigint, gone_seq bigint"
)


def latest_sets(records: DataFrame) -> DataFrame:
    """A row per key: its newest set, its last record and its last tombstone.

    ``records`` have ``topic, key, seq, is_delete`` and the tag, NULL in tombstones. As a streaming
    aggregation it is combined in the tasks before the shuffle, so a hot key is one row of each;
    the state store holds the keys and writes those that changed.
    """
    sent = ~F.col("is_delete")
    newest = [F.max_by(F.when(sent, F.col(c)), F.when(sent, F.col("seq"))).alias(c) for c in TAG_COLUMNS]
    return records.groupBy(*ON).agg(
        *newest,
        F.max(F.when(sent, F.col("seq"))).alias("last_seq"),
        F.max(F.when(F.col("is_delete"), F.col("seq"))).alias("gone_seq"),
    )


def stream_latest_sets(
    records: DataFrame, out_path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Write, batch by batch below ``out_path``, the keys whose set or tombstone changed."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    writer = latest_sets(records).writeStream.outputMode("update").foreachBatch(step)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_sets(spark: SparkSession, out_path: str) -> DataFrame:
    """The sets of all keys that have not been deleted since their last record."""
    changes = spark.read.schema(f"{LATEST}, batch int").parquet(out_path)
    values = [c for c in changes.columns if c not in (*ON, "batch")]
    last = changes.groupBy(*ON).agg(F.max_by(F.struct(*values), "batch").alias("now")).select(*ON, "now.*")
    alive = F.col("last_seq").isNotNull() & (
        F.col("gone_seq").isNull() | (F.col("last_seq") > F.col("gone_seq"))
    )
    return last.where(alive).select(*ON, *TAG_COLUMNS)

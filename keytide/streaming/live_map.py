"""Routing a stream by a map that somebody else keeps and changes while the stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keytide.functions.joins import dimension_join
from keytide.operators.message_sets import sent_partition
from keytide.streaming.hot_keys import (
    AVAILABLE_NOW,
    TOTALS,
    HotKeyConfig,
    sequence_batch,
    start_batches,
    tag_batch,
)
from keytide.streaming.state import VersionedState

ENTRIES = "topic string, key string, count bigint, partition int"
VERSION = "version bigint"


class MapVersions:
    """Snapshots of a map below ``root``, numbered; one is seen only once it is whole.

    ``root`` belongs in the folder the executors share.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def publish(self, entries: DataFrame, version: int) -> None:
        """Write a snapshot, then make it known. Publishing a version again replaces it."""
        snapshot = entries.select("topic", "key", F.col("count").cast("long").alias("count"), "partition")
        snapshot.write.mode("overwrite").parquet(f"{self.root}/snapshot={version}")
        known = self.spark.createDataFrame([(version,)], VERSION)
        known.write.mode("overwrite").parquet(f"{self.root}/known/v={version}")

    def newest(self) -> int | None:
        """The highest version that is whole; None before the first."""
        known = VersionedState(self.spark, self.root).exists_path(f"{self.root}/known")
        if not known:
            return None
        versions = self.spark.read.schema(VERSION).parquet(f"{self.root}/known")
        return versions.agg(F.max("version")).first()[0]

    def read(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(f"{self.root}/snapshot={version}")


def pinned_version(state: VersionedState, versions: MapVersions, batch_id: int) -> int | None:
    """The version a batch goes by: the newest when the batch is first tried, and the same after.

    So a batch that is repeated after a failure routes its messages as before, whatever has been
    published since.
    """
    if not state.exists("map_version", batch_id):
        pin = state.spark.createDataFrame([(versions.newest(),)], VERSION)
        state.save("map_version", batch_id, pin)
    return state.read("map_version", batch_id, VERSION).first()[0]


def entries_from(state: VersionedState, entries: DataFrame, batch_id: int) -> DataFrame:
    """A snapshot as a log: its entries hold from the batch's first message of their topic on."""
    before = state.before("totals", batch_id, TOTALS)
    start = (F.coalesce(F.col("seen"), F.lit(0)) + 1).alias("valid_from")
    none = F.lit(None).cast("long").alias("valid_to")
    return dimension_join(entries, before, ["topic"]).select("topic", "key", "partition", start, none)


def stream_live_map(
    stream: DataFrame,
    versions: MapVersions,
    state_dir: str,
    out_path: str,
    checkpoint: str,
    config: HotKeyConfig,
    trigger: dict = AVAILABLE_NOW,
    keep: int | None = None,
) -> StreamingQuery:
    """Route and tag each micro-batch by the map version that is newest when it starts.

    A key goes to its hash partition while it is in no version. A key is only mapped after it
    has sent messages (as by a sketch of the stream); its first set is then that of its hash
    partition, however long it was not mapped.
    """
    state = VersionedState(stream.sparkSession, state_dir, keep)

    def step(batch: DataFrame, batch_id: int) -> None:
        messages, _ = sequence_batch(state, batch, batch_id, config.slice_rows)
        entries = versions.read(pinned_version(state, versions, batch_id))
        log = state.scratch("map", batch_id, entries_from(state, entries, batch_id))
        tagged = tag_batch(state, messages, log, batch_id, config)
        sent_partition(tagged).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        state.finish(batch_id)

    return start_batches(stream, step, checkpoint, trigger)

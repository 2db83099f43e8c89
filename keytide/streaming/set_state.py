"""Tagging with the sets of keys in Spark's own state store.

A streaming operator with a value per key would get all messages of a hot key in one task. What it
needs is much less: which partition the key was on, in the order of the map's changes. So each
micro-batch is first reduced to the intervals of the map that its messages fall into (partial
aggregation, one row per key and interval), and only those rows go through the state. The store
writes what changed: a key whose set is the same as before costs a lookup.

Three steps follow each other: messages are numbered and reduced, in ``foreachBatch``; the reduced
rows pass ``transformWithState``; every message takes its tag from the numbered sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from keytide.functions.joins import plan_interval_join
from keytide.operators.message_sets import apply_sets, first_in_interval, sent_partition
from keytide.operators.routing import ON, timeline
from keytide.streaming.hot_keys import AVAILABLE_NOW, HotKeyConfig, sequence_batch, start_batches
from keytide.streaming.state import VersionedState

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VISITED = (
    "topic string, key string, valid_from bigint, valid_to bigint, partition int,"
    " first_seq bigint, at_batch bigint"
)
SETS = (
    "topic string, key string, valid_from bigint, valid_to bigint, src_partition int, src_idx int,"
    " dest_partition int, dest_idx int, set_seq bigint, at_batch bigint"
)
SET = Row(*(column.split()[0] for column in SETS.split(", ")))


class SetNumbers(StatefulProcessor):
    """The set each key is in: its partition, index, and where it came from."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "partition int, idx int, src int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # most keys have a row or two: plain rows and few calls of the store are what counts
        visits = sorted(rows, key=lambda v: (v.at_batch, v.valid_from))
        known = self.last.get()
        now, opened, batch = known and tuple(known), None, None
        for v in visits:
            if v.at_batch != batch:
                batch, opened = v.at_batch, None
            if now is None:
                now = (v.partition, 0, -1)
            elif now[0] != v.partition:
                now, opened = (v.partition, now[1] + 1, now[0]), v.first_seq
            src_idx = now[1] - 1 if now[1] else -1
            yield SET(*key, v.valid_from, v.valid_to, now[2], src_idx, now[0], now[1], opened, batch)
        if known is None or now != tuple(known):
            self.last.update(now)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own choice comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def number_sets_stream(visited: DataFrame) -> DataFrame:
    """Sets of a stream of visited intervals, a row for each key and interval of a batch."""
    return visited.groupBy(*ON).transformWithState(
        statefulProcessor=SetNumbers(), outputStructType=SETS, outputMode="Append", timeMode="None"
    )


def stream_tags_in_store(
    stream: DataFrame,
    hot_map_log: Callable[[SparkSession], DataFrame],
    state_dir: str,
    out_path: str,
    checkpoint: str,
    config: HotKeyConfig,
    trigger: dict = AVAILABLE_NOW,
) -> None:
    """Route and tag what has arrived, and return; call again for what arrives later.

    The map is read anew for every batch and is the full history of its keys. Whatever step a failure
    stops, the next call goes on from there: numbered batches wait under ``state_dir`` until their
    tags are written below ``out_path``.
    """
    spark = stream.sparkSession
    state = VersionedState(spark, state_dir)

    def line_of(batch_id: int) -> DataFrame:
        return state.read("timeline", batch_id, "topic string, key string, valid_from bigint, valid_to bigint, partition int")

    def reduce(batch: DataFrame, batch_id: int) -> None:
        if state.exists("visited", batch_id):
            return  # done before the failure: the next step may have read it
        messages, _ = sequence_batch(state, batch, batch_id, config.slice_rows)
        line = state.save("timeline", batch_id, timeline(hot_map_log(spark), config.n_partitions))
        plan = plan_interval_join(line, ON, messages, "seq", config.broadcast_rows)
        visited = first_in_interval(messages, line, plan)
        state.emit("visited", batch_id, visited.withColumn("at_batch", F.lit(batch_id).cast("long")))

    start_batches(stream, reduce, f"{checkpoint}/messages", trigger).awaitTermination()
    reduced = state.versions("visited")
    if not reduced:
        return
    visited = spark.readStream.schema(VISITED).option("recursiveFileLookup", True).parquet(f"{state_dir}/visited")
    with rocksdb(spark):
        sets = number_sets_stream(visited).writeStream.format("parquet").outputMode("append")
        sets = sets.option("checkpointLocation", f"{checkpoint}/sets").trigger(**trigger).start(f"{state_dir}/sets")
    sets.awaitTermination()
    numbered = spark.read.schema(SETS).parquet(f"{state_dir}/sets")
    tagged = VersionedState(spark, out_path)
    for batch_id in sorted(set(reduced) - set(tagged.versions(""))):
        messages = spark.read.parquet(state.path("messages", batch_id))
        plan = plan_interval_join(line_of(batch_id), ON, messages, "seq", config.broadcast_rows)
        own = numbered.where(F.col("at_batch") == batch_id).drop("at_batch")
        sent = sent_partition(apply_sets(messages, own, plan, config.n_partitions))
        sent.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

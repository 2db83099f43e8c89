"""Sketch, placement, routing and tagging of a live stream.

Each step runs in ``foreachBatch`` with the very functions of the batch side. What
crosses batches is small: message counts per topic, tracked lives and the open
bucket of the sketch, the standing map, and the last set of keys that ever were hot.
Per-key state of a streaming operator would put a hot key's whole batch into one
task; here a hot key is spread like any other rows.

A micro-batch is taken in arrival order ``(ts, msg_id)``; batches follow each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keytide.functions.chunked import SLICE_ROWS, with_sequence
from keytide.functions.hashing import fnv_partition
from keytide.functions.joins import (
    BROADCAST_ROWS,
    dimension_join,
    plan_interval_join,
    small_join,
)
from keytide.operators import control, sketch
from keytide.operators.load import (
    busy_ticks,
    elapsed_ticks,
    every_tick,
    partition_sizes,
    weight_snapshots,
)
from keytide.operators.message_sets import (
    apply_sets,
    first_in_interval,
    number_sets,
    sent_partition,
)
from keytide.operators.routing import ON, timeline
from keytide.streaming.state import VersionedState

TOTALS = "topic string, seen bigint"
PENDING = "topic string, key string, bucket bigint, c bigint, first_n bigint"
LIVES = (
    "topic string, key string, start_bucket bigint, end_bucket bigint, seen bigint,"
    " insert_n bigint, count bigint, status string, hot_bucket bigint, hot_count bigint"
)
TICKS = "topic string, tick bigint, at_seq bigint"
LAST_SETS = "topic string, key string, last_partition int, last_idx int, last_src int"


@dataclass(frozen=True)
class HotKeyConfig:
    """``rebalance_every`` counts turnovers of the sketch, ``rebalance_seconds`` a clock's; with
    ``weight_seconds`` the sizes of all partitions come out at every tick of that clock."""

    n_partitions: int
    epsilon: float
    support: float
    rebalance_every: int | None = None
    rebalance_seconds: int | None = None
    weight_seconds: int | None = None
    stop_rule: str = "improves"
    tolerance: float | None = None
    cooldown: int | None = None
    slice_rows: int = SLICE_ROWS
    bucket_chunk: int = sketch.BUCKET_CHUNK
    broadcast_rows: int = BROADCAST_ROWS


def sequence_batch(
    state: VersionedState, batch: DataFrame, batch_id: int, slice_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Number a batch's messages on from the batches before: ``(messages, totals)``."""
    totals = state.before("totals", batch_id, TOTALS)
    base = totals.withColumnRenamed("seen", "_seen")
    ranked = with_sequence(batch, slice_rows=slice_rows)
    numbered = dimension_join(ranked, base, ["topic"]).withColumn(
        "seq", F.col("seq") + F.coalesce("_seen", F.lit(0))
    )
    messages = state.scratch("messages", batch_id, numbered.drop("_seen"))
    counted = messages.groupBy("topic").agg(F.count(F.lit(1)).alias("seen"))
    now = totals.unionByName(counted).groupBy("topic").agg(F.sum("seen").alias("seen"))
    return messages, state.save("totals", batch_id, now)


def advance_sketch(
    state: VersionedState,
    messages: DataFrame,
    totals: DataFrame,
    batch_id: int,
    config: HotKeyConfig,
) -> tuple[DataFrame, DataFrame]:
    """Take a batch into the sketch: ``(lives, turnovers)`` of this batch.

    A life from an earlier batch enters the scan as one row at its start bucket with
    all its occurrences; lives that ended earlier are gone.
    """
    bucketed = sketch.assign_buckets(messages, config.epsilon)
    open_counts = state.before("pending", batch_id, PENDING)
    counts = (
        sketch.bucket_counts(bucketed)
        .unionByName(open_counts)
        .groupBy("topic", "key", "bucket")
        .agg(F.sum("c").alias("c"), F.min("first_n").alias("first_n"))
    )
    width = sketch.bucket_width(config.epsilon)
    full = totals.select("topic", F.floor(F.col("seen") / width).cast("long").alias("full"))
    pending = small_join(counts, full, ["topic"]).where(F.col("bucket") > F.col("full")).drop("full")
    state.save("pending", batch_id, pending)

    none = F.lit(None).cast("long")
    fresh = counts.withColumns({"carried": F.lit(False), "hot_bucket": none, "hot_count": none})
    tracked = state.before("lives", batch_id, LIVES).where(F.col("end_bucket").isNull())
    carried = tracked.select(
        "topic",
        "key",
        F.col("start_bucket").alias("bucket"),
        F.col("seen").alias("c"),
        F.col("insert_n").alias("first_n"),
        F.lit(True).alias("carried"),
        "hot_bucket",
        "hot_count",
    )
    scan = sketch.scan_buckets(
        fresh.unionByName(carried), full, config.bucket_chunk, max_bucket=None
    )
    lives = state.save(
        "lives", batch_id, sketch.lives_of(scan, config.epsilon, config.support)
    )
    state.emit("ended_lives", batch_id, lives.where(F.col("end_bucket").isNotNull()))
    return lives, sketch.turnovers(bucketed, config.epsilon)


def advance_clock(
    state: VersionedState, name: str, messages: DataFrame, batch_id: int, every_seconds: int
) -> DataFrame:
    """``load.elapsed_ticks`` of a clock that runs by the messages: what passed with this batch.

    The tick after a topic's last message waits for a later message, so a stream passes the
    same ticks as a batch job, idle ones too, wherever its micro-batches are cut.
    """
    busy = busy_ticks(messages, every_seconds).unionByName(state.before(name, batch_id, TICKS))
    busy = busy.groupBy("topic", "tick").agg(F.max("at_seq").alias("at_seq"))
    busy = state.scratch(f"{name}_busy", batch_id, busy)
    last = busy.groupBy("topic").agg(
        F.max("tick").alias("tick"), F.max_by("at_seq", "tick").alias("at_seq")
    )
    state.save(name, batch_id, last)
    return elapsed_ticks(busy)


def advance_map(
    state: VersionedState,
    lives: DataFrame,
    turns: DataFrame,
    batch_id: int,
    config: HotKeyConfig,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Replay the batch's control events on the standing map; its part of the log."""
    standing = state.before("map_log", batch_id, control.LOG_SCHEMA).where(
        F.col("valid_to").isNull()
    )
    # Only turnovers of this batch are in ``turns``, so older events drop out.
    events = control.control_events(
        lives, turns, config.n_partitions, config.rebalance_every, ticks
    )
    log = control.replay_control(
        control.load_events(standing).unionByName(events),
        config.n_partitions,
        config.stop_rule,
        config.tolerance,
        config.cooldown,
    )
    log = state.save("map_log", batch_id, log)
    state.emit("closed_intervals", batch_id, log.where(F.col("valid_to").isNotNull()))
    return log


def tag_batch(
    state: VersionedState,
    messages: DataFrame,
    log: DataFrame,
    batch_id: int,
    config: HotKeyConfig,
    log_is_complete: bool = False,
) -> DataFrame:
    """Tag a batch with its message sets, continuing the sets of earlier batches.

    A key that enters the log only now was hashed before, so it continues set 0 on
    its hash partition. ``log_is_complete``: the log is the same full history for
    every batch, and a key without state has sent nothing yet.
    """
    earlier = state.before("last_sets", batch_id, LAST_SETS)
    home = fnv_partition(F.col("key"), config.n_partitions)
    line = timeline(log, config.n_partitions)
    # Keys hot in earlier batches only are back on their hash partition.
    left = earlier.join(line.select(*ON).distinct(), list(ON), "left_anti").select(
        *ON,
        F.lit(1).cast("long").alias("valid_from"),
        F.lit(None).cast("long").alias("valid_to"),
        home.alias("partition"),
    )
    line = state.scratch("timeline", batch_id, line.unionByName(left))
    plan = plan_interval_join(line, ON, messages, "seq", config.broadcast_rows)
    visited = first_in_interval(messages, line, plan).join(earlier, list(ON), "left")
    fallback = (None, None, None) if log_is_complete else (home, F.lit(0), F.lit(-1))
    for column, otherwise in zip(("last_partition", "last_idx", "last_src"), fallback):
        known = F.col(column)
        value = known if otherwise is None else F.coalesce(known, otherwise)
        visited = visited.withColumn(f"_{column}", value)
    sets = state.scratch("sets", batch_id, number_sets(visited))
    newest = sets.groupBy(*ON).agg(
        F.max_by(F.struct("dest_partition", "dest_idx", "src_partition"), "valid_from").alias("_now")
    )
    now = newest.select(
        *ON,
        F.col("_now.dest_partition").alias("last_partition"),
        F.col("_now.dest_idx").alias("last_idx"),
        F.col("_now.src_partition").alias("last_src"),
    )
    unchanged = earlier.join(newest, list(ON), "left_anti")
    state.save("last_sets", batch_id, now.unionByName(unchanged))
    return apply_sets(messages, sets, plan, config.n_partitions)


def start_batches(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(**trigger).start()


AVAILABLE_NOW = {"availableNow": True}


def stream_sketch(
    stream: DataFrame,
    state_dir: str,
    checkpoint: str,
    config: HotKeyConfig,
    trigger: dict = AVAILABLE_NOW,
    keep: int | None = None,
) -> StreamingQuery:
    """Keep the sketch up to date; its lives are in ``<state_dir>/lives``.

    A batch's version holds what is tracked after it and what it dropped. With ``keep`` only
    the last versions stay; dropped lives of all batches are in ``<state_dir>/ended_lives``.
    """
    state = VersionedState(stream.sparkSession, state_dir, keep)

    def step(batch: DataFrame, batch_id: int) -> None:
        messages, totals = sequence_batch(state, batch, batch_id, config.slice_rows)
        advance_sketch(state, messages, totals, batch_id, config)
        state.finish(batch_id)

    return start_batches(stream, step, checkpoint, trigger)


def stream_tags(
    stream: DataFrame,
    hot_map_log: Callable[[SparkSession], DataFrame],
    state_dir: str,
    out_path: str,
    checkpoint: str,
    config: HotKeyConfig,
    trigger: dict = AVAILABLE_NOW,
    log_is_complete: bool = True,
    keep: int | None = None,
) -> StreamingQuery:
    """Route and tag with a map kept elsewhere, read anew for every batch."""
    spark = stream.sparkSession
    state = VersionedState(spark, state_dir, keep)

    def step(batch: DataFrame, batch_id: int) -> None:
        messages, _ = sequence_batch(state, batch, batch_id, config.slice_rows)
        tagged = tag_batch(state, messages, hot_map_log(spark), batch_id, config, log_is_complete)
        sent_partition(tagged).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        state.finish(batch_id)

    return start_batches(stream, step, checkpoint, trigger)


def run_hot_key_stream(
    stream: DataFrame,
    state_dir: str,
    out_path: str,
    checkpoint: str,
    config: HotKeyConfig,
    trigger: dict = AVAILABLE_NOW,
    keep: int | None = None,
) -> StreamingQuery:
    """The whole producer side: sketch, placement, rebalancing, routing, tagging.

    Sent messages are written below ``out_path``, intervals of the map that ended below
    ``<state_dir>/closed_intervals``, the sizes of all partitions below ``<state_dir>/weights``: at each tick
    of ``weight_seconds``, or after each batch where that is not set. For a timed run pass
    ``{"processingTime": "10 seconds"}``.
    """
    state = VersionedState(stream.sparkSession, state_dir, keep)

    def step(batch: DataFrame, batch_id: int) -> None:
        messages, totals = sequence_batch(state, batch, batch_id, config.slice_rows)
        lives, turns = advance_sketch(state, messages, totals, batch_id, config)
        ticks = None
        if config.rebalance_seconds is not None:
            ticks = advance_clock(state, "rounds", messages, batch_id, config.rebalance_seconds)
        log = advance_map(state, lives, turns, batch_id, config, ticks)
        tagged = tag_batch(state, messages, log, batch_id, config)
        sent_partition(tagged).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        if config.weight_seconds is None:
            weights = partition_sizes(
                control.current_map(log), config.n_partitions, totals.select("topic")
            )
        else:
            passed = advance_clock(state, "seconds", messages, batch_id, config.weight_seconds)
            weights = weight_snapshots(log, every_tick(passed), config.n_partitions)
        state.emit("weights", batch_id, weights)
        state.finish(batch_id)

    return start_batches(stream, step, checkpoint, trigger)

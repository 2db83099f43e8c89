"""Partition load: sizes of the hot map, delivery counts and rates, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.chunked import CHUNK, chunk_of, chunked_lag, chunked_running_sum

# Ticks of a topic that are looked at together.
TICK_CHUNK = 65_536


def all_partitions(n_partitions: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n_partitions - 1)))


def partition_sizes(
    hot_map: DataFrame, n_partitions: int, topics: DataFrame | None = None
) -> DataFrame:
    """Sum of the counts mapped to each partition; zero where nothing is mapped."""
    names = hot_map.select("topic").distinct() if topics is None else topics
    mapped = hot_map.groupBy("topic", "partition").agg(F.sum("count").alias("mapped"))
    return (
        names.withColumn("partition", all_partitions(n_partitions))
        .join(mapped, ["topic", "partition"], "left")
        .select("topic", "partition", F.coalesce("mapped", F.lit(0)).cast("long").alias("size"))
    )


def system_avg(sizes: DataFrame) -> DataFrame:
    """Mean size over all partitions of a topic, empty ones included."""
    return sizes.groupBy("topic").agg(
        (F.sum("size").cast("double") / F.count(F.lit(1))).alias("avg_size")
    )


def ack_counts(acks: DataFrame) -> DataFrame:
    return acks.groupBy("topic").agg(
        F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("errors")
    )


def partition_rate(acks: DataFrame, width: str = "1 second") -> DataFrame:
    """Messages delivered into each partition per time window."""
    return (
        acks.where("ok")
        .groupBy(F.window("ts", width).alias("span"), "topic", "partition")
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(
            "topic",
            "partition",
            F.unix_micros("span.start").alias("window_us"),
            "messages",
        )
    )


def time_ticks(messages: DataFrame, every_seconds: int) -> DataFrame:
    """Every tick of a clock from a topic's first message to its last: topic, tick, at_seq.

    ``at_seq`` is the last message before the tick; ticks between which no message arrived have
    the same.
    """
    busy = busy_ticks(messages, every_seconds).withColumns(
        {"_at": F.struct("tick", "at_seq"), "_chunk": chunk_of("tick", TICK_CHUNK)}
    )
    after = chunked_lag(busy, ["topic"], ["tick"], ["_chunk"], "_at", "_before")
    idle = F.coalesce(F.col("_before.tick") + 1, F.col("tick"))
    ticks = after.withColumn("_tick", F.explode(F.sequence(idle, F.col("tick"))))
    at_seq = F.when(F.col("_tick") == F.col("tick"), F.col("at_seq")).otherwise(
        F.col("_before.at_seq")
    )
    return ticks.select("topic", F.col("_tick").alias("tick"), at_seq.alias("at_seq"))


def busy_ticks(messages: DataFrame, every_seconds: int) -> DataFrame:
    """``(topic, tick, at_seq)``: the first tick after each message, with the last message before it."""
    tick = F.floor(F.unix_micros("ts") / F.lit(every_seconds * 1_000_000)).cast("long") + 1
    return messages.groupBy("topic", tick.alias("tick")).agg(F.max("seq").alias("at_seq"))


def elapsed_ticks(busy: DataFrame, chunk: int = TICK_CHUNK) -> DataFrame:
    """``(topic, tick, at_seq, times)``: ticks that have passed, given all ``busy_ticks``.

    Ticks between which nothing arrived are one row: ``times`` of them, the first being ``tick``. A tick
    has passed once a message after it is there, so that of a topic's last message has not.
    """
    line = busy.withColumns({"_at": F.struct("tick", "at_seq"), "_chunk": chunk_of("tick", chunk)})
    after = chunked_lag(line, ["topic"], ["tick"], ["_chunk"], "_at", "_before")
    return after.where(F.col("_before").isNotNull()).select(
        "topic",
        F.col("_before.tick").alias("tick"),
        F.col("_before.at_seq").alias("at_seq"),
        (F.col("tick") - F.col("_before.tick")).alias("times"),
    )


def every_tick(passed: DataFrame) -> DataFrame:
    """``(topic, tick, at_seq)``: a row for each of the ``times`` of ``elapsed_ticks``."""
    all_of_them = F.sequence("tick", F.col("tick") + F.col("times") - 1)
    return passed.select("topic", F.explode(all_of_them).alias("tick"), "at_seq")


def clock_ticks(messages: DataFrame, every_seconds: int) -> DataFrame:
    """Ticks of a clock, from a topic's first message on, that passed before its last one."""
    return elapsed_ticks(busy_ticks(messages, every_seconds))


def weight_snapshots(
    hot_map_log: DataFrame, ticks: DataFrame, n_partitions: int, chunk: int = CHUNK
) -> DataFrame:
    """Size of every partition at every tick.

    Each interval adds its count where it starts and takes it back where it ends;
    a size is the running sum of these steps, so intervals and ticks are never
    paired. A change made after message s is in force at a tick after s.
    """
    gains = hot_map_log.select("topic", "partition", F.col("valid_from").alias("pos"), "count")
    losses = hot_map_log.where(F.col("valid_to").isNotNull()).select(
        "topic", "partition", F.col("valid_to").alias("pos"), (-F.col("count")).alias("count")
    )
    steps = (
        gains.unionByName(losses)
        .groupBy("topic", "partition", "pos")
        .agg(F.sum("count").alias("step"))
        .withColumn("tick", F.lit(None).cast("long"))
    )
    probes = ticks.select(
        "topic",
        all_partitions(n_partitions).alias("partition"),
        (F.col("at_seq") + 1).alias("pos"),
        F.lit(0).cast("long").alias("step"),
        "tick",
    )
    line = steps.unionByName(probes).withColumn("_chunk", chunk_of("pos", chunk))
    # NULL ticks sort first: at one position the steps count before the probes.
    summed = chunked_running_sum(
        line, ["topic", "partition"], ["pos", "tick"], ["_chunk"], "step", "size"
    )
    return summed.where(F.col("tick").isNotNull()).select("topic", "tick", "partition", "size")

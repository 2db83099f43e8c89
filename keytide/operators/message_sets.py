"""Message sets: the tags from which a key's total order can be rebuilt.

A set is a run of messages of a key on one partition. Every message carries its
set: where the key came from and where it is now, each with the set's index. The
first message after a change still goes to the old partition, so that its consumer
learns of the change.

Only keys that were ever on the hot map can change partition. For those the first
message of each interval is found by one partial aggregation; the ordered scan
runs over intervals, never over the messages of a (possibly very hot) key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.hashing import fnv_partition
from keytide.functions.joins import (
    BROADCAST_ROWS,
    IntervalPlan,
    interval_join,
    plan_interval_join,
)
from keytide.operators.routing import ON, timeline

TAG_COLUMNS = ("src_partition", "src_idx", "dest_partition", "dest_idx")


def number_sets(visited: DataFrame) -> DataFrame:
    """Tags of each key's sets, given its visited intervals with their ``first_seq``.

    Neighbouring intervals on one partition belong to one set. ``set_seq`` is the
    message that opened the set, NULL for a set nothing was moved for. Columns
    ``_last_partition``, ``_last_idx`` and ``_last_src``, where present, are the set
    the key was in before (a stream continuing).
    """
    by_key = W.partitionBy(*ON).orderBy("valid_from")
    so_far = by_key.rowsBetween(W.unboundedPreceding, 0)
    if "_last_idx" not in visited.columns:
        unknown = F.lit(None).cast("int")
        visited = visited.withColumns(
            {"_last_partition": unknown, "_last_idx": unknown, "_last_src": unknown}
        )
    came = F.coalesce(F.lag("partition").over(by_key), F.col("_last_partition"))
    steps = visited.withColumn("_came", came).withColumn(
        "_changed", F.coalesce(F.col("_came") != F.col("partition"), F.lit(False))
    )
    opened = F.when(F.col("_changed"), F.struct("_came", "first_seq"))
    changes = F.sum(F.col("_changed").cast("int")).over(so_far)
    numbered = steps.withColumns(
        {
            "_open": F.last(opened, ignorenulls=True).over(so_far),
            "dest_idx": (F.coalesce(F.col("_last_idx"), F.lit(0)) + changes).cast("int"),
        }
    )
    return numbered.select(
        *ON,
        "valid_from",
        "valid_to",
        F.coalesce("_open._came", "_last_src", F.lit(-1)).alias("src_partition"),
        F.when(F.col("dest_idx") > 0, F.col("dest_idx") - 1).otherwise(-1).alias("src_idx"),
        F.col("partition").alias("dest_partition"),
        "dest_idx",
        F.col("_open.first_seq").alias("set_seq"),
    )


def first_in_interval(messages: DataFrame, line: DataFrame, plan: IntervalPlan) -> DataFrame:
    """Intervals in which a key sent anything, with the first of those messages."""
    return (
        interval_join(messages.select(*ON, "seq"), line, ON, "seq", plan)
        .where(F.col("valid_from").isNotNull())
        .groupBy(*ON, "valid_from", "valid_to", "partition")
        .agg(F.min("seq").alias("first_seq"))
    )


def apply_sets(
    messages: DataFrame, sets: DataFrame, plan: IntervalPlan, n_partitions: int
) -> DataFrame:
    """Give every message its set's tag; what has none is in its key's first set."""
    joined = interval_join(messages, sets, ON, "seq", plan)
    home = fnv_partition(F.col("key"), n_partitions)
    return joined.withColumns(
        {
            "src_partition": F.coalesce("src_partition", F.lit(-1)),
            "src_idx": F.coalesce("src_idx", F.lit(-1)),
            "dest_partition": F.coalesce("dest_partition", home),
            "dest_idx": F.coalesce("dest_idx", F.lit(0)),
            "is_boundary": F.coalesce(F.col("seq") == F.col("set_seq"), F.lit(False)),
        }
    ).drop("valid_from", "valid_to", "set_seq")


def tag_message_sets(
    messages: DataFrame,
    n_partitions: int,
    hot_map_log: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the tag (src_partition, src_idx, dest_partition, dest_idx) and is_boundary.

    A key's first set is ``(-1, -1, p, 0)``; so is the only set of a key that was
    never mapped, which needs no lookup beyond the miss in the join.
    """
    line = timeline(hot_map_log, n_partitions)
    plan = plan_interval_join(line, ON, messages, "seq", broadcast_rows)
    # No more sets than intervals, on whose number the plan was made.
    sets = number_sets(first_in_interval(messages, line, plan))
    return apply_sets(messages, sets, plan, n_partitions)


def sent_partition(tagged: DataFrame) -> DataFrame:
    """Add where each message is really sent: the boundary message to the old place."""
    return tagged.withColumn(
        "sent_partition",
        F.when(F.col("is_boundary"), F.col("src_partition")).otherwise(F.col("dest_partition")),
    )


def latest_message_set(tagged: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """The set each key is in now.

    ``deletes`` are tombstones ``(topic, key, seq)``: a key is gone unless it sent a message after
    its last one.
    """
    # Number by number: structs as buffers would sort all messages.
    newest = [F.max_by(c, "dest_idx").alias(c) for c in TAG_COLUMNS]
    if deletes is None:
        return tagged.groupBy(*ON).agg(*newest)
    latest = tagged.groupBy(*ON).agg(*newest, F.max("seq").alias("_seq"))
    gone = deletes.groupBy(*ON).agg(F.max("seq").alias("_gone"))
    found = latest.join(gone, list(ON), "left")
    return found.where(F.col("_gone").isNull() | (F.col("_seq") > F.col("_gone"))).drop("_seq", "_gone")


def set_count(latest: DataFrame) -> DataFrame:
    """How many keys of each topic are in a set."""
    return latest.groupBy("topic").agg(F.count(F.lit(1)).alias("keys"))


def tag_struct():
    """The tag as one struct column, ready to be encoded into a header."""
    return F.struct("key", *TAG_COLUMNS)

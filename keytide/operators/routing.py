"""Which partition a message goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.hashing import fnv_partition
from keytide.functions.joins import BROADCAST_ROWS, interval_join, plan_interval_join

ON = ("topic", "key")


def cold_partition(n_partitions: int, cold: str = "hash") -> Column:
    """Partition of a key that is not mapped: its hash, or one drawn per message."""
    if cold == "hash":
        return fnv_partition(F.col("key"), n_partitions)
    if cold == "random":
        return fnv_partition(F.concat(F.col("msg_id").cast("string"), F.lit("#r")), n_partitions)
    raise ValueError("cold is 'hash' or 'random'")


def route(
    messages: DataFrame,
    n_partitions: int,
    hot_map_log: DataFrame | None = None,
    cold: str = "hash",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add ``route``. Without a map every key is hashed (vanilla).

    With one, a message takes the partition its key is mapped to as of its ``seq``;
    only keys not mapped at that moment are hashed.
    """
    if hot_map_log is None:
        return messages.withColumn("route", cold_partition(n_partitions, cold))
    intervals = hot_map_log.select(*ON, "valid_from", "valid_to", F.col("partition").alias("_to"))
    plan = plan_interval_join(intervals, ON, messages, "seq", broadcast_rows)
    joined = interval_join(messages, intervals, ON, "seq", plan)
    return joined.withColumn(
        "route", F.coalesce("_to", cold_partition(n_partitions, cold))
    ).drop("_to", "valid_from", "valid_to")


def timeline(hot_map_log: DataFrame, n_partitions: int) -> DataFrame:
    """Gapless intervals of every key that was ever mapped, from its first message on.

    While a key is not mapped it stays on its hash partition.
    """
    standing = hot_map_log.where(
        F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to"))
    ).select(*ON, "valid_from", "valid_to", "partition")
    by_key = W.partitionBy(*ON).orderBy("valid_from")
    linked = standing.withColumns(
        {
            "_free_from": F.lag("valid_to", 1).over(by_key),
            "_is_first": F.row_number().over(by_key) == 1,
            "_next": F.lead("valid_from").over(by_key),
        }
    ).withColumn(
        "_free_from", F.when(F.col("_is_first"), F.lit(1).cast("long")).otherwise(F.col("_free_from"))
    )
    home = fnv_partition(F.col("key"), n_partitions)
    # Up to three intervals per row: the gap before it, itself, and the open end.
    before = F.when(
        F.col("_free_from") < F.col("valid_from"),
        F.struct(
            F.col("_free_from").alias("valid_from"),
            F.col("valid_from").alias("valid_to"),
            home.alias("partition"),
        ),
    )
    own = F.struct("valid_from", "valid_to", "partition")
    after = F.when(
        F.col("_next").isNull() & F.col("valid_to").isNotNull(),
        F.struct(
            F.col("valid_to").alias("valid_from"),
            F.lit(None).cast("long").alias("valid_to"),
            home.alias("partition"),
        ),
    )
    pieces = F.array_compact(F.array(before, own, after))
    return linked.select(*ON, F.inline(pieces))

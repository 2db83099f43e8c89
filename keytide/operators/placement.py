"""Placing and rebalancing hot keys, one set-based step at a time.

These act on a given map; ``control`` replays a whole history with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.hashing import p2c_draws
from keytide.functions.joins import small_join

STOP_RULES = ("improves", "as_written")


def _size_list(sizes: DataFrame) -> DataFrame:
    """Per topic its sizes in partition order: as long as there are partitions."""
    listed = F.sort_array(F.collect_list(F.struct("partition", "size")))
    return sizes.groupBy("topic").agg(F.transform(listed, lambda s: s["size"]).alias("_sizes"))


def p2c_choose(keys: DataFrame, sizes: DataFrame, n_partitions: int) -> DataFrame:
    """Power of two choices: the second draw only if the first is strictly larger."""
    first, second = p2c_draws(F.col("key"), n_partitions)
    drawn = keys.withColumns({"p1": first, "p2": second})
    drawn = small_join(drawn, _size_list(sizes), ["topic"])
    heavier = F.get("_sizes", F.col("p1")) > F.get("_sizes", F.col("p2"))
    return drawn.withColumn("partition", F.when(heavier, F.col("p2")).otherwise(F.col("p1"))).drop(
        "_sizes"
    )


def partition_sets(sizes: DataFrame) -> DataFrame:
    """Label partitions below (``less``) and above (``greater``) the average."""
    per_topic = W.partitionBy("topic")
    mean = F.sum("size").over(per_topic).cast("double") / F.count(F.lit(1)).over(per_topic)
    labelled = sizes.withColumn("avg_size", mean)
    side = F.when(F.col("size") < F.col("avg_size"), "less").when(
        F.col("size") > F.col("avg_size"), "greater"
    )
    return labelled.withColumn("side", side)


def migration_candidates(hot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Keys of an overloaded partition that fit into its excess over the average."""
    over = partition_sets(sizes).where("side = 'greater'").drop("side")
    return hot_map.join(over, ["topic", "partition"]).where(
        F.col("count") <= F.col("size") - F.col("avg_size")
    )


def stops(src: Column, dst: Column, count: Column, stop_rule: str) -> Column:
    """True where a move is refused.

    ``as_written`` adds twice the count and so refuses everything; ``improves`` is
    the evident intent: refuse what would widen the gap between the two partitions.
    """
    gap = src - dst
    if stop_rule == "improves":
        after = gap - 2 * count
    elif stop_rule == "as_written":
        after = gap + 2 * count
    else:
        raise ValueError(f"stop_rule is one of {STOP_RULES}")
    return (src < dst) | (gap < F.abs(after))


def target_match(candidates: DataFrame, sizes: DataFrame, stop_rule: str = "improves") -> DataFrame:
    """Best target of each candidate: topic, key, count, src, dst.

    The target is the underloaded partition that ends up nearest to the average,
    the lowest id among equals. Each row searches its topic's short list of
    underloaded partitions; candidates and partitions are not paired as rows.
    """
    under = partition_sets(sizes).where("side = 'less'")
    targets = under.groupBy("topic").agg(
        F.collect_list(F.struct("partition", "size")).alias("_under")
    )

    def rated(target: Column) -> Column:
        return F.struct(
            F.abs(target["size"] + F.col("count") - F.col("avg_size")).alias("off"),
            target["partition"].alias("partition"),
        )

    allowed = F.filter(
        "_under", lambda t: ~stops(F.col("size"), t["size"], F.col("count"), stop_rule)
    )
    best = F.array_min(F.transform(allowed, rated))
    return (
        small_join(candidates, targets, ["topic"])
        .withColumn("dst", best["partition"])
        .where(F.col("dst").isNotNull())
        .select("topic", "key", "count", F.col("partition").alias("src"), "dst")
    )


def within_tolerance(sizes: DataFrame, tolerance: float) -> DataFrame:
    """Per topic whether the largest partition is close enough to the average to wait."""
    return sizes.groupBy("topic").agg(
        F.max("size").alias("max_size"),
        (F.sum("size").cast("double") / F.count(F.lit(1))).alias("avg_size"),
    ).withColumn("skip_round", F.col("max_size") <= F.col("avg_size") * F.lit(1.0 + tolerance))


def cooled_candidates(
    candidates: DataFrame, hot_map_log: DataFrame, now: DataFrame, cooldown: int
) -> DataFrame:
    """Candidates that were not moved within the last ``cooldown`` messages.

    ``now`` holds ``topic, at_seq``. A key's move is the start of an interval on
    another partition than the interval before.
    """
    by_key = W.partitionBy("topic", "key").orderBy("valid_from")
    moves = hot_map_log.withColumn("_was", F.lag("partition").over(by_key)).where(
        F.col("_was").isNotNull() & (F.col("_was") != F.col("partition"))
    )
    recent = (
        small_join(moves, now, ["topic"])
        .where(
            (F.col("valid_from") <= F.col("at_seq"))
            & (F.col("at_seq") - F.col("valid_from") < cooldown)
        )
        .select("topic", "key")
        .distinct()
    )
    return candidates.join(recent, ["topic", "key"], "left_anti")

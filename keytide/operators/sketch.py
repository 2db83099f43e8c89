"""Lossy counting over count windows, as a scan instead of a loop.

A bucket is ``floor(1/epsilon)`` consecutive counted messages of a topic. At the
end of bucket b every tracked key loses one; a key tracked since bucket j with f
occurrences stays iff ``f >= 2k``, where ``k = b - j + 1``, and is hot iff
``f - k >= (support - epsilon) * width``. Support is tested per bucket and what a
survivor loses it never regains.

With c(b) the occurrences in bucket b and S(b) the running sum of ``c - 2``, that
rule says: a key is dropped exactly when S falls below its own running minimum,
and its next tracked life starts at the following occurrence. The state machine
is thus a running sum and a running minimum, both of which can be computed in
chunks; a key that fills a third of the stream is cut like any other.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.chunked import CHUNK, chunk_of, chunked_rank, chunked_running_sum
from keytide.functions.joins import small_join
from keytide.session import materialize

# Buckets per chunk.
BUCKET_CHUNK = 100_000
CARRIED_COLUMNS = ("carried", "hot_bucket", "hot_count")


def bucket_width(epsilon: float) -> int:
    return math.floor(1 / epsilon)


def hot_threshold(epsilon: float, support: float) -> float:
    """In doubles and in this order: (0.01 - 0.001) * 1000 is slightly above 9."""
    return (support - epsilon) * bucket_width(epsilon)


def assign_buckets(
    messages: DataFrame, epsilon: float, sampled: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Add ``n``, the rank among the counted messages, and their ``bucket``.

    ``messages`` carries ``seq``. Unless it was ``sampled``, n is seq itself.
    """
    if sampled:
        ranked = chunked_rank(
            messages.withColumn("_chunk", chunk_of("seq", chunk)), ["topic"], ["seq"], ["_chunk"], "n"
        ).drop("_chunk")
    else:
        ranked = messages.withColumn("n", F.col("seq"))
    width = bucket_width(epsilon)
    return ranked.withColumn("bucket", F.floor((F.col("n") - 1) / width).cast("long") + 1)


def turnovers(bucketed: DataFrame, epsilon: float) -> DataFrame:
    """Complete buckets of each topic, from the message closing each: no shuffle."""
    width = bucket_width(epsilon)
    return bucketed.where(F.col("n") % width == 0).select(
        "topic",
        "bucket",
        F.lit(width).cast("long").alias("n_messages"),
        F.col("seq").alias("close_seq"),
    )


def bucket_counts(bucketed: DataFrame) -> DataFrame:
    """Occurrences of each key in each bucket."""
    return bucketed.groupBy("topic", "key", "bucket").agg(
        F.count(F.lit(1)).alias("c"), F.min("n").alias("first_n")
    )


def scan_buckets(
    counts: DataFrame, full: DataFrame, bucket_chunk: int, max_bucket: int | None
) -> DataFrame:
    """Per (key, bucket): life start, occurrences since, and the next occurrence.

    ``counts`` may carry earlier lives into a later batch of a stream: a row at the
    start bucket with all occurrences so far, ``carried`` true, and when it was hot.
    """
    complete = small_join(counts, full, ["topic"]).where(F.col("bucket") <= F.col("full"))
    if max_bucket is None:
        max_bucket = full.agg(F.max("full")).first()[0] or 0
    key = ["topic", "key"]
    before_own = F.col("c_sum") - F.col("c") - 2 * (F.col("bucket") - 1)

    def lifelines(rows: DataFrame, inside: W) -> DataFrame:
        upto = inside.rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("c_sum", F.sum("c").over(upto))
        rows = rows.withColumn("low", F.struct(before_own.alias("p"), F.col("bucket").alias("b")))
        return rows.withColumns(
            {"low": F.min("low").over(upto), "next_bucket": F.lead("bucket").over(inside)}
        )

    if max_bucket < bucket_chunk:
        scanned = lifelines(complete, W.partitionBy(*key).orderBy("bucket"))
    else:
        cut = materialize(complete.withColumn("_chunk", chunk_of("bucket", bucket_chunk)), "buckets")
        local = lifelines(cut, W.partitionBy(*key, "_chunk").orderBy("bucket"))
        summary = local.groupBy(*key, "_chunk").agg(
            F.sum("c").alias("_c"), F.min("low").alias("_low"), F.min("bucket").alias("_first")
        )
        over_chunks = W.partitionBy(*key).orderBy("_chunk")
        earlier = over_chunks.rowsBetween(W.unboundedPreceding, -1)
        carry = summary.withColumn("_base", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        carry = carry.withColumn(
            "_low",
            F.struct(
                (F.col("_low.p") + F.col("_base")).alias("p"), F.col("_low.b").alias("b")
            ),
        ).withColumns(
            {
                "_carry": F.min("_low").over(earlier),
                "_next": F.lead("_first").over(over_chunks),
            }
        )
        scanned = (
            local.join(carry.select(*key, "_chunk", "_base", "_carry", "_next"), [*key, "_chunk"])
            .withColumn("c_sum", F.col("c_sum") + F.col("_base"))
            .withColumn(
                "low",
                F.least(
                    F.struct(
                        (F.col("low.p") + F.col("_base")).alias("p"), F.col("low.b").alias("b")
                    ),
                    F.col("_carry"),
                ),
            )
            .withColumn("next_bucket", F.coalesce("next_bucket", "_next"))
        )
    start = F.col("low.b")
    seen = F.col("c_sum") - F.col("low.p") - 2 * (start - 1)
    extra = [c for c in CARRIED_COLUMNS if c in counts.columns]
    return scanned.select(
        *key, "bucket", "c", "first_n", "full", "next_bucket", *extra,
        start.alias("start_bucket"), seen.alias("seen"),
    )


def _kept() -> Column:
    return F.col("seen") >= 2 * (F.col("bucket") - F.col("start_bucket") + 1)


def _count_at(bucket: Column) -> Column:
    return F.col("seen") - (bucket - F.col("start_bucket") + 1)


def _full_buckets(bucketed: DataFrame, epsilon: float) -> DataFrame:
    width = bucket_width(epsilon)
    return bucketed.groupBy("topic").agg(
        F.floor(F.count(F.lit(1)) / width).cast("long").alias("full")
    )


def lossy_lifecycles(
    bucketed: DataFrame,
    epsilon: float,
    support: float,
    max_bucket: int | None = None,
    bucket_chunk: int = BUCKET_CHUNK,
) -> DataFrame:
    """One row per tracked life of a key.

    ``end_bucket`` is the turnover that drops it (NULL: still tracked after the last
    complete bucket), ``hot_bucket`` and ``hot_count`` the first turnover at which
    it is hot and its count then, ``insert_n`` its place in visiting order.
    ``max_bucket`` may be any upper bound on the bucket ids; it saves a look at them.
    """
    scan = scan_buckets(
        bucket_counts(bucketed), _full_buckets(bucketed, epsilon), bucket_chunk, max_bucket
    )
    return lives_of(scan, epsilon, support)


def lives_of(scan: DataFrame, epsilon: float, support: float) -> DataFrame:
    count = _count_at(F.col("bucket"))
    is_hot = _kept() & (count.cast("double") >= F.lit(hot_threshold(epsilon, support)))
    hot_bucket, hot_count = F.when(is_hot, F.col("bucket")), F.when(is_hot, count)
    if "carried" in scan.columns:
        hot_bucket = F.when(F.col("carried"), F.col("hot_bucket")).otherwise(hot_bucket)
        hot_count = F.when(F.col("carried"), F.col("hot_count")).otherwise(hot_count)
    # Numbers only in the buffers, so that this is a hash aggregation.
    lives = scan.groupBy("topic", "key", "start_bucket").agg(
        F.sum("c").alias("seen"),
        F.min("first_n").alias("insert_n"),
        F.max("full").alias("full"),
        F.min(hot_bucket).alias("hot_bucket"),
        F.min_by(hot_count, hot_bucket).alias("hot_count"),
    )
    drop_at = F.col("start_bucket") + F.floor(F.col("seen") / 2).cast("long")
    dropped = drop_at <= F.col("full")
    return lives.select(
        "topic",
        "key",
        "start_bucket",
        F.when(dropped, drop_at).alias("end_bucket"),
        "seen",
        "insert_n",
        F.when(~dropped, F.col("seen") - (F.col("full") - F.col("start_bucket") + 1)).alias("count"),
        F.when(dropped, "evicted").otherwise("tracked").alias("status"),
        "hot_bucket",
        "hot_count",
    )


def lossy_items(
    bucketed: DataFrame,
    epsilon: float,
    support: float,
    max_bucket: int | None = None,
    bucket_chunk: int = BUCKET_CHUNK,
) -> DataFrame:
    """The tracked keys with their counts after every turnover, and whether hot."""
    scan = scan_buckets(
        bucket_counts(bucketed), _full_buckets(bucketed, epsilon), bucket_chunk, max_bucket
    ).where(_kept())
    # Without another occurrence the key is kept until the bucket before it is dropped.
    alive_to = F.col("start_bucket") + F.floor(F.col("seen") / 2).cast("long") - 1
    last = F.least(alive_to, F.col("full"), F.coalesce(F.col("next_bucket") - 1, F.col("full")))
    # Long silences are unfolded in two steps, so no row ever holds a long array.
    stretches = scan.withColumn("_last", last).withColumn(
        "_from", F.explode(F.sequence("bucket", "_last", F.lit(bucket_chunk)))
    )
    upto = F.least(F.col("_last"), F.col("_from") + bucket_chunk - 1)
    turns = stretches.withColumn("turn", F.explode(F.sequence(F.col("_from"), upto)))
    count = _count_at(F.col("turn"))
    return turns.select(
        "topic",
        "key",
        F.col("turn").alias("bucket"),
        count.alias("count"),
        (F.col("start_bucket") - 1).alias("delta"),
        (count.cast("double") >= F.lit(hot_threshold(epsilon, support))).alias("is_hot"),
    )


def hot_keys(lives: DataFrame) -> DataFrame:
    """Promotions: the first hot turnover of each life that has one."""
    return lives.where(F.col("hot_bucket").isNotNull()).select(
        "topic", "key", F.col("hot_bucket").alias("bucket"), F.col("hot_count").alias("count"), "insert_n"
    )


def evictions(lives: DataFrame) -> DataFrame:
    """Keys dropped from the sketch; ``was_hot`` tells which were on the map."""
    return lives.where(F.col("end_bucket").isNotNull()).select(
        "topic",
        "key",
        F.col("end_bucket").alias("bucket"),
        "insert_n",
        F.col("hot_bucket").isNotNull().alias("was_hot"),
    )


def sketch_stats(
    lives: DataFrame, turns: DataFrame, bucket_chunk: int = BUCKET_CHUNK
) -> DataFrame:
    """Messages and tracked keys at each turnover, from starts and ends alone."""
    last = F.col("end_bucket")
    counted = lives.where(last.isNull() | (last > F.col("start_bucket")))
    steps = counted.select("topic", F.col("start_bucket").alias("bucket"), F.lit(1).alias("step"))
    steps = steps.unionByName(
        counted.where(last.isNotNull()).select(
            "topic", last.alias("bucket"), F.lit(-1).alias("step")
        )
    )
    changes = steps.groupBy("topic", "bucket").agg(F.sum("step").alias("step"))
    dense = turns.join(changes, ["topic", "bucket"], "left").select(
        "topic", "bucket", "n_messages", F.coalesce("step", F.lit(0)).alias("step"),
        chunk_of("bucket", bucket_chunk).alias("_chunk"),
    )
    return chunked_running_sum(
        dense, ["topic"], ["bucket"], ["_chunk"], "step", "tracked"
    ).select("topic", "bucket", "n_messages", "tracked")

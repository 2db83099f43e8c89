"""Sampling, exact key counts and the reports made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.hashing import msg_uniform
from keytide.functions.headers import producer_headers


def sample_messages(
    messages: DataFrame, threshold: float, seed: int | None = None, by: str = "msg_id"
) -> DataFrame:
    """Keep a message when its uniform is at least ``threshold``.

    The share kept is thus ``1 - threshold``. Without a seed the uniform is derived
    from the message id, so a replay samples the same messages.
    """
    uniform = msg_uniform(F.col(by)) if seed is None else F.rand(seed)
    return messages.where(uniform >= F.lit(float(threshold)))


def with_producer_header(messages: DataFrame, producer: str | Column) -> DataFrame:
    """Attach the producer's id as a record header."""
    who = F.col(producer) if isinstance(producer, str) else producer
    return messages.withColumn("headers", producer_headers(who))


def key_counts(messages: DataFrame) -> DataFrame:
    """Messages per key, counted exactly; partial sums are formed before the shuffle."""
    return messages.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("count"))


def heavy_keys(counts: DataFrame, min_count: int = 100) -> DataFrame:
    """Keys with more than ``min_count`` messages."""
    return counts.where(F.col("count") > min_count)


def freq_report(counts: DataFrame, keyspace: int | None = None, min_count: int = 100) -> DataFrame:
    """One row per topic: how much of the traffic the heavy keys carry.

    ``keyspace`` is the number of keys there could be; by default all that occur in any topic.
    """
    heavy = F.col("count") > min_count
    keys = F.lit(keyspace) if keyspace is not None else counts.agg(F.count_distinct("key")).scalar()
    return counts.groupBy("topic").agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(heavy).alias("heavy_keys"),
        F.coalesce(F.sum(F.when(heavy, F.col("count"))), F.lit(0)).alias("heavy_requests"),
        F.sum("count").alias("total_requests"),
        keys.cast("long").alias("keyspace"),
    )

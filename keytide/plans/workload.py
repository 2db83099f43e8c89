"""Views over the driver's tables that give them the shape of a keyed stream.

All derivations use integer arithmetic, so other engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.chunked import with_sequence
from keytide.functions.hashing import fnv_partition
from keytide.operators.frequency import key_counts
from keytide.operators.latency import KEY_TAG, PARTITION_TAG, PROCESS, PRODUCE, RECEIVE
from keytide.session import materialize

# Parameters of the registered queries.
N_PARTITIONS = 10
EPSILON = 0.01
SUPPORT = 0.05
REBALANCE_EVERY = 2
REBALANCE_SECONDS = 6 * 3600
SAMPLE_THRESHOLD = 0.5
# The given log maps every third key, in as many intervals, each a third of its topic.
GIVEN_INTERVALS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def keynum() -> Column:
    """Number in the key, strongly skewed: a cubed residue spread over 40 values.

    Every eighth message has one of the rare keys instead, four messages each, so the number
    of keys grows with the stream.
    """
    return F.expr(
        "CASE WHEN event_id % 8 = 5 THEN 40 + event_id div 32 "
        "ELSE x * x * x * 40L div 1027243729L END"
    )


def keyed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, ts, topic, key, body: the first key has a quarter of all messages."""
    x = F.expr("(event_id * 7919L) % 1009L")
    return (
        events(spark, sf_dir)
        .select("event_id", "ts", "event_type", x.alias("x"))
        .select(
            F.col("event_id").alias("msg_id"),
            "ts",
            F.col("event_type").alias("topic"),
            F.concat(F.lit("location_"), keynum().cast("string")).alias("key"),
        )
        .withColumn("body", F.concat("key", F.lit(" message body")))
    )


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns routing needs, with ``seq``."""
    narrow = keyed_messages(spark, sf_dir).select("msg_id", "ts", "topic", "key")
    return with_sequence(narrow)


def sequenced_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, stored: for queries that read the messages more than once."""
    return materialize(sequenced(spark, sf_dir), "sequenced")


def spread(df: DataFrame) -> DataFrame:
    """Give all cores work where a table comes in fewer splits than there are cores.

    A large table has many splits and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hot_map_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of all keys with their counts; every key sits on its hash partition."""
    counts = key_counts(keyed_messages(spark, sf_dir))
    given = counts.withColumn("partition", fnv_partition(F.col("key"), N_PARTITIONS))
    return materialize(given, "hot-map")


def given_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, step: messages of a given interval, one row per topic."""
    topics = keyed_messages(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return topics.select("topic", F.expr(f"greatest(n div {GIVEN_INTERVALS}, 1)").alias("step"))


def hot_map_log_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals of every third key, the last one open.

    Keys whose number is a multiple of four change interval, but not partition.
    """
    num = F.expr("CAST(substr(key, 10) AS BIGINT)")
    keys = keyed_messages(spark, sf_dir).select("topic", "key").distinct()
    versions = (
        keys.withColumn("num", num)
        .where("num % 3 = 0")
        .join(given_intervals(spark, sf_dir), "topic")
        .withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(GIVEN_INTERVALS - 1))))
    )
    moved = F.when(F.col("num") % 4 == 0, 0).otherwise(F.col("v"))
    start = (F.col("v") * F.col("step") + 1).cast("long")
    log = versions.select(
        "topic",
        "key",
        (F.col("num") * 10 + F.col("v") + 1).cast("long").alias("count"),
        ((F.col("num") * 3 + moved) % N_PARTITIONS).cast("int").alias("partition"),
        start.alias("valid_from"),
        F.when(F.col("v") < GIVEN_INTERVALS - 1, start + F.col("step")).alias("valid_to"),
    )
    return materialize(log, "map-log")


def hot_map_events_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history as change events, plus one eviction of key 9 in the last interval."""
    log = hot_map_log_given(spark, sf_dir)
    changes = log.select(
        "topic",
        "key",
        (F.col("valid_from") - 1).alias("seq"),
        F.when(F.col("valid_from") == 1, "promote").otherwise("move").alias("op"),
        "count",
        "partition",
    )
    last = log.where((F.col("key") == "location_9") & F.col("valid_to").isNull())
    evicted = last.select(
        "topic",
        "key",
        F.expr(f"(valid_from - 1) * (2 * {GIVEN_INTERVALS} - 1) div (2 * {GIVEN_INTERVALS - 1})").alias("seq"),
        F.lit("evict").alias("op"),
        "count",
        "partition",
    )
    return changes.unionByName(evicted)


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery acknowledgements; every 97th message failed."""
    messages = keyed_messages(spark, sf_dir)
    return messages.select(
        "topic",
        fnv_partition(F.col("key"), N_PARTITIONS).alias("partition"),
        "msg_id",
        "ts",
        (F.col("msg_id") % 97 != 0).alias("ok"),
    )


# Template texts of the ingest check, chosen by ``event_id % 7``.
def raw_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request texts: two of seven kinds are valid."""
    text = F.expr(
        """CASE event_id % 7
             WHEN 0 THEN concat('{"key":"location_', event_id % 40, '","body":"b', event_id, '"}')
             WHEN 1 THEN concat('{"KEY":"location_', event_id % 40, '"}')
             WHEN 2 THEN concat('{"key":', event_id, '}')
             WHEN 3 THEN concat('{"key":"k","extra":', event_id, '}')
             WHEN 4 THEN concat('{"key":"k', event_id, '"')
             WHEN 5 THEN concat('{"key":"k"} {"key":"', event_id, '"}')
             ELSE '   ' END"""
    )
    return spread(table(spark, sf_dir, "events").select("event_id")).select(
        "event_id", text.alias("raw")
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace of three spans per event; every 11th lacks a span, every 13th a tag."""
    messages = keyed_messages(spark, sf_dir).select("msg_id", "key", F.unix_micros("ts").alias("us"))
    messages = spread(messages)
    key_tag = F.struct(F.lit(KEY_TAG).alias("key"), F.col("key").alias("value"))
    partition_tag = F.struct(
        F.lit(PARTITION_TAG).alias("key"),
        fnv_partition(F.col("key"), N_PARTITIONS).cast("string").alias("value"),
    )
    other = F.struct(F.lit("sending-gateway").alias("key"), F.lit("10.1.0.1").alias("value"))
    no_partition = F.col("msg_id") % 13 == 0
    tags = F.when(no_partition, F.array(key_tag, other)).otherwise(
        F.array(partition_tag, key_tag, other)
    )
    none = F.array().cast("array<struct<key:string,value:string>>")

    def span(operation: str, shift: Column, extra: int, process: str, tag: Column) -> Column:
        return F.struct(
            F.lit(operation).alias("operationName"),
            (F.col("us") + shift).alias("startTime"),
            (F.col("msg_id") % 1000 + extra).alias("duration"),
            F.lit(process).alias("processID"),
            tag.alias("tags"),
        )

    zero = F.lit(0).cast("long")
    produced = span(PRODUCE, zero, 1, "p1", none)
    received = span(RECEIVE, F.col("msg_id") % 500, 2, "p2", none)
    processed = span(PROCESS, F.col("msg_id") % 900, 3, "p2", tags)
    spans = F.when(F.col("msg_id") % 11 == 0, F.array(produced, processed)).otherwise(
        F.array(produced, received, processed)
    )
    processes = F.create_map(
        F.lit("p1"), F.struct(F.lit("producer").alias("serviceName")),
        F.lit("p2"), F.struct(F.lit("consumer").alias("serviceName")),
    )
    return messages.select(
        F.col("msg_id").cast("string").alias("traceID"),
        spans.alias("spans"),
        processes.alias("processes"),
    )


def endpoint_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert per supplier under its nation's name, then deletes of every fifth nation."""
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    ip = F.concat(
        F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."),
        (F.col("s_suppkey") % 250).cast("string"),
    )
    address = F.array(F.struct(F.array(F.struct(ip.alias("ip"))).alias("addresses")))
    upserts = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("feed_seq"),
        F.lit("default").alias("namespace"),
        F.col("n_name").alias("service"),
        F.lit("upsert").alias("op"),
        address.alias("subsets"),
    )
    deletes = nations.where("n_nationkey % 5 = 0").select(
        (F.lit(1_000_000_000_000) + F.col("n_nationkey")).alias("feed_seq"),
        F.lit("default").alias("namespace"),
        F.col("n_name").alias("service"),
        F.lit("delete").alias("op"),
        F.lit(None).cast("array<struct<addresses:array<struct<ip:string>>>>").alias("subsets"),
    )
    return upserts.unionByName(deletes)


def endpoints(spark: SparkSession) -> DataFrame:
    """Four fixed endpoints, the gateway's configuration."""
    return spark.range(4).select(
        F.col("id").cast("int").alias("endpoint_idx"),
        F.concat(F.lit("10.2.0."), (F.col("id") + 1).cast("string")).alias("ip"),
    )

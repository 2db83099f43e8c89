"""Latencies from traces."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.chunked import chunk_of

# Operation names and tags as the traced programs write them.
PRODUCE = "produce message"
PROCESS = "print message"
RECEIVE = "OrderGo receive"
PARTITION_TAG = "message_bus.destination"
KEY_TAG = "consumer.key"

# Values of a group that are counted up together.
VALUE_CHUNK = 4_096

# Columns of the latency table, in order.
LATENCY_COLUMNS = (
    "traceID",
    "Rcv_Duration",
    "Print_Duration",
    "Partition",
    "Key",
    "StartTimeDiff",
)


def span_of(operation: str) -> Column:
    """Last span of an operation in ``spans``; NULL when the trace lacks it."""
    return F.try_element_at(
        F.filter("spans", lambda s: s["operationName"] == operation), F.lit(-1)
    )


def tag_of(span: Column, name: str) -> Column:
    """Value of the last tag called ``name``; NULL when the span lacks it."""
    return F.try_element_at(F.filter(span["tags"], lambda t: t["key"] == name), F.lit(-1))["value"]


def trace_spans(traces: DataFrame) -> DataFrame:
    """Traces that have all three spans: traceID, produced, processed, received.

    Unfolding the one kept struct, rather than filtering on it, finds each span once.
    """
    found = F.struct(
        span_of(PRODUCE).alias("produced"),
        span_of(PROCESS).alias("processed"),
        span_of(RECEIVE).alias("received"),
    )

    def complete(trace: Column) -> Column:
        return (
            trace["produced"].isNotNull()
            & trace["processed"].isNotNull()
            & trace["received"].isNotNull()
        )

    return traces.select("traceID", F.inline(F.filter(F.array(found), complete)))


def trace_tags(spans: DataFrame) -> DataFrame:
    """Partition and key of each trace, from the tags of the processing span."""
    return spans.withColumns(
        {
            "Partition": tag_of(F.col("processed"), PARTITION_TAG),
            "Key": tag_of(F.col("processed"), KEY_TAG),
        }
    )


def trace_latency(traces: DataFrame, intervals: bool = False) -> DataFrame:
    """Receive and processing time, and the delay from produce to receive.

    Durations are microseconds, or day-time intervals if asked for. Row by row,
    without a shuffle.
    """
    tagged = trace_tags(trace_spans(traces))

    def duration(col: Column) -> Column:
        if not intervals:
            return col
        return F.make_dt_interval(secs=(col / F.lit(1_000_000)).cast("decimal(18,6)"))

    return tagged.select(
        "traceID",
        duration(F.col("received.duration")).alias("Rcv_Duration"),
        duration(F.col("processed.duration")).alias("Print_Duration"),
        "Partition",
        "Key",
        duration(F.col("received.startTime") - F.col("produced.startTime")).alias("StartTimeDiff"),
    )


def latency_by(
    latency: DataFrame,
    by: Sequence[str],
    partition: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """Processing times by partition, key or both, optionally for one of them only.

    Percentiles are exact, the smallest value that at least their share of a group's values
    does not exceed, and found in two levels: counts per chunk of values tell which chunk holds the
    rank, and only values of that chunk are looked at. Traces are read once; all that follows
    works on counts of different values, so no group is gathered in one task.
    """
    kept = latency
    if partition is not None:
        kept = kept.where(F.col("Partition") == partition)
    if key is not None:
        kept = kept.where(F.col("Key") == key)
    by = list(by)
    values = (
        kept.groupBy(*by, F.col("Print_Duration").alias("_took"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_chunk", chunk_of("_took", VALUE_CHUNK))
    )
    chunks = values.groupBy(*by, "_chunk").agg(
        F.sum("_n").alias("_n"),
        F.sum(F.col("_n") * F.col("_took")).alias("_sum"),
        F.min("_took").alias("_min"),
        F.max("_took").alias("_max"),
    )
    group = W.partitionBy(*by)
    timed = F.when(F.col("_chunk").isNotNull(), F.col("_n")).otherwise(0)
    upto = F.sum(timed).over(group.orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0))
    chunks = chunks.withColumns({"_upto": upto, "_timed": F.sum(timed).over(group)})
    stats = chunks.groupBy(*by).agg(
        F.sum("_n").alias("traces"),
        F.sum("_sum").alias("total_us"),
        F.min("_min").alias("min_us"),
        F.max("_max").alias("max_us"),
        (F.sum("_sum") / F.max("_timed")).alias("avg_us"),
    )
    before = F.col("_upto") - F.col("_n")
    holds = lambda q: (before < F.col("_timed") * q) & (F.col("_upto") >= F.col("_timed") * q)
    wanted = chunks.where(F.col("_chunk").isNotNull() & (holds(0.5) | holds(0.99))).select(
        *[F.col(c).alias(f"_of_{c}") for c in [*by, "_chunk"]], before.alias("_before"), "_timed"
    )
    # NULL groups meet as well
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_chunk"]]
    looked_at = values.join(wanted, reduce(and_, same))
    inside = W.partitionBy(*by, "_chunk").orderBy("_took").rowsBetween(W.unboundedPreceding, 0)
    looked_at = looked_at.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.col("_timed") * q, F.col("_took")))

    found = looked_at.groupBy(*by).agg(at(0.5).alias("p50_us"), at(0.99).alias("p99_us"))
    columns = ("traces", "total_us", "min_us", "max_us", "avg_us", "p50_us", "p99_us")
    both = stats.unionByName(found, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(c).alias(c) for c in columns])


def flat_spans(traces: DataFrame) -> DataFrame:
    """One row per span."""
    return traces.select("traceID", F.posexplode("spans").alias("span_no", "span")).select(
        F.col("traceID").alias("trace_id"),
        "span_no",
        F.col("span.operationName").alias("operation"),
        F.col("span.startTime").alias("start_us"),
        F.col("span.duration").alias("duration_us"),
        F.col("span.tags").alias("tags"),
    )


def pivot_spans(spans: DataFrame) -> DataFrame:
    """The flat counterpart of ``trace_spans``: one row per trace with all three spans."""

    def last_of(operation: str, value: str) -> Column:
        hit = F.col("operation") == operation
        return F.max_by(F.when(hit, F.col(value)), F.when(hit, F.col("span_no")))

    names = {"produced": PRODUCE, "processed": PROCESS, "received": RECEIVE}
    values = ("start_us", "duration_us")
    # Plain numbers as aggregation buffers: hashed, not sorted.
    pivoted = spans.groupBy("trace_id").agg(
        *[last_of(op, v).alias(f"{name}_{v}") for name, op in names.items() for v in values]
    )
    kept = pivoted.dropna(subset=[f"{name}_start_us" for name in names])
    return kept.select(
        "trace_id",
        *[
            F.struct(*[F.col(f"{name}_{v}").alias(v) for v in values]).alias(name)
            for name in names
        ],
    )


def correlate_spans(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """Producer and consumer side of each trace, with the delay between them."""
    left = produced.select("trace_id", F.col("start_us").alias("produce_us"))
    right = consumed.select("trace_id", F.col("start_us").alias("consume_us"), "duration_us")
    return left.join(right, "trace_id").withColumn(
        "delay_us", F.col("consume_us") - F.col("produce_us")
    )

"""Joins of the message stream with small and not so small tables.

The stream side is the skewed one. A table is broadcast only after its rows and bytes have
been counted; beyond the limit each join has a shuffled form in which no key
forms one big group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytide.functions.chunked import CHUNK, chunk_of

# What may be broadcast: so many rows, and so many bytes of values.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# Intervals of a key that a message may be held against one by one.
PROBES = 16
# A key with more than 1/HEAVY_SHARE of all rows is joined apart; so at most
# HEAVY_SHARE keys can be heavy, whatever the data.
HEAVY_SHARE = 10_000


def value_bytes(df: DataFrame) -> Column:
    """About how many bytes the values of a row take."""
    sizes = []
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(field.name), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    return sum(sizes[1:], sizes[0]).cast("long")


def may_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Counts rows and the bytes of their values, of at most one row more than allowed."""
    some = df.select(value_bytes(df).alias("b")).limit(rows + 1)
    seen = some.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= most


@dataclass(frozen=True)
class IntervalPlan:
    """How to join messages with validity intervals.

    A broadcast table with a ``chunk`` is cut at multiples of it, up to ``horizon``, into at
    most as many rows as may be broadcast. In the shuffled form the chunk cuts messages.
    """

    broadcast: bool
    chunk: int | None = None
    horizon: int | None = None


def plan_interval_join(
    intervals: DataFrame,
    on: Sequence[str],
    facts: DataFrame,
    at: str,
    broadcast_rows: int = BROADCAST_ROWS,
    chunk: int = CHUNK,
) -> IntervalPlan:
    """Count the intervals: only a table of checked size is broadcast.

    Where some key has many intervals, they are cut into chunks small enough for a
    message to meet but a few of them, if the pieces still fit the limit.
    """
    measured = intervals.agg(F.count(F.lit(1)).alias("n"), F.sum(value_bytes(intervals)).alias("b")).first()
    rows = measured["n"]
    if (measured["b"] or 0) > BROADCAST_BYTES:
        return IntervalPlan(broadcast=False, chunk=chunk)
    if rows <= broadcast_rows and rows <= PROBES:
        return IntervalPlan(broadcast=True)
    per_key = intervals.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    seen = per_key.agg(F.max("n").alias("widest"), F.count(F.lit(1)).alias("keys")).first()
    if rows <= broadcast_rows and seen["widest"] <= PROBES:
        return IntervalPlan(broadcast=True)
    horizon = facts.agg(F.max(at)).first()[0] or 1
    pieces = -(-(seen["widest"] or 1) // PROBES)
    cut_rows = rows + seen["keys"] * pieces
    if cut_rows <= broadcast_rows and measured["b"] * cut_rows <= BROADCAST_BYTES * rows:
        return IntervalPlan(broadcast=True, chunk=-(-horizon // pieces), horizon=horizon)
    return IntervalPlan(broadcast=False, chunk=chunk)


def _cut(intervals: DataFrame, plan: IntervalPlan, start: str, end: str) -> DataFrame:
    """One row per interval and chunk it reaches into."""
    last_at = F.least(F.coalesce(F.col(end) - 1, F.lit(plan.horizon)), F.lit(plan.horizon))
    return intervals.where(F.col(start) <= last_at).withColumn(
        "_chunk",
        F.explode(F.sequence(chunk_of(start, plan.chunk), chunk_of(last_at, plan.chunk))),
    )


def interval_join(
    facts: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    plan: IntervalPlan,
    start: str = "valid_from",
    end: str = "valid_to",
) -> DataFrame:
    """Left join: the interval ``start <= at < end`` (NULL end: open) of each fact.

    The intervals of one key do not overlap. A table of checked size is broadcast and
    found by key (and chunk), the range being a residual; the stream is not shuffled.
    Otherwise facts and intervals are sorted together within key and chunk and each
    fact takes the last interval that began: linear however many a key has, and a hot
    key is spread over as many groups as its messages fill chunks. An interval is there
    once, and once more in each later chunk of its key that begins inside it and has facts
    or starts; how long it lasts doesn't matter.
    """
    on = list(on)
    if plan.broadcast:
        return _probe(facts, intervals, on, at, plan, start, end)
    return _merge(facts, intervals, on, at, plan, start, end)


def _probe(facts, intervals, on, at, plan, start, end) -> DataFrame:
    keys, left, right = on, facts, intervals
    if plan.chunk is not None:
        keys = [*on, "_chunk"]
        left = facts.withColumn("_chunk", chunk_of(at, plan.chunk))
        right = _cut(intervals, plan, start, end)
    renamed = F.broadcast(
        right.select(
            *[F.col(c).alias(f"_r_{c}") for c in keys],
            *[F.col(c) for c in right.columns if c not in keys],
        )
    )
    condition = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_r_{key}"))
    joined = left.join(renamed, condition, "left")
    return joined.drop(*[f"_r_{k}" for k in keys], "_chunk")


def _begun(facts, intervals, on, at, plan, start, end) -> DataFrame:
    """Intervals where they start, and what each chunk finds as the last one begun before it."""
    payload = [c for c in intervals.columns if c not in on]
    lasting = intervals.where(F.col(end).isNull() | (F.col(end) > F.col(start)))
    own = lasting.select(
        *on,
        chunk_of(start, plan.chunk).alias("_chunk"),
        F.col(start).alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct(*payload).alias("_hit"),
    )
    visited = facts.select(*on, chunk_of(at, plan.chunk).alias("_chunk")).distinct()
    last = (
        own.unionByName(visited, allowMissingColumns=True)
        .groupBy(*on, "_chunk")
        .agg(F.max_by("_hit", "_at").alias("_newest"))
    )
    earlier = W.partitionBy(*on).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = last.withColumn("_hit", F.last("_newest", ignorenulls=True).over(earlier)).select(
        *on,
        "_chunk",
        (F.col("_chunk") * plan.chunk).alias("_at"),
        F.lit(-1).alias("_kind"),
        "_hit",
    )
    return own.unionByName(carried.where(F.col("_hit").isNotNull()))


def _merge(facts, intervals, on, at, plan, start, end) -> DataFrame:
    payload = [c for c in intervals.columns if c not in on]
    rest = [c for c in facts.columns if c not in on]
    right = _begun(facts, intervals, on, at, plan, start, end)
    left = facts.select(
        *on,
        chunk_of(at, plan.chunk).alias("_chunk"),
        F.col(at).alias("_at"),
        F.lit(1).alias("_kind"),
        F.struct(*rest).alias("_fact"),
    )
    line = left.unionByName(right, allowMissingColumns=True)
    so_far = (
        W.partitionBy(*on, "_chunk")
        .orderBy("_at", "_kind")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    merged = line.withColumn("_last", F.last("_hit", ignorenulls=True).over(so_far)).where(
        F.col("_kind") == 1
    )
    valid = F.col(f"_last.{end}").isNull() | (F.col("_at") < F.col(f"_last.{end}"))
    merged = merged.withColumn("_last", F.when(valid, F.col("_last")))
    columns = {c: F.col(f"_fact.{c}") for c in rest} | {c: F.col(f"_last.{c}") for c in payload}
    named = [columns[c].alias(c) if c in columns else F.col(c) for c in facts.columns]
    return merged.select(*named, *[columns[c].alias(c) for c in payload])


def small_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join with a table that is unique on ``on`` and has few of its values, so that an
    equi-join alone would put a value's facts into one task."""
    marked = table.withColumn("_matched", F.lit(True))
    return dimension_join(facts, marked, on, broadcast_rows).where("_matched").drop("_matched")


def dimension_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join with a table that is unique on ``on``, safe against hot keys.

    A counted small table is broadcast. Otherwise the heavy keys, of which there
    are at most HEAVY_SHARE by the definition of heavy, are joined by broadcast
    and all other keys by a shuffle.
    """
    on = list(on)
    if may_broadcast(dimension, broadcast_rows):
        return facts.join(F.broadcast(dimension), on, "left")
    floor = facts.count() // HEAVY_SHARE + 1
    heavy = (
        facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > floor)
    ).select(*on)
    hot = facts.join(F.broadcast(heavy), on, "left_semi").join(
        F.broadcast(dimension.join(F.broadcast(heavy), on, "left_semi")), on, "left"
    )
    cold = facts.join(F.broadcast(heavy), on, "left_anti").join(dimension, on, "left")
    return hot.unionByName(cold)

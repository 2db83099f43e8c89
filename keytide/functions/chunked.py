"""Ordered scans that never put a whole group into one task.

A plain window over a key keeps all rows of that key in one task, and in this
engine one key, topic or partition may well hold a third of everything. Each
scan here is therefore done in two levels: inside chunks of a group, which are
of bounded size, and over one summary row per chunk.

Where the order column is a dense number (sequence, offset, bucket) a chunk is
plain arithmetic. Only the arrival order ``(ts, msg_id)`` is not dense; there
``with_sequence`` cuts slices at sampled bounds, as a range partitioner would.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values of a dense order column per chunk, and rows per slice of an arrival order.
CHUNK = 1_000_000
SLICE_ROWS = 2_000_000
# Rows sampled per slice, and the most slices one literal of bounds may carry.
SAMPLE_PER_SLICE = 32
MAX_SLICES = 16_384


def chunk_of(dense: str | Column, size: int) -> Column:
    col = F.col(dense) if isinstance(dense, str) else dense
    return F.floor(col / F.lit(size)).cast("long")


def fits_one_task(df: DataFrame, rows: int) -> bool:
    """Whether all of ``df`` is no more than ``rows``; on a stored table a look at footers."""
    return df.count() <= rows


def plain_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``chunked_rank`` for data known to fit one task."""
    whole = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(whole).cast("long"))


def _before(group: Sequence[str], chunk: Sequence[str]) -> W:
    return W.partitionBy(*group).orderBy(*chunk).rowsBetween(W.unboundedPreceding, -1)


def chunked_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str], chunk: Sequence[str], out: str
) -> DataFrame:
    """1-based rank of each row of a group by ``order``.

    ``chunk`` names columns that are non-decreasing in ``order``; they are kept.
    """
    group, chunk = list(group), list(chunk)
    totals = df.groupBy(*group, *chunk).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = totals.withColumn(
        "_offset", F.coalesce(F.sum("_rows").over(_before(group, chunk)), F.lit(0))
    ).drop("_rows")
    inside = W.partitionBy(*group, *chunk).orderBy(*order)
    return (
        df.withColumn(out, F.row_number().over(inside).cast("long"))
        .join(offsets, [*group, *chunk])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_offset")
    )


def chunked_lag(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    chunk: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Value of the preceding row of the group in ``order`` (NULL for the first)."""
    group, chunk = list(group), list(chunk)
    within = [c for c in order if c not in chunk]
    latest = F.col(within[0]) if len(within) == 1 else F.struct(*within)
    last = df.groupBy(*group, *chunk).agg(F.max_by(value, latest).alias("_last"))
    carried = last.withColumn(
        "_carry", F.lag("_last").over(W.partitionBy(*group).orderBy(*chunk))
    ).drop("_last")
    inside = W.partitionBy(*group, *chunk).orderBy(*order)
    return (
        df.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn(out, F.lag(value).over(inside))
        .join(carried, [*group, *chunk])
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out)))
        .drop("_first", "_carry")
    )


def chunked_running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    chunk: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Running sum of ``value`` over the group in ``order``, current row included."""
    group, chunk = list(group), list(chunk)
    totals = df.groupBy(*group, *chunk).agg(F.sum(value).alias("_total"))
    offsets = totals.withColumn(
        "_offset", F.coalesce(F.sum("_total").over(_before(group, chunk)), F.lit(0))
    ).drop("_total")
    inside = (
        W.partitionBy(*group, *chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        df.withColumn(out, F.sum(value).over(inside))
        .join(offsets, [*group, *chunk])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_offset")
    )


def _sortable(df: DataFrame, name: str) -> Column:
    """Timestamps as microseconds, so that bounds survive a trip through JSON."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).alias(name)
    return F.col(name)


def _slice_bounds(df: DataFrame, columns: Sequence[str], rows: int, slice_rows: int) -> list[dict]:
    """At most MAX_SLICES - 1 cut points that split the whole order evenly."""
    # Enough slices to keep all cores busy, even where fewer would fit the tasks.
    cores = df.sparkSession.sparkContext.defaultParallelism
    slices = min(max(math.ceil(rows / slice_rows), 4 * cores), MAX_SLICES)
    fraction = min(1.0, slices * SAMPLE_PER_SLICE / rows)
    narrow = df.select(*[_sortable(df, c) for c in columns])
    sampled = narrow.sample(fraction, seed=7).orderBy(*columns).collect()
    if not sampled:
        return []
    step = len(sampled) / slices
    cuts = sorted({tuple(sampled[int(i * step)]) for i in range(1, slices)})
    return [dict(zip(columns, cut)) for cut in cuts]


def _slice_id(df: DataFrame, columns: Sequence[str], bounds: list[dict]) -> Column:
    """Number of bounds at or before the row: a binary search over a literal array."""
    position = F.struct(*[_sortable(df, c).alias(c) for c in columns])
    entry = df.select(position.alias("p")).schema["p"].dataType.simpleString()
    literal = F.from_json(F.lit(json.dumps(bounds)), f"array<{entry}>")
    top = 1 << max(len(bounds).bit_length() - 1, 0)
    steps = []
    while top:
        steps.append(top)
        top //= 2

    def search(at: Column) -> Column:
        def probe(found: Column, step: Column) -> Column:
            # Beyond the last bound there is none to compare with: not found.
            return F.when(F.get(literal, found + step - F.lit(1)) <= at, found + step).otherwise(found)

        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe)

    # The detour over an array builds the position once per row, not once per probe.
    return F.transform(F.array(position), search)[0]


def with_sequence(
    df: DataFrame,
    group: Sequence[str] = ("topic",),
    order: Sequence[str] = ("ts", "msg_id"),
    out: str = "seq",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Rank of each message of a group in arrival order, starting at 1.

    ``order`` must be unique within a group. The rows are counted first: up to
    ``slice_rows`` of them in all, one plain window is cheapest and cannot
    overload a task; above, the order is cut into slices of about that size,
    however unevenly the groups or the time stamps are spread.
    """
    group, order = list(group), list(order)
    rows = df.count()
    if rows <= slice_rows:
        return plain_rank(df, group, order, out)
    columns = [*group, *order]
    bounds = _slice_bounds(df, columns, rows, slice_rows)
    sliced = df.withColumn("_slice", _slice_id(df, columns, bounds))
    return chunked_rank(sliced, group, order, ["_slice"], out).drop("_slice")

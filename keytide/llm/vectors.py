"""What the vector searches share: usable vectors, shards, queries in blocks, merging shards."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block; a task holds one of each.
SHARD_ROWS, BLOCK_QUERIES = 8_192, 2_048


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x array<double>)`` of vectors without NULL or non-finite components.

    Rows without an id go. Of rows that repeat an id the smallest vector takes part, once.
    """
    x = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where("vec_id is not null and x is not null")
        .where(~F.exists("x", bad))
        .groupBy("vec_id")
        .agg(F.min("x").alias("x"))
    )


def shards(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def sharded(vectors: DataFrame, n: int, key: str = "vec_id") -> DataFrame:
    return vectors.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are filled up with zeros."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes = np.diff(array.offsets.to_numpy())
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(array), width))
    at = np.arange(width)[None, :] < sizes[:, None]
    out[at] = array.flatten().to_numpy()
    return out


def search_blocks(
    index: DataFrame, queries: DataFrame, n_shards: int, n_queries: int,
    search: Callable[[pa.Table, pa.Table], pa.Table], score: str, block: int = BLOCK_QUERIES,
) -> DataFrame:
    """``search`` of every block of queries in every shard: ``(query_id, vec_id, score)``.

    ``index`` has a ``shard``. Both sides are keyed by shard and block of queries, so a task
    holds one shard and one block at a time, however many queries there are.
    """
    n_blocks = shards(n_queries, block)
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_blocks)).cast("int"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    tasks = 4 * n_shards  # in proportion to the index; blocks of queries follow each other
    keys = ("shard", "block")
    return (
        left.repartition(tasks, *keys).groupBy(*keys)
        .cogroup(right.repartition(tasks, *keys).groupBy(*keys))
        .applyInArrow(search, f"query_id long, vec_id long, score {score}")
    )


def best(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores over all shards, ties to
    smaller ids. A query has at most ``k`` rows from each shard."""
    order: list[Column] = [F.col("score").desc(), F.col("vec_id").asc()]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]

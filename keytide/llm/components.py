"""Connected components by repeated contraction, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.session import materialize


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """``(node, root)`` for every node of ``links (a long, b long)``; equal root, same component.

    In each round a node is replaced by that node of its closed neighbourhood whose hash is
    smallest, links are renamed and those within one node go. As hashes are in no relation
    to the links, a constant share of nodes goes in each round, on chains too. Every round
    is written to the shared folder; only the count of its links reaches the driver.
    """
    rounds: list[DataFrame] = []
    todo = materialize(_undirected(links), f"{name}-0")
    while todo.take(1):
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        chosen = todo.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("best"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
        step = materialize(
            chosen.select("node", F.least(own, F.col("best")).getField("n").alias("next")),
            f"{name}-step{len(rounds)}",
        )
        rounds.append(step)
        renamed = (
            todo.join(step.withColumnRenamed("node", "a"), "a")
            .select(F.col("next").alias("a"), "b")
            .join(step.select(F.col("node").alias("b"), F.col("next").alias("to")), "b")
            .select("a", F.col("to").alias("b"))
            .where("a <> b")
        )
        todo = materialize(renamed.distinct(), f"{name}-{len(rounds)}")
    if not rounds:
        return todo.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1].withColumnRenamed("next", "root")
    for step in reversed(rounds[:-1]):
        last = out.select(F.col("node").alias("next"), F.col("root").alias("later"))
        out = step.join(last, "next", "left").select(
            "node", F.coalesce("later", "next").alias("root")
        )
    return out


def _undirected(links: DataFrame) -> DataFrame:
    links = links.select("a", "b").where("a <> b")
    return links.union(links.select("b", "a")).distinct()

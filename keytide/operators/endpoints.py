"""Sticky round-robin assignment of keys to endpoints, and the service registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.functions.chunked import SLICE_ROWS, with_sequence
from keytide.functions.joins import BROADCAST_ROWS, dimension_join, small_join

# Message ids are non-negative BIGINTs, so below this.
ID_SPAN = 10**19


def assign_endpoints(
    messages: DataFrame,
    endpoints: DataFrame,
    epoch_col: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per key: the endpoint the round-robin gave it at its first message.

    ``endpoints`` is ``endpoint_idx`` (from 0, without gaps) and ``ip``. With
    ``epoch_col`` every key is assigned anew in each epoch; the turn is not reset.
    """
    scope = [epoch_col] if epoch_col else []
    first = first_messages(messages, scope)
    turns = with_sequence(first, [], ["_ts", "_id"], "turn", slice_rows)
    return take_turns(turns, endpoints).select(*scope, "key", "turn", "endpoint_idx", "endpoint")


def take_turns(turns: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Add ``endpoint_idx`` and ``endpoint`` by ``turn``, which counts from 1."""
    n_endpoints = endpoints.agg(F.count(F.lit(1))).scalar()
    placed = turns.withColumn("endpoint_idx", ((F.col("turn") - 1) % n_endpoints).cast("int"))
    return small_join(placed, endpoints.withColumnRenamed("ip", "endpoint"), ["endpoint_idx"])


def first_messages(messages: DataFrame, scope: list[str]) -> DataFrame:
    """``(*scope, key, _ts, _id)``: when each key first appeared."""
    # Time and id in one number: as a buffer it is hashed, a struct would be sorted.
    span = F.lit(str(ID_SPAN)).cast("decimal(20,0)")
    micros = F.unix_micros("ts").cast("decimal(18,0)")
    first = messages.groupBy(*scope, "key").agg(
        F.min((micros * span + F.col("msg_id")).cast("decimal(38,0)")).alias("_first")
    )
    msg_id = F.col("_first") % span
    return first.select(
        *scope,
        "key",
        ((F.col("_first") - msg_id) / span).cast("long").alias("_ts"),
        msg_id.cast("long").alias("_id"),
    )


def sticky_round_robin(
    messages: DataFrame,
    endpoints: DataFrame,
    epoch_col: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add ``endpoint``: a key's first message takes the next one, later ones stick."""
    assigned = assign_endpoints(messages, endpoints, epoch_col)
    on = [epoch_col, "key"] if epoch_col else ["key"]
    return dimension_join(messages, assigned.select(*on, "endpoint"), on, broadcast_rows)


def fold_endpoints(feed: DataFrame, delete_key: str = "service") -> DataFrame:
    """Latest address list of each service: service, ips, version.

    Each change raises the version, which starts at 1. Entries are made under the
    bare service name. With ``delete_key='as_written'`` deletions name
    ``namespace/service`` and so remove nothing; ``'service'`` makes them work.
    """
    if delete_key == "service":
        name = F.col("service")
    elif delete_key == "as_written":
        qualified = F.concat("namespace", F.lit("/"), "service")
        name = F.when(F.col("op") == "delete", qualified).otherwise(F.col("service"))
    else:
        raise ValueError("delete_key is 'service' or 'as_written'")
    addresses = F.flatten(
        F.transform("subsets", lambda s: F.transform(s["addresses"], lambda a: a["ip"]))
    )
    changes = feed.select(name.alias("service"), "feed_seq", "op", addresses.alias("ips"))
    latest = changes.groupBy("service").agg(
        F.max_by(F.struct("op", "ips"), "feed_seq").alias("_last")
    )
    version = feed.agg(F.count(F.lit(1)) + 1).scalar()
    return latest.where(F.col("_last.op") == "upsert").select(
        "service",
        F.coalesce("_last.ips", F.array().cast("array<string>")).alias("ips"),
        version.cast("long").alias("version"),
    )


def lookup_endpoints(
    requests: DataFrame, registry: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``ips`` to each request; NULL for a service the registry does not know."""
    return dimension_join(requests, registry.select("service", "ips"), ["service"], broadcast_rows)

"""What the consuming side sees: offsets, shift and sync events, per-key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.chunked import (
    CHUNK,
    chunk_of,
    chunked_lag,
    chunked_rank,
    fits_one_task,
    plain_rank,
)
from keytide.functions.headers import TAG_HEADER, decode_tag, header
from keytide.functions.joins import dimension_join


def delivery_log(sent: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``offset``, counting from 0 in each partition in the order of sending.

    Reads its input more than once: pass the stored log of what was sent.
    """
    group = ["topic", "sent_partition"]
    if fits_one_task(sent, chunk):
        ranked = plain_rank(sent, group, ["seq"], "offset")
    else:
        cut = sent.withColumn("_chunk", chunk_of("seq", chunk))
        ranked = chunked_rank(cut, group, ["seq"], ["_chunk"], "offset").drop("_chunk")
    return ranked.withColumn("offset", F.col("offset") - 1)


def decode_records(records: DataFrame, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """``(decoded, undecodable)`` by the set tag in the headers of each record.

    A record without the header is neither shifted nor synced: it is decoded with a
    NULL tag. One whose tag cannot be read goes to quarantine.
    """
    raw = header(F.col("headers"), TAG_HEADER)
    parsed = records.withColumns({"_raw": raw, "tag": decode_tag(raw, fmt)})
    broken = F.col("_raw").isNotNull() & F.col("tag").isNull()
    return parsed.where(~broken).drop("_raw"), parsed.where(broken).drop("_raw", "tag")


def is_shift() -> Column:
    return F.col("dest_partition") != F.col("sent_partition")


def is_sync() -> Column:
    return (F.col("src_partition") > -1) & (F.col("src_idx") > -1)


def shift_events(delivered: DataFrame) -> DataFrame:
    """Records that tell a consumer their key now continues elsewhere."""
    return delivered.where(is_shift())


def sync_events(delivered: DataFrame) -> DataFrame:
    """Records of any set but a key's first, with ``is_set_start``.

    As every record repeats its set's tag, the event fires on all of them;
    ``is_set_start`` marks the first to arrive at the destination. Its offset is found by
    aggregation; there are few sets, so they are looked up without moving the records.
    """
    on = ["topic", "key", "dest_idx"]
    synced = delivered.where(is_sync())
    starts = synced.where(~is_shift()).groupBy(*on).agg(F.min("offset").alias("_start"))
    marked = dimension_join(synced, starts, on).withColumn(
        "is_set_start", F.coalesce((F.col("offset") == F.col("_start")) & ~is_shift(), F.lit(False))
    )
    return marked.drop("_start")


# Sets in turn; within one the boundary record, then the destination's records.
_ORDER = ("dest_idx", "_settled", "offset")
_CUT = ("dest_idx", "_settled", "_chunk")


def _consumption_order(delivered: DataFrame, chunk: int) -> DataFrame:
    return delivered.withColumns(
        {"_settled": (~is_shift()).cast("int"), "_chunk": chunk_of("offset", chunk)}
    )


def key_total_order(delivered: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``pos``, the place of each record in its key's order across partitions."""
    cut = _consumption_order(delivered, chunk)
    if fits_one_task(delivered, chunk):
        ordered = plain_rank(cut, ["topic", "key"], _ORDER, "pos")
    else:
        ordered = chunked_rank(cut, ["topic", "key"], _ORDER, _CUT, "pos")
    return ordered.drop("_settled", "_chunk")


def order_violations(delivered: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records that would be consumed after a record sent later; none if all is well.

    ``(topic, key, seq, prev_seq)``. Checked set by set, so that no key's messages are sorted: a set
    must begin after the one before it ended, for which its first and last record do, and a
    partition that is in the order of sending as a whole is so for each of its keys. Only in
    partitions that are not, a key's records are held against each other.
    """
    cut = _consumption_order(delivered, chunk)
    sets = cut.groupBy("topic", "key", "dest_idx", "_settled").agg(
        F.min_by("seq", "offset").alias("seq"), F.max_by("seq", "offset").alias("_last")
    )
    in_turn = W.partitionBy("topic", "key").orderBy("dest_idx", "_settled")
    between = sets.withColumn("prev_seq", F.lag("_last").over(in_turn))

    place = ["topic", "sent_partition"]
    scanned = chunked_lag(
        cut.select(*place, "_chunk", "offset", "seq"), place, ["offset"], ["_chunk"], "seq", "prev_seq"
    )
    # a row for each partition, as many as the topics have
    mixed = scanned.where(F.col("prev_seq") > F.col("seq")).select(*place).distinct()
    loose = cut.join(mixed, place, "left_semi")
    own = ["topic", "key", "dest_idx", "_settled"]
    inside = chunked_lag(loose, [*own, "sent_partition"], ["offset"], ["_chunk"], "seq", "prev_seq")
    columns = ["topic", "key", "seq", "prev_seq"]
    found = between.select(*columns).unionByName(inside.select(*columns))
    return found.where(F.col("prev_seq") > F.col("seq"))

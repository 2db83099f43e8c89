"""Rate of messages into each partition, as a windowed stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keytide.operators.load import partition_rate


def stream_partition_rate(
    acks: DataFrame, width: str = "1 second", delay: str = "10 seconds"
) -> DataFrame:
    """``partition_rate`` of a stream; acks later than ``delay`` are dropped.

    In append mode a window comes out once the watermark has passed its end.
    """
    return partition_rate(acks.withWatermark("ts", delay), width)

"""Shift and sync events of a live stream: stateless filters on decoded records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.operators.delivery import decode_records, is_shift, is_sync
from keytide.operators.message_sets import TAG_COLUMNS


def _untagged(records: DataFrame, fmt: str) -> DataFrame:
    decoded, _ = decode_records(records, fmt)
    return decoded.withColumns({c: F.col(f"tag.{c}") for c in TAG_COLUMNS})


def stream_shift_events(records: DataFrame, fmt: str = "json") -> DataFrame:
    """Records (``headers``, ``sent_partition``) whose key continues elsewhere."""
    return _untagged(records, fmt).where(is_shift())


def stream_sync_events(records: DataFrame, fmt: str = "json") -> DataFrame:
    """Records of any set but a key's first."""
    return _untagged(records, fmt).where(is_sync())

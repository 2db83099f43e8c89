from keytide.sources.messages import (
    MESSAGE_SCHEMA,
    kafka_columns,
    read_messages,
    write_messages,
)
from keytide.sources.traces import TRACE_SCHEMA, read_traces, write_latency_csv

__all__ = [
    "MESSAGE_SCHEMA",
    "kafka_columns",
    "read_messages",
    "write_messages",
    "TRACE_SCHEMA",
    "read_traces",
    "write_latency_csv",
]

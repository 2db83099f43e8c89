"""Trace dumps (JSON) as a source, latency tables (CSV) as a sink."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.sources.envelopes import NAME, register

TRACE_SCHEMA = (
    "traceID string,"
    " spans array<struct<operationName:string,startTime:bigint,duration:bigint,"
    "processID:string,tags:array<struct<key:string,value:string>>>>,"
    " processes map<string,struct<serviceName:string>>"
)


def read_traces(
    spark: SparkSession,
    path: str,
    service: str | None = None,
    since: datetime | int | None = None,
    limit: int | None = None,
    envelope: bool = False,
) -> DataFrame:
    """Exported traces, one JSON object per line.

    ``envelope=True`` reads documents of the form ``{"data": [trace, ...]}``, each file trace by trace
    (``sources.envelopes``). ``service`` keeps traces with a span of that service, ``since`` (a time or
    epoch microseconds) those with a span that started then or later.
    """
    if since is not None and not isinstance(since, int):
        since = int(since.timestamp() * 1_000_000)
    if envelope:
        register(spark)
        reader = spark.read.format(NAME)
        for name, value in (("service", service), ("since", since)):
            reader = reader if value is None else reader.option(name, str(value))
        traces = reader.load(path)
        return traces.limit(limit) if limit is not None else traces
    traces = spark.read.schema(TRACE_SCHEMA).json(path)
    if service is not None:
        traces = traces.where(
            F.exists(
                "spans",
                lambda s: F.try_element_at("processes", s["processID"])["serviceName"] == service,
            )
        )
    if since is not None:
        traces = traces.where(F.exists("spans", lambda s: s["startTime"] >= F.lit(since)))
    return traces.limit(limit) if limit is not None else traces


def write_latency_csv(latency: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Latency rows as CSV with a header line; durations are microseconds."""
    latency.write.mode(mode).option("header", True).csv(path)

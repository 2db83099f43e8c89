import datetime as dt
import json

import pytest

from keytide.operators import endpoints, frequency, latency
from keytide.plans import queries as q
from keytide.plans import workload as wl
from keytide.session import scratch_path
from keytide.sources import TRACE_SCHEMA, read_messages, read_traces, write_latency_csv

T0 = dt.datetime(2024, 1, 1)


def calls(spark, keys):
    rows = [(i, T0 + dt.timedelta(seconds=i), k, 0 if i < 5 else 1) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "msg_id long, ts timestamp, key string, epoch int")


def two_endpoints(spark):
    return spark.createDataFrame([(0, "x"), (1, "y")], "endpoint_idx int, ip string")


@pytest.mark.parametrize("limit", [1000, 0])
def test_first_appearance_takes_the_next_endpoint(spark, limit):
    df = endpoints.sticky_round_robin(
        calls(spark, "aabacdbda"), two_endpoints(spark), broadcast_rows=limit
    )
    got = "".join(r.endpoint for r in df.orderBy("msg_id").collect())
    assert got == "xxyxxyyyx"


def test_epochs_assign_anew_but_do_not_reset_the_turn(spark):
    df = endpoints.sticky_round_robin(calls(spark, "aabacdbda"), two_endpoints(spark), "epoch")
    got = "".join(r.endpoint for r in df.orderBy("msg_id").collect())
    # epoch 0: a x, b y, c x; epoch 1: d y, b x, a y
    assert got == "xxyxx" + "yxyy"


def feed(spark):
    subsets = "array<struct<addresses:array<struct<ip:string>>>>"
    rows = [
        (1, "n1", "a", "upsert", [[["1"], ["2"]], [["3"]]]),
        (2, "n1", "b", "upsert", []),
        (3, "n2", "a", "upsert", [[["9"]]]),
        (4, "n1", "c", "upsert", [[["5"]]]),
        (5, "n1", "c", "delete", None),
    ]
    shaped = [
        (i, ns, s, op, None if sub is None else [([(ip[0],) for ip in group],) for group in sub])
        for i, ns, s, op, sub in rows
    ]
    return spark.createDataFrame(
        shaped, f"feed_seq long, namespace string, service string, op string, subsets {subsets}"
    )


def test_registry_modes(spark):
    by_service = {r.service: r.ips for r in endpoints.fold_endpoints(feed(spark)).collect()}
    assert by_service == {"a": ["9"], "b": []}
    literal = {r.service: r.ips for r in endpoints.fold_endpoints(feed(spark), "as_written").collect()}
    assert literal == {"a": ["9"], "b": [], "c": ["5"]}
    assert {r.version for r in endpoints.fold_endpoints(feed(spark)).collect()} == {6}


def test_lookup_of_an_unknown_service(spark):
    requests = spark.createDataFrame([("a",), ("nope",)], "service string")
    found = endpoints.lookup_endpoints(requests, endpoints.fold_endpoints(feed(spark)))
    assert {r.service: r.ips for r in found.collect()} == {"a": ["9"], "nope": None}


def span(op, start, took, tags=(), process="p2"):
    return {
        "operationName": op,
        "startTime": start,
        "duration": took,
        "processID": process,
        "tags": [{"key": k, "value": v} for k, v in tags],
    }


FULL = [("message_bus.destination", 7), ("other", "z"), ("consumer.key", "k1")]
DUMP = [
    {"traceID": "all", "spans": [span("produce message", 100, 1, process="p1"), span("OrderGo receive", 130, 5), span("print message", 140, 9, FULL)]},
    {"traceID": "no-receive", "spans": [span("produce message", 100, 1), span("print message", 140, 9, FULL)]},
    {"traceID": "two-prints", "spans": [span("print message", 1, 1), span("produce message", 100, 1), span("OrderGo receive", 90, 5), span("print message", 140, 11, [*FULL, ("consumer.key", "k2")])]},
    {"traceID": "no-partition", "spans": [span("produce message", 100, 1), span("OrderGo receive", 130, 5), span("print message", 140, 9, [("consumer.key", "k3")])]},
    {"traceID": "empty", "spans": []},
]
LATENCY = {
    ("all", 5, 9, "7", "k1", 30),
    ("two-prints", 5, 11, "7", "k2", -10),
    ("no-partition", 5, 9, None, "k3", 30),
}
for trace in DUMP:
    trace["processes"] = {"p1": {"serviceName": "producer"}, "p2": {"serviceName": "consumer"}}


@pytest.mark.parametrize("envelope", [False, True])
def test_hand_made_dump(spark, tmp_path, envelope):
    path = tmp_path / "dump.json"
    if envelope:
        path.write_text(json.dumps({"data": DUMP}, indent=1))
    else:
        path.write_text("\n".join(json.dumps(t) for t in DUMP))
    traces = read_traces(spark, str(path), envelope=envelope)
    rows = latency.trace_latency(traces)
    assert rows.columns == list(latency.LATENCY_COLUMNS)
    assert {tuple(r) for r in rows.collect()} == LATENCY
    flat = latency.pivot_spans(latency.flat_spans(traces)).select("trace_id", "processed.duration_us")
    assert {tuple(r) for r in flat.collect()} == {(r[0], r[2]) for r in LATENCY}
    write_latency_csv(rows, str(tmp_path / "csv"))
    back = spark.read.schema(rows.schema).option("header", True).csv(str(tmp_path / "csv"))
    assert {tuple(r) for r in back.collect()} == LATENCY


def test_the_source_gives_every_trace(spark, sf):
    seen = q.trace_source(spark, sf)
    assert seen.count() == wl.keyed_messages(spark, sf).count()
    # the filters on lines find what they find in documents
    traces, since = q._traces_of_services(spark, sf)
    path = scratch_path(spark, "lines")
    traces.write.json(path)
    lines = q._seen(read_traces(spark, path, service="consumer", since=since))
    found = sorted(map(tuple, lines.collect()))
    assert found == sorted(map(tuple, q.trace_envelopes(spark, sf).collect())) and 0 < len(found) < seen.count()


def test_trace_filters(spark, tmp_path):
    path = tmp_path / "dump.json"
    path.write_text("\n".join(json.dumps(t) for t in DUMP))
    ids = lambda df: {r.traceID for r in df.collect()}
    assert ids(read_traces(spark, str(path), service="producer")) == {"all"}
    assert ids(read_traces(spark, str(path), service="consumer")) == {t["traceID"] for t in DUMP[:4]}
    assert ids(read_traces(spark, str(path), since=141)) == set()
    late = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=140)
    assert len(ids(read_traces(spark, str(path), since=late))) == 4
    assert read_traces(spark, str(path), limit=2).count() == 2


def test_latency_filters_and_intervals(spark):
    traces = spark.read.schema(TRACE_SCHEMA).json(
        spark.sparkContext.parallelize([json.dumps(t) for t in DUMP])
    )
    rows = latency.trace_latency(traces)
    by_key = latency.latency_by(rows, ["Key"], partition="7").collect()
    assert {(r.Key, r.traces, r.total_us) for r in by_key} == {("k1", 1, 9), ("k2", 1, 11)}
    timed = latency.trace_latency(traces, intervals=True).where("traceID = 'all'").first()
    assert timed.Print_Duration == dt.timedelta(microseconds=9)


def test_source_fills_missing_fields_and_filters_topics(spark, tmp_path):
    spark.sql(
        "SELECT 1L msg_id, TIMESTAMP'2024-01-01' ts, 't' topic, CAST(NULL AS STRING) key, CAST(NULL AS STRING) body"
        " UNION ALL SELECT 2L, TIMESTAMP'2024-01-01', 'u', 'k', 'b'"
    ).write.parquet(str(tmp_path / "log"))
    rows = read_messages(spark, str(tmp_path / "log"), topic="t").collect()
    assert [(r.key, r.body) for r in rows] == [("", "")]


def test_sampling_keeps_one_minus_threshold(spark):
    messages = spark.range(20_000).withColumnRenamed("id", "msg_id")
    for threshold in (0.0, 0.3, 1.0):
        kept = frequency.sample_messages(messages, threshold).count() / 20_000
        assert abs(kept - (1 - threshold)) < 0.02
    seeded = frequency.sample_messages(messages, 0.3, seed=1).count() / 20_000
    assert abs(seeded - 0.7) < 0.02


def test_heavy_means_more_than_the_limit(spark):
    counts = spark.createDataFrame(
        [("t", "a", 100), ("t", "b", 101), ("t", "c", 5)], "topic string, key string, count long"
    )
    assert [r.key for r in frequency.heavy_keys(counts).collect()] == ["b"]
    row = frequency.freq_report(counts, keyspace=9).first()
    assert tuple(row) == ("t", 3, 1, 101, 206, 9)

"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from keytide.functions import with_sequence
from keytide.operators import message_sets, routing, sketch
from keytide.plans import queries as q
from keytide.plans import workload as wl


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange (\w+(?:\([^)]*\))?)", text)


PYTHON = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
FACT_PATH = [
    "msg_source", "fnv_partition", "sampled_msgs", "key_counts", "bucketed", "lossy_lifecycle",
    "lossy_items", "partition_rate", "weight_snapshots", "route_vanilla", "route_hot",
    "route_hot_shuffled", "message_sets", "sent_messages", "delivery_log", "sync_events",
    "key_total_order", "order_violations", "ingest_accept", "trace_latency", "latency_by_key",
]


@pytest.mark.parametrize("name", FACT_PATH)
def test_no_python_and_no_single_task_on_the_message_path(spark, sf, name):
    text = plan(q.QUERIES[name](spark, sf))
    assert not any(p in text for p in PYTHON)
    assert "SinglePartition" not in text
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_routing_does_not_shuffle_the_messages(spark, sf):
    messages = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("topic"), F.lit("k").alias("key"), F.col("event_id").alias("seq")
    )
    text = plan(routing.route(messages, 10, wl.hot_map_log_given(spark, sf)))
    side = text.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in side and exchanges(side) == []


def test_a_large_history_is_merged_not_broadcast(spark, sf):
    text = plan(q.QUERIES["route_hot_shuffled"](spark, sf))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" not in text
    merging = [line for line in text.splitlines() if "Window [last(" in line]
    assert merging and all("_chunk" in line for line in merging)


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(q.QUERIES["key_counts"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_counts_are_combined_before_the_shuffle(spark, sf):
    text = plan(q.QUERIES["key_counts"](spark, sf))
    assert "partial_count" in text and len(exchanges(text)) == 1


def test_a_hot_topic_is_cut_into_slices(spark, sf):
    messages = wl.keyed_messages(spark, sf).select("msg_id", "ts", F.lit("one").alias("topic"))
    text = plan(with_sequence(messages, slice_rows=100))
    ranking = [line for line in text.splitlines() if "row_number()" in line]
    assert ranking and all("_slice" in line for line in ranking)


def test_the_fold_is_sorted_once(spark, sf):
    text = plan(q.QUERIES["control_replay"](spark, sf))
    above = text.split("FlatMapGroupsInPandas")[1]
    # The sort below the fold is the explicit one: by time, not by topic alone.
    first_sort = re.search(r"Sort \[([^\]]*)\]", above).group(1)
    assert first_sort.count("ASC") >= 3


def test_windows_of_message_sets_run_over_intervals(spark, sf):
    messages = wl.sequenced(spark, sf).select("msg_id", "topic", "key", "seq")
    text = plan(message_sets.tag_message_sets(messages, 10, wl.hot_map_log_given(spark, sf)))
    by_key = [
        line for line in text.splitlines()
        if "Window" in line and re.search(r"windowspecdefinition\(topic#\d+, key#\d+", line)
    ]
    assert by_key and all("valid_from" in line for line in by_key)


def test_no_join_gathers_a_topic(spark, sf):
    """With broadcasting by size off, nothing message- or key-sized is dealt by topic alone."""
    from keytide.operators import placement

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        messages = wl.sequenced_log(spark, sf)
        bucketed = sketch.assign_buckets(messages, 0.02)
        lives = sketch.lossy_lifecycles(bucketed, 0.02, 0.1)
        sizes = q._given_sizes(spark, sf)
        keys = messages.select("topic", "key").distinct()
        chosen = placement.p2c_choose(keys, sizes, 10)
        matched = placement.target_match(q._candidates(spark, sf), sizes)
        for df in (lives, chosen, matched):
            text = plan(df)
            assert not re.search(r"SortMergeJoin \[topic#\d+\], ", text)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_percentiles_read_the_traces_once(spark, sf):
    df = q.QUERIES["latency_by_partition_key"](spark, sf)
    df.collect()
    text = plan(df)
    text = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_order_is_checked_without_sorting_a_key(spark, sf):
    text = plan(q.QUERIES["order_violations"](spark, sf))
    scans = [line for line in text.splitlines() if "lag(seq#" in line]
    assert scans and all("_chunk" in line for line in scans)

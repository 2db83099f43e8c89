import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from keytide.operators import message_sets
from keytide.plans import queries as q
from keytide.plans import workload as wl
from keytide.session import scratch_path
from keytide.streaming import (
    HotKeyConfig,
    MapVersions,
    run_hot_key_stream,
    set_state,
    stream_tags_in_store,
)
from keytide.streaming.live_map import pinned_version
from keytide.streaming.state import VersionedState

CONFIG = HotKeyConfig(10, 0.02, 0.1, rebalance_every=1)
COLUMNS = ["topic", "seq", "key", *message_sets.TAG_COLUMNS, "is_boundary", "sent_partition"]


@pytest.fixture(scope="module")
def streamed(spark, sf):
    state, out = scratch_path(spark, "state"), scratch_path(spark, "sent")
    offsets = scratch_path(spark, "offsets")
    q.run_in_parts(spark, sf, lambda s: run_hot_key_stream(s, state, out, offsets, CONFIG))
    return state, out


@pytest.fixture(scope="module")
def batch_log(spark, sf):
    from keytide.operators import control, sketch

    bucketed = sketch.assign_buckets(wl.sequenced(spark, sf), CONFIG.epsilon)
    lives = sketch.lossy_lifecycles(bucketed, CONFIG.epsilon, CONFIG.support)
    turns = sketch.turnovers(bucketed, CONFIG.epsilon)
    events = control.control_events(lives, turns, 10, CONFIG.rebalance_every)
    return control.replay_control(events, 10).cache()


def test_stream_of_batches_equals_the_batch_twin(spark, sf, streamed, batch_log):
    _, out = streamed
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() >= 3
    messages = wl.sequenced(spark, sf)
    want = message_sets.sent_partition(message_sets.tag_message_sets(messages, 10, batch_log))
    rows = lambda df: sorted(map(tuple, df.select(*COLUMNS).collect()))
    assert rows(got) == rows(want)
    assert want.where("is_boundary").count() == 11


def test_map_history_of_the_stream(spark, streamed, batch_log):
    state, _ = streamed
    columns = ["topic", "key", "count", "partition", "valid_from", "valid_to", "opened_by"]
    logs = spark.read.parquet(f"{state}/map_log")
    last = logs.agg(F.max("batch")).first()[0]
    streamed_log = logs.where(F.col("valid_to").isNotNull() | (F.col("batch") == last))
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(streamed_log) == rows(batch_log)
    weights = spark.read.parquet(f"{state}/weights").where(F.col("batch") == last)
    total = batch_log.where("valid_to IS NULL").agg(F.sum("count")).first()[0]
    assert weights.agg(F.sum("size")).first()[0] == total
    assert weights.count() == 50


def test_a_repeated_batch_changes_nothing(spark):
    state = VersionedState(spark, scratch_path(spark, "again"), keep=2)
    for _ in range(2):
        before = state.before("n", 0, "v long")
        state.save("n", 0, before.unionByName(spark.range(3).withColumnRenamed("id", "v")))
    assert state.before("n", 1, "v long").count() == 3
    state.emit("results", 0, spark.range(1))
    for batch in (1, 2, 3):
        state.save("n", batch, spark.range(batch).withColumnRenamed("id", "v"))
        state.emit("results", batch, spark.range(1))
        state.scratch("once", batch, spark.range(1))
        state.finish(batch)
    assert state.history("results").count() == 4
    with pytest.raises(ValueError):
        VersionedState(spark, "unused", keep=1)
    assert {r.batch for r in state.history("n").select("batch").distinct().collect()} == {2, 3}


def test_a_repeated_batch_keeps_its_map_version(spark):
    state = VersionedState(spark, scratch_path(spark, "pins"))
    versions = MapVersions(spark, scratch_path(spark, "maps"))
    assert versions.newest() is None and versions.read(None).count() == 0
    assert pinned_version(state, versions, 0) is None
    entries = spark.createDataFrame([("t", "a", 1, 3)], "topic string, key string, count int, partition int")
    versions.publish(entries, 4)
    assert pinned_version(state, versions, 0) is None
    assert pinned_version(state, versions, 1) == 4
    versions.publish(entries.limit(0), 9)
    assert pinned_version(state, versions, 1) == 4 and pinned_version(state, versions, 2) == 9
    assert [r.partition for r in versions.read(4).collect()] == [3]
    assert versions.read(9).count() == 0


def test_tags_in_the_store_go_on_after_a_failure(spark, sf):
    """A run that stops after numbering is taken up by the next; state holds ever mapped keys only."""
    state, out, offsets = (scratch_path(spark, n) for n in ("state", "tagged", "offsets"))
    log = wl.hot_map_log_given(spark, sf)
    calls, streams = [], []

    def given(session):
        calls.append(1)
        return log

    def run(stream):
        streams.append(stream)
        stream_tags_in_store(stream, given, state, out, offsets, CONFIG)

    q.run_in_parts(spark, sf, run)
    assert len(calls) == 3
    before = sorted(map(tuple, spark.read.parquet(out).select(*COLUMNS).collect()))
    want = message_sets.sent_partition(
        message_sets.tag_message_sets(wl.sequenced(spark, sf), 10, log)
    )
    assert before == sorted(map(tuple, want.select(*COLUMNS).collect()))
    tagged = VersionedState(spark, out)
    tagged._delete(f"{out}/batch=1")
    run(streams[-1])
    assert sorted(map(tuple, spark.read.parquet(out).select(*COLUMNS).collect())) == before
    sets = spark.read.parquet(f"{state}/sets")
    assert sets.select("topic", "key").distinct().count() == log.select("topic", "key").distinct().count()


def test_the_store_is_asked_once_for_a_key():
    """Most keys of a batch have one row, so calls of the store and tables for each key are the cost."""
    calls = []

    class Store:
        value = None

        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    numbers = set_state.SetNumbers()
    numbers.init(Store())
    visit = Row("topic", "key", "valid_from", "valid_to", "partition", "first_seq", "at_batch")
    went = [visit("t", "k", 5, 9, 4, 6, 0), visit("t", "k", 1, 5, 3, 2, 0)]
    found = list(numbers.handleInputRows(("t", "k"), iter(went), None))
    assert list(map(tuple, found)) == [
        ("t", "k", 1, 5, -1, -1, 3, 0, None, 0), ("t", "k", 5, 9, 3, 0, 4, 1, 6, 0)
    ]
    assert calls == ["get", "update"]
    found = list(numbers.handleInputRows(("t", "k"), iter([visit("t", "k", 9, None, 4, 9, 1)]), None))
    assert list(map(tuple, found)) == [("t", "k", 9, None, 3, 0, 4, 1, None, 1)]
    assert calls == ["get", "update", "get"]

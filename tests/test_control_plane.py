import math

import pytest

from keytide.operators import control, placement, sketch
from keytide.operators.load import partition_sizes, system_avg, weight_snapshots
from tests.models import MapModel, control_history, lives_and_events, skewed_keys


def stream(spark, topics):
    rows = [(t, k, i + 1, i) for t, keys in topics.items() for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "topic string, key string, seq long, msg_id long")


def test_hand_case(spark):
    keys = list("aaabc" "addab" "eeeee")
    bucketed = sketch.assign_buckets(stream(spark, {"t": keys}), 0.2)
    lives = sketch.lossy_lifecycles(bucketed, 0.2, 0.6)
    got = {
        (r.key, r.start_bucket): (r.end_bucket, r.seen, r.hot_bucket, r.hot_count)
        for r in lives.collect()
    }
    assert got == {
        ("a", 1): (3, 5, 1, 2),
        ("b", 1): (1, 1, None, None),
        ("c", 1): (1, 1, None, None),
        ("d", 2): (3, 2, None, None),
        ("b", 2): (2, 1, None, None),
        ("e", 3): (None, 5, 3, 4),
    }


def test_threshold_is_computed_in_doubles():
    assert sketch.hot_threshold(0.001, 0.01) > 9
    assert math.ceil(sketch.hot_threshold(0.001, 0.01)) == 10
    assert sketch.bucket_width(0.01) == 100


@pytest.mark.parametrize("bucket_chunk", [sketch.BUCKET_CHUNK, 3])
@pytest.mark.parametrize("width", [4, 10, 25])
def test_random_streams_match_the_model(spark, bucket_chunk, width):
    epsilon = 1 / width
    support = epsilon + 2 / width
    topics = {f"t{i}": skewed_keys(330 + 7 * i, f"{width}/{i}", spread=8 + 6 * i) for i in range(6)}
    bucketed = sketch.assign_buckets(stream(spark, topics), epsilon)
    lives = sketch.lossy_lifecycles(bucketed, epsilon, support, bucket_chunk=bucket_chunk).cache()
    want_events, want_stats = set(), set()
    for topic, keys in topics.items():
        events, tracked = lives_and_events(keys, epsilon, support)
        want_events |= {(topic, *e) for e in events}
        want_stats |= {(topic, b + 1, n) for b, n in enumerate(tracked)}
    hot = {(r.topic, r.bucket, r.key, "hot", r["count"]) for r in sketch.hot_keys(lives).collect()}
    gone = {(r.topic, r.bucket, r.key, "gone", r.was_hot) for r in sketch.evictions(lives).collect()}
    assert hot | gone == want_events
    turns = sketch.turnovers(bucketed, epsilon)
    stats = sketch.sketch_stats(lives, turns, bucket_chunk=bucket_chunk)
    assert {(r.topic, r.bucket, r.tracked) for r in stats.collect()} == want_stats
    items = sketch.lossy_items(bucketed, epsilon, support, bucket_chunk=bucket_chunk)
    per_turn = items.groupBy("topic", "bucket").count().collect()
    assert {(r.topic, r.bucket, r["count"]) for r in per_turn} == {s for s in want_stats if s[2]}
    # What bounds the input of the control fold.
    limit = (support - epsilon) * width
    assert len(hot) <= sum(map(len, topics.values())) / (limit + 1)
    lives.unpersist()


def given_map(spark, seed, n=10):
    rows = [
        ("t", f"k{i}", 1 + (i * seed) % 37, (i * i * seed) % n if i % 3 else 1) for i in range(30)
    ]
    return spark.createDataFrame(rows, "topic string, key string, count long, partition int")


@pytest.mark.parametrize("seed", [5, 7, 11, 13])
@pytest.mark.parametrize("rule", placement.STOP_RULES)
def test_rebalance_round_matches_the_model(spark, seed, rule):
    given = given_map(spark, seed)
    model = MapModel(10)
    model.at = {r.key: (r["count"], r.partition) for r in given.collect()}
    before = dict(model.at)
    moves = model.round(rule)
    got = control.rebalance_round(given, 10, rule).collect()
    assert {r.key: (r["count"], r.partition) for r in got} == model.at
    assert sum(r.src is not None for r in got) == moves
    assert all(r.src in (None, before[r.key][1]) for r in got)
    if rule == "as_written":
        assert moves == 0
    assert sum(r["count"] for r in got) == sum(c for c, _ in before.values())


def test_tolerance_skips_the_round(spark):
    given = given_map(spark, 7)
    assert control.rebalance_round(given, 10).where("src IS NOT NULL").count() > 0
    assert control.rebalance_round(given, 10, tolerance=50.0).where("src IS NOT NULL").count() == 0


def test_sizes_cover_empty_partitions(spark):
    given = spark.createDataFrame([("t", "a", 6, 1)], "topic string, key string, count long, partition int")
    sizes = partition_sizes(given, 4)
    assert {(r.partition, r.size) for r in sizes.collect()} == {(0, 0), (1, 6), (2, 0), (3, 0)}
    assert system_avg(sizes).first().avg_size == 1.5


def test_equal_sizes_belong_to_neither_set(spark):
    given = spark.createDataFrame(
        [("t", "a", 5, 0), ("t", "b", 5, 1)], "topic string, key string, count long, partition int"
    )
    labelled = placement.partition_sets(partition_sizes(given, 2))
    assert {r.side for r in labelled.collect()} == {None}


@pytest.mark.parametrize(
    "options",
    [
        {"every": None},
        {"every": 1},
        {"every": 2},
        {"every": 2, "rule": "as_written"},
        {"every": 1, "tolerance": 0.8},
        {"every": 1, "cooldown": 60},
        {"every": 1, "tolerance": 0.3, "cooldown": 60},
    ],
)
def test_replay_matches_the_model(spark, options):
    epsilon, support, n = 1 / 20, 3 / 20, 5
    topics = {f"t{i}": skewed_keys(600, f"replay{i}", spread=20) for i in range(3)}
    every, rule = options["every"], options.get("rule", "improves")
    tolerance, cooldown = options.get("tolerance"), options.get("cooldown")
    bucketed = sketch.assign_buckets(stream(spark, topics), epsilon)
    lives = sketch.lossy_lifecycles(bucketed, epsilon, support)
    turns = sketch.turnovers(bucketed, epsilon)
    events = control.control_events(lives, turns, n, every)
    log = [r.asDict() for r in control.replay_control(events, n, rule, tolerance, cooldown).collect()]
    total_moves = 0
    for topic, keys in topics.items():
        states, moves = control_history(keys, epsilon, support, n, every, rule, tolerance, cooldown)
        total_moves += moves
        mine = [r for r in log if r["topic"] == topic]
        assert sum(r["opened_by"] == "move" for r in mine) == moves
        for bucket, state in enumerate(states, 1):
            position = bucket * 20 + 1
            now = {
                r["key"]: (r["count"], r["partition"])
                for r in mine
                if r["valid_from"] <= position and (r["valid_to"] is None or r["valid_to"] > position)
            }
            assert now == state
    if rule == "as_written" or every is None:
        assert total_moves == 0
    elif tolerance is None:
        assert total_moves > 0


def test_small_arrow_batches_do_not_change_the_replay(spark):
    epsilon, support, n = 1 / 20, 3 / 20, 5
    topics = {"t": skewed_keys(600, "batches", spread=20)}
    bucketed = sketch.assign_buckets(stream(spark, topics), epsilon)
    events = control.control_events(
        sketch.lossy_lifecycles(bucketed, epsilon, support), sketch.turnovers(bucketed, epsilon), n, 1
    )
    whole = sorted(map(str, control.replay_control(events, n).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(str, control.replay_control(events, n).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_map_log_from_events(spark):
    events = spark.createDataFrame(
        [
            ("t", "a", 10, "promote", 5, 1),
            ("t", "a", 20, "move", 5, 3),
            ("t", "a", 30, "evict", 5, 3),
            ("t", "a", 50, "promote", 9, 2),
        ],
        "topic string, key string, seq long, op string, count long, partition int",
    )
    log = control.build_map_log(events)
    assert {(r.partition, r.valid_from, r.valid_to, r.opened_by) for r in log.collect()} == {
        (1, 11, 21, "promote"),
        (3, 21, 31, "move"),
        (2, 51, None, "promote"),
    }
    assert [(r.key, r["count"], r.partition) for r in control.current_map(log).collect()] == [("a", 9, 2)]
    now = spark.createDataFrame([("t", 20)], "topic string, at_seq long")
    assert [r.partition for r in control.map_at(log, now).collect()] == [3]
    ticks = spark.createDataFrame([("t", 1, 9), ("t", 2, 20), ("t", 3, 40), ("t", 4, 90)], "topic string, tick long, at_seq long")
    weights = weight_snapshots(log, ticks, 4, chunk=7).where("size > 0").collect()
    assert {(r.tick, r.partition, r.size) for r in weights} == {(2, 3, 5), (4, 2, 9)}

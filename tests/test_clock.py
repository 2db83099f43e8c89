"""Rounds of rebalancing by the clock, and folds that are cut into ranges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keytide.operators import control, load, sketch
from tests.models import MapModel, lives_and_events, skewed_keys

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def timed(spark, topics):
    """Messages ``topic -> [(key, second)]``, numbered."""
    rows = [
        (t, k, i + 1, i, T0 + dt.timedelta(seconds=s))
        for t, messages in topics.items()
        for i, (k, s) in enumerate(messages)
    ]
    return spark.createDataFrame(rows, "topic string, key string, seq long, msg_id long, ts timestamp")


def bursts(n, seed, every):
    """Keys with times: bursts, long silences, several messages on a tick."""
    out, now = [], 3
    for i, key in enumerate(skewed_keys(n, seed, spread=20)):
        now += 0 if i % 3 else (every * 4 + 1 if i % 50 == 0 else i % 4)
        out.append((key, now))
    return out


def test_ticks_are_counted_between_messages(spark):
    messages = timed(spark, {"a": [("x", 1), ("x", 9), ("x", 10), ("x", 47)], "b": [("y", 5)]})
    passed = load.clock_ticks(messages, 10)
    base = int(T0.timestamp()) // 10
    assert sorted(map(tuple, passed.collect())) == [("a", base + 1, 2, 1), ("a", base + 2, 3, 3)]
    every = load.every_tick(passed).collect()
    assert sorted(map(tuple, every)) == [("a", base + 1, 2)] + [("a", base + i, 3) for i in (2, 3, 4)]


def replayed(messages, epsilon, support, **how):
    """The map after every message, by a plain loop over messages and ticks."""
    n, every = how["n"], how["every"]
    width = round(1 / epsilon)
    events, _ = lives_and_events([k for k, _ in messages], epsilon, support)
    by_bucket = {}
    for event in events:
        by_bucket.setdefault(event[0], []).append(event)
    model, states, moves, last_move = MapModel(n), [], 0, {}
    base = int(T0.timestamp())
    clock = (base + messages[0][1]) // every + 1
    for i, (_, second) in enumerate(messages):
        while clock * every <= base + second:
            frozen = {k for k, t in last_move.items() if how.get("cooldown") and i - t < how["cooldown"]}
            before = dict(model.at)
            moves += model.round("improves", how.get("tolerance"), frozen)
            last_move |= {k: i for k, (_, p) in model.at.items() if before[k][1] != p}
            if states:
                states[-1] = dict(model.at)
            clock += 1
        if (i + 1) % width == 0:
            for _, key, kind, value in by_bucket.get((i + 1) // width, []):
                if kind == "hot":
                    model.add(key, value)
                    last_move.pop(key, None)
                elif value:
                    model.at.pop(key)
        states.append(dict(model.at))
    return states, moves


@pytest.mark.parametrize("how", [{}, {"tolerance": 0.3}, {"cooldown": 45}, {"tolerance": 0.3, "cooldown": 45}])
def test_timed_rounds_match_a_loop_over_the_messages(spark, how):
    epsilon, support, n, every = 1 / 20, 3 / 20, 5, 30
    topics = {f"t{i}": bursts(500, f"clock{i}", every) for i in range(3)}
    messages = timed(spark, topics)
    bucketed = sketch.assign_buckets(messages, epsilon)
    lives, turns = sketch.lossy_lifecycles(bucketed, epsilon, support), sketch.turnovers(bucketed, epsilon)
    events = control.control_events(lives, turns, n, ticks=load.clock_ticks(messages, every))
    log = [r.asDict() for r in control.replay_control(events, n, **how).collect()]
    total = 0
    for topic, own in topics.items():
        states, moves = replayed(own, epsilon, support, n=n, every=every, **how)
        total += moves
        mine = [r for r in log if r["topic"] == topic]
        assert sum(r["opened_by"] == "move" for r in mine) == moves
        for i, state in enumerate(states):
            at = i + 2  # what the message after this one finds
            now = {
                r["key"]: (r["count"], r["partition"])
                for r in mine
                if r["valid_from"] <= at and (r["valid_to"] is None or r["valid_to"] > at)
            }
            assert now == state
    assert total > 0


def test_rounds_come_from_one_place(spark):
    with pytest.raises(ValueError):
        control.control_events(None, None, 3, rebalance_every=2, ticks=spark.range(1))


@pytest.mark.parametrize("cooldown", [None, 70])
@pytest.mark.parametrize("clock", [None, 30])
def test_the_log_does_not_depend_on_ranges(spark, clock, cooldown):
    epsilon, support, n = 1 / 20, 3 / 20, 5
    messages = timed(spark, {f"t{i}": bursts(400 + 90 * i, f"range{i}", 30) for i in range(3)})
    bucketed = sketch.assign_buckets(messages, epsilon)
    lives, turns = sketch.lossy_lifecycles(bucketed, epsilon, support), sketch.turnovers(bucketed, epsilon)
    ticks = None if clock is None else load.clock_ticks(messages, clock)
    events = control.control_events(lives, turns, n, 1 if clock is None else None, ticks).cache()
    whole = sorted(map(str, control.replay_control(events, n, cooldown=cooldown).collect()))
    assert any("move" in row for row in whole)
    for span in (29, 1_000):
        ranges = events.select(F.floor((F.col("at") - 1) / span)).distinct().count()
        assert ranges == (1 if span == 1_000 else 20)
        cut = control.replay_in_ranges(events, n, span, cooldown=cooldown)
        assert sorted(map(str, cut.collect())) == whole
    assert control.replay_in_ranges(events.limit(0), n, 10).count() == 0
    events.unpersist()


def test_stored_ranges_follow_the_events(spark, monkeypatch):
    """Many ranges of few messages are folded together: no job for each of them."""
    rows = [
        ("t", 40 * i + 1, 0, i, op, f"k{i // 2 if op == 'promote' else i // 2 - 3}", 5, i % 3, (i + 1) % 3)
        for i in range(300) for op in [("promote", "evict")[i % 2]]
    ]
    events = spark.createDataFrame(
        rows, "topic string, at long, phase int, insert_n long, op string, key string, count long, p1 int, p2 int"
    )
    whole = sorted(map(str, control.replay_control(events, 3).collect()))
    stored, kept = [], control.materialize
    monkeypatch.setattr(control, "materialize", lambda df, name: stored.append(name) or kept(df, name))
    assert sorted(map(str, control.replay_in_ranges(events, 3, 40).collect())) == whole
    assert 1 < len(stored) <= control.RANGES
    stored.clear()
    monkeypatch.setattr(control, "RANGE_EVENTS", 10)
    assert sorted(map(str, control.replay_in_ranges(events, 3, 40).collect())) == whole
    assert control.RANGES < len(stored) <= 30


def test_large_output_is_sent_in_parts(spark):
    """More closed intervals in one Arrow batch than are held."""
    rows = [("t", i, 0, i, op, f"k{i // 2}", 5, i % 3, (i + 1) % 3) for i in range(30_000) for op in [("promote", "evict")[i % 2]]]
    events = spark.createDataFrame(
        rows, "topic string, at long, phase int, insert_n long, op string, key string, count long, p1 int, p2 int"
    )
    log = control.replay_control(events, 3)
    assert log.count() == 15_000 and log.where("valid_to - valid_from = 1").count() == 15_000

"""The control plane: history of the hot map from sketch events and rebalance ticks.

Placing a key depends on the sizes all earlier placements left, so within one
topic this is sequential by definition. What is folded is small: a key must first
collect ``(support - epsilon) / epsilon`` messages beyond its losses to be promoted,
cold evictions are dropped beforehand, and the state is the current map. Events
arrive sorted and in batches, so memory holds the map, one batch and FLUSH_ROWS of
output, never a topic's whole history; messages do not pass through here at all. A topic
whose events outgrow one task is folded range by range (``replay_in_ranges``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.hashing import p2c_draws
from keytide.functions.joins import dimension_join
from keytide.operators import sketch
from keytide.operators.placement import STOP_RULES
from keytide.session import materialize, scratch_path

LOG_SCHEMA = (
    "topic string, key string, count bigint, partition int,"
    " valid_from bigint, valid_to bigint, opened_by string, moved_at bigint"
)
# Prefix of the events that put back an entry; what opened it follows.
LOAD = "load:"
# Closed intervals held before they are sent on.
FLUSH_ROWS = 10_000
# Stored ranges of a replay: not more than RANGES, unless they would have more than RANGE_EVENTS events.
RANGES = 16
RANGE_EVENTS = 200_000
EVENT_COLUMNS = ("topic", "at", "phase", "insert_n", "op", "key", "count", "p1", "p2")


def control_events(
    lives: DataFrame,
    turns: DataFrame,
    n_partitions: int,
    rebalance_every: int | None = None,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Promotions, evictions of hot keys and ticks, each at the message it follows.

    Rounds of rebalancing come every ``rebalance_every`` turnovers, or by the clock: ``ticks`` are
    ``(topic, at_seq, times)`` (see ``load.clock_ticks``), so many rounds after that message.
    With neither the map stays unbalanced. Turnovers at the same message go first.
    """
    if rebalance_every is not None and ticks is not None:
        raise ValueError("rounds come by turnovers or by the clock, not by both")
    was_hot = F.col("hot_bucket").isNotNull()
    up = F.struct(
        F.col("hot_bucket").alias("bucket"),
        F.col("hot_count").alias("count"),
        F.lit("promote").alias("op"),
    )
    down = F.struct(
        F.col("end_bucket").alias("bucket"),
        F.lit(0).cast("long").alias("count"),
        F.lit("evict").alias("op"),
    )
    # Both events of a life in one pass; keys that never were hot drop out here.
    events = lives.where(was_hot).select(
        "topic",
        "key",
        "insert_n",
        F.inline(F.array_compact(F.array(up, F.when(F.col("end_bucket").isNotNull(), down)))),
    )
    first, second = p2c_draws(F.col("key"), n_partitions)
    changes = (
        events.join(turns.select("topic", "bucket", "close_seq"), ["topic", "bucket"])
        .select(
            "topic",
            F.col("close_seq").alias("at"),
            F.lit(0).alias("phase"),
            "insert_n",
            "op",
            "key",
            "count",
            first.alias("p1"),
            second.alias("p2"),
        )
    )
    if rebalance_every is not None:
        ticks = turns.where(F.col("bucket") % rebalance_every == 0).select(
            "topic", F.col("close_seq").alias("at_seq"), F.lit(1).alias("times")
        )
    return changes if ticks is None else changes.unionByName(tick_events(ticks))


def tick_events(ticks: DataFrame) -> DataFrame:
    """Events of ``ticks (topic, at_seq, times)``; ``count`` is the number of rounds."""
    return ticks.select(
        "topic",
        F.col("at_seq").alias("at"),
        F.lit(1).alias("phase"),
        F.lit(0).cast("long").alias("insert_n"),
        F.lit("tick").alias("op"),
        F.lit("").alias("key"),
        F.col("times").cast("long").alias("count"),
        F.lit(0).alias("p1"),
        F.lit(0).alias("p2"),
    )


def load_events(standing: DataFrame) -> DataFrame:
    """Events that put the standing entries of a log back, before all others of the topic."""
    return standing.select(
        "topic",
        F.col("valid_from").alias("at"),
        F.lit(-1).alias("phase"),
        F.coalesce("moved_at", F.lit(-1)).cast("long").alias("insert_n"),
        F.concat(F.lit(LOAD), F.col("opened_by")).alias("op"),
        "key",
        "count",
        F.col("partition").alias("p1"),
        F.lit(0).alias("p2"),
    )


class TopicMap:
    """Hot map of one topic: key -> [count, partition, since, opened_by, moved_at]."""

    def __init__(self, n_partitions: int):
        self.sizes = [0] * n_partitions
        self.members: list[set[str]] = [set() for _ in range(n_partitions)]
        self.entries: dict[str, list] = {}
        # nothing has changed since a round that found nothing to move
        self.settled = False

    def put(self, key: str, count: int, partition: int, since: int, op: str, moved_at=None):
        self.entries[key] = [count, partition, since, op, moved_at]
        self.members[partition].add(key)
        self.sizes[partition] += count
        self.settled = False

    def take(self, key: str) -> list | None:
        entry = self.entries.pop(key, None)
        if entry is not None:
            self.members[entry[1]].discard(key)
            self.sizes[entry[1]] -= entry[0]
            self.settled = False
        return entry

    def lighter(self, p1: int, p2: int) -> int:
        return p2 if self.sizes[p1] > self.sizes[p2] else p1

    def target(self, count: int, src: int, under: list[int], mean: float, rule: str) -> int | None:
        sign = -2 if rule == "improves" else 2
        best, best_off = None, None
        for dst in under:
            gap = self.sizes[src] - self.sizes[dst]
            if gap < 0 or gap < abs(gap + sign * count):
                continue
            off = abs(self.sizes[dst] + count - mean)
            if best is None or off < best_off:
                best, best_off = dst, off
        return best

    def rebalance(
        self, at: int, rule: str, tolerance: float | None, cooldown: int | None
    ) -> list[tuple[str, list, int]]:
        """Moves of one round as (key, entry before the move, new partition)."""
        if self.settled:
            return []
        waiting = False
        mean = sum(self.sizes) / len(self.sizes)
        if tolerance is not None and max(self.sizes) <= mean * (1.0 + tolerance):
            return []
        under = [p for p, size in enumerate(self.sizes) if size < mean]
        over = [p for p, size in enumerate(self.sizes) if size > mean]
        moves = []
        for src in over:
            excess = self.sizes[src] - mean
            # All targets of one source are chosen before any of its keys moves,
            # so keys of equal count share their target.
            chosen: dict[int, int | None] = {}
            leaving = []
            for key in self.members[src]:
                count, _, _, _, moved_at = self.entries[key]
                if count > excess:
                    continue
                if cooldown is not None and moved_at is not None and at - moved_at < cooldown:
                    waiting = True
                    continue
                if count not in chosen:
                    chosen[count] = self.target(count, src, under, mean, rule)
                if chosen[count] is not None:
                    leaving.append((key, chosen[count]))
            for key, dst in leaving:
                before = self.take(key)
                self.put(key, before[0], dst, at + 1, "move", at)
                moves.append((key, before, dst))
        self.settled = not moves and not waiting
        return moves


    def round_by_counts(
        self, by_source: list[dict[int, int]], rule: str, tolerance: float | None
    ) -> list[tuple[int, int, int]]:
        """Moves of one round as (source, count of the keys, target), ``by_source`` telling how
        many keys of each count a partition has; only ``sizes`` are used and changed."""
        mean = sum(self.sizes) / len(self.sizes)
        if tolerance is not None and max(self.sizes) <= mean * (1.0 + tolerance):
            return []
        under = [p for p, size in enumerate(self.sizes) if size < mean]
        over = [p for p, size in enumerate(self.sizes) if size > mean]
        moves = []
        for src in over:
            excess = self.sizes[src] - mean
            targets = {
                count: self.target(count, src, under, mean, rule)
                for count in by_source[src]
                if count <= excess
            }
            for count, dst in targets.items():
                if dst is not None:
                    self.sizes[src] -= count * by_source[src][count]
                    self.sizes[dst] += count * by_source[src][count]
                    moves.append((src, count, dst))
        return moves


def replay_control(
    events: DataFrame,
    n_partitions: int,
    stop_rule: str = "improves",
    tolerance: float | None = None,
    cooldown: int | None = None,
) -> DataFrame:
    """Validity intervals of the hot map: each key's partition from and to which seq.

    A change made after message s is valid from s + 1; ``valid_to`` is exclusive and
    NULL while the entry stands; ``moved_at`` is the key's last move. ``cooldown`` is in
    messages of the topic. Events made by ``load_events`` put back an earlier state.
    """
    if stop_rule not in STOP_RULES:
        raise ValueError(f"stop_rule is one of {STOP_RULES}")

    def fold(group: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topic = group[0]
        state = TopicMap(n_partitions)
        columns = [
            "key", "count", "partition", "valid_from", "opened_by", "moved_at", "valid_to",
        ]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            out.insert(0, "topic", topic)
            for nullable in ("valid_to", "moved_at"):
                out[nullable] = out[nullable].astype("Int64")
            return out

        for batch in batches:
            closed: list[tuple] = []
            for at, moved, op, key, count, p1, p2 in zip(
                batch["at"], batch["insert_n"], batch["op"], batch["key"],
                batch["count"], batch["p1"], batch["p2"],
            ):
                at = int(at)
                if op == "promote":
                    if key not in state.entries:
                        state.put(key, int(count), state.lighter(p1, p2), at + 1, "promote")
                elif op == "evict":
                    entry = state.take(key)
                    if entry is not None:
                        closed.append((key, *entry, at + 1))
                elif op.startswith(LOAD):
                    last_move = int(moved) if moved >= 0 else None
                    state.put(key, int(count), int(p1), at, op[len(LOAD):], last_move)
                else:
                    # idle ticks: nothing arrives in between, so a round without moves is the last
                    for _ in range(int(count)):
                        moves = state.rebalance(at, stop_rule, tolerance, cooldown)
                        closed.extend((moved_key, *before, at + 1) for moved_key, before, _ in moves)
                        if not moves:
                            break
                if len(closed) >= FLUSH_ROWS:
                    yield frame(closed)
                    closed = []
            if closed:
                yield frame(closed)
        entries = iter(state.entries.items())
        while standing := [(key, *entry, None) for key, entry in islice(entries, FLUSH_ROWS)]:
            yield frame(standing)

    # One exchange and one sort; the grouping below finds both already in place.
    ordered = (
        events.select(*EVENT_COLUMNS)
        .repartition("topic")
        .sortWithinPartitions("topic", F.col("phase") >= 0, "at", "phase", "insert_n")
    )
    return ordered.groupBy("topic").applyInPandas(_iterating(fold), LOG_SCHEMA)


def replay_in_ranges(
    events: DataFrame,
    n_partitions: int,
    span: int,
    stop_rule: str = "improves",
    tolerance: float | None = None,
    cooldown: int | None = None,
) -> DataFrame:
    """``replay_control``, ``span`` messages of every topic at a time: the same log.

    The map as it stands after a range is stored and put back at the start of the next, so a
    task folds a topic's events of one range only, and what is lost with an executor is one range.
    Many ranges with few events each are folded with their neighbours, so that the number of
    jobs follows the events (see RANGES), not the messages. Reads ``events`` three times: pass them stored.
    """
    which = F.floor((F.col("at") - 1) / F.lit(span)).cast("long")
    bounds = _range_bounds(events.select(which.alias("r")))
    if not bounds:
        return replay_control(events, n_partitions, stop_rule, tolerance, cooldown)
    earlier = F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < which)
    dealt = events.select(*EVENT_COLUMNS, F.size(earlier).alias("_range")).repartition("_range", "topic")
    path = scratch_path(events.sparkSession, "range-events")
    dealt.write.partitionBy("_range").parquet(path)
    schema = events.select(*EVENT_COLUMNS).schema
    parts: list[DataFrame] = []
    standing = None
    for r in range(len(bounds)):
        own = events.sparkSession.read.schema(schema).parquet(f"{path}/_range={r}")
        if standing is not None:
            own = load_events(standing).unionByName(own)
        log = replay_control(own, n_partitions, stop_rule, tolerance, cooldown)
        log = materialize(log, f"map-log-{r}")
        standing = log.where(F.col("valid_to").isNull())
        parts.append(log.where(F.col("valid_to").isNotNull()))
    for part in parts:
        standing = standing.unionByName(part)
    return standing


def _range_bounds(ranges: DataFrame) -> list[int]:
    """The last range of each group to fold, given ``r`` of every event; every group has events."""
    most = max(RANGES, -(-ranges.count() // RANGE_EVENTS))
    some = sorted(row["r"] for row in ranges.distinct().limit(most + 1).collect())
    if len(some) <= most:
        return some
    shares = [i / most for i in range(1, most + 1)]
    cuts = ranges.agg(F.percentile_approx("r", shares).alias("cuts"), F.max("r").alias("last")).first()
    return sorted({*cuts["cuts"], cuts["last"]})


def _iterating(fold):
    """Give the fold the annotations by which Spark selects the batch-wise form."""

    def run(
        key: tuple[str, ...], batches: Iterator[pd.DataFrame]
    ) -> Iterator[pd.DataFrame]:
        return fold(key, batches)

    run.__annotations__ = {
        "key": tuple[str, ...],
        "batches": Iterator[pd.DataFrame],
        "return": Iterator[pd.DataFrame],
    }
    return run


def rebalance_round(
    hot_map: DataFrame,
    n_partitions: int,
    stop_rule: str = "improves",
    tolerance: float | None = None,
) -> DataFrame:
    """One round on a given map: topic, key, count, src, partition.

    Sources go in ascending order and each sees the sizes the ones before left. Keys of one source
    with equal counts share their target, and a partition that only receives is no source; so
    the round is decided on how many keys each partition has of each count, and keys look up
    what became of theirs. A topic's different counts are what one task holds, not its keys.
    """
    if stop_rule not in STOP_RULES:
        raise ValueError(f"stop_rule is one of {STOP_RULES}")

    def decide(key: tuple, tally: pd.DataFrame) -> pd.DataFrame:
        state = TopicMap(n_partitions)
        by_source: list[dict[int, int]] = [{} for _ in range(n_partitions)]
        for partition, count, keys in zip(tally["partition"], tally["count"], tally["keys"]):
            by_source[partition][int(count)] = int(keys)
            state.sizes[partition] += int(count) * int(keys)
        moves = [
            (key[0], src, count, dst)
            for src, count, dst in state.round_by_counts(by_source, stop_rule, tolerance)
        ]
        return pd.DataFrame(moves, columns=["topic", "partition", "count", "_to"])

    tally = hot_map.groupBy("topic", "partition", "count").agg(F.count(F.lit(1)).alias("keys"))
    moves = tally.groupBy("topic").applyInPandas(
        decide, "topic string, partition int, count bigint, _to int"
    )
    moves = materialize(moves, "moves")
    after = dimension_join(hot_map, moves, ["topic", "partition", "count"])
    return after.select(
        "topic",
        "key",
        "count",
        F.when(F.col("_to").isNotNull(), F.col("partition")).alias("src"),
        F.coalesce("_to", "partition").alias("partition"),
    )


def build_map_log(events: DataFrame) -> DataFrame:
    """Intervals from change events ``topic, key, seq, op, count, partition``.

    An entry stands from the message after the change to the key's next change;
    evictions close an entry and open none.
    """
    by_key = W.partitionBy("topic", "key").orderBy("seq")
    chained = events.withColumn("valid_to", F.lead("seq").over(by_key) + 1)
    return chained.where(F.col("op") != "evict").select(
        "topic",
        "key",
        "count",
        "partition",
        (F.col("seq") + 1).alias("valid_from"),
        "valid_to",
        F.col("op").alias("opened_by"),
    )


def current_map(hot_map_log: DataFrame) -> DataFrame:
    """The map as it stands after the last change."""
    return hot_map_log.where(F.col("valid_to").isNull()).select(
        "topic", "key", "count", "partition"
    )


def map_at(hot_map_log: DataFrame, now: DataFrame) -> DataFrame:
    """The map right after message ``at_seq`` of each topic."""
    position = F.col("at_seq") + 1
    return (
        hot_map_log.join(now, "topic")
        .where(
            (F.col("valid_from") <= position)
            & (F.col("valid_to").isNull() | (F.col("valid_to") > position))
        )
        .select("topic", "key", "count", "partition")
    )

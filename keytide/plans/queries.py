"""One callable per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.chunked import with_sequence
from keytide.functions.hashing import fnv1a, fnv_partition
from keytide.functions.headers import decode_tag, encode_tag, header, producer_headers
from keytide.operators import (
    control,
    delivery,
    endpoints,
    frequency,
    ingest,
    latency,
    load,
    message_sets,
    placement,
    routing,
    sketch,
)
from keytide.plans import oracle as o
from keytide.plans import workload as wl
from keytide.session import configure, materialize, scratch_path
from keytide.sources import (
    kafka_columns,
    read_messages,
    read_traces,
    write_latency_csv,
    write_messages,
)
from keytide.streaming import (
    HotKeyConfig,
    MapVersions,
    current_sets,
    run_hot_key_stream,
    stream_latest_sets,
    stream_live_map,
    stream_partition_rate,
    stream_shift_events,
    stream_sketch,
    stream_sticky_round_robin,
    stream_sync_events,
    stream_tags,
    stream_tags_in_store,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = o.MESSAGES, recursive: bool = False):
    def register(fn):
        QUERIES[name] = lambda spark, sf: fn(configure(spark), sf)
        if sql is not None:
            ORACLES[name] = o._with(recursive, ctes, sql) if ctes else sql
        return fn

    return register


def micros(ts: str = "ts"):
    return F.unix_micros(ts).alias("ts_us")


# --- sources, hashing, counts -------------------------------------------------


@query("msg_source", "SELECT msg_id, ts_us, topic, key, body FROM km")
def msg_source(spark, sf):
    """The log, written as files and read by the source."""
    path = scratch_path(spark, "log")
    wl.keyed_messages(spark, sf).write.parquet(path)
    return read_messages(spark, path).select("msg_id", micros(), "topic", "key", "body")


@query("fnv_partition", "SELECT key, h AS hash, p AS partition FROM hashes", o.SEQ)
def fnv_partition_query(spark, sf):
    keys = wl.keyed_messages(spark, sf).select("key").distinct()
    return keys.select(
        "key",
        fnv1a(F.col("key")).alias("hash"),
        fnv_partition(F.col("key"), wl.N_PARTITIONS).alias("partition"),
    )


@query(
    "sampled_msgs",
    f"""SELECT msg_id, topic, key FROM km
    WHERE CAST(('0x' || substr(md5(CAST(msg_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE
          >= {wl.SAMPLE_THRESHOLD}""",
)
def sampled_msgs(spark, sf):
    messages = wl.keyed_messages(spark, sf).select("msg_id", "topic", "key")
    return frequency.sample_messages(messages, wl.SAMPLE_THRESHOLD)


def _with_producer(spark, sf):
    messages = wl.keyed_messages(spark, sf)
    who = F.concat(F.lit("10.1.0."), (F.col("msg_id") % 3).cast("string"))
    return frequency.with_producer_header(messages, who)


@query(
    "msg_headers",
    """SELECT msg_id, 'Producer' AS header_key,
              '10.1.0.' || CAST(msg_id % 3 AS VARCHAR) AS header_value FROM km""",
)
def msg_headers(spark, sf):
    first = F.col("headers")[0]
    return _with_producer(spark, sf).select(
        "msg_id",
        first["key"].alias("header_key"),
        first["value"].cast("string").alias("header_value"),
    )


@query(
    "header_lookup",
    """SELECT msg_id, '10.1.0.' || CAST(msg_id % 3 AS VARCHAR) AS producer,
              CAST(NULL AS VARCHAR) AS absent FROM km""",
)
def header_lookup(spark, sf):
    return _with_producer(spark, sf).select(
        "msg_id",
        header(F.col("headers"), "Producer").cast("string").alias("producer"),
        header(F.col("headers"), "NoSuchHeader").cast("string").alias("absent"),
    )


@query("key_counts", "SELECT topic, key, count(*) AS count FROM km GROUP BY ALL")
def key_counts(spark, sf):
    return frequency.key_counts(wl.keyed_messages(spark, sf))


@query(
    "freq_report",
    """SELECT topic, count(*) AS distinct_keys, count(*) FILTER (c > 100) AS heavy_keys,
              CAST(coalesce(sum(c) FILTER (c > 100), 0) AS BIGINT) AS heavy_requests,
              CAST(sum(c) AS BIGINT) AS total_requests, (SELECT count(DISTINCT key) FROM km) AS keyspace
       FROM (SELECT topic, key, count(*) AS c FROM km GROUP BY ALL) GROUP BY topic""",
)
def freq_report(spark, sf):
    return frequency.freq_report(key_counts(spark, sf))


@query(
    "heavy_keys",
    "SELECT topic, key, count(*) AS count FROM km GROUP BY ALL HAVING count(*) > 100",
)
def heavy_keys(spark, sf):
    return frequency.heavy_keys(key_counts(spark, sf))


# --- arrival order and count windows ------------------------------------------


@query("sequence", "SELECT msg_id, topic, seq FROM ms", o.SEQ)
def sequence(spark, sf):
    """The sliced form, whatever the size of the input."""
    narrow = wl.keyed_messages(spark, sf).select("msg_id", "ts", "topic")
    return with_sequence(narrow, slice_rows=1_500).select("msg_id", "topic", "seq")


def _bucketed(spark, sf):
    """From the stored log: what follows reads it more than once."""
    return sketch.assign_buckets(wl.sequenced_log(spark, sf), wl.EPSILON)


def _max_bucket(spark, sf):
    return wl.events(spark, sf).count() // sketch.bucket_width(wl.EPSILON)


@query(
    "bucketed", "SELECT msg_id, topic, key, seq AS n, bucket FROM bk", o.lossy(), recursive=True
)
def bucketed(spark, sf):
    return _bucketed(spark, sf).select("msg_id", "topic", "key", "n", "bucket")


@query(
    "bucketed_sampled",
    f"""SELECT msg_id, topic, n, (n - 1) // 100 + 1 AS bucket FROM (
          SELECT msg_id, topic, row_number() OVER (PARTITION BY topic ORDER BY seq) AS n FROM ms
          WHERE CAST(('0x' || substr(md5(CAST(msg_id AS VARCHAR)), 1, 8)) AS BIGINT)
                / 4294967296.0::DOUBLE >= {wl.SAMPLE_THRESHOLD})""",
    o.SEQ,
)
def bucketed_sampled(spark, sf):
    kept = frequency.sample_messages(wl.sequenced(spark, sf), wl.SAMPLE_THRESHOLD)
    return sketch.assign_buckets(kept, wl.EPSILON, sampled=True).select(
        "msg_id", "topic", "n", "bucket"
    )


def _lives(spark, sf):
    return sketch.lossy_lifecycles(
        _bucketed(spark, sf), wl.EPSILON, wl.SUPPORT, max_bucket=_max_bucket(spark, sf)
    )


@query(
    "lossy_lifecycle",
    """SELECT s.topic, s.key, s.start_b AS start_bucket,
              min(s.bucket) FILTER (NOT s.kept) AS end_bucket,
              max(s.seen) AS seen, min(s.ins) AS insert_n,
              min(s.bucket) FILTER (s.hot) AS hot_bucket,
              arg_min(s.cnt, s.bucket) FILTER (s.hot) AS hot_count
       FROM step s GROUP BY s.topic, s.key, s.start_b""",
    o.lossy(),
    recursive=True,
)
def lossy_lifecycle(spark, sf):
    return _lives(spark, sf).drop("status", "count")


@query(
    "lossy_items",
    """SELECT topic, key, bucket, cnt AS count, start_b - 1 AS delta, hot AS is_hot
       FROM step WHERE kept""",
    o.lossy(),
    recursive=True,
)
def lossy_items(spark, sf):
    return sketch.lossy_items(
        _bucketed(spark, sf), wl.EPSILON, wl.SUPPORT, max_bucket=_max_bucket(spark, sf)
    )


@query(
    "hot_keys",
    """SELECT topic, key, min(bucket) AS bucket, arg_min(cnt, bucket) AS count,
              min(ins) AS insert_n
       FROM step WHERE hot GROUP BY topic, key, start_b""",
    o.lossy(),
    recursive=True,
)
def hot_keys(spark, sf):
    return sketch.hot_keys(_lives(spark, sf))


@query(
    "evictions",
    """SELECT s.topic, s.key, s.bucket, s.ins AS insert_n,
              EXISTS (SELECT 1 FROM step h WHERE h.hot AND h.topic = s.topic
                      AND h.key = s.key AND h.start_b = s.start_b) AS was_hot
       FROM step s WHERE NOT s.kept""",
    o.lossy(),
    recursive=True,
)
def evictions(spark, sf):
    return sketch.evictions(_lives(spark, sf))


@query(
    "sketch_stats",
    """SELECT b.topic, b.bucket, CAST(100 AS BIGINT) AS n_messages,
              (SELECT count(*) FROM step s WHERE s.kept AND s.topic = b.topic
               AND s.bucket = b.bucket) AS tracked
       FROM (SELECT topic, unnest(range(1, nb + 1)) AS bucket FROM fullb) b""",
    o.lossy(),
    recursive=True,
)
def sketch_stats(spark, sf):
    bucketed = _bucketed(spark, sf)
    lives = sketch.lossy_lifecycles(
        bucketed, wl.EPSILON, wl.SUPPORT, max_bucket=_max_bucket(spark, sf)
    )
    return sketch.sketch_stats(lives, sketch.turnovers(bucketed, wl.EPSILON))


# --- load ---------------------------------------------------------------------


def _given(spark, sf):
    """A stored map, and the sizes of its partitions."""
    given = wl.hot_map_given(spark, sf)
    return given, load.partition_sizes(given, wl.N_PARTITIONS)


def _given_sizes(spark, sf):
    return _given(spark, sf)[1]


@query("partition_sizes", "SELECT * FROM sz", o.GIVEN_MAP)
def partition_sizes(spark, sf):
    return _given_sizes(spark, sf)


@query("system_avg", "SELECT * FROM av", o.GIVEN_MAP)
def system_avg(spark, sf):
    return load.system_avg(_given_sizes(spark, sf))


@query(
    "ack_counts",
    """SELECT topic, count(*) FILTER (msg_id % 97 <> 0) AS successes,
              count(*) FILTER (msg_id % 97 = 0) AS errors FROM km GROUP BY topic""",
)
def ack_counts(spark, sf):
    return load.ack_counts(wl.acks(spark, sf))


@query(
    "partition_rate",
    """SELECT topic, p AS partition, ts_us // 1000000 * 1000000 AS window_us, count(*) AS messages
       FROM ms WHERE msg_id % 97 <> 0 GROUP BY ALL""",
    o.SEQ,
)
def partition_rate(spark, sf):
    return load.partition_rate(wl.acks(spark, sf))


SNAPSHOT_SECONDS = 3600


@query(
    "weight_snapshots",
    f"""SELECT t.topic, t.tick, p.partition,
               CAST(coalesce((SELECT sum(count) FROM lg
                 WHERE lg.topic = t.topic AND lg.partition = p.partition
                   AND lg.valid_from <= t.at_seq + 1
                   AND (lg.valid_to IS NULL OR lg.valid_to > t.at_seq + 1)), 0) AS BIGINT) AS size
        FROM (SELECT topic, tick, max(busy) OVER (PARTITION BY topic ORDER BY tick) AS at_seq
              FROM (SELECT topic, unnest(range(min(tick), max(tick) + 1)) AS tick
                    FROM tk GROUP BY topic)
              LEFT JOIN (SELECT topic, tick, max(seq) AS busy FROM tk GROUP BY ALL)
                USING (topic, tick)) t,
             (SELECT CAST(unnest(range(0, {wl.N_PARTITIONS})) AS INTEGER) AS partition) p""",
    o.GIVEN_LOG
    + f""",
tk AS (SELECT topic, ts_us // {SNAPSHOT_SECONDS * 1000000} + 1 AS tick, seq FROM ms)""",
)
def weight_snapshots(spark, sf):
    ticks = load.time_ticks(wl.sequenced(spark, sf), SNAPSHOT_SECONDS)
    return load.weight_snapshots(wl.hot_map_log_given(spark, sf), ticks, wl.N_PARTITIONS)


# --- placement ----------------------------------------------------------------


@query(
    "p2c_step",
    """SELECT topic, key, p1, p2, CASE WHEN s1 > s2 THEN p2 ELSE p1 END AS partition FROM (
         SELECT d.*, a.size AS s1, b.size AS s2 FROM draws d
         JOIN sz a ON a.topic = d.topic AND a.partition = d.p1
         JOIN sz b ON b.topic = d.topic AND b.partition = d.p2)""",
    o.GIVEN_MAP
    + f""",
draws AS (
  SELECT topic, key, {o.fnv_part("(key || '#1')")} AS p1, {o.fnv_part("(key || '#2')")} AS p2
  FROM (SELECT DISTINCT topic, key FROM ms)
)""",
)
def p2c_step(spark, sf):
    keys = wl.keyed_messages(spark, sf).select("topic", "key").distinct()
    return placement.p2c_choose(keys, _given_sizes(spark, sf), wl.N_PARTITIONS)


@query(
    "partition_sets",
    """SELECT topic, partition, size, avg_size,
              CASE WHEN size < avg_size THEN 'less' WHEN size > avg_size THEN 'greater' END AS side
       FROM sz JOIN av USING (topic)""",
    o.GIVEN_MAP,
)
def partition_sets(spark, sf):
    return placement.partition_sets(_given_sizes(spark, sf))


def _candidates(spark, sf):
    return placement.migration_candidates(*_given(spark, sf))


@query(
    "migration_candidates",
    "SELECT topic, key, count, partition, size, avg_size FROM cand",
    o.GIVEN_MAP,
)
def migration_candidates(spark, sf):
    return _candidates(spark, sf)


@query(
    "target_match",
    o.target_match("c.size < d.size OR c.size - d.size < abs(c.size - d.size - 2 * c.count)"),
    o.GIVEN_MAP,
)
def target_match(spark, sf):
    given, sizes = _given(spark, sf)
    return placement.target_match(placement.migration_candidates(given, sizes), sizes)


@query(
    "target_match_as_written",
    o.target_match("c.size < d.size OR c.size - d.size < abs(c.size - d.size + 2 * c.count)"),
    o.GIVEN_MAP,
)
def target_match_as_written(spark, sf):
    given, sizes = _given(spark, sf)
    return placement.target_match(placement.migration_candidates(given, sizes), sizes, "as_written")


@query(
    "rebalance_round",
    f"SELECT topic, key, count, src, cur AS partition FROM rb WHERE step = {wl.N_PARTITIONS}",
    o.REBALANCE,
    recursive=True,
)
def rebalance_round(spark, sf):
    return control.rebalance_round(wl.hot_map_given(spark, sf), wl.N_PARTITIONS)


TOLERANCE = 1.5


@query(
    "rebalance_tolerance",
    f"""SELECT topic, max(size) AS max_size, any_value(avg_size) AS avg_size,
               max(size) <= any_value(avg_size) * (1.0::DOUBLE + {TOLERANCE}::DOUBLE) AS skip_round
        FROM sz JOIN av USING (topic) GROUP BY topic""",
    o.GIVEN_MAP,
)
def rebalance_tolerance(spark, sf):
    return placement.within_tolerance(_given_sizes(spark, sf), TOLERANCE)


COOLDOWN = 400


@query(
    "cooldown_candidates",
    f"""SELECT topic, key, count, partition, size, avg_size FROM cand
        WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT lg.*, 2 * step + {COOLDOWN // 2} AS now,
                                lag(partition) OVER (PARTITION BY topic, key ORDER BY valid_from)
                                  AS was FROM lg JOIN iv USING (topic)) l
          WHERE l.topic = cand.topic AND l.key = cand.key AND l.was <> l.partition
            AND l.valid_from <= l.now AND l.now - l.valid_from < {COOLDOWN})""",
    o.GIVEN_MAP + "," + o.GIVEN_INTERVALS[len(o.SEQ) + 1 :],
)
def cooldown_candidates(spark, sf):
    log = wl.hot_map_log_given(spark, sf)
    # shortly after the last moves of every topic
    now = wl.given_intervals(spark, sf).select(
        "topic", (F.col("step") * 2 + COOLDOWN // 2).alias("at_seq")
    )
    return placement.cooled_candidates(_candidates(spark, sf), log, now, COOLDOWN)


MAP_EVENTS = (
    o.GIVEN_LOG
    + """,
ev AS (
  SELECT topic, key, valid_from - 1 AS seq,
         CASE WHEN valid_from = 1 THEN 'promote' ELSE 'move' END AS op, count, partition FROM lg
  UNION ALL
  SELECT topic, key, (valid_from - 1) * 5 // 4, 'evict', count, partition
  FROM lg WHERE num = 9 AND valid_to IS NULL
),
chained AS (SELECT *, lead(seq) OVER (PARTITION BY topic, key ORDER BY seq) AS next_seq FROM ev)"""
)


@query(
    "hot_map_log",
    """SELECT topic, key, count, partition, seq + 1 AS valid_from, next_seq + 1 AS valid_to,
              op AS opened_by FROM chained WHERE op <> 'evict'""",
    MAP_EVENTS,
)
def hot_map_log(spark, sf):
    return control.build_map_log(wl.hot_map_events_given(spark, sf))


@query(
    "hot_map_current",
    """SELECT topic, key, count, partition FROM chained
       WHERE op <> 'evict' AND next_seq IS NULL""",
    MAP_EVENTS,
)
def hot_map_current(spark, sf):
    return control.current_map(hot_map_log(spark, sf))


@query(
    "hot_map_as_of",
    """SELECT lg.topic, key, count, partition FROM lg JOIN iv ON iv.topic = lg.topic
       WHERE valid_from <= step + step // 2 + 1 AND (valid_to IS NULL OR valid_to > step + step // 2 + 1)""",
    o.GIVEN_LOG,
)
def hot_map_as_of(spark, sf):
    """The map in the middle of each topic's second interval."""
    now = wl.given_intervals(spark, sf).select("topic", F.expr("step + step div 2").alias("at_seq"))
    return control.map_at(wl.hot_map_log_given(spark, sf), now)


def control_log(spark, sf, messages=None, **options):
    """The whole control plane: sketch, placement and rebalancing."""
    if messages is None:
        messages = wl.sequenced_log(spark, sf)
    bucketed = sketch.assign_buckets(messages, wl.EPSILON)
    lives = sketch.lossy_lifecycles(
        bucketed, wl.EPSILON, wl.SUPPORT, max_bucket=_max_bucket(spark, sf)
    )
    turns = sketch.turnovers(bucketed, wl.EPSILON)
    seconds = options.pop("rebalance_seconds", None)
    if seconds is None:
        every = options.pop("rebalance_every", wl.REBALANCE_EVERY)
        events = control.control_events(lives, turns, wl.N_PARTITIONS, every)
    else:
        ticks = load.clock_ticks(messages, seconds)
        events = control.control_events(lives, turns, wl.N_PARTITIONS, ticks=ticks)
    span = options.pop("span", None)
    if span is not None:
        return control.replay_in_ranges(
            materialize(events, "control-events"), wl.N_PARTITIONS, span, **options
        )
    return control.replay_control(events, wl.N_PARTITIONS, **options)


MAP_LOG = "SELECT topic, key, count, partition, valid_from, valid_to, opened_by FROM lgr"


@query("p2c_replay", MAP_LOG, o.replay(None), recursive=True)
def p2c_replay(spark, sf):
    return control_log(spark, sf, rebalance_every=None).drop("moved_at")


@query("control_replay", MAP_LOG, o.replay(o.EVERY_TURNOVERS), recursive=True)
def control_replay(spark, sf):
    return control_log(spark, sf).drop("moved_at")


@query("control_replay_ranges", MAP_LOG, o.replay(o.EVERY_TURNOVERS), recursive=True)
def control_replay_ranges(spark, sf):
    """The same, folded range by range; the number of stored ranges grows with the events."""
    return control_log(spark, sf, span=400).drop("moved_at")


@query("control_replay_timed", MAP_LOG, o.replay(o.EVERY_SECONDS), recursive=True)
def control_replay_timed(spark, sf):
    """Rounds of rebalancing by the clock, idle ticks included."""
    return control_log(spark, sf, rebalance_seconds=wl.REBALANCE_SECONDS).drop("moved_at")


# --- routing ------------------------------------------------------------------


@query("route_vanilla", "SELECT msg_id, topic, key, p AS route FROM ms", o.SEQ)
def route_vanilla(spark, sf):
    messages = wl.keyed_messages(spark, sf).select("msg_id", "topic", "key")
    return routing.route(messages, wl.N_PARTITIONS)


@query("route_hot", "SELECT msg_id, topic, key, seq, route FROM routed", o.GIVEN_LOG)
def route_hot(spark, sf):
    messages = wl.sequenced(spark, sf).select("msg_id", "topic", "key", "seq")
    return routing.route(messages, wl.N_PARTITIONS, wl.hot_map_log_given(spark, sf))


@query("route_hot_shuffled", "SELECT msg_id, topic, key, seq, route FROM routed", o.GIVEN_LOG)
def route_hot_shuffled(spark, sf):
    """The form used when the map's history is too large to broadcast."""
    messages = wl.sequenced(spark, sf).select("msg_id", "topic", "key", "seq")
    log = wl.hot_map_log_given(spark, sf)
    return routing.route(messages, wl.N_PARTITIONS, log, broadcast_rows=0)


@query(
    "route_unordered",
    f"""SELECT msg_id, topic, key, coalesce(lg.partition, {o.fnv_part("(CAST(msg_id AS VARCHAR) || '#r')")})
                 AS route
        FROM ms LEFT JOIN lg USING (topic, key)
        WHERE lg.topic IS NULL OR (ms.seq >= lg.valid_from
              AND (lg.valid_to IS NULL OR ms.seq < lg.valid_to))""",
    o.GIVEN_LOG,
)
def route_unordered(spark, sf):
    messages = wl.sequenced(spark, sf).select("msg_id", "topic", "key", "seq")
    log = wl.hot_map_log_given(spark, sf)
    return routing.route(messages, wl.N_PARTITIONS, log, cold="random").drop("seq")


@query(
    "sticky_rr",
    """SELECT km.msg_id, km.key, '10.2.0.' || CAST((t.turn - 1) % 4 + 1 AS VARCHAR) AS endpoint
       FROM km JOIN (
         SELECT key, row_number() OVER (ORDER BY f.ts, f.msg_id) AS turn
         FROM (SELECT key, min({'ts': ts, 'msg_id': msg_id}) AS f FROM km GROUP BY key)) t
       USING (key)""",
)
def sticky_rr(spark, sf):
    messages = wl.keyed_messages(spark, sf).select("msg_id", "ts", "key")
    return endpoints.sticky_round_robin(messages, wl.endpoints(spark)).drop("ts")


EPOCH_DAYS = 7


@query(
    "sticky_rr_epochs",
    f"""SELECT km.msg_id, km.key, ts_us // {EPOCH_DAYS * 86_400_000_000} AS epoch,
               '10.2.0.' || CAST((t.turn - 1) % 4 + 1 AS VARCHAR) AS endpoint
       FROM km JOIN (
         SELECT key, epoch, row_number() OVER (ORDER BY f.ts, f.msg_id) AS turn
         FROM (SELECT key, ts_us // {EPOCH_DAYS * 86_400_000_000} AS epoch, min({{'ts': ts, 'msg_id': msg_id}}) AS f
               FROM km GROUP BY ALL)) t
       ON t.key = km.key AND t.epoch = ts_us // {EPOCH_DAYS * 86_400_000_000}""",
)
def sticky_rr_epochs(spark, sf):
    """Endpoints change every week: all keys are assigned anew, the turn goes on."""
    return endpoints.sticky_round_robin(_epochs(wl.keyed_messages(spark, sf)), wl.endpoints(spark), "epoch").drop("ts")


def _epochs(messages):
    epoch = F.floor(F.unix_micros("ts") / F.lit(EPOCH_DAYS * 86_400_000_000)).cast("long")
    return messages.select("msg_id", "ts", "key", epoch.alias("epoch"))


@query("endpoint_registry", "SELECT service, array_to_string(ips, ',') AS ips, version FROM reg", o.FEED)
def endpoint_registry(spark, sf):
    registry = endpoints.fold_endpoints(wl.endpoint_feed(spark, sf))
    return registry.withColumn("ips", F.array_join("ips", ","))


@query(
    "endpoint_lookup",
    """SELECT s_suppkey AS request_id, n_name AS service, array_to_string(reg.ips, ',') AS ips
       FROM supplier JOIN nation ON s_nationkey = n_nationkey
       LEFT JOIN reg ON reg.service = n_name""",
    o.FEED,
)
def endpoint_lookup(spark, sf):
    feed = wl.endpoint_feed(spark, sf)
    requests = feed.where("op = 'upsert'").select(F.col("feed_seq").alias("request_id"), "service")
    found = endpoints.lookup_endpoints(requests, endpoints.fold_endpoints(feed))
    return found.withColumn("ips", F.array_join("ips", ","))


# --- message sets and delivery --------------------------------------------------


# What follows a stage reads it more than once, so each stage's log is stored: what
# arrived, what was sent, what was delivered. Lazily chained, every reader would
# compute all stages before it again.


def _tagged(spark, sf):
    messages = wl.sequenced_log(spark, sf).select("topic", "key", "seq")
    log = wl.hot_map_log_given(spark, sf)
    return message_sets.tag_message_sets(messages, wl.N_PARTITIONS, log)


def _sent(spark, sf):
    return message_sets.sent_partition(_tagged(spark, sf))


def _sent_log(spark, sf):
    return materialize(_sent(spark, sf), "sent")


def _delivered(spark, sf):
    return materialize(delivery.delivery_log(_sent_log(spark, sf)), "delivered")


TAG = "src_partition, src_idx, dest_partition, dest_idx"


@query("message_sets", f"SELECT topic, seq, key, {TAG}, is_boundary FROM tagged", o.GIVEN_LOG)
def message_sets_query(spark, sf):
    return _tagged(spark, sf)


@query("sent_messages", "SELECT topic, seq, key, is_boundary, sent_partition FROM sent", o.GIVEN_LOG)
def sent_messages(spark, sf):
    return _sent(spark, sf).select("topic", "seq", "key", "is_boundary", "sent_partition")


@query(
    "latest_msgset",
    f"""SELECT topic, key, {TAG} FROM (
          SELECT *, row_number() OVER (PARTITION BY topic, key ORDER BY seq DESC) AS rk FROM tagged)
        WHERE rk = 1""",
    o.GIVEN_LOG,
)
def latest_msgset(spark, sf):
    return message_sets.latest_message_set(_tagged(spark, sf))


# Every fifth key is deleted at two thirds of its topic; some send again after that.
SETS_LEFT = o.GIVEN_LOG + """,
left_over AS (
  SELECT * FROM (
    SELECT tagged.*, row_number() OVER (PARTITION BY topic, key ORDER BY seq DESC) AS rk FROM tagged
  ) JOIN iv USING (topic) WHERE rk = 1 AND (num % 5 <> 0 OR seq > 2 * step)
)"""


def _deletes(spark, sf):
    num = F.expr("CAST(substr(key, 10) AS BIGINT)")
    keys = wl.keyed_messages(spark, sf).select("topic", "key").distinct().where(num % 5 == 0)
    return keys.join(wl.given_intervals(spark, sf), "topic").select(
        "topic", "key", (F.col("step") * 2).alias("seq")
    )


@query("latest_msgset_deleted", f"SELECT topic, key, {TAG} FROM left_over", SETS_LEFT)
def latest_msgset_deleted(spark, sf):
    return message_sets.latest_message_set(_tagged(spark, sf), _deletes(spark, sf))


@query("msgset_length", "SELECT topic, count(*) AS keys FROM left_over GROUP BY topic", SETS_LEFT)
def msgset_length(spark, sf):
    return message_sets.set_count(latest_msgset_deleted(spark, sf))


@query("stream_latest_msgset", f"SELECT topic, key, {TAG} FROM left_over", SETS_LEFT)
def stream_latest_msgset(spark, sf):
    """Tagged records and tombstones as a stream, in as many batches as there are thirds."""
    path, out, offsets = (scratch_path(spark, n) for n in ("records", "latest", "offsets"))
    tags = [F.col(c) for c in message_sets.TAG_COLUMNS]
    sent = _tagged(spark, sf).select("topic", "key", "seq", F.lit(False).alias("is_delete"), *tags)
    dead = _deletes(spark, sf).withColumn("is_delete", F.lit(True))
    line = materialize(sent.unionByName(dead, allowMissingColumns=True), "records")
    step = wl.given_intervals(spark, sf)
    line = line.join(step, "topic").withColumn("third", F.least(F.expr("(seq - 1) div step"), F.lit(2)))
    for third in range(3):
        line.where(F.col("third") == third).drop("third", "step").write.mode("append").parquet(path)
        records = spark.readStream.schema(line.drop("third", "step").schema).parquet(path)
        stream_latest_sets(records, out, offsets).awaitTermination()
    return current_sets(spark, out)


@query(
    "msgset_codec",
    f"""SELECT topic, seq, key, {TAG},
               concat_ws(' ', key, src_partition, src_idx, dest_partition, dest_idx) || chr(10) AS wire
        FROM tagged""",
    o.GIVEN_LOG,
)
def msgset_codec(spark, sf):
    """Tags written to bytes in both forms and read back."""
    tagged = _tagged(spark, sf).withColumn("tag", message_sets.tag_struct())
    wired = tagged.select(
        "topic",
        "seq",
        encode_tag(F.col("tag"), "text").alias("text"),
        encode_tag(F.col("tag"), "json").alias("json"),
    )
    read = wired.select(
        "topic",
        "seq",
        F.col("text").cast("string").alias("wire"),
        decode_tag(F.col("text"), "text").alias("a"),
        decode_tag(F.col("json"), "json").alias("b"),
    )
    return read.where(F.col("a") == F.col("b")).select("topic", "seq", "wire", "a.*")


@query(
    "tag_quarantine",
    """SELECT topic, seq, key, seq % 9 = 0 AS undecodable, CASE WHEN seq % 9 <> 0 AND seq % 10 <> 1 THEN dest_idx END
         AS dest_idx FROM tagged""",
    o.GIVEN_LOG,
)
def tag_quarantine(spark, sf):
    """Every ninth tag is cut off, some records have none: who can be read, and who goes to quarantine."""
    tagged = _tagged(spark, sf)
    whole = encode_tag(message_sets.tag_struct())
    broken = F.when(F.col("seq") % 9 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    bare, full = producer_headers(F.lit("10.1.0.1")), producer_headers(F.lit("10.1.0.1"), broken)
    records = tagged.select(
        "topic",
        "seq",
        "key",
        F.when((F.col("seq") % 9 != 0) & (F.col("seq") % 10 == 1), bare).otherwise(full).alias("headers"),
    )
    decoded, bad = delivery.decode_records(records)
    columns = ["topic", "seq", "key"]
    read = decoded.select(*columns, F.lit(False).alias("undecodable"), F.col("tag.dest_idx").alias("dest_idx"))
    return read.unionByName(bad.select(*columns, F.lit(True).alias("undecodable")), allowMissingColumns=True)


@query(
    "delivery_log",
    'SELECT topic, seq, key, sent_partition, "offset" FROM delivered',
    o.GIVEN_LOG,
)
def delivery_log(spark, sf):
    return delivery.delivery_log(_sent_log(spark, sf)).select("topic", "seq", "key", "sent_partition", "offset")


@query(
    "shift_events",
    """SELECT topic, key, seq, sent_partition, dest_partition, "offset" FROM delivered
       WHERE dest_partition <> sent_partition""",
    o.GIVEN_LOG,
)
def shift_events(spark, sf):
    return delivery.shift_events(_delivered(spark, sf)).select(
        "topic", "key", "seq", "sent_partition", "dest_partition", "offset"
    )


@query(
    "sync_events",
    """SELECT topic, key, seq, sent_partition, src_partition, dest_partition, dest_idx, "offset",
              NOT is_boundary AND seq = min(CASE WHEN NOT is_boundary THEN seq END)
                OVER (PARTITION BY topic, key, dest_idx) AS is_set_start
       FROM delivered WHERE src_partition > -1 AND src_idx > -1""",
    o.GIVEN_LOG,
)
def sync_events(spark, sf):
    return delivery.sync_events(_delivered(spark, sf)).select(
        "topic", "key", "seq", "sent_partition", "src_partition", "dest_partition",
        "dest_idx", "offset", "is_set_start",
    )


@query(
    "key_total_order",
    """SELECT topic, key, seq, row_number() OVER (PARTITION BY topic, key ORDER BY seq) AS pos
       FROM delivered""",
    o.GIVEN_LOG,
)
def key_total_order(spark, sf):
    ordered = delivery.key_total_order(_delivered(spark, sf))
    return ordered.select("topic", "key", "seq", "pos")


VIOLATIONS = """
SELECT topic, key, seq, prev_seq FROM (
  SELECT topic, key, seq,
         lag(seq) OVER (PARTITION BY topic, key
                        ORDER BY {}, sent_partition = dest_partition, "offset") AS prev_seq
  FROM delivered
) WHERE prev_seq > seq"""


@query(
    "order_violations",
    VIOLATIONS.format("dest_idx"),
    o.GIVEN_LOG,
)
def order_violations(spark, sf):
    """None: the tags restore the order in which messages were sent."""
    return delivery.order_violations(_delivered(spark, sf)).select(
        "topic", "key", "seq", "prev_seq"
    )


@query("order_violations_reversed", VIOLATIONS.format("-dest_idx"), o.GIVEN_LOG)
def order_violations_reversed(spark, sf):
    """What a consumer sees that takes the sets of a key in the wrong order."""
    wrong = _delivered(spark, sf).withColumn("dest_idx", -F.col("dest_idx"))
    return delivery.order_violations(wrong).select("topic", "key", "seq", "prev_seq")


def _records(spark, sf):
    """What is sent, with headers and explicit partition."""
    full = materialize(with_sequence(wl.keyed_messages(spark, sf)), "sequenced")
    tagged = message_sets.tag_message_sets(full, wl.N_PARTITIONS, wl.hot_map_log_given(spark, sf))
    who = F.concat(F.lit("10.1.0."), (F.col("msg_id") % 3).cast("string"))
    return message_sets.sent_partition(tagged).select(
        "topic",
        "sent_partition",
        "key",
        "body",
        "msg_id",
        "seq",
        producer_headers(who, encode_tag(message_sets.tag_struct())).alias("headers"),
    )


@query(
    "kafka_records",
    f"""SELECT topic, key, body AS value, sent_partition AS partition, {TAG},
               '10.1.0.' || CAST(msg_id % 3 AS VARCHAR) AS producer FROM sent""",
    o.GIVEN_LOG,
)
def kafka_records(spark, sf):
    """The columns of the Kafka sink, bytes read back as text and headers decoded."""
    wired = kafka_columns(_records(spark, sf))
    decoded, _ = delivery.decode_records(wired)
    return decoded.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "partition",
        *[F.col(f"tag.{c}").alias(c) for c in message_sets.TAG_COLUMNS],
        header(F.col("headers"), "Producer").cast("string").alias("producer"),
    )


@query(
    "msg_sink",
    f"""SELECT topic, sent_partition AS partition, key, body, msg_id, seq, {TAG},
               '10.1.0.' || CAST(msg_id % 3 AS VARCHAR) AS producer FROM sent""",
    o.GIVEN_LOG,
)
def msg_sink(spark, sf):
    """Written with headers under topic and partition, then read and decoded."""
    records = _records(spark, sf)
    path = scratch_path(spark, "sink")
    write_messages(records, path)
    decoded, _ = delivery.decode_records(spark.read.parquet(path))
    return decoded.select(
        "topic",
        "partition",
        "key",
        "body",
        "msg_id",
        "seq",
        *[F.col(f"tag.{c}").alias(c) for c in message_sets.TAG_COLUMNS],
        header(F.col("headers"), "Producer").cast("string").alias("producer"),
    )


# --- ingest -------------------------------------------------------------------


@query(
    "ingest_accept",
    """SELECT event_id, 'location_' || CAST(event_id % 40 AS VARCHAR) AS key,
              CASE WHEN event_id % 7 = 0 THEN 'b' || CAST(event_id AS VARCHAR) ELSE '' END AS body
       FROM events WHERE event_id % 7 IN (0, 1)""",
)
def ingest_accept(spark, sf):
    return ingest.validate_messages(wl.raw_bodies(spark, sf))[0]


@query(
    "ingest_reject",
    """SELECT event_id,
              CASE event_id % 7 WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'unknown_key'
                WHEN 4 THEN 'badly_formed' WHEN 5 THEN 'multiple_values' ELSE 'empty' END AS reason,
              CASE event_id % 7 WHEN 2 THEN 'key' WHEN 3 THEN 'extra' END AS field
       FROM events WHERE event_id % 7 > 1""",
)
def ingest_reject(spark, sf):
    return ingest.validate_messages(wl.raw_bodies(spark, sf))[1].drop("raw")


SMALL_LIMIT = 24


@query(
    "ingest_size_limit",
    f"""SELECT event_id,
              CASE WHEN event_id % 7 = 6 THEN 'empty' WHEN strlen(raw) > {SMALL_LIMIT} THEN 'too_large'
                WHEN event_id % 7 = 2 THEN 'wrong_type' WHEN event_id % 7 = 3 THEN 'unknown_key'
                WHEN event_id % 7 = 4 THEN 'badly_formed' WHEN event_id % 7 = 5 THEN 'multiple_values' END AS reason
       FROM (SELECT event_id, CASE event_id % 7
               WHEN 0 THEN '{{"key":"location_' || event_id % 40 || '","body":"b' || event_id || '"}}'
               WHEN 1 THEN '{{"KEY":"location_' || event_id % 40 || '"}}'
               WHEN 2 THEN '{{"key":' || event_id || '}}' WHEN 3 THEN '{{"key":"k","extra":' || event_id || '}}'
               WHEN 4 THEN '{{"key":"k' || event_id || '"' WHEN 5 THEN '{{"key":"k"}} {{"key":"' || event_id || '"}}'
               ELSE '   ' END AS raw FROM events)""",
)
def ingest_size_limit(spark, sf):
    """The verdict on every text when few bytes are allowed."""
    judged = ingest.judge_messages(wl.raw_bodies(spark, sf), max_bytes=SMALL_LIMIT)
    return judged.select("event_id", "reason")


# --- traces -------------------------------------------------------------------


# Every seventh trace lacks the service that is asked for; half of the time is before ``since``.
TRACE_FILTER = """
    SELECT trace_id AS "traceID", CASE WHEN receive_us IS NULL THEN 2 ELSE 3 END AS n_spans,
           produce_us AS first_us
    FROM tr, (SELECT min(ts_us) + (max(ts_us) - min(ts_us)) // 2 AS since FROM ms)
    WHERE msg_id % 7 <> 0 AND greatest(produce_us, coalesce(receive_us, 0), process_us) >= since"""


def _traces_of_services(spark, sf):
    """The traces, of which some lack the consumer, and the time to look at them from."""
    audited = F.map_from_arrays(F.map_keys("processes"), F.expr(
        "transform(map_values(processes), x -> named_struct('serviceName', 'audit'))"
    ))
    traces = wl.traces(spark, sf).withColumn(
        "processes", F.when(F.col("traceID").cast("long") % 7 == 0, audited).otherwise(F.col("processes"))
    )
    us = F.unix_micros("ts")
    low, high = wl.events(spark, sf).agg(F.min(us), F.max(us)).first()
    return traces, low + (high - low) // 2


def _seen(traces):
    return traces.select(
        "traceID", F.size("spans").alias("n_spans"), F.col("spans")[0]["startTime"].alias("first_us")
    )


@query(
    "trace_source",
    """SELECT trace_id AS "traceID", CASE WHEN receive_us IS NULL THEN 2 ELSE 3 END AS n_spans,
              produce_us AS first_us FROM tr""",
    o.TRACES,
)
def trace_source(spark, sf):
    """All traces; filters that leave some out are checked in ``trace_envelopes``."""
    path = scratch_path(spark, "traces")
    wl.traces(spark, sf).write.json(path)
    return _seen(read_traces(spark, path, service="consumer", since=0))


@query("trace_envelopes", TRACE_FILTER, o.TRACES)
def trace_envelopes(spark, sf):
    """Traces of a service since some time, from documents that hold many traces each."""
    path = scratch_path(spark, "envelopes")
    traces, since = _traces_of_services(spark, sf)
    text = F.to_json(F.struct("traceID", "spans", "processes"))
    documents = (
        traces.groupBy(F.floor(F.col("traceID").cast("long") / 2_000).alias("document"))
        .agg(F.collect_list(text).alias("traces"))
        .select(F.concat(F.lit('{"total": 0, "data": ['), F.array_join("traces", ",\n"), F.lit("]}")))
    )
    documents.write.text(path)
    return _seen(read_traces(spark, path, service="consumer", since=since, envelope=True))


@query(
    "trace_spans",
    """SELECT trace_id AS "traceID", produce_us, receive_us, process_us FROM tr
       WHERE receive_us IS NOT NULL""",
    o.TRACES,
)
def trace_spans(spark, sf):
    return latency.trace_spans(wl.traces(spark, sf)).select(
        "traceID",
        F.col("produced.startTime").alias("produce_us"),
        F.col("received.startTime").alias("receive_us"),
        F.col("processed.startTime").alias("process_us"),
    )


@query(
    "trace_spans_flat",
    """SELECT trace_id, produce_us, receive_us, process_us FROM tr WHERE receive_us IS NOT NULL""",
    o.TRACES,
)
def trace_spans_flat(spark, sf):
    return latency.pivot_spans(latency.flat_spans(wl.traces(spark, sf))).select(
        "trace_id",
        F.col("produced.start_us").alias("produce_us"),
        F.col("received.start_us").alias("receive_us"),
        F.col("processed.start_us").alias("process_us"),
    )


@query(
    "trace_tags",
    'SELECT trace_id AS "traceID", tag_partition AS "Partition", tag_key AS "Key" FROM tr '
    "WHERE receive_us IS NOT NULL",
    o.TRACES,
)
def trace_tags(spark, sf):
    tagged = latency.trace_tags(latency.trace_spans(wl.traces(spark, sf)))
    return tagged.select("traceID", "Partition", "Key")


@query("trace_latency", "SELECT * FROM lat", o.TRACES)
def trace_latency(spark, sf):
    return latency.trace_latency(wl.traces(spark, sf))


@query("trace_csv", "SELECT * FROM lat", o.TRACES)
def trace_csv(spark, sf):
    path = scratch_path(spark, "latency")
    rows = latency.trace_latency(wl.traces(spark, sf))
    write_latency_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("latency_by_partition", o.latency_by('"Partition"'), o.TRACES)
def latency_by_partition(spark, sf):
    return latency.latency_by(latency.trace_latency(wl.traces(spark, sf)), ["Partition"])


@query("latency_by_key", o.latency_by('"Key"'), o.TRACES)
def latency_by_key(spark, sf):
    return latency.latency_by(latency.trace_latency(wl.traces(spark, sf)), ["Key"])


@query("latency_by_partition_key", o.latency_by('"Partition", "Key"'), o.TRACES)
def latency_by_partition_key(spark, sf):
    return latency.latency_by(latency.trace_latency(wl.traces(spark, sf)), ["Partition", "Key"])


@query(
    "trace_join",
    """SELECT trace_id, produce_us, process_us AS consume_us, process_dur AS duration_us,
              process_us - produce_us AS delay_us FROM tr""",
    o.TRACES,
)
def trace_join(spark, sf):
    spans = latency.flat_spans(wl.traces(spark, sf))
    return latency.correlate_spans(
        spans.where(F.col("operation") == latency.PRODUCE),
        spans.where(F.col("operation") == latency.PROCESS),
    )


# --- flagship -----------------------------------------------------------------


@query(
    "load_comparison",
    f"""SELECT t.topic, p.partition, coalesce(h.hashed, 0) AS hashed, coalesce(s.placed, 0) AS placed
        FROM (SELECT DISTINCT topic FROM ms) t,
             (SELECT CAST(unnest(range({wl.N_PARTITIONS})) AS INTEGER) AS partition) p
        LEFT JOIN (SELECT topic, p AS partition, count(*) AS hashed FROM ms GROUP BY ALL) h
          ON h.topic = t.topic AND h.partition = p.partition
        LEFT JOIN (SELECT topic, sent_partition AS partition, count(*) AS placed FROM sent GROUP BY ALL) s
          ON s.topic = t.topic AND s.partition = p.partition""",
    o.sent_by(o.replay(o.EVERY_TURNOVERS), "lgr"),
    recursive=True,
)
def load_comparison(spark, sf):
    """Messages per partition when every key is hashed and when hot keys are placed.

    Sketch, placement and rebalancing make the map; every message is routed as of
    its own time, tagged and sent.
    """
    messages = wl.sequenced_log(spark, sf).select("topic", "key", "seq")
    log = materialize(control_log(spark, sf, messages), "map-log")
    sent = message_sets.sent_partition(
        message_sets.tag_message_sets(messages, wl.N_PARTITIONS, log)
    )
    hashed = (
        routing.route(frequency.key_counts(messages), wl.N_PARTITIONS)
        .groupBy("topic", F.col("route").alias("partition"))
        .agg(F.sum("count").alias("hashed"))
    )
    placed = sent.groupBy("topic", F.col("sent_partition").alias("partition")).agg(
        F.count(F.lit(1)).alias("placed")
    )
    frame = messages.select("topic").distinct().withColumn(
        "partition", load.all_partitions(wl.N_PARTITIONS)
    )
    return (
        frame.join(hashed, ["topic", "partition"], "left")
        .join(placed, ["topic", "partition"], "left")
        .fillna(0, ["hashed", "placed"])
    )


# --- streams: the same results from micro-batches -------------------------------

STREAM_PARTS = 3


def stream_cuts(messages):
    """Instants that cut the time from the first to the last message into equal parts."""
    us = F.unix_micros("ts")
    low, high = messages.agg(F.min(us), F.max(us)).first()
    return [low + (high - low) * i // STREAM_PARTS for i in range(1, STREAM_PARTS)]


def run_in_parts(spark, sf, start, before=lambda part, log: None):
    """Append the log part by part and let the stream catch up with each.

    Every part is one micro-batch of however many files Spark writes for it; the
    stream is started anew each time and resumes from its checkpoint. ``before`` is called ahead
    of each part with its number and what was appended so far.
    """
    path = scratch_path(spark, "log")
    messages = wl.keyed_messages(spark, sf)
    us = F.unix_micros("ts")
    edges = [None, *stream_cuts(messages), None]
    for number, (low, high) in enumerate(zip(edges, edges[1:])):
        part = messages if low is None else messages.where(us > low)
        part = part if high is None else part.where(us <= high)
        before(number, messages.where("false") if low is None else messages.where(us <= low))
        part.write.mode("append").parquet(path)
        running = start(read_messages(spark, path, streaming=True))
        if running is not None:
            running.awaitTermination()


def stream_config():
    return HotKeyConfig(wl.N_PARTITIONS, wl.EPSILON, wl.SUPPORT, wl.REBALANCE_EVERY)


ALL_LIVES = """
SELECT topic, key, start_b AS start_bucket, min(bucket) FILTER (NOT kept) AS end_bucket,
       max(seen) AS seen, min(ins) AS insert_n, min(bucket) FILTER (hot) AS hot_bucket,
       arg_min(cnt, bucket) FILTER (hot) AS hot_count
FROM step GROUP BY topic, key, start_b"""


@query("stream_sketch_expiring", ALL_LIVES, o.lossy(), recursive=True)
def stream_sketch_expiring(spark, sf):
    """The same with old state deleted: ended lives are results and stay."""
    state, offsets = scratch_path(spark, "state"), scratch_path(spark, "offsets")
    run_in_parts(spark, sf, lambda s: stream_sketch(s, state, offsets, stream_config(), keep=2))
    lives = spark.read.parquet(f"{state}/lives")
    last = lives.agg(F.max("batch")).first()[0]
    tracked = lives.where(F.col("end_bucket").isNull() & (F.col("batch") == last))
    ended = spark.read.parquet(f"{state}/ended_lives")
    return tracked.unionByName(ended).drop("batch", "status", "count")


@query("stream_sketch", ALL_LIVES, o.lossy(), recursive=True)
def stream_sketch_query(spark, sf):
    """Ended lives of all batches and what is tracked after the last."""
    state, offsets = scratch_path(spark, "state"), scratch_path(spark, "offsets")
    run_in_parts(spark, sf, lambda s: stream_sketch(s, state, offsets, stream_config()))
    lives = spark.read.parquet(f"{state}/lives")
    last = lives.agg(F.max("batch")).first()[0]
    return lives.where(F.col("end_bucket").isNotNull() | (F.col("batch") == last)).drop(
        "batch", "status", "count"
    )


@query(
    "stream_tags",
    f"SELECT topic, seq, key, {TAG}, is_boundary, sent_partition FROM sent",
    o.GIVEN_LOG,
)
def stream_tags_query(spark, sf):
    out, state = scratch_path(spark, "tagged"), scratch_path(spark, "state")
    offsets = scratch_path(spark, "offsets")

    def given(session: SparkSession) -> DataFrame:
        return wl.hot_map_log_given(session, sf)

    run_in_parts(
        spark, sf, lambda s: stream_tags(s, given, state, out, offsets, stream_config())
    )
    return spark.read.parquet(out).drop("batch", "msg_id", "ts", "body")


@query(
    "stream_tags_in_store",
    f"SELECT topic, seq, key, {TAG}, is_boundary, sent_partition FROM sent",
    o.GIVEN_LOG,
)
def stream_tags_in_store_query(spark, sf):
    """The same with the sets of keys in Spark's state store."""
    out, state = scratch_path(spark, "tagged"), scratch_path(spark, "state")
    offsets = scratch_path(spark, "offsets")

    def given(session: SparkSession) -> DataFrame:
        return wl.hot_map_log_given(session, sf)

    run_in_parts(
        spark, sf, lambda s: stream_tags_in_store(s, given, state, out, offsets, stream_config())
    )
    return spark.read.parquet(out).drop("batch", "msg_id", "ts", "body")


LIVE_COUNT = 20
LIVE_MAP = o.sent_by(
    o.SEQ
    + f""",
cut AS (SELECT min(ts_us) AS a, max(ts_us) - min(ts_us) AS span FROM ms),
parted AS (
  SELECT ms.*, CASE {" ".join(f"WHEN ts_us <= a + span * {i} // {STREAM_PARTS} THEN {i - 1}" for i in range(1, STREAM_PARTS))}
               ELSE {STREAM_PARTS - 1} END AS part FROM ms, cut
),
live AS (
  SELECT v.b, topic, key, CAST((any_value(num) * 3 + v.b) % {wl.N_PARTITIONS} AS INTEGER) AS partition
  FROM parted JOIN (SELECT unnest(range(1, {STREAM_PARTS})) AS b) v ON parted.part < v.b
  GROUP BY v.b, topic, key HAVING count(*) > {LIVE_COUNT}
),
spans AS (SELECT topic, part, min(seq) AS valid_from, max(seq) + 1 AS valid_to FROM parted GROUP BY ALL),
lgl AS (
  SELECT live.topic, key, partition, valid_from, valid_to
  FROM live JOIN spans ON spans.topic = live.topic AND spans.part = live.b
)""",
    "lgl",
)


@query(
    "stream_live_map",
    f"SELECT topic, seq, key, {TAG}, is_boundary, sent_partition FROM sent",
    LIVE_MAP,
)
def stream_live_map_query(spark, sf):
    """Another job maps, ahead of each part, the keys it has counted so far, elsewhere each time."""
    out, state = scratch_path(spark, "tagged"), scratch_path(spark, "state")
    offsets = scratch_path(spark, "offsets")
    versions = MapVersions(spark, scratch_path(spark, "maps"))

    def publish(part: int, log: DataFrame) -> None:
        num = F.expr("CAST(substr(key, 10) AS BIGINT)")
        partition = ((num * 3 + part) % wl.N_PARTITIONS).cast("int")
        counted = frequency.heavy_keys(frequency.key_counts(log), LIVE_COUNT)
        versions.publish(counted.withColumn("partition", partition), part)

    run_in_parts(
        spark,
        sf,
        lambda s: stream_live_map(s, versions, state, out, offsets, stream_config()),
        publish,
    )
    return spark.read.parquet(out).drop("batch", "msg_id", "ts", "body")


def _run_hot_keys(spark, sf, config):
    """Where the stream has written what it sent, and its state."""
    out, state = scratch_path(spark, "sent"), scratch_path(spark, "state")
    offsets = scratch_path(spark, "offsets")
    run_in_parts(spark, sf, lambda s: run_hot_key_stream(s, state, out, offsets, config))
    return out, state


@query(
    "stream_hot_keys",
    f"SELECT topic, seq, key, {TAG}, is_boundary, sent_partition FROM sent",
    o.sent_by(o.replay(o.EVERY_TURNOVERS), "lgr"),
    recursive=True,
)
def stream_hot_keys(spark, sf):
    """The whole producer side as a stream."""
    out, _ = _run_hot_keys(spark, sf, stream_config())
    return spark.read.parquet(out).drop("batch", "msg_id", "ts", "body")


@query("stream_control_timed", MAP_LOG, o.replay(o.EVERY_SECONDS), recursive=True)
def stream_control_timed(spark, sf):
    """History of the map of a stream that rebalances by the clock: what ended and what stands."""
    config = HotKeyConfig(
        wl.N_PARTITIONS, wl.EPSILON, wl.SUPPORT, rebalance_seconds=wl.REBALANCE_SECONDS
    )
    _, state = _run_hot_keys(spark, sf, config)
    maps = spark.read.parquet(f"{state}/map_log")
    last = maps.agg(F.max("batch")).first()[0]
    standing = maps.where(F.col("valid_to").isNull() & (F.col("batch") == last))
    ended = spark.read.parquet(f"{state}/closed_intervals")
    return standing.unionByName(ended).drop("batch", "moved_at")


@query(
    "stream_weights",
    f"""SELECT t.topic, t.tick, p.partition,
               CAST(coalesce((SELECT sum(count) FROM lgr
                 WHERE lgr.topic = t.topic AND lgr.partition = p.partition
                   AND lgr.valid_from <= t.at_seq + 1
                   AND (lgr.valid_to IS NULL OR lgr.valid_to > t.at_seq + 1)), 0) AS BIGINT) AS size
        FROM (SELECT topic, tick, max(busy) OVER (PARTITION BY topic ORDER BY tick) AS at_seq
              FROM (SELECT topic, unnest(range(min(tick), max(tick))) AS tick FROM tk GROUP BY topic)
              LEFT JOIN (SELECT topic, tick, max(seq) AS busy FROM tk GROUP BY ALL)
                USING (topic, tick)) t,
             (SELECT CAST(unnest(range({wl.N_PARTITIONS})) AS INTEGER) AS partition) p""",
    o.replay(o.EVERY_TURNOVERS)
    + f""",
tk AS (SELECT topic, ts_us // {SNAPSHOT_SECONDS * 1000000} + 1 AS tick, seq FROM ms)""",
    recursive=True,
)
def stream_weights(spark, sf):
    """Sizes of all partitions at every tick that passed, idle ones too, from the live map."""
    config = replace(stream_config(), weight_seconds=SNAPSHOT_SECONDS)
    _, state = _run_hot_keys(spark, sf, config)
    return spark.read.parquet(f"{state}/weights").drop("batch")


def _sticky_stream(spark, sf, shape, epoch_col=None):
    out, state = scratch_path(spark, "placed"), scratch_path(spark, "state")
    offsets = scratch_path(spark, "offsets")
    run_in_parts(
        spark,
        sf,
        lambda s: stream_sticky_round_robin(shape(s), wl.endpoints(spark), state, out, offsets, epoch_col),
    )
    return spark.read.parquet(out).drop("batch", "ts")


@query("stream_sticky_rr", ORACLES["sticky_rr"], "")
def stream_sticky_rr(spark, sf):
    return _sticky_stream(spark, sf, lambda s: s.select("msg_id", "ts", "key"))


@query("stream_sticky_rr_epochs", ORACLES["sticky_rr_epochs"], "")
def stream_sticky_rr_epochs(spark, sf):
    return _sticky_stream(spark, sf, _epochs, "epoch")


@query(
    "stream_partition_rate",
    """SELECT topic, p AS partition, ts_us // 60000000 * 60000000 AS window_us, count(*) AS messages
       FROM ms WHERE msg_id % 97 <> 0 GROUP BY ALL""",
    o.SEQ,
)
def stream_rate_query(spark, sf):
    out, offsets = scratch_path(spark, "rates"), scratch_path(spark, "offsets")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def start(messages: DataFrame):
        acked = messages.select(
            "topic",
            fnv_partition(F.col("key"), wl.N_PARTITIONS).alias("partition"),
            "ts",
            (F.col("msg_id") % 97 != 0).alias("ok"),
        )
        rates = stream_partition_rate(acked, "60 seconds", "10 seconds")
        writer = rates.writeStream.outputMode("update").foreachBatch(step)
        return writer.option("checkpointLocation", offsets).trigger(availableNow=True).start()

    run_in_parts(spark, sf, start)
    # In update mode the last batch that touched a window has its final count.
    return spark.read.parquet(out).groupBy("topic", "partition", "window_us").agg(
        F.max_by("messages", "batch").alias("messages")
    )


@query(
    "stream_shift_events",
    "SELECT topic, key, sent_partition, dest_partition, dest_idx FROM delivered "
    "WHERE dest_partition <> sent_partition",
    o.GIVEN_LOG,
)
def stream_shift_query(spark, sf):
    return _detected(spark, sf, stream_shift_events)


@query(
    "stream_sync_events",
    "SELECT topic, key, sent_partition, dest_partition, dest_idx FROM delivered "
    "WHERE src_partition > -1 AND src_idx > -1",
    o.GIVEN_LOG,
)
def stream_sync_query(spark, sf):
    return _detected(spark, sf, stream_sync_events)


def _detected(spark, sf, detect):
    """Records written to the log with their headers, then consumed as a stream."""
    path, out = scratch_path(spark, "records"), scratch_path(spark, "detected")
    records = _sent(spark, sf).select(
        "topic",
        "key",
        "sent_partition",
        producer_headers(F.lit("10.1.0.1"), encode_tag(message_sets.tag_struct())).alias("headers"),
    )
    records.write.parquet(path)
    stream = spark.readStream.schema(records.schema).parquet(path)
    detect(stream).select("topic", "key", "sent_partition", "dest_partition", "dest_idx").writeStream.option(
        "checkpointLocation", scratch_path(spark, "offsets")
    ).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.parquet(out)

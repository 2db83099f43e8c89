"""Plain SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

import math

from keytide.plans import workload as wl


def fnv(text: str) -> str:
    pairs = f"range(1, octet_length(encode({text})) * 2, 2)"
    byte = f"('0x' || substr(hex(encode({text})), i, 2))::BIGINT"
    return (
        f"list_reduce(list_prepend(2166136261::BIGINT, list_transform({pairs}, lambda i: {byte})),"
        " lambda h, b: ((xor(h, b)) * 16777619) & 4294967295)"
    )


def fnv_part(text: str, n: int = wl.N_PARTITIONS) -> str:
    return f"CAST(({fnv(text)} & 2147483647) % {n} AS INTEGER)"


MESSAGES = """
km AS (
  SELECT event_id AS msg_id, ts, epoch_us(ts) AS ts_us, event_type AS topic, num,
         'location_' || num AS key, 'location_' || num || ' message body' AS body
  FROM (
    SELECT *, CASE WHEN event_id % 8 = 5 THEN 40 + event_id // 32
                   ELSE x * x * x * 40 // 1027243729 END AS num
    FROM (SELECT event_id, ts, event_type, (event_id * 7919) % 1009 AS x FROM events)
  )
)"""

SEQ = (
    MESSAGES
    + f""",
hashes AS (
  SELECT key, {fnv('key')} AS h, {fnv_part('key')} AS p FROM (SELECT DISTINCT key FROM km)
),
ms AS (
  SELECT km.*, hashes.h, hashes.p,
         row_number() OVER (PARTITION BY topic ORDER BY ts, msg_id) AS seq
  FROM km JOIN hashes USING (key)
)"""
)


def lossy(epsilon: float = wl.EPSILON, support: float = wl.SUPPORT) -> str:
    """The bucket-by-bucket recurrence over a dense grid of keys and buckets."""
    width = math.floor(1 / epsilon)
    thr = f"((CAST({support} AS DOUBLE) - CAST({epsilon} AS DOUBLE)) * {width})"
    return (
        SEQ
        + f""",
bk AS (SELECT *, (seq - 1) // {width} + 1 AS bucket FROM ms),
fullb AS (SELECT topic, count(*) // {width} AS nb FROM ms GROUP BY topic),
occ AS (SELECT topic, key, bucket, count(*) AS c, min(seq) AS first_n FROM bk GROUP BY ALL),
ks AS (SELECT DISTINCT topic, key FROM occ),
grid AS (
  SELECT ks.topic, ks.key, b.bucket, coalesce(occ.c, 0) AS c, occ.first_n
  FROM ks JOIN fullb USING (topic),
       LATERAL (SELECT unnest(range(1, nb + 1)) AS bucket) b
  LEFT JOIN occ ON occ.topic = ks.topic AND occ.key = ks.key AND occ.bucket = b.bucket
),
walk AS (
  SELECT topic, key, CAST(0 AS BIGINT) AS bucket, CAST(0 AS BIGINT) AS cnt,
         CAST(NULL AS BIGINT) AS start_b, CAST(0 AS BIGINT) AS seen,
         CAST(NULL AS BIGINT) AS ins, false AS kept, false AS present
  FROM ks
  UNION ALL
  SELECT w.topic, w.key, g.bucket,
         CASE WHEN w.kept THEN w.cnt ELSE 0 END + g.c - 1,
         CASE WHEN w.kept THEN w.start_b ELSE g.bucket END,
         CASE WHEN w.kept THEN w.seen ELSE 0 END + g.c,
         CASE WHEN w.kept THEN w.ins ELSE g.first_n END,
         CASE WHEN w.kept OR g.c > 0 THEN
           CASE WHEN w.kept THEN w.cnt ELSE 0 END + g.c - 1
             + CASE WHEN w.kept THEN w.start_b - 1 ELSE g.bucket - 1 END >= g.bucket
         ELSE false END,
         w.kept OR g.c > 0
  FROM walk w JOIN grid g ON g.topic = w.topic AND g.key = w.key AND g.bucket = w.bucket + 1
),
step AS (
  SELECT *, kept AND CAST(cnt AS DOUBLE) >= {thr} AS hot FROM walk WHERE present
)"""
    )


def _with(recursive: bool, ctes: str, query: str) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{query.strip()}"


GIVEN_MAP = (
    SEQ
    + f""",
gm AS (
  SELECT topic, key, count(*) AS count, any_value(p) AS partition
  FROM ms GROUP BY topic, key
),
parts AS (
  SELECT topic, CAST(unnest(range(0, {wl.N_PARTITIONS})) AS INTEGER) AS partition
  FROM (SELECT DISTINCT topic FROM gm)
),
sz AS (
  SELECT topic, partition,
         CAST(coalesce((SELECT sum(count) FROM gm
                        WHERE gm.topic = parts.topic AND gm.partition = parts.partition), 0)
              AS BIGINT) AS size
  FROM parts
),
av AS (SELECT topic, CAST(sum(size) AS DOUBLE) / {wl.N_PARTITIONS} AS avg_size FROM sz GROUP BY topic),
cand AS (
  SELECT gm.topic, gm.key, gm.count, gm.partition, sz.size, av.avg_size
  FROM gm JOIN sz USING (topic, partition) JOIN av USING (topic)
  WHERE sz.size > av.avg_size AND gm.count <= sz.size - av.avg_size
)"""
)


# One step per source partition; sizes are taken anew in each, the underloaded set is not.
REBALANCE = (
    GIVEN_MAP
    + f""",
rb AS (
  SELECT 0 AS step, topic, key, count, partition AS cur, CAST(NULL AS INTEGER) AS src FROM gm
  UNION ALL
  SELECT s.step + 1, s.topic, s.key, s.count, coalesce(m.dst, s.cur),
         CASE WHEN m.dst IS NULL THEN s.src ELSE s.cur END
  FROM rb s LEFT JOIN (
    SELECT c.topic, c.key, d.partition AS dst,
           row_number() OVER (PARTITION BY c.topic, c.key
                              ORDER BY abs(d.size + c.count - a.avg_size), d.partition) AS rk
    FROM rb c
    JOIN av a ON a.topic = c.topic
    JOIN (SELECT topic, cur, sum(count) AS size FROM rb GROUP BY ALL) z
      ON z.topic = c.topic AND z.cur = c.cur
    JOIN (SELECT sz.topic, sz.partition, coalesce(sum(rb.count), 0) AS size
          FROM sz JOIN av USING (topic)
          LEFT JOIN rb ON rb.topic = sz.topic AND rb.cur = sz.partition
          WHERE sz.size < av.avg_size GROUP BY ALL) d ON d.topic = c.topic
    WHERE c.cur = c.step AND z.size > a.avg_size AND c.count <= z.size - a.avg_size
      AND EXISTS (SELECT 1 FROM sz o JOIN av USING (topic)
                  WHERE o.topic = c.topic AND o.partition = c.cur AND o.size > av.avg_size)
      AND NOT (z.size < d.size OR z.size - d.size < abs(z.size - d.size - 2 * c.count))
  ) m ON m.topic = s.topic AND m.key = s.key AND m.rk = 1
  WHERE s.step < {wl.N_PARTITIONS}
)"""
)


def _target(entry: str) -> str:
    """Where an entry of an overloaded partition may go: the best place that doesn't widen the gap."""
    gap = f"(sizes[{entry}.part + 1] - sizes[d + 1])"
    allowed = f"{gap} >= 0 AND {gap} >= abs({gap} - 2 * {entry}.count)"
    off = f"{{'off': abs(sizes[d + 1] + {entry}.count - mean), 'd': d}}"
    fits = f"list_filter(under_now, lambda d: {allowed})"
    return f"list_sort(list_transform({fits}, lambda d: {off}))[1].d"


def replay(ticks: str | None) -> str:
    """The whole control plane, one event a step, each topic's map as a list.

    ``ticks`` is a query ``topic, pos, times`` over what ``lossy`` defines. A rebalancing round is one
    step for each partition, in ascending order; who is under and over the mean is settled in
    the first. Gives ``lgr``, the history of the map.
    """
    n = wl.N_PARTITIONS
    width = math.floor(1 / wl.EPSILON)
    rounds = "" if ticks is None else f"""
  UNION ALL
  SELECT topic, pos, 1, 0, 'tick', '', 0, 0, 0, r, s
  FROM (SELECT topic, pos, unnest(range(times)) AS r FROM ({ticks})),
       (SELECT unnest(range({n})) AS s)"""
    entry = "STRUCT(key VARCHAR, count BIGINT, part INTEGER, since BIGINT, op VARCHAR)"
    known = "len(list_filter(entries, lambda x: x.key = ev_key)) > 0"
    place = "CAST(CASE WHEN sizes[p1 + 1] > sizes[p2 + 1] THEN p2 ELSE p1 END AS INTEGER)"
    new = f"{{'key': ev_key, 'count': ev_count, 'part': {place}, 'since': pos + 1, 'op': 'promote'}}"
    leaves = f"x.part = sub AND x.count <= sizes[sub + 1] - mean AND {_target('x')} IS NOT NULL"
    moved = (
        f"CASE WHEN {leaves} THEN {{'key': x.key, 'count': x.count, 'part': CAST({_target('x')} AS INTEGER),"
        " 'since': pos + 1, 'op': 'move'} ELSE x END"
    )
    gone = "CASE WHEN op = 'evict' THEN x.key = ev_key ELSE op = 'tick' AND list_contains(over_now, sub) AND " + leaves + " END"
    return (
        lossy()
        + f""",
hotl AS (
  SELECT topic, key, start_b, min(ins) AS insert_n, min(bucket) FILTER (hot) AS hot_bucket,
         arg_min(cnt, bucket) FILTER (hot) AS hot_count, min(bucket) FILTER (NOT kept) AS end_bucket
  FROM step GROUP BY topic, key, start_b HAVING count(*) FILTER (hot) > 0
),
evs AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY pos, phase, insert_n, r, sub) AS i FROM (
    SELECT topic, hot_bucket * {width} AS pos, 0 AS phase, insert_n, 'promote' AS op, key AS ev_key,
           CAST(hot_count AS BIGINT) AS ev_count, {fnv_part("(key || '#1')")} AS p1,
           {fnv_part("(key || '#2')")} AS p2, 0 AS r, 0 AS sub
    FROM hotl
    UNION ALL
    SELECT topic, end_bucket * {width}, 0, insert_n, 'evict', key, 0, 0, 0, 0, 0
    FROM hotl WHERE end_bucket IS NOT NULL{rounds}
  )
),
fold AS (
  SELECT topic, CAST(0 AS BIGINT) AS i, CAST([] AS {entry}[]) AS entries, CAST([] AS BIGINT[]) AS under,
         CAST([] AS BIGINT[]) AS over, CAST([] AS {entry}[]) AS closed, CAST(NULL AS BIGINT) AS closed_at
  FROM (SELECT DISTINCT topic FROM evs)
  UNION ALL
  SELECT topic, i,
         CASE WHEN op = 'promote' THEN CASE WHEN {known} THEN entries ELSE list_append(entries, {new}) END
              WHEN op = 'evict' THEN list_filter(entries, lambda x: x.key <> ev_key)
              WHEN list_contains(over_now, sub) THEN list_transform(entries, lambda x: {moved})
              ELSE entries END,
         under_now, over_now,
         CASE WHEN op = 'promote' THEN [] ELSE list_filter(entries, lambda x: {gone}) END, pos + 1
  FROM (
    SELECT *, CASE WHEN op = 'tick' AND sub = 0 THEN list_filter(range({n}), lambda p: sizes[p + 1] < mean) ELSE under END
                AS under_now,
           CASE WHEN op = 'tick' AND sub = 0 THEN list_filter(range({n}), lambda p: sizes[p + 1] > mean) ELSE over END
                AS over_now
    FROM (
      SELECT *, CAST(list_sum(sizes) AS DOUBLE) / {n} AS mean
      FROM (
        SELECT e.*, f.entries, f.under, f.over,
               list_transform(range({n}), lambda p: coalesce(list_sum(list_transform(
                 list_filter(f.entries, lambda x: x.part = p), lambda x: x.count)), 0)) AS sizes
        FROM fold f JOIN evs e ON e.topic = f.topic AND e.i = f.i + 1
      )
    )
  )
),
lgr AS (
  SELECT topic, e.key AS key, e.count AS count, e.part AS partition, e.since AS valid_from,
         closed_at AS valid_to, e.op AS opened_by
  FROM (SELECT topic, closed_at, unnest(closed) AS e FROM fold)
  UNION ALL
  SELECT topic, e.key, e.count, e.part, e.since, NULL, e.op
  FROM (SELECT topic, unnest(entries) AS e FROM fold f
        WHERE i = (SELECT max(i) FROM fold g WHERE g.topic = f.topic))
)"""
    )


EVERY_TURNOVERS = (
    f"SELECT topic, b * {math.floor(1 / wl.EPSILON)} AS pos, 1 AS times FROM (SELECT topic,"
    f" unnest(range({wl.REBALANCE_EVERY}, nb + 1, {wl.REBALANCE_EVERY})) AS b FROM fullb)"
)

EVERY_SECONDS = f"""
SELECT * FROM (
  SELECT topic, max(seq) AS pos, lead(tick) OVER (PARTITION BY topic ORDER BY tick) - tick AS times
  FROM (SELECT topic, seq, ts_us // {wl.REBALANCE_SECONDS * 1000000} + 1 AS tick FROM ms)
  GROUP BY topic, tick
) WHERE times IS NOT NULL"""


def target_match(refused: str) -> str:
    return f"""
SELECT topic, key, count, src, dst FROM (
  SELECT c.topic, c.key, c.count, c.partition AS src, d.partition AS dst,
         row_number() OVER (PARTITION BY c.topic, c.key
                            ORDER BY abs(d.size + c.count - c.avg_size), d.partition) AS rk
  FROM cand c JOIN sz d ON d.topic = c.topic AND d.size < c.avg_size
  WHERE NOT ({refused})
) WHERE rk = 1"""


GIVEN_INTERVALS = (
    SEQ
    + f""",
iv AS (SELECT topic, greatest(count(*) // 3, 1) AS step FROM ms GROUP BY topic),
lg AS (
  SELECT topic, key, num,
         CAST(num * 10 + v + 1 AS BIGINT) AS count,
         CAST((num * 3 + CASE WHEN num % 4 = 0 THEN 0 ELSE v END) % {wl.N_PARTITIONS} AS INTEGER)
           AS partition,
         CAST(v * step + 1 AS BIGINT) AS valid_from,
         CASE WHEN v < 2 THEN CAST((v + 1) * step + 1 AS BIGINT) END AS valid_to
  FROM (SELECT DISTINCT topic, key, num FROM ms WHERE num % 3 = 0) JOIN iv USING (topic),
       (SELECT unnest([0, 1, 2]) AS v)
)"""
)


def sent_by(ctes: str, log: str) -> str:
    """What is routed, tagged, sent and delivered under the map's history ``log`` of ``ctes``."""
    return (
        ctes
        + f""",
routed AS (
  SELECT ms.*, coalesce(lg.partition, ms.p) AS route
  FROM ms LEFT JOIN {log} lg ON lg.topic = ms.topic AND lg.key = ms.key
    AND ms.seq >= lg.valid_from AND (lg.valid_to IS NULL OR ms.seq < lg.valid_to)
),
lagged AS (
  SELECT *, lag(route) OVER (PARTITION BY topic, key ORDER BY seq) AS prev FROM routed
),
numbered AS (
  SELECT *, prev IS NOT NULL AND prev <> route AS is_boundary,
         CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> route THEN 1 ELSE 0 END)
              OVER (PARTITION BY topic, key ORDER BY seq) AS INTEGER) AS dest_idx
  FROM lagged
),
tagged AS (
  SELECT *, route AS dest_partition,
         CAST(CASE WHEN dest_idx > 0 THEN dest_idx - 1 ELSE -1 END AS INTEGER) AS src_idx,
         coalesce(max(CASE WHEN is_boundary THEN prev END)
                  OVER (PARTITION BY topic, key, dest_idx), -1) AS src_partition
  FROM numbered
),
sent AS (
  SELECT *, CASE WHEN is_boundary THEN src_partition ELSE dest_partition END AS sent_partition
  FROM tagged
),
delivered AS (
  SELECT *, row_number() OVER (PARTITION BY topic, sent_partition ORDER BY seq) - 1 AS "offset"
  FROM sent
)"""
    )


GIVEN_LOG = sent_by(GIVEN_INTERVALS, "lg")

TRACES = (
    SEQ
    + """,
tr AS (
  SELECT CAST(msg_id AS VARCHAR) AS trace_id, msg_id, ts_us AS produce_us, key AS tag_key,
         CASE WHEN msg_id % 13 = 0 THEN NULL ELSE CAST(p AS VARCHAR) END AS tag_partition,
         CASE WHEN msg_id % 11 = 0 THEN NULL ELSE ts_us + msg_id % 500 END AS receive_us,
         msg_id % 1000 + 2 AS receive_dur,
         ts_us + msg_id % 900 AS process_us, msg_id % 1000 + 3 AS process_dur
  FROM ms
),
lat AS (
  SELECT trace_id AS "traceID", receive_dur AS "Rcv_Duration", process_dur AS "Print_Duration",
         tag_partition AS "Partition", tag_key AS "Key", receive_us - produce_us AS "StartTimeDiff"
  FROM tr WHERE receive_us IS NOT NULL
)"""
)


def latency_by(by: str) -> str:
    return f"""
SELECT {by}, count(*) AS traces, CAST(sum("Print_Duration") AS BIGINT) AS total_us,
       min("Print_Duration") AS min_us, max("Print_Duration") AS max_us,
       avg("Print_Duration") AS avg_us,
       quantile_disc("Print_Duration", 0.5) AS p50_us,
       quantile_disc("Print_Duration", 0.99) AS p99_us
FROM lat GROUP BY {by}"""


FEED = """
feed AS (
  SELECT s_suppkey AS feed_seq, n_name AS service, 'upsert' AS op,
         ['10.0.' || s_nationkey || '.' || s_suppkey % 250] AS ips
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 1000000000000 + n_nationkey, n_name, 'delete', NULL FROM nation WHERE n_nationkey % 5 = 0
),
reg AS (
  SELECT service, ips, (SELECT count(*) + 1 FROM feed) AS version
  FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY feed_seq DESC) AS rk FROM feed)
  WHERE rk = 1 AND op = 'upsert'
)"""

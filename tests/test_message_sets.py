import pytest
from pyspark.sql import functions as F

from keytide.operators import delivery, message_sets, routing
from keytide.functions import encode_tag, producer_headers
from tests.models import part

# (seq, tag, sent to, shift, sync, set start) of one key routed 5 5 8 8 2 2 2.
HAND = [
    (1, (-1, -1, 5, 0), 5, False, False, False),
    (2, (-1, -1, 5, 0), 5, False, False, False),
    (3, (5, 0, 8, 1), 5, True, True, False),
    (4, (5, 0, 8, 1), 8, False, True, True),
    (5, (8, 1, 2, 2), 8, True, True, False),
    (6, (8, 1, 2, 2), 2, False, True, True),
    (7, (8, 1, 2, 2), 2, False, True, False),
]


def log_of(spark, rows):
    return spark.createDataFrame(
        rows, "topic string, key string, count long, partition int, valid_from long, valid_to long"
    )


def messages_of(spark, n, key="k"):
    return spark.range(1, n + 1).select(
        F.lit("t").alias("topic"), F.lit(key).alias("key"), F.col("id").alias("seq"), F.col("id").alias("msg_id")
    )


def sent_of(spark, routes, **kwargs):
    """Messages of one key whose routes are as listed."""
    rows = [("t", "k", 1, p, i + 1, i + 2) for i, p in enumerate(routes)]
    tagged = message_sets.tag_message_sets(
        messages_of(spark, len(routes)), 10, log_of(spark, rows), **kwargs
    )
    return message_sets.sent_partition(tagged)


@pytest.mark.parametrize("limit", [1000, 0])
def test_hand_case(spark, limit):
    delivered = delivery.delivery_log(sent_of(spark, [5, 5, 8, 8, 2, 2, 2], broadcast_rows=limit))
    shifted = {r.seq for r in delivery.shift_events(delivered).collect()}
    synced = {r.seq: r.is_set_start for r in delivery.sync_events(delivered).collect()}
    got = [
        (
            r.seq,
            (r.src_partition, r.src_idx, r.dest_partition, r.dest_idx),
            r.sent_partition,
            r.seq in shifted,
            r.seq in synced,
            synced.get(r.seq, False),
        )
        for r in delivered.orderBy("seq").collect()
    ]
    assert got == HAND


def test_a_set_of_one_message_is_sent_where_the_key_never_was(spark):
    rows = sent_of(spark, [5, 8, 2]).orderBy("seq").collect()
    assert [(r.src_partition, r.dest_partition, r.sent_partition) for r in rows] == [
        (-1, 5, 5),
        (5, 8, 5),
        (8, 2, 8),
    ]


def test_interval_change_without_partition_change_starts_no_set(spark):
    log = log_of(spark, [("t", "k", 1, 4, 1, 5), ("t", "k", 2, 4, 5, None)])
    tagged = message_sets.tag_message_sets(messages_of(spark, 9), 10, log)
    assert {(r.dest_idx, r.dest_partition) for r in tagged.collect()} == {(0, 4)}


def test_intervals_nobody_wrote_in_start_no_set(spark):
    """The key moves away and back while silent: still one set."""
    log = log_of(spark, [("t", "k", 1, 4, 1, 5), ("t", "k", 1, 6, 5, 8), ("t", "k", 1, 4, 8, None)])
    messages = messages_of(spark, 12).where("seq < 5 OR seq >= 8")
    tagged = message_sets.tag_message_sets(messages, 10, log)
    assert {r.dest_idx for r in tagged.collect()} == {0}


def test_unmapped_times_fall_back_to_the_hash(spark):
    home = part("k", 10)
    other = (home + 1) % 10
    log = log_of(spark, [("t", "k", 1, other, 4, 7)])
    messages = messages_of(spark, 9)
    routes = [r.route for r in routing.route(messages, 10, log).orderBy("seq").collect()]
    assert routes == [home] * 3 + [other] * 3 + [home] * 3
    tagged = message_sets.tag_message_sets(messages, 10, log).orderBy("seq").collect()
    assert [r.dest_partition for r in tagged] == routes
    assert [r.dest_idx for r in tagged] == [0] * 3 + [1] * 3 + [2] * 3
    assert [r.seq for r in tagged if r.is_boundary] == [4, 7]


def test_zero_length_intervals_are_ignored(spark):
    log = log_of(spark, [("t", "k", 1, 3, 4, 4), ("t", "k", 1, 6, 4, None)])
    tagged = message_sets.tag_message_sets(messages_of(spark, 6), 10, log)
    assert {r.dest_partition for r in tagged.where("seq >= 4").collect()} == {6}


def many(spark):
    """Several keys, among them one with most messages, moving about."""
    rows = []
    for i in range(6):
        for v in range(5):
            rows.append(("t", f"k{i}", 1, (i * 3 + v * (i + 1)) % 10, v * 40 + 1 + i, v * 40 + 30 + i))
    messages = spark.range(1, 401).select(
        F.lit("t").alias("topic"),
        F.concat(F.lit("k"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 9)).alias("key"),
        F.col("id").alias("seq"),
    )
    return messages, log_of(spark, rows)


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_order_can_be_rebuilt(spark, limit, chunk):
    messages, log = many(spark)
    tagged = message_sets.tag_message_sets(messages, 10, log, broadcast_rows=limit)
    sent = message_sets.sent_partition(tagged)
    delivered = delivery.delivery_log(sent, chunk)
    rows = delivery.key_total_order(delivered, chunk).collect()
    assert len(rows) == 400
    assert all(0 <= r.sent_partition < 10 for r in rows)
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, []).append(r)
    for mine in by_key.values():
        assert [r.pos for r in sorted(mine, key=lambda r: r.seq)] == list(range(1, len(mine) + 1))
    assert delivery.order_violations(delivered, chunk).count() == 0
    boundaries = sum(r.is_boundary for r in rows)
    sets = {(r.key, r.dest_idx) for r in rows if r.dest_idx > 0}
    assert boundaries == len(sets) > 10
    latest = {r.key: r.dest_idx for r in message_sets.latest_message_set(tagged).collect()}
    assert latest == {k: max(r.dest_idx for r in mine) for k, mine in by_key.items()}


@pytest.mark.parametrize("chunk", [1_000_000, 3])
def test_violations_are_found(spark, chunk):
    messages, log = many(spark)
    delivered = delivery.delivery_log(
        message_sets.sent_partition(message_sets.tag_message_sets(messages, 10, log))
    )
    swapped = delivered.withColumn(
        "offset", F.when(F.col("key") == "k0", 1000 - F.col("offset")).otherwise(F.col("offset"))
    )
    bad = delivery.order_violations(swapped, chunk)
    assert bad.count() > 0
    assert {r.key for r in bad.select("key").distinct().collect()} == {"k0"}


def test_records_with_broken_tags_are_quarantined(spark):
    sent = sent_of(spark, [5, 8])
    whole = sent.select(
        "key", "seq", "sent_partition",
        producer_headers(F.lit("p"), encode_tag(message_sets.tag_struct())).alias("headers"),
    )
    broken = whole.withColumn("headers", producer_headers(F.lit("p"), F.lit("{")))
    plain = whole.withColumn("headers", producer_headers(F.lit("p")))
    decoded, bad = delivery.decode_records(whole.unionByName(broken).unionByName(plain))
    assert bad.count() == 2
    assert sorted(r.tag is None for r in decoded.collect()) == [False, False, True, True]


def test_random_cold_routing(spark):
    log = log_of(spark, [("t", "hot", 1, 3, 1, None)])
    messages = messages_of(spark, 200, "cold").unionByName(messages_of(spark, 5, "hot"))
    routed = routing.route(messages, 10, log, cold="random")
    assert {r.route for r in routed.where("key = 'hot'").collect()} == {3}
    assert len({r.route for r in routed.where("key = 'cold'").collect()}) == 10

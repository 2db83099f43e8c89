import datetime as dt

import pytest
from pyspark.sql import functions as F

from keytide.functions import (
    chunked_lag,
    chunked_running_sum,
    decode_tag,
    dimension_join,
    encode_tag,
    fnv1a,
    fnv_partition,
    header,
    interval_join,
    plan_interval_join,
    with_sequence,
)
from keytide.functions.chunked import chunk_of

# Numbers of the keys location_<i> that hash to each of 10 partitions.
GOLDEN = {
    0: [3, 18, 25, 34],
    1: [11, 26, 28, 33, 39],
    2: [10, 27, 29, 32, 38],
    3: [4, 13, 20, 31],
    4: [5, 12, 21, 30],
    5: [6, 8, 15, 22],
    6: [7, 9, 14, 23],
    7: [0, 17, 37],
    8: [1, 16, 36],
    9: [2, 19, 24, 35],
}
RAW = {
    "": (2166136261, 3, 13),
    "location_0": (347411857, 7, 57),
    "location_1": (330634238, 8, 38),
    "location_3": (297079000, 0, 0),
    "location_18": (3423477938, 0, 90),
    "location_39": (3238629939, 1, 91),
    "é": (513665217, 7, 17),
}


def test_golden_partitions(spark):
    keys = spark.range(40).select(F.concat(F.lit("location_"), F.col("id").cast("string")).alias("k"), "id")
    got = {}
    for row in keys.select("id", fnv_partition(F.col("k"), 10).alias("p")).collect():
        got.setdefault(row.p, []).append(row.id)
    assert {p: sorted(ids) for p, ids in got.items()} == GOLDEN


def test_raw_hashes(spark):
    df = spark.createDataFrame([(k,) for k in RAW], "k string")
    rows = df.select(
        "k", fnv1a(F.col("k")), fnv_partition(F.col("k"), 10), fnv_partition(F.col("k"), 100)
    ).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == RAW


def _messages(spark, rows):
    return spark.createDataFrame(rows, "topic string, ts timestamp, msg_id long")


@pytest.mark.parametrize("same_instant", [False, True])
def test_sliced_sequence_equals_plain_rank(spark, same_instant):
    """Also when all messages of a topic, or nearly all of them, share one instant."""
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        topic = "a" if i % 10 else f"t{i % 7}"
        second = 0 if same_instant and i % 50 else (i * 7919) % 977
        rows.append((topic, t0 + dt.timedelta(seconds=second), (i * 104729) % 1_000_003))
    df = _messages(spark, rows)
    sliced = {(r.topic, r.msg_id): r.seq for r in with_sequence(df, slice_rows=100).collect()}
    ordered = {}
    for topic, ts, msg_id in sorted(rows):
        ordered.setdefault(topic, []).append(msg_id)
    assert sliced == {(t, m): i + 1 for t, ms in ordered.items() for i, m in enumerate(ms)}


def test_sequence_without_groups(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=(i * 37) % 101), i) for i in range(500)]
    got = with_sequence(_messages(spark, rows), group=[], slice_rows=50).collect()
    by_seq = [(r.ts, r.msg_id) for r in sorted(got, key=lambda r: r.seq)]
    assert by_seq == sorted((ts, m) for _, ts, m in rows)
    assert sorted(r.seq for r in got) == list(range(1, 501))


def test_slices_are_even(spark):
    """A topic with most of the rows is cut; no slice is much larger than asked for."""
    from keytide.functions.chunked import _slice_bounds, _slice_id

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a" if i % 20 else "b", t0, i) for i in range(20_000)]
    df = _messages(spark, rows)
    columns = ["topic", "ts", "msg_id"]
    bounds = _slice_bounds(df, columns, 20_000, 1_000)
    sizes = df.groupBy(_slice_id(df, columns, bounds)).count().collect()
    assert max(r["count"] for r in sizes) < 2_500


def test_chunked_sum_and_lag(spark):
    rows = [("g" if i % 4 else "h", i, (i * 31) % 17) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, at long, v long").withColumn("c", chunk_of("at", 9))
    summed = chunked_running_sum(df, ["g"], ["at"], ["c"], "v", "total")
    both = chunked_lag(summed, ["g"], ["at"], ["c"], "v", "prev").collect()
    want, total, prev = {}, {}, {}
    for g, at, v in rows:
        total[g] = total.get(g, 0) + v
        want[at] = (total[g], prev.get(g))
        prev[g] = v
    assert {r["at"]: (r.total, r.prev) for r in both} == want


@pytest.mark.parametrize("limit", [1000, 0])
def test_interval_join(spark, limit):
    facts = spark.range(1, 101).select(F.lit("k").alias("key"), F.col("id").alias("at"))
    intervals = spark.createDataFrame(
        [("k", 5, 20, 1), ("k", 20, 60, 2), ("k", 60, 60, 3), ("k", 80, None, 4), ("z", 1, None, 5)],
        "key string, valid_from long, valid_to long, p int",
    )
    plan = plan_interval_join(intervals, ["key"], facts, "at", broadcast_rows=limit, chunk=7)
    assert plan.broadcast == bool(limit)
    got = {r["at"]: r.p for r in interval_join(facts, intervals, ["key"], "at", plan).collect()}

    def expected(at):
        return 1 if 5 <= at < 20 else 2 if 20 <= at < 60 else 4 if at >= 80 else None

    assert got == {at: expected(at) for at in range(1, 101)}


@pytest.mark.parametrize("limit,broadcast", [(10_000, True), (100, False)])
def test_many_intervals_of_one_key(spark, limit, broadcast):
    """Interval i of key a is [10i, 10i + 7); key b has one long interval."""
    facts = spark.range(0, 4000).select(
        F.when(F.col("id") % 4 == 0, "b").when(F.col("id") % 4 == 1, "c").otherwise("a").alias("key"),
        F.col("id").alias("at"),
        (F.col("id") * 2).alias("x"),
    )
    many = spark.range(0, 350).select(
        F.lit("a").alias("key"),
        (F.col("id") * 10).alias("valid_from"),
        (F.col("id") * 10 + 7).alias("valid_to"),
        F.col("id").alias("p"),
    )
    one = spark.sql("SELECT 'b' AS key, 17L AS valid_from, 3000L AS valid_to, -1L AS p")
    intervals = many.unionByName(one)
    plan = plan_interval_join(intervals, ["key"], facts, "at", broadcast_rows=limit, chunk=130)
    assert plan.broadcast == broadcast and plan.chunk is not None
    rows = interval_join(facts, intervals, ["key"], "at", plan).collect()
    assert len(rows) == 4000
    for r in rows:
        at = r["at"]
        want = None
        if r.key == "a" and at % 10 < 7 and at < 3500:
            want = at // 10
        elif r.key == "b" and 17 <= at < 3000:
            want = -1
        assert (r.p, r.x) == (want, 2 * at)


@pytest.mark.parametrize("limit", [1000, 0])
def test_dimension_join_keeps_every_row(spark, limit):
    facts = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id"
    )
    dim = spark.range(20_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    joined = dimension_join(facts, dim, ["key"], broadcast_rows=limit)
    row = joined.agg(
        F.count("*").alias("n"),
        F.count("v").alias("hits"),
        F.sum(F.when(F.col("v") != F.col("key") * 2, 1).otherwise(0)).alias("wrong"),
    ).first()
    want = facts.where("key < 20000").count()
    assert (row.n, row.hits, row.wrong) == (30_000, want, 0)


def test_header_takes_the_last_of_a_name(spark):
    df = spark.sql(
        "SELECT array(named_struct('key','Producer','value',CAST('a' AS BINARY)),"
        " named_struct('key','Producer','value',CAST('b' AS BINARY))) AS headers"
    )
    row = df.select(
        header(F.col("headers"), "Producer").cast("string"), header(F.col("headers"), "x")
    ).first()
    assert tuple(row) == ("b", None)


@pytest.mark.parametrize("fmt", ["json", "text"])
def test_tag_codec(spark, fmt):
    df = spark.sql(
        "SELECT named_struct('key','location_1','src_partition',-1,'src_idx',-1,"
        "'dest_partition',8,'dest_idx',0) AS tag"
    )
    wired = df.select("tag", encode_tag(F.col("tag"), fmt).alias("w"))
    row = wired.select("tag", "w", decode_tag(F.col("w"), fmt).alias("back")).first()
    assert row.tag == row.back
    if fmt == "text":
        assert bytes(row.w) == b"location_1 -1 -1 8 0\n"


@pytest.mark.parametrize(
    "fmt,bad",
    [("json", "{"), ("json", '{"key":"a","src_partition":1}'), ("text", "a 1 2 3\n"), ("text", "a b 1 2 3\n")],
)
def test_broken_tags_decode_to_null(spark, fmt, bad):
    df = spark.createDataFrame([(bad,)], "w string").select(F.col("w").cast("binary").alias("w"))
    assert df.select(decode_tag(F.col("w"), fmt)).first()[0] is None


def test_only_json_carries_keys_with_spaces(spark):
    df = spark.sql(
        "SELECT named_struct('key','a b','src_partition',-1,'src_idx',-1,'dest_partition',8,'dest_idx',0) t"
    )
    row = df.select(
        decode_tag(encode_tag(F.col("t"), "json"), "json").alias("j"),
        decode_tag(encode_tag(F.col("t"), "text"), "text").alias("x"),
    ).first()
    assert row.j.key == "a b" and row.x is None


def test_long_intervals_are_not_multiplied(spark):
    from keytide.functions import joins

    intervals = spark.range(1000).selectExpr(
        "id AS key", "1L AS valid_from", "CAST(NULL AS BIGINT) AS valid_to", "id AS p"
    )
    far = 100_000_000_000
    facts = spark.range(1000).selectExpr("id AS key", f"{far}L + id AS at")
    plan = plan_interval_join(intervals, ["key"], facts, "at", broadcast_rows=10)
    assert not plan.broadcast
    assert joins._begun(facts, intervals, ["key"], "at", plan, "valid_from", "valid_to").count() == 2000
    rows = interval_join(facts, intervals, ["key"], "at", plan).collect()
    assert len(rows) == 1000 and all(r.p == r.key for r in rows)

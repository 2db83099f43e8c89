import gzip
import hashlib

import pytest

from keytide.llm import warc
from keytide.session import scratch_path
from tests.llm.fixtures import rows_of

BIG = "<p>é中🙂</p>WARC/1.1\r\n\r\n" * 5_000
PAGES = [
    (0, "http://a/0", "x" * 99), (1, "http://a/1", "x" * 99), (2, "http://a/2", "y" * 100),
    (3, "http://a/3", "y" * 100), (4, None, None), (5, "http://a/5\r\nX: y", ""), (6, "http://a/6", BIG),
    (7, "http://a/7", BIG), (8, "http://a/8", "0\r\n\r\n" * 50), (9, "u", "y" * 100), (9, "u", "y" * 100),
    (None, "n", "z" * 200), (10, "n", "z" * 200),
]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' AS payload", "'y' AS digest", "1 AS refers_to", "2 AS segment")


def test_round_trip(spark, monkeypatch):
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [j for j, _, h in PAGES if j is not None and (h or "").encode() == raw]
        again = i is not None and len(raw) >= 100 and min(same) < i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    got = rows_of(warc.round_trip(pages(spark).repartition(3)))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_segments_come_back_whole(spark):
    path = scratch_path(spark, "warc-test")
    warc.write(pages(spark), path, segment_bytes=100)
    parts = warc.records(spark, path, segmented=True)
    assert parts.where("record_type = 'continuation'").count() > 1000
    texts = {r.page_id: r.payload for r in warc.reassembled(spark, path).where("record_type = 'response'").collect()}
    assert bytes(texts[6]).decode() == BIG and bytes(texts[8]) == b"0\r\n\r\n" * 50


def test_damage_is_seen(spark, tmp_path):
    whole = list(warc.records_of(1, "u", b"a" * 1000, "d", None, "n", segment_bytes=300))
    for k, records in enumerate([whole, whole[:1] + whole[2:], [*whole, whole[1]], whole[:-1], whole[::-1]]):
        folder = tmp_path / str(k)
        folder.mkdir()
        body = b"".join(r + b"\r\n\r\n" for r in records)
        (folder / "a.warc.gz").write_bytes(gzip.compress(body[:50]) + gzip.compress(body[50:]))
        (row,) = warc.reassembled(spark, str(folder)).collect()
        assert (bytes(row.payload) if row.payload is not None else None) == (b"a" * 1000 if k in (0, 4) else None)


@pytest.mark.parametrize("body", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabcX0\r\n\r\n", b"3\r\nabc\r\n"])
def test_broken_framing(body):
    assert warc.unchunked(body) is None


def test_framing():
    assert warc.unchunked(warc.chunked(b"abc" * 9_000)) == b"abc" * 9_000
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"

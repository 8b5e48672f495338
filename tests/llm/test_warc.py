import base64
import hashlib

import pytest
from helpers import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from shotweave.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    out, first = [], {}
    for p, _, html in rows:
        b = (html or "").encode()
        first.setdefault(b, []).append(p)
    for b, ids in first.items():
        ids.sort(key=lambda p: (p is None, p or 0))
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out += [(p, len(b), digest, "revisit" if k else "response", ids[0] if k else None) for k, p in enumerate(ids)]
    return sorted(out, key=str)


def report(df):
    assert df.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted(map(tuple, df.collect()), key=str)


ROWS = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, "http://a/9", "same"), (1, None, None), (2, "", ""), (4, "http://x/\r\nWARC-Type: revisit", "x"),
        (6, "u", prose(1, 30_000)), (7, "u", "WARC/1.1\r\n" * 400), (8, "WARC/1.1", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (10, "é ü", "é" * 5000 + "\r\n0\r\n\r\n"),
        (11, "u", "0\r\n\r\n"), (12, "u", "W" * 9000), (None, "n", "null id"), (None, "n", "same"), (13, "u", "twice"), (13, "u", "twice"), (14, "u", "\r\nWARC/1.1")]


@pytest.mark.parametrize("segment,chunk", [(64, 5), (1000, 64), (warc.SEGMENT_BYTES, warc.CHUNK_BYTES)])
def test_round_trip(spark, segment, chunk):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    assert report(warc.round_trip(pages, segment, chunk)) == brute(ROWS)


def test_payloads_and_addresses_come_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "1 as record_id", "2 as payload", "3 as same", "4 as digest")
    warc.write(pages, f"{tmp_path}/w", 300, 50, min_revisit=5)
    got = {(r.page_id, r.uri): r for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert bytes(got[7, "u"].payload) == ROWS[7][2].encode() and bytes(got[6, "u"].payload) == ROWS[6][2].encode()
    assert got[4, "http://x/%0D%0AWARC-Type:%20revisit"].type == "response" and (8, "WARC%2F1.1") in got
    assert got[5, "http://a/5"].type == "response"  # four bytes: below the bound for revisits


def test_empty_table(spark):
    assert report(warc.round_trip(spark.createDataFrame([], PAGES))) == []


def test_hot_payload_and_reading_in_small_splits(spark, tmp_path):
    """A third of the pages are alike; archives of one file are read by many tasks."""
    rows = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else prose(i, 40 + i % 700)) for i in range(600)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/w", 500, 100)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = warc.read_records(spark, f"{tmp_path}/w")
        assert read.rdd.getNumPartitions() > 10
        got = {r.page_id: r for r in warc.read(spark, f"{tmp_path}/w").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 600 and all(bytes(got[i].payload).decode() == html for i, _, html in rows if i % 3 or not i)
    assert {got[i].refers_to_id for i in range(3, 600, 3)} == {got[0].record_id}


def test_missing_segment_and_wrong_length_raise(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", prose(3, 900))], PAGES), f"{tmp_path}/w", 400, 100)
    records = warc.read_records(spark, f"{tmp_path}/w")
    n = records.count()
    assert n > 5
    for bad in (records.filter("segment is null or segment <> 3"), records.filter("segment <> 1"), records.filter(f"segment <> {n}"),
                records.withColumn("total_length", records.total_length + 1)):
        with pytest.raises(Exception, match="segments of a record"):
            warc.reassembled(bad).collect()


def test_records_of_other_writers():
    """A head inside a payload, lower-case fields, chunk extensions and trailers, no framing."""
    body = b"a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body
    one = b"WARC/1.1\r\nwarc-type: response\r\nwarc-record-id: <x>\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    found = list(warc.records_of(iter((one + one).split(b"WARC/1.1\r\n")), b"WARC/1.1\r\n"))
    assert [warc.http_payload(r["block"]) for r in found] == [body, body]
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for bad in (b"", b"z\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b"3\r\nabc\r\n0"):
        with pytest.raises(warc.WarcError):
            warc.dechunked(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"WARC/1.1", b"\r\n", b"W", b"0", b"x" * 7, b"\xc3\xa9"]), max_size=40).map(b"".join), st.integers(1, 30))
def test_framing_round_trip(payload, size):
    framed = warc.chunked(payload, size)
    assert warc.dechunked(framed) == payload and b"WARC/1.1\r\n" not in framed

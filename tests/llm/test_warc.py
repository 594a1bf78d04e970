import base64
import hashlib

import pytest

from segmart.llm import warc

EVIL = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nContent-Length: 9999999\r\n\r\n"
ROWS = [
    (1, "http://a", "x"), (2, "http://b", EVIL), (3, "u\r\nWARC/1.1\r\n", "x"), (4, None, None), (5, "e", ""),
    (6, "n", "é" * 1000 + EVIL * 50), (7, "z", "\r\n\r\nWARC/1.1\r\n"), (8, "m", "WARC/1.1\r\n" * 500), (None, "q", "x"),
    (9, "w", "﻿mark"), (-5, "neg", "x"), (10, "t", "tail\r\n\r\n"), (2, "http://b", EVIL),
] + [(100 + i, "l", f"p{i % 17}" * 200 + EVIL) for i in range(60)]


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    found = []
    for page, _, html in rows:
        data, least = (html or "").encode(), first.get(html or "")
        again = least is not None and page != least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        found.append((page, len(data), digest, "revisit" if again else "response", least if again else None))
    return sorted(found, key=str)


@pytest.fixture
def pages(spark):
    rows = [(*row, i, "x") for i, row in enumerate(ROWS)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, block long, payload string")


@pytest.mark.parametrize(("block_bytes", "compression"), [(None, "gzip"), (None, "none"), ("2500", "none")])
def test_magic_in_payloads_is_no_record(spark, pages, block_bytes, compression):
    """Also when files are split into blocks much smaller than a record."""
    if block_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    try:
        rows = warc.round_trip(pages.coalesce(2), compression)
        found = warc.digest(rows).collect()
        assert sorted(map(tuple, found), key=str) == expected(ROWS)
        payloads = {r.page_id: r.payload for r in rows.where("record_type = 'response'").collect()}
        assert payloads[6] == "é" * 1000 + EVIL * 50 and payloads[9] == "﻿mark"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_default_archives_are_many_blocks(spark, pages, monkeypatch):
    """The pointers between blocks are followed on the registered path, and no task has a whole archive."""
    seen = []
    reachable = warc.reachable
    monkeypatch.setattr(warc, "reachable", lambda found: seen.append(found) or reachable(found))
    many = pages.crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
    many = many.selectExpr("page_id * 100 + copy AS page_id", "url", "concat(coalesce(html, ''), copy) AS html")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = warc.digest(warc.round_trip(many.coalesce(2))).collect()
        blocks = seen[0].groupBy("file").agg({"block": "max"}).count(), seen[0].select("file", "block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks[0] <= 2 and blocks[1] > 10 * blocks[0]
    rows = [(r.page_id, r.url, r.html) for r in many.collect()]
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_clashing_and_extra_columns(spark, pages):
    odd = pages.withColumnRenamed("payload", "header").withColumn("piece", pages.url).withColumn("owner", pages.page_id)
    assert sorted(map(tuple, warc.digest(warc.round_trip(odd)).collect()), key=str) == expected(ROWS)


def test_empty_table(pages):
    assert warc.round_trip(pages.where("false")).count() == 0


def test_records_are_plain_archives(spark, pages, tmp_path):
    warc.write_archives(warc.page_records(pages.where("page_id = 5")), str(tmp_path / "w"))
    (part,) = (tmp_path / "w").glob("part-*")
    data = part.read_bytes()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")

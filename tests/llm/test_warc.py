import base64
import gzip
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.llm import warc
from panelspark.llm.queries import ORACLE, QUERIES
from panelspark.llm.warc import read_archives, round_trip, write_archives
from panelspark.session import scratch_folder

SCHEMA = "page_id bigint, url string, html string, digest string, refers int"


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "ünï " * 700_000
    rows = [
        (1, "http://a/1", "same", "x", 1),
        (2, "http://a/2\r\nWARC-Type: evil", "same", None, 2),
        (3, None, "same", "x", 3),
        (4, "http://a/4", None, "x", 4),
        (5, "http://a/5", "", "x", 5),
        (6, "http://a/6", big, "x", 6),
        (7, "http://a/7", big, "x", 7),
        (8, "http://a/8", "text\r\n\r\nWARC/1.1\r\n\r\n\x00", "x", 8),
        (8, "http://a/8", "another payload, same id", "x", 8),
        (9, "http://a/9", "twice", "x", 9),
        (9, "http://a/9", "twice", "x", 9),
        (None, "http://a/", "same", "x", 0),
        (None, "http://a/", "lone", "x", 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def wanted(rows):
    out = []
    for r in rows:
        same = [x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None]
        top = max(same, default=None)
        first = top is None or r.page_id == top
        out.append((r.page_id, len((r.html or "").encode()), digest(r.html), "response" if first else "revisit", None if first else top))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_odd_and_whole_pages(spark, sf, odd_pages):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for table in (pages, odd_pages, odd_pages.limit(0)):
        assert ordered(round_trip(table).collect()) == ordered(wanted(table.collect()))


def test_sql_gives_the_same_rows(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert ordered(QUERIES["op6_warc_round_trip"](spark, sf).collect()) == ordered(con.execute(ORACLE["op6_warc_round_trip"]).fetchall())


def test_chunks_carry_digests_and_restore_payloads(spark, odd_pages, monkeypatch):
    folder = scratch_folder(spark, "archives")
    manifest = write_archives(odd_pages, folder)
    rows = read_archives(manifest).collect()
    by_name = {}
    for r in sorted(rows, key=lambda r: (r.name, r.digest if r.name in ("8", "") else "", r.chunk)):
        by_name.setdefault(r.name, []).append(r)
    long = by_name["7"]
    assert len(long) > 1 and [r.chunk for r in long] == list(range(len(long)))
    so_far = b""
    for r in long:
        so_far += r.bytes
        assert r.size == len(so_far)
        assert r.digest == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
        assert len(r.bytes) <= warc.CHUNK and r.last == (r is long[-1])
    assert so_far.decode() == odd_pages.where("page_id = 7").first().html
    assert by_name["6"][0].kind == "revisit" and by_name["6"][0].refers == "7"


def test_files_are_gzip_members_and_damage_is_found(spark, odd_pages):
    folder = scratch_folder(spark, "archives")
    manifest = write_archives(odd_pages, folder)
    paths = sorted({r.path for r in manifest.collect()})
    whole = b"".join(gzip.open(warc.opened(p)[1]).read() for p in paths)
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == odd_pages.count()
    assert b"\nWARC-Type: evil" not in whole
    path = warc.opened(paths[0])[1]
    size = os.path.getsize(path)
    with open(path, "r+b") as f:
        f.truncate(size - 7)
    with pytest.raises(Exception, match="ends inside a record"):
        read_archives(manifest).collect()


def test_small_segments_and_archives(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = scratch_folder(spark, "archives")
    manifest = write_archives(pages.withColumn("html", F.concat("html", F.lit("x"))), folder)
    assert manifest.agg(F.sum("records")).first()[0] == pages.count()
    ends = read_archives(manifest, keep_bytes=False).where("last")
    assert ends.count() == pages.count()

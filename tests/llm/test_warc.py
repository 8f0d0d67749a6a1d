import base64
import gzip
import hashlib

import pytest

from nearfield.llm import warc
from nearfield.llm.common import table


def plain(rows, min_bytes=0):
    payloads = {i: (h or "").encode() for i, _, h in rows}
    found = []
    for i, p in payloads.items():
        latest = max(j for j, q in payloads.items() if q == p)
        refers = latest if latest != i and len(p) >= min_bytes else None
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        found.append((i, len(p), digest, "response" if refers is None else "revisit", refers))
    return sorted(found)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
ROWS = [(1, "u1", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u\r\n3", None), (4, "u4", ""), (5, "u5", "é\r\n\r\nWARC/1.1"),
        (6, "u6", "x" * 3_000_000), (7, "u7", "x" * 3_000_000), (-8, "u8", "<p>a</p>")]


@pytest.mark.parametrize("min_bytes", [0, 1, 9])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    whole = warc.write_archives(pages, min_bytes)
    records = warc.read_records(warc.normalise(whole))
    assert sorted(map(tuple, records.select(COLUMNS).collect())) == plain(ROWS, min_bytes)
    texts = {r.page_id: bytes(r.payload).decode() for r in records.collect() if r.record_type == "response"}
    assert texts == {i: h or "" for i, _, h in ROWS if i in texts} and 7 in texts


def test_members_lie_where_the_sidecar_says(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    whole = warc.write_archives(pages)
    normal = warc.normalise(whole)
    assert warc.save_files(normal, str(tmp_path / "out")).count() == whole.count()
    for r in warc.sidecar(normal).collect():
        octets = (tmp_path / "out" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        record = gzip.decompress(octets)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert b"X-Page-Id: %d\r\n" % r.page_id in record
    # one stream or a member for each record: the same records, and normalising again changes nothing
    streams = {r.archive: gzip.decompress(r.octets) for r in whole.collect()}
    again = warc.normalise(warc.load_files(spark, str(tmp_path / "out")))
    assert {r.archive: gzip.decompress(r.octets) for r in again.collect()} == streams


def test_repeated_and_missing_ids_empty_and_damaged(spark):
    rows = [(None, "a", "same"), (3, "b", "same"), (3, "b", "same"), (3, "c", "other"), (None, "d", "alone")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, digest int, n string")
    found = warc.read_records(warc.normalise(warc.write_archives(pages))).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(None, "revisit", 3), (3, "response", None), (3, "response", None), (3, "response", None), (None, "response", None)], key=str
    )
    assert warc.read_records(warc.normalise(warc.write_archives(pages.limit(0)))).count() == 0
    cut = spark.createDataFrame([("a", bytearray(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))], warc.ARCHIVES)
    with pytest.raises(Exception, match="within a record"):
        warc.normalise(cut)


def test_small_table(spark, small):
    db, folder = small
    rows = db.execute("SELECT page_id, url, html FROM pages").fetchall()
    found = warc.read_records(warc.normalise(warc.write_archives(table(spark, folder, "pages"))), payloads=False)
    assert sorted(map(tuple, found.select(COLUMNS).collect())) == plain(rows)

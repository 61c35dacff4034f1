import struct

import duckdb
import pytest
import zstandard

from lakeatlas.llm import registry, warc

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    got = sorted(map(tuple, registry.QUERIES["op1_warc_zstd"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == sorted(c.sql(registry.ORACLES["op1_warc_zstd"]).fetchall())


def test_edges(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "a b%\r\nc:é", "x" * 1000, 0), (3, "u", "x" * 1000, 0), (2, "u", "x" * 1000, 0), (None, "u", "x" * 1000, 0), (None, "u", "y" * 2000, 0), (5, "u", "z" * 999, 0), (6, "u", "z" * 999, 0), (7, "u", "é" * 3_000_000, 0), (8, "u", "\r\n\r\nWARC/1.1", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {(1, 0, "response", None), (2, 0, "response", None), (3, 1000, "response", None), (2, 1000, "revisit", 3), (None, 1000, "revisit", 3), (None, 2000, "response", None), (5, 999, "response", None), (6, 999, "response", None), (7, 6_000_000, "response", None), (8, 12, "response", None)}
    assert "a b%\r\nc:é" in {r.url for r in warc.round_trip(df).collect()}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_ids_beyond_doubles(spark):
    big = 2**53
    rows = [(big + 1, "u", "x" * 1000), (big + 3, "u", "x" * 1000), (None, "u", "x" * 1000), (big + 5, "u", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {(big + 1, "revisit", big + 3), (big + 3, "response", None), (None, "revisit", big + 3), (big + 5, "response", None)}


def test_files_hold_payloads_and_a_dictionary(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    archives = warc.write_archives(warc.plan_records(pages.coalesce(1)), f"file://{tmp_path}/w", archive_bytes=200_000)
    assert archives.count() > 2
    path = next((tmp_path / "w").glob("*.warc.zst"))
    data = path.read_bytes()
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    got = {r.page_id: r for r in warc.read_files(spark, f"file://{tmp_path}/w").collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    assert set(got) == set(html)
    for i, r in got.items():
        first = got[r.refers_to] if r.record_type == "revisit" else r
        assert first.payload.decode() == html[i] and r.error is None


def record(**change):
    data = warc.encode_record(1, "u", b"hello", "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d", "response", None)
    for a, b in change.values():
        assert a in data
        data = data.replace(a, b)
    return data


def test_records_are_validated():
    assert warc.decode_record(record())["payload"] == b"hello"
    for a, b in [(b"WARC/1.1", b"WARC/9"), (b"WARC-Date", b"X-Date"), (b"hello", b"hullo"), (b"Content-Length: 5", b"Content-Length: 4"), (b"Content-Length: 5", b"Content-Length: x"), (b"sha1:", b"md5:"), (b"\r\n\r\nhello", b"\r\nhello"), (b"hello\r\n\r\n", b"hello\r\n"), (b"WARC-Type:", b"WARC-Type"), (b"<urn:pages:1>", b"<x>")]:
        with pytest.raises(warc.WarcError):
            warc.decode_record(record(x=(a, b)))


def test_broken_archives_give_an_error_after_what_is_sound(spark, tmp_path):
    (archive, n), = warc.encode_archives(iter([record() + b""] * 20))
    assert n == 20 and len(list(warc.decode_archive(archive))) == 21  # and the warcinfo
    plain = b"".join(zstandard.ZstdCompressor(write_content_size=False).compress(record()) for _ in range(3))
    assert len(list(warc.decode_archive(plain))) == 3
    for bad in (archive[:-3], archive + b"garbage here", plain[:-1], b"\x00" * 20, b"abc"):
        *sound, last = warc.decode_archive(bad)
        assert isinstance(last, warc.WarcError) and all(isinstance(x, bytes) for x in sound)
    (tmp_path / "a.warc.zst").write_bytes(plain + b"garbage here")
    got = warc.read_files(spark, f"file://{tmp_path}").collect()
    assert [r.error is None for r in got] == [True, True, True, False]

import gzip
import hashlib

import duckdb
import pytest

from grovemill.llm.warc_segments import SQL, archive_and_read, decode_chunks, page_records, parse, reassemble, segments, transfer_chunks, write_archives

SCHEMA = "page_id bigint, url string, html string, digest string, fault int"
LONG = "<p>" + "long päge " * 3000
ROWS = [
    (5, "http://a/x y", "<html>" + "a" * 200, "x", 1), (3, "http://b", "<html>" + "a" * 200, "x", 1), (9, None, "<html>" + "a" * 200, "x", 1), (3, "http://b", "<html>" + "a" * 200, "x", 1),
    (10, "u", "small", None, None), (11, "u", "small", None, None), (12, "u", None, None, None), (13, "u", "", None, None),
    (20, "u", LONG, "x", 1), (21, "u", LONG, "x", 1), (None, "u", LONG, "x", 1), (None, "u", "b" * 150, "x", 1), (None, "u", "b" * 150, "x", 1), (30, "u", "0\r\n\r\n" * 40, "x", 1),
]


def slow():
    least, out = {}, []
    for i, _, html, *_ in ROWS:
        if i is not None and len((html or "").encode()) >= 100:
            least[html] = min(i, least.get(html, i))
    for i, _, html, *_ in ROWS:
        body = (html or "").encode()
        first = least.get(html)
        later = first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if later else "response", first if later else None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [90, 4096, 1 << 20])
def test_round_trip(spark, segment):
    assert sorted(map(tuple, archive_and_read(spark.createDataFrame(ROWS, SCHEMA), segment).collect()), key=str) == slow()


def test_sql_twin():
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [r[:3] for r in ROWS])
    assert sorted(con.sql(SQL).fetchall(), key=str) == slow()


def test_thousands_of_equal_rows(spark):
    df = spark.range(6000).selectExpr("if(id < 3000, 7, id) as page_id", "'u' as url", f"'{'x' * 150}' as html")
    pages = write_archives(df, segment=100)
    assert segments(pages).where("number = 1 and type = 'response'").count() <= pages.count()
    got = {(r.record_type, r.refers_to): r["count"] for r in archive_and_read(df, 100).groupBy("record_type", "refers_to").count().collect()}
    assert got == {("response", None): 3000, ("revisit", 7): 3000}


def test_archives_are_plain_warc_files(spark):
    rows = write_archives(spark.createDataFrame(ROWS, SCHEMA), segment=500, archive=2000).collect()
    assert len(rows) > len({r.name.rsplit("-", 1)[0] for r in rows})
    for r in rows:
        kinds = [f["warc-type"] for f, _ in parse(r.content)]
        assert kinds[0] == "warcinfo" and len(kinds) == r.records and gzip.decompress(r.content).count(b"WARC/1.1\r\n") == r.records


@pytest.mark.parametrize(("drop", "fault"), [(0, "the first segment is missing"), (2, "a segment is missing"), (-1, "the total length differs")])
def test_broken_sets_are_reported(spark, drop, fault):
    members = page_records(1, "u", LONG.encode(), None, 5000)
    del members[drop]
    content = b"".join(map(gzip.compress, reversed(members)))
    got = reassemble(segments(spark.createDataFrame([(bytearray(content),)], "content binary"))).collect()
    assert [(r.fault, r.payload) for r in got] == [(fault, None)]


def test_transfer_chunks():
    for n in (0, 1, 1500, 1501, 9000):
        assert decode_chunks(transfer_chunks(b"\r\n0" * n)) == b"\r\n0" * n
    assert decode_chunks(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            decode_chunks(bad)


def test_empty(spark):
    assert archive_and_read(spark.createDataFrame([], SCHEMA)).collect() == []

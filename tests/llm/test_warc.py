"""Archives of both ARC versions with awkward records, and the round trip of pages."""

import gzip
import hashlib

from evalspark.llm import queries, warc

TRAP = "WARC/1.1\r\nWARC-Type: response\r\n\r\nhttp://a/ 0.0.0.0 20000101000000 text/html 5\n"


def record(url, body, version=1, length=None, date="19991231235959"):
    extra = "200 - - 0 x.arc " if version == 2 else ""
    return f"{url} 1.2.3.4 {date} text/html {extra}{len(body) if length is None else length}\n".encode() + body + b"\n"


def arc(version):
    about = f"{version} 0 me\nfields\n".encode()
    return record("filedesc://x.arc", about, version).replace(b"text/html", b"text/plain", 1)


def test_parse_arc():
    http = b"HTTP/1.0 200 OK\r\nX-Page-Id: -7\r\n\r\nbody\n\nwith lines\n"
    for version in (1, 2):
        data = arc(version) + record("http://a/", http, version) + b"no header\n" + record("dns:b", b"1.2.3.4", version) + record("http://c/", b"", version) + record("http://d/", b"cut", version, length=99)
        for content in (data, gzip.compress(data), gzip.compress(data[:70]) + gzip.compress(data[70:])):
            rows = list(warc.parse_arc("f", content))
            assert [r.get("url") for r in rows] == ["http://a/", None, "dns:b", "http://c/", "http://d/"]
            assert [r["error"] for r in rows] == [None, "malformed", None, None, "truncated"]
            assert rows[0]["payload_digest"] == hashlib.sha1(b"body\n\nwith lines\n").hexdigest() and rows[0]["order_key"] == -7
            assert [r.get("http") for r in rows] == [True, None, False, False, False] and {r["version"] for r in rows if r["error"] != "malformed"} == {version}
    assert [r["url"] for r in warc.parse_arc("f", record("http://a/", http, 2))] == ["http://a/"]  # no version block: by its width
    assert list(warc.parse_arc("f", b"")) == []


def test_round_trip(spark):
    big = "é" * 600 + TRAP
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "u", big + "!"), (4, "", None), (5, "u", ""), (None, "u", big), (6, "filedesc://x", "s"), (7, "u", "s"), (7, "u", "s"), (-9, "u", TRAP)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, order_key int, record_id string").repartition(3)
    out = warc.archive_pages(spark, pages).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 2
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(((r.order_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == sorted(want, key=str)
    assert all(r.intact for r in out) and len({r.record_id for r in out}) == len(rows) and {r.date for r in out} == {"2000-01-01T00:00:00Z"}
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_query(spark):
    out = queries.QUERIES["op1_arc_to_warc"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_headers():
    """Blanks in urls and content types, lines without a header, and payloads that look like headers."""
    trap = b"http://evil/ 0.0.0.0 20000101000000 text/html 3\nabc\n"
    for version in (1, 2):
        bad = b"http://bad/ 1.2.3.4 nodate text/html " + (b"x 200 - - zero x.arc " if version == 2 else b"x y z w v ") + str(len(trap)).encode() + b"\n" + trap + b"\n"
        data = arc(version) + record("http://a/b c d", b"one", version) + record("http://e/", b"two", version).replace(b"text/html", b"text/html; charset=x", 1) + bad + record("http://f/", b"three", version)
        rows = list(warc.parse_arc("f", data))
        assert [(r.get("url"), r["error"]) for r in rows] == [("http://a/b c d", None), ("http://e/", None), (None, "malformed"), ("http://f/", None)]
        assert rows[1]["mime"] == "text/html; charset=x" and rows[0]["payload_bytes"] == 3
    assert warc.arc_header("http://x y/ 1.1.1.1 20000101000000 text/html 7", None)[1]["url"] == "http://x y/"


def test_plain_and_truncated_archives(spark, tmp_path):
    """Archives that are not compressed are converted too; a record cut short is written with what is there."""
    whole = arc(1) + record("http://a/ b", b"HTTP/1.0 200 OK\r\nX-Page-Id: 1\r\n\r\nbody") + record("http://cut/", b"HTTP/1.0 200 OK\r\nX-Page-Id: 2\r\n\r\npart", length=900)
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "plain.arc").write_bytes(whole)
    (source / "packed.arc.gz").write_bytes(gzip.compress(whole))
    warc.convert_archives(spark, [str(source)], str(target))
    out = [(r.url, r.order_key, bytes(r.payload)) for r in warc.warc_records(spark, [str(target)]).collect()]
    assert sorted(out) == sorted([("http://a/ b", 1, b"body"), ("http://cut/", 2, b"part\n")] * 2)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in target.glob("*.gz"))
    assert text.count(b"WARC-Truncated: unspecified") == 2

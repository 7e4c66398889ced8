import base64
import gzip
import hashlib
import struct
import zipfile

import duckdb
import pytest

from tamarack.llm import queries
from tamarack.llm import warc_zip as W

SCHEMA = "page_id long, url string, html string, digest string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(k, f"http://x/{k}", f"<p>é {k % 7}\r\n\r\n</p>" * (k % 5), "d") for k in range(60)]
    rows += [(100, None, None, "d"), (101, "http://y\nz", "", "d"), (None, "u", "alone", "d"), (None, "u", rows[9][2], "d"), (-5, "u", "z" * 3_000_000, "d"), (-4, "u", "z" * 3_000_000, "d")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = W.round_trip(df, archive_bytes=4000).collect()
    first = {}
    for page, _, html, _ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, _, html, _ in rows:
        html = html or ""
        back = html in first and page != first[html]
        want.append((page, len(html.encode()), digest(html), "revisit" if back else "response", first[html] if back else None, b"" if back else html.encode()))
    key = lambda r: str(r[:5])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    large = {r.page_id: r.record_type for r in W.round_trip(df, least_bytes=1000).collect()}
    assert large[101] == large[59] == "response" and large[-4] == "revisit"
    assert W.round_trip(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "a", "d")] * 3 + [(2, "u", "a", "d")], SCHEMA)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in W.round_trip(df).collect()) == [(1, "response", None)] * 3 + [(2, "revisit", 1)]


def test_zip64_and_foreign_packages(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a/é.txt", b"hello world")
        z.writestr(zipfile.ZipInfo("deflated"), b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"with PK\x05\x06 inside, and more than enough bytes behind it"
    package = W.Package(f"file://{path}")
    assert package.read("a/é.txt", 6, 5) == b"world" and list(package.ranges("a/é.txt", [(0, 1), (4, 1), (0, 2)])) == [b"h", b"o", b"he"]
    for bad in (lambda: package.read("deflated", 0, 1), lambda: package.read("a/é.txt", 6, 6)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "b.zip").write_bytes(path.read_bytes()[:-70])
    with pytest.raises(ValueError):
        W.Package(f"file://{tmp_path}/b.zip")


def test_reads_zip64_records(tmp_path):
    path, members = tmp_path / "c.zip", {"one": b"first member", "two": b"second"}
    out, central = bytearray(), bytearray()
    for name, data in members.items():
        at, n = len(out), name.encode()
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 20) + n + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        extra = struct.pack("<HHI", 9, 4, 0) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + n + extra
    start = len(out)
    out += central + struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 2, 2, len(central), start)
    out += struct.pack("<IIQI", 0x07064B50, 0, start + len(central), 1) + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path.write_bytes(bytes(out))
    package = W.Package(f"file://{path}")
    assert {n: package.read(n, 0, len(d)) for n, d in members.items()} == members


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got = queries.op8_warc_zip(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.oracle_sql()["op8_warc_zip"]).fetchall())


def record(kind, body, **headers):
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()], f"Content-Length: {len(body)}"])
    return head.encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_packages_made_elsewhere(spark, tmp_path):
    """Several archives, real index lines (the last one without a line end), and records without what ours have."""
    html = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>no length</p>"
    told = {
        "archive/part-1.warc.gz": [record("warcinfo", b"software: x", Content_Type="application/warc-fields"), record("response", html, WARC_Target_URI="http://a.b/c", Content_Type="application/http;msgtype=response", WARC_Record_ID="<urn:uuid:1>")],
        "archive/part-2.warc": [record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"), record("resource", b"\x00\xff raw", WARC_Payload_Digest="sha1:ABC")],
    }
    lines, path = [], tmp_path / "hand.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        for name, records in told.items():
            parts = [gzip.compress(r) if name.endswith("gz") else r for r in records]
            z.writestr(name, b"".join(parts))
            lines += [f'b,a)/c 2024010203040{k} {{"url": "http://a.b/c", "offset": "{sum(map(len, parts[:k]))}", "length": "{len(p)}", "filename": "{name.split("/")[1]}"}}' for k, p in enumerate(parts)]
        z.writestr("indexes/index.cdxj", "\n".join(lines))
    for entries in (1, 2, 2000):
        got = W.read_records(spark.createDataFrame([(f"file://{path}",)], "path string"), entries=entries).collect()
        assert sorted((r.record_type, bytes(r.payload), r.payload_bytes, r.payload_digest, r.url, r.page_id) for r in got) == [
            ("request", b"", 0, None, None, None), ("resource", b"\x00\xff raw", 6, "ABC", None, None), ("response", b"<p>no length</p>", 16, None, "http://a.b/c", None), ("warcinfo", b"software: x", 11, None, None, None)]
    bare = tmp_path / "bare.wacz"
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("archive/x.warc", told["archive/part-2.warc"][0])
    with pytest.raises(Exception, match="no index"):
        W.read_records(spark.createDataFrame([(f"file://{bare}",)], "path string")).collect()


def test_index_lines():
    assert W._surt("http://www.Example.org/a b?c") == "org,example,www)/a%20b?c" and W._surt(None) == "-"
    assert W.index_entry(b'org,a)/ 2020 {"offset": "7", "length": "9", "filename": "x"}') == {"offset": 7, "length": 9, "filename": "x"} == W.index_entry(b'{"offset": 7, "length": 9, "filename": "x"}')


def test_many_repeated_payloads_go_by_a_join(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "u", f"p{k % 9}", "d") for k in range(90)], SCHEMA)
    want = sorted(map(tuple, W.round_trip(rows).collect()))
    monkeypatch.setattr("tamarack.llm.common.BROADCAST_BYTES", 0)
    assert sorted(map(tuple, W.round_trip(rows).collect())) == want

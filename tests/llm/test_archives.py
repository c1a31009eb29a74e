"""WARC files as a reader sees them that knows only the standard's fields, and reruns."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def members(path):
    """(fields, block) of the records of a file, by the standard's grammar alone."""
    data, out = gzip.open(path).read(), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4 :]
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://h/{k}", None if k % 9 == 0 else f"<p>{k % 5}</p>") for k in range(60)] + [(7, "http://h/7", "<p>2</p>"), (None, None, "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_standard_fields(spark, pages):
    from lamella.llm.common import new_path, staged
    from lamella.llm.warc import convert, revisits, scan_arc, write_arc

    arcs = staged(write_arc(pages, new_path(spark, "arc")), "arc-files")
    warcs = staged(convert(arcs, revisits(scan_arc(arcs)), new_path(spark, "warc")), "warc-files").collect()
    records = [x for w in warcs for x in members(w.path.removeprefix("file://"))]
    assert {f["WARC-Type"] for f, _ in records} == {"warcinfo", "response", "revisit"}
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    assert all(f["WARC-Block-Digest"] == sha1(b) for f, b in records)
    response = {f["WARC-Record-ID"]: (f, b) for f, b in records if f["WARC-Type"] == "response"}
    revisit = [f for f, _ in records if f["WARC-Type"] == "revisit"]
    assert len(response) == 6 and len(revisit) == 62 - 6
    for f in revisit:
        of, block = response[f["WARC-Refers-To"]]
        assert f["WARC-Payload-Digest"] == of["WARC-Payload-Digest"] == sha1(block.partition(b"\r\n\r\n")[2])
        assert f["WARC-Refers-To-Target-URI"] == of["WARC-Target-URI"] and f["WARC-Refers-To-Date"] == of["WARC-Date"]
    assert sum(f["WARC-Type"] == "warcinfo" for f, _ in records) == arcs.count()


def test_reruns_agree(pages):
    from lamella.llm.warc import archive_pages

    rows = lambda: sorted(map(tuple, archive_pages(pages).collect()), key=str)
    assert rows() == rows()


def test_other_content(spark, tmp_path):
    """Records that aren't HTTP become resources of their own type."""
    from lamella.llm.common import new_path
    from lamella.llm.warc import arc_line, arc_version_block, convert, read_warc, revisits, scan_arc

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    data = arc_version_block(1, "old.arc") + arc_line(1, "dns:example.org", "19990102030405", "text/dns", 0, "", "-", 9) + b"127.0.0.1\n" + arc_line(1, "http://x", "19990102030406", "text/html", 0, "", "-", len(body)) + body + b"\n"
    path = tmp_path / "old.arc"
    path.write_bytes(data)
    files = spark.createDataFrame([("file://" + str(path), 2, len(data))], "path string, records long, bytes long")
    out = convert(files, revisits(scan_arc(files)), new_path(spark, "warc"))
    from lamella.llm.common import staged

    listed = staged(out, "warc-files")
    found = {f["WARC-Type"]: (f, b) for f, b in members(listed.first().path.removeprefix("file://"))}
    assert set(found) == {"warcinfo", "resource", "response"}
    fields, block = found["resource"]
    assert block == b"127.0.0.1" and fields["Content-Type"] == "text/dns" and fields["WARC-Date"] == "1999-01-02T03:04:05Z" and fields["WARC-Target-URI"] == "dns:example.org"
    assert found["warcinfo"][0]["WARC-Filename"] == "old.arc"
    got = {r.record_type: r for r in read_warc(listed).collect()}
    assert got["resource"].payload_bytes == 9 and got["response"].payload_bytes == 5


def test_hot_payload(spark, pages):
    """A payload of most rows: the pages' ids, whichever way its records are joined."""
    from lamella.llm.common import met

    rows = spark.createDataFrame([("a", k) for k in range(3000)] + [("b", k) for k in range(2)], "key string, v long")
    of = rows.groupBy("key").agg(F.max("v").alias("m"), F.count("*").alias("rows"))
    got = met(rows, of, "key", 3002)
    assert got.count() == 3002 and {(r.key, r.m) for r in got.select("key", "m").distinct().collect()} == {("a", 2999), ("b", 1)}


def test_cut_archive():
    from lamella.llm.warc import Stream, arc_line, arc_records, arc_version_block

    data = arc_version_block(2, "f.arc") + arc_line(2, "http://a", "2001", "text/html", 0, "f.arc", "-", 500) + b"short"
    with pytest.raises(ValueError):
        list(arc_records(Stream(io.BytesIO(data))))

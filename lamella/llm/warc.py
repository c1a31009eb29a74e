"""Conversion of legacy ARC archives to WARC.

An ARC file begins with a version block whose second line names the version and whose third lists the fields of the
header lines: five in version 1 (URL, IP address, date, type, length), ten in version 2 (and result code, checksum,
location, offset, file name). Each record is one header line, then as many bytes as the line declares, then a line feed.
The converter reads each file by its own version, takes the declared length as the only thing that ends a record, and
writes for each record a WARC one: the identifier is a name-based UUID of the file's title, offset, URL, date and payload digest
(a title has no random part, so reruns over the same partitions agree), the date is the 14-digit date in ISO form, the digests are
SHA-1 in base32. The version block becomes a warcinfo, content that begins with an HTTP status line a response, or a revisit for a
payload that another response has, anything else (dns, ftp) a resource of its own type. A revisit names its response by the
standard fields (WARC-Refers-To, its target URI and date), by which it is also found when the files are read. Files are
compressed, each record a gzip member of its own.

An archive file is the unit of work, bounded in bytes and records; a task takes files of TASK_BYTES together. Only a row of numbers
per record is shuffled, to find equal payloads; the decisions go back as one row for each file, and payloads are read from
the archives by the task that writes them out again. Equal payloads are first summed up by digest where they are read, and
digests that a thousandth of the records share (a thousand at most) are broadcast, so a payload that a third of the records
share is no large group anywhere. Which record is the response: the one with the largest page id (null below all
others; then the last by file and offset). Payloads below `least` bytes are all responses.

A null page id is written as none and comes back null; null html is an empty payload; a null URL is "-". White space in a URL is
percent-encoded, since header lines are split at spaces. Rows that are repeated are records of their own: one of them is
the response, the others revisit it. An empty table makes no archive and no row. Only page_id, url and html are read;
other columns, whatever their names, don't matter. Very long payloads are read and written as they are.

Each task writes files under names of its own, and lists them when it has succeeded: what a lost executor leaves is named
nowhere.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import discard, filesystem, met, new_path, small_batches, staged

#: A file is closed at so many bytes of content or records.
FILE_BYTES, FILE_RECORDS = 24 << 20, 8192
#: What a task reads at most, where there are enough files to keep all busy.
TASK_BYTES = 256 << 20
#: Rows are handed on so many at a time.
ROWS = 2048
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = b"\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Members:
    """Writes byte strings as gzip members, one after the other."""

    def __init__(self, out):
        self.out, self.at, self.size = out, 0, 0

    def add(self, *parts: bytes) -> int:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        begun = self.at
        for p in parts:
            self.at += self.out.write(z.compress(p))
            self.size += len(p)
        self.at += self.out.write(z.flush())
        return begun

    def close(self) -> None:
        self.out.close()


class Stream:
    """The decompressed content of a file of gzip members (or of a plain one), read as it is needed."""

    def __init__(self, file, block: int = 1 << 18):
        self.file, self.block, self.raw, self.buffer, self.z = file, block, b"", bytearray(), None
        self.at, self.plain, self.ended = 0, None, False

    def _more(self) -> None:
        data = self.raw or self.file.read(self.block)
        self.raw = b""
        if not data:
            self.ended = True
            return
        if self.plain is None:
            self.plain = data[:2] != b"\x1f\x8b"
        if self.plain:
            self.buffer += data
            return
        if self.z is None:
            self.z = zlib.decompressobj(31)
        self.buffer += self.z.decompress(data)
        if self.z.eof:
            self.raw, self.z = self.z.unused_data, None

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and not self.ended:
            self._more()
        if len(self.buffer) < n:
            raise ValueError(f"the archive ends {n - len(self.buffer)} bytes before a declared length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.at += n
        return out

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        looked = 0
        while (k := self.buffer.find(b"\n", looked)) < 0:
            looked = len(self.buffer)
            if self.ended:
                return None if not self.buffer else self.take(len(self.buffer))
            self._more()
        return self.take(k + 1).rstrip(b"\r\n")


# ---- ARC


def arc_version_block(version: int, name: str) -> bytes:
    """The first record of a file."""
    fields = ARC_FIELDS[version]
    body = f"{version} 0 lamella\n{fields}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 19960101000000 text/plain "
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"{head}{more}{len(body)}\n".encode() + body + b"\n"


def arc_line(version: int, url: str, date: str, kind: str, offset: int, name: str, payload_digest: str, length: int) -> bytes:
    more = "" if version == 1 else f"200 {payload_digest} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} {kind} {more}{length}\n".encode()


def arc_records(stream: Stream, info: bool = False) -> Iterator[dict]:
    """The records of an ARC file (with info, its version block first): the header's fields by name, offset, content and the kind of WARC record."""
    first = stream.line()
    if first is None:
        return
    if not first.startswith(b"filedesc:"):
        raise ValueError("an ARC file begins with filedesc:")
    content = stream.take(int(first.rsplit(b" ", 1)[1]))
    block = content.split(b"\n")
    version = int(block[0].split()[0])
    fields = block[1].decode().split()
    if fields != ARC_FIELDS.get(version, "").split():
        raise ValueError(f"version {version} has other fields: {fields}")
    parts = first.decode("utf-8", "replace").split(" ")
    if info:
        yield {"URL": parts[0], "IP-address": parts[1], "Archive-date": parts[2], "Content-type": parts[3], "offset": 0, "version": version, "content": content, "kind": "warcinfo"}
    stream.line()
    while True:
        offset = stream.at
        line = stream.line()
        if line is None:
            return
        if not line:
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if len(parts) > len(fields):  # old writers left spaces in the type; the last fields are counted from the end
            spare = len(parts) - len(fields)
            parts[3 : 4 + spare] = [" ".join(parts[3 : 4 + spare])]
        record = dict(zip(fields, parts, strict=True))
        content = stream.take(int(record["Archive-length"]))
        yield record | {"offset": offset, "version": version, "content": content, "kind": "response" if content.startswith(b"HTTP/") else "resource"}


def http_parts(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header block (with its empty line), its fields by lower-case name, body."""
    head, mark, body = content.partition(CRLF + CRLF)
    fields = {}
    for line in head.split(CRLF)[1:]:
        k, _, v = line.partition(b":")
        fields[k.decode("latin-1").strip().lower()] = v.decode("latin-1").strip()
    return head + mark, fields, body


def url_of(url: str | None) -> str:
    out = "".join(c if c > " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return out or "-"


class Rolling:
    """Files below a folder, closed at FILE_BYTES or FILE_RECORDS; `rows` lists those that are complete."""

    def __init__(self, folder: str, end: str, open_with=None):
        self.folder = folder
        self.system, self.root = filesystem(folder)
        self.system.create_dir(self.root, recursive=True)
        self.end, self.open_with, self.out, self.rows, self.seq = end, open_with, None, [], 0
        self.part = TaskContext.get().partitionId() if TaskContext.get() else 0

    def file(self) -> Members:
        if self.out is not None and (self.out.size >= FILE_BYTES or self.n >= FILE_RECORDS):
            self.close()
        if self.out is None:
            self.title = f"{self.part:06d}-{self.seq:04d}{self.end}"
            self.name = f"{self.part:06d}-{self.seq:04d}-{uuid.uuid4().hex}{self.end}"  # of its own for each attempt of a task
            self.out, self.n, self.seq = Members(self.system.open_output_stream(f"{self.root}/{self.name}", compression=None)), 0, self.seq + 1
            if self.open_with:
                self.out.add(self.open_with(self))
        self.n += 1
        return self.out

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((f"{self.folder}/{self.name}", self.n, self.out.size))
            self.out = None


def title_of(path: str) -> str:
    """The name of a file without what tells attempts of a task apart."""
    return re.sub(r"-[0-9a-f]{32}(?=\.)", "", path.rsplit("/", 1)[1])


def _listed(rows: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])


FILES = "path string, records long, bytes long"


def _each(files: DataFrame, of: DataFrame) -> DataFrame:
    """The list `files` dealt out, about TASK_BYTES a task, or fewer where cores would have none; `of` lists the same files with their bytes."""
    n, size = of.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    spread = 2 * files.sparkSession.sparkContext.defaultParallelism
    return files.repartitionByRange(max(1, min(n, spread), -(-size // TASK_BYTES)), "path")


def write_arc(pages: DataFrame, folder: str, date: str = "20050101000000", type_: str = "text/html") -> DataFrame:
    """A legacy archive of pages(page_id, url, html): files of version 1 and 2 by turns. Returns the list of files."""

    def write(batches):
        files = Rolling(folder, ".arc.gz")
        files.open_with = lambda r: arc_version_block(1 + r.seq % 2, r.title)
        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url"), batch.column("html").cast(pa.large_binary()), strict=True):
                body = html.as_py() or b""
                named = b"" if page is None else f"X-Page-Id: {page}\r\n".encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: {type_}; charset=utf-8\r\nContent-Length: {len(body)}\r\n".encode() + named + CRLF
                out = files.file()
                version = 1 + files.seq % 2
                checksum = "-" if version == 1 else digest(body)
                out.add(arc_line(version, url_of(url.as_py()), date, type_, out.at, files.title, checksum, len(head) + len(body)), head, body, b"\n")
        files.close()
        yield from _listed(files.rows)

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(write, FILES)


_SCAN = "path string, offset long, page_id long, payload_bytes long, payload_digest string, url string, date string"


def _typed(schema: str) -> tuple[list[str], list[pa.DataType]]:
    columns = [x.strip().split(" ") for x in schema.split(",")]
    return [c for c, _ in columns], [{"long": pa.int64(), "string": pa.string()}[t] for _, t in columns]


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names, types = _typed(schema)
    while held := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def scan_arc(files: DataFrame) -> DataFrame:
    """path, offset, page_id, payload_bytes, payload_digest, url and date of every HTTP response in the listed ARC files."""

    def rows(path):
        system, place = filesystem(path)
        with system.open_input_stream(place, compression=None) as f:
            for r in arc_records(Stream(f)):
                if r["kind"] == "response":
                    _, fields, body = http_parts(r["content"])
                    page = fields.get("x-page-id")
                    yield path, r["offset"], None if page is None else int(page), len(body), digest(body), r["URL"], r["Archive-date"]

    def scan(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _batches(rows(path), _SCAN)

    return _each(files.select("path"), files).mapInArrow(scan, _SCAN)


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """One row for each file that has revisits: path, and an array of the offset of each and of the path, offset, URL and date of its response."""
    place = F.struct("page_id", "path", "offset", "url", "date")  # a null id is the least
    enough = records.filter(F.col("payload_bytes") >= least)
    of = enough.groupBy("payload_digest").agg(F.max(place).alias("response"), F.count("*").alias("rows")).filter("rows > 1")
    hits = met(enough, of, "payload_digest", enough.count()).filter(~((F.col("path") == F.col("response.path")) & (F.col("offset") == F.col("response.offset"))))
    one = F.struct("offset", *(F.col(f"response.{c}").alias(f"of_{c}") for c in ("path", "offset", "url", "date")))
    return hits.groupBy("path").agg(F.collect_list(one).alias("revisits"))


def record_id(title: str, offset: int, url: str, date: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{title}#{offset}#{url}#{date}#{payload_digest}')}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: dict, title: str, of: dict | None) -> tuple[bytes, ...]:
    """A record of the ARC file of this title as parts of a WARC record; of: the response that it revisits."""
    content, url, date = r["content"], r["URL"], r["Archive-date"]
    head, fields, body = http_parts(content) if r["kind"] == "response" else (b"", {}, content)
    kind = "revisit" if of else r["kind"]
    block = (head,) if of else (head, body)
    payload = digest(body)
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(title, r["offset"], url, date, payload)),
        ("WARC-Date", warc_date(date)),
        ("WARC-Block-Digest", f"sha1:{digest(b''.join(block))}"),
        ("Content-Type", "application/http; msgtype=response" if r["kind"] == "response" else r["Content-type"]),
        ("X-Arc-Version", str(r["version"])),
    ]
    if kind == "warcinfo":
        lines.append(("WARC-Filename", url.removeprefix("filedesc://")))
    else:
        lines += [("WARC-Target-URI", url), ("WARC-IP-Address", r["IP-address"]), ("WARC-Payload-Digest", f"sha1:{payload}"), ("X-Payload-Length", str(len(body)))]
    if "x-page-id" in fields:
        lines.append(("X-Page-Id", fields["x-page-id"]))
    if of:
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(title_of(of["of_path"]), of["of_offset"], of["of_url"], of["of_date"], payload)),
            ("WARC-Refers-To-Target-URI", of["of_url"]),
            ("WARC-Refers-To-Date", warc_date(of["of_date"])),
        ]
    lines.append(("Content-Length", str(sum(map(len, block)))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + CRLF, *block, CRLF + CRLF


def convert(files: DataFrame, decisions: DataFrame, folder: str) -> DataFrame:
    """Write the records of the listed ARC files as WARC; decisions as revisits() gives them. Returns the list of files."""

    def write(batches):
        out = Rolling(folder, ".warc.gz")
        for batch in batches:
            for path, found in zip(batch.column("path").to_pylist(), batch.column("revisits").to_pylist(), strict=True):
                of = {x["offset"]: x for x in found or ()}
                system, place = filesystem(path)
                with system.open_input_stream(place, compression=None) as f:
                    for r in arc_records(Stream(f), info=True):
                        out.file().add(*warc_record(r, title_of(path), of.get(r["offset"]) if r["kind"] == "response" else None))
        out.close()
        yield from _listed(out.rows)

    return _each(files.select("path").join(decisions, "path", "left"), files).mapInArrow(write, FILES)


def warc_records(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (by lower-case name) and block of each record of a WARC file."""
    while True:
        line = stream.line()
        if line is None:
            return
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        fields = {}
        while line := stream.line():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.take(int(fields["content-length"]))


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, of_record string, url string, warc_date string"


def read_records(files: DataFrame) -> DataFrame:
    """_READ of the responses, revisits and resources in the listed WARC files; of_record: the id of what is revisited. The digest and length
    of a payload are computed from it and must be those that its header declares."""

    def rows(path):
        system, place = filesystem(path)
        with system.open_input_stream(place, compression=None) as f:
            for h, block in warc_records(Stream(f)):
                kind = h["warc-type"]
                if kind not in ("response", "revisit", "resource"):
                    continue
                length, named = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                if kind != "revisit":
                    body = http_parts(block)[2] if kind == "response" else block
                    if (len(body), digest(body)) != (length, named):
                        raise ValueError(f"{path}: {h['warc-record-id']} doesn't hold what it declares")
                page = h.get("x-page-id")
                yield None if page is None else int(page), length, named, kind, h["warc-record-id"], h.get("warc-refers-to"), h["warc-target-uri"], h["warc-date"]

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _batches(rows(path), _READ)

    return _each(files.select("path"), files).mapInArrow(read, _READ)


def read_warc(files: DataFrame) -> DataFrame:
    """read_records() with refers_to: the page id of the record that a revisit names."""
    records = staged(read_records(files), "warc-records")
    wanted = records.filter("of_record is not null").groupBy("of_record").agg(F.count("*").alias("rows"))
    of = wanted.join(records.select(F.col("record_id").alias("of_record"), F.col("page_id").alias("refers_to")), "of_record")
    revisit = records.filter("of_record is not null")
    found = met(revisit, of, "of_record", records.count())
    columns = [F.col(c) for c in records.columns]
    return found.select(*columns, "refers_to").unionByName(records.filter("of_record is null").select(*columns, F.lit(None).cast("long").alias("refers_to")))


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to a legacy ARC archive, that to WARC, and what is read from the WARC files. The archives stay; the tables of the steps between go."""
    spark = pages.sparkSession
    arcs = staged(write_arc(pages, new_path(spark, "arc")), "arc-files")
    records = staged(scan_arc(arcs), "arc-records")
    decisions = staged(revisits(records, least), "arc-revisits")
    warcs = staged(convert(arcs, decisions, new_path(spark, "warc")), "warc-files")
    discard(records, decisions)
    return read_warc(warcs)

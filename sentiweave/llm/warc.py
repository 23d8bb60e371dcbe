"""WARC records inside of ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file with stored (not deflated) members: archives below ``archive/``,
whose records are gzip members of their own, and indexes below ``indexes/``, one line with
archive, offset and length for each record. The writer here makes one of each; the reader
takes as many as the directory lists, under whatever names. Because the members are stored, a
byte of a member is a byte of the file: the reader fetches the end of a file, walks the central
directory (the ZIP64 one, too), finds the members' places and then fetches ranges of records.

Files are opened through Arrow's file systems by the URI of the shared folder, so the tasks
of any executor reach them.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_A_TIME, cut_lineage, shared_folder, table

#: Payloads below this size are always written in full.
REVISIT_BYTES = 100
#: A package is closed once its records take so many bytes.
PACKAGE_BYTES = 16 << 20
#: Neighbouring records are fetched together up to so many bytes.
FETCH_BYTES = 2 << 20

ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX = f"{ARCHIVES}data.warc.gz", f"{INDEXES}index.cdxj"
_TOO_LARGE_16, _TOO_LARGE_32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """Where a member's local header is, and what the central directory says of it."""

    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def zip_package(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """Stored members one after the other; ``zip64`` writes all sizes in ZIP64 fields."""
    out, central = [], []
    at = 0
    for name, data in members:
        if not zip64 and max(len(data), at) >= _TOO_LARGE_32:
            raise ValueError("sizes over 4 GB need ZIP64 fields")
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        short = _TOO_LARGE_32 if zip64 else size
        version = 45 if zip64 else 20
        sizes = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
        local = struct.pack(
            "<IHHHHHIIIHH", 0x04034B50, version, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(sizes)
        )
        out += [local, raw, sizes, data]
        sizes_place = struct.pack("<HHQQQ", 1, 24, size, size, at) if zip64 else b""
        central.append(
            struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, version, version, 0x800, 0, 0, 0x21, crc, short, short,
                        len(raw), len(sizes_place), 0, 0, 0, 0, _TOO_LARGE_32 if zip64 else at)
            + raw + sizes_place
        )
        at += len(local) + len(raw) + len(sizes) + size
    directory = b"".join(central)
    count = len(members)
    end = b""
    if zip64:
        end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(directory), at)
        end += struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    short = (_TOO_LARGE_16, _TOO_LARGE_16, _TOO_LARGE_32, _TOO_LARGE_32) if zip64 else (count, count, len(directory), at)
    end += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, *short, 0)
    return b"".join([*out, directory, end])


class RangeReader:
    """A file of which only ranges are read."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def get(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise EOFError(f"{length} bytes wanted at {start}, {len(data)} there")
        return data

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def central_directory(file: RangeReader) -> dict[str, Member]:
    """All members by name, from the end of the file; a comment behind it is allowed."""
    length = min(file.size, 22 + 0xFFFF + 20)
    tail = file.get(file.size - length, length)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, size, start = struct.unpack_from("<HHHHII", tail, end + 4)
    place = file.size - length + end
    if _TOO_LARGE_16 == count or _TOO_LARGE_32 in (size, start):
        locator = file.get(place - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = file.get(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    data = file.get(start, size)
    members, at = {}, 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, _, _, crc, packed, full = struct.unpack_from("<HHHIII", data, at + 10)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode()
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        full, packed, header = _zip64_sizes(extra, full, packed, header)
        members[name] = Member(name, method, crc, packed, full, header)
        at += 46 + n_name + n_extra + n_comment
    return members


def _zip64_sizes(extra: bytes, *fields: int) -> tuple[int, ...]:
    """The fields that are too large for 32 bits stand, in this order, in extra field 1."""
    at, found = 0, b""
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            found = extra[at + 4 : at + 4 + length]
        at += 4 + length
    out, at = [], 0
    for value in fields:
        if value == _TOO_LARGE_32:
            value = struct.unpack_from("<Q", found, at)[0]
            at += 8
        out.append(value)
    return tuple(out)


def stored_start(file: RangeReader, member: Member) -> int:
    """Place of a stored member's first byte, which its local header tells."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    header = file.get(member.header, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record that has the payload's digest and size alone."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + payload if refers_to is None else http
    name = "null" if page is None else str(page)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head.insert(4, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type,
    refers_to of a record; a response's size and digest are those of what it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    page = lambda x: None if x in (None, "<urn:page:null>") else int(x[10:-1])
    out = {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload": None,
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields.get("WARC-Refers-To")),
    }
    if out["record_type"] == "response":
        out["payload"] = body.partition(b"\r\n\r\n")[2]
        digest = hashlib.sha256(out["payload"]).hexdigest()
        if (len(out["payload"]), digest) != (out["payload_bytes"], out["payload_digest"]):
            raise ValueError(f"record of page {out['page_id']} is damaged")
    return out


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the page whose equal payload was kept, if any."""
    pages = pages.select("page_id", "url", "html")
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = pages.select("page_id", F.sha2(data, 256).alias("digest"), F.octet_length(data).alias("size")).where(
        F.col("size") >= REVISIT_BYTES
    )
    # Of one digest a task sends one row here, however many pages have it.
    repeated = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    refers = (
        digests.join(repeated, "digest")
        .where("page_id <> first")
        .groupBy(F.col("page_id").alias("_page_id"))
        .agg(F.min("first").alias("refers_to"))
    )
    return pages.join(refers, pages["page_id"] == refers["_page_id"], "left").select(
        pages["page_id"], pages["url"], pages["html"], "refers_to"
    )


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for each row of :func:`with_originals`; uri and n_records per package.

    A task closes a package at ``package_bytes`` and goes on with the next. Names are new
    for each attempt, so a task that is run again leaves others' files alone; the returned
    rows name the packages that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, lines, at = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                for row in batch.slice(start, ROWS_AT_A_TIME).to_pylist():
                    payload = (row["html"] or "").encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    raw = warc_record(row["page_id"], row["url"], payload, digest, row["refers_to"])
                    record = gzip.compress(raw, 1, mtime=0)
                    place = {"filename": DATA.removeprefix(ARCHIVES), "offset": at, "length": len(record)}
                    lines.append(json.dumps({"page": row["page_id"]} | place))
                    records.append(record)
                    at += len(record)
                    if at >= package_bytes:
                        yield close(records, lines)
                        records, lines, at = [], [], 0
        if records:
            yield close(records, lines)

    def close(records: list[bytes], lines: list[str]) -> pa.RecordBatch:
        data = zip_package([(DATA, b"".join(records)), (INDEX, "\n".join(lines).encode())])
        uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = pafs.FileSystem.from_uri(uri)
        with system.open_output_stream(path) as out:
            out.write(data)
        return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(records)], pa.int64())], ["uri", "n_records"])

    # Written once: later reads take the list of packages from the shared folder.
    return cut_lineage(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "uri string, n_records long"))


READ_SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def read_packages(packages: DataFrame, payload: bool = True) -> DataFrame:
    """The records of all packages in column ``uri``; without ``payload`` that column is null."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with RangeReader(uri) as file:
                    for rows in _records(file):
                        if not payload:
                            rows = [r | {"payload": None} for r in rows]
                        yield pa.RecordBatch.from_pylist(rows, schema)

    count = max(1, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return packages.select("uri").repartition(count, "uri").mapInArrow(run, READ_SCHEMA)


def record_places(file: RangeReader) -> dict[str, list[tuple[int, int]]]:
    """Offset and length of every record of each archive member, as the indexes list them.

    A line of an index is JSON, alone or (as in CDXJ) behind a key and a time; it names its
    archive, unless there is only one. An archive without lines, or lines without their
    archive, are an error: some records would be left out.
    """
    members = central_directory(file)
    places: dict[str, list[tuple[int, int]]] = {
        name: [] for name in members if name.startswith(ARCHIVES) and name != ARCHIVES
    }
    for name, member in members.items():
        if not name.startswith(INDEXES) or name == INDEXES:
            continue
        for line in file.get(stored_start(file, member), member.size).decode().split("\n"):
            if "{" not in line:
                continue
            entry = json.loads(line[line.index("{") :])
            only = next(iter(places)).removeprefix(ARCHIVES) if len(places) == 1 else None
            archive = ARCHIVES + str(entry.get("filename", only))
            if archive not in places:
                raise ValueError(f"{name} lists records of {archive}, which isn't there")
            places[archive].append((int(entry["offset"]), int(entry["length"])))
    if without := [name for name, own in places.items() if not own and members[name].size]:
        raise ValueError(f"no index lists the records of {', '.join(without)}")
    return {name: sorted(set(own)) for name, own in places.items()}


def _records(file: RangeReader) -> Iterator[list[dict]]:
    members = central_directory(file)
    for name, places in record_places(file).items():
        start = stored_start(file, members[name])
        group: list[tuple[int, int]] = []
        for offset, length in [*places, (None, 0)]:
            joins = group and offset == group[-1][0] + group[-1][1]
            if group and not (joins and offset + length - group[0][0] <= FETCH_BYTES and len(group) < ROWS_AT_A_TIME):
                first = group[0][0]
                data = file.get(start + first, sum(n for _, n in group))
                yield [parse_record(gzip.decompress(data[o - first : o - first + n])) for o, n in group]
                group = []
            group.append((offset, length))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages into packages in the shared folder; the packages' uri and n_records.

    pages: page_id, url, html. A null html is an empty payload. Of equal payloads of at
    least REVISIT_BYTES bytes the smallest page_id's is kept in full and the others refer to
    it. Repeated rows of a page are written each; those of the kept page are responses all.
    A page without page_id is always written in full.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}"
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return write_packages(with_originals(pages), folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = archive_pages(table(spark, sf_dir, "pages"))
    return read_packages(packages, payload=False).drop("url", "payload")


OP9_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)
"""

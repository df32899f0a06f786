"""WARC records in ZIP packages: writing them, and reading records by ranges without extraction.

A package written here holds stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member for each record,
``indexes/index.cdxj``, a sorted line for each record (key of the url, time, and its place in the archive member), and with ``describe`` a
``datapackage.json`` with the sizes and SHA-256 digests of these.

*Writing.* Of pages with equal payloads of ``revisit_bytes`` or more, that with the largest id becomes a
response record and the others revisit records without a payload. The groups are found from digests; the pages
themselves are shuffled only if there are more than ``broadcast_groups`` groups with copies, by a plain join that adaptive
execution splits at a hot digest. Each task
streams its pages into packages of about ``package_bytes`` under fresh names and returns one manifest row for
each package it closed. A package is part of the result only if the manifest names it, so a task that
failed or ran twice leaves a file, but no record twice.

*Reading.* The end of a package gives the central directory, by way of the ZIP64 directory where sizes or
counts ask for it. It locates the members; the indexes, each read as one range, give the records' places.
Ranges of about ``range_bytes`` are then dealt to tasks, each read with one request. Packages of other writers are read too: any
stored ``archive/*.warc`` or ``.warc.gz`` with any ``indexes/*.cdx`` or ``.cdxj``, gzipped or not, in any order and with records that
the index leaves out. Names of header fields match in any case, chunked bodies are put together, SHA-1 digests may be in hex or base 32 and stand for the
body as it was sent or as it was put together; a record without one is taken as it is. Records that are no response or
revisit (``warcinfo``, ``request``, ``resource``, ...) come with their type, and their block as payload. Packages whose archives or indexes
are compressed by the ZIP or encrypted, and records that are cut off or whose digest is wrong, raise with the package's path.

Memory is bounded by a package's index, a range and the longest record. Packages are opened with Arrow's file
systems, in the tasks, so any store that these reach will do.

A null payload is the empty one. Pages without an id are written and read back without one: they revisit the
largest id of their group, and if none has an id, all are responses. Rows that repeat the largest id are all
responses. A null url is left out of the record; characters that a header cannot hold come back percent-encoded. An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import need_columns, record_batch, slices, to_arrow
from tableflow.sources.scratch import written

DATA, INDEX, DESCRIPTION = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
REVISIT_BYTES = 1000
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Bytes between two records that are read in vain rather than by a request of their own.
GAP_BYTES = 64 << 10
BROADCAST_GROUPS = 200_000
ID_URN = "urn:tableflow:record:"

MANIFEST = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())]
)
RANGES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to_record", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


# Writing --------------------------------------------------------------------------------------


def with_record_types(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_bytes: int, broadcast_groups: int
) -> DataFrame:
    """(id, url, payload, digest, leader): the id of the response that a page revisits, else null."""
    need_columns(pages, id_col, url_col, payload_col)
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    groups = (
        rows.where(large)
        .groupBy("digest")
        .agg(F.max("id").alias("leader"), F.count("*").alias("n"))
        .where("n > 1 AND leader IS NOT NULL")
        .select(F.col("digest").alias("shared"), "leader")
    )
    groups, _ = written(groups, "groups")
    if groups.count() <= broadcast_groups:
        groups = F.broadcast(groups)
    joined = rows.join(groups, (F.col("digest") == F.col("shared")) & large, "left")
    leader = F.when(~F.col("id").eqNullSafe(F.col("leader")), F.col("leader"))
    return joined.select("id", "url", "payload", "digest", leader.alias("leader"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, leader: int | None, date: str) -> bytes:
    name = f"{ID_URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = [
        ("WARC-Type", "response" if leader is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|<>\"{}^`\\")))
    if leader is not None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<{ID_URN}{leader}>"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = block.encode() + (payload if leader is None else b"")
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def url_key(url: str | None) -> str:
    """The sort key of a url in an index: the host's parts from the last on, then path and query; ``-`` for what has no host."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname, parts.port
    except ValueError:  # no url
        return "-"
    if not host:
        return "-"
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return quote(f"{key}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower(), safe="%/:=&?~#+!$,;'@()*[]|")


class _Package:
    """A package being written to a stream."""

    def __init__(self, folder: str, date: str, describe: bool) -> None:
        self.date, self.describe = date, describe
        self.path = f"{folder.rstrip('/')}/pages-{uuid.uuid4().hex}.wacz"
        fs, name = _open_fs(self.path)
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.stream = fs.open_output_stream(name)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0
        self.hash = hashlib.sha256()

    def add(self, record: bytes, url: str | None, digest: str, kind: str) -> None:
        self.member.write(record)
        if self.describe:
            self.hash.update(record)
        place = {"filename": DATA.rsplit("/", 1)[1], "offset": self.size, "length": len(record)}
        entry = {"url": url or "", "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": 200, "digest": f"sha1:{digest}", **place}
        time = re.sub(r"\D", "", self.date)
        self.index.append(f"{url_key(url)} {time} {json.dumps(entry)}")
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = "".join(f"{line}\n" for line in sorted(self.index)).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        if self.describe:
            parts = [(DATA, self.hash.hexdigest(), self.size), (INDEX, hashlib.sha256(index).hexdigest(), len(index))]
            resources = [{"name": path.rsplit("/", 1)[1], "path": path, "hash": f"sha256:{digest}", "bytes": size} for path, digest, size in parts]
            described = {"profile": "data-package", "wacz_version": "1.1.1", "created": self.date, "resources": resources}
            self.zip.writestr(zipfile.ZipInfo(DESCRIPTION), json.dumps(described, indent=2))
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return self.path, size, len(self.index)


def write_packages(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    package_bytes: int = PACKAGE_BYTES,
    broadcast_groups: int = BROADCAST_GROUPS,
    describe: bool = False,
) -> DataFrame:
    """Write packages below ``folder``, a path that all executors share, and return the manifest.

    The manifest's rows say what was written when it was computed: store it before reading it twice.
    """
    schema = to_arrow(MANIFEST)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for columns in slices(batches, 64):
            for page_id, url, payload, digest, leader in zip(*columns, strict=True):
                package = package or _Package(folder, date, describe)
                kind = "response" if leader is None else "revisit"
                package.add(_record(page_id, url, payload, digest, leader, date), url, digest, kind)
                if package.size >= package_bytes:
                    yield record_batch([[x] for x in package.close()], schema)
                    package = None
        if package:
            yield record_batch([[x] for x in package.close()], schema)

    rows = with_record_types(pages, id_col, url_col, payload_col, revisit_bytes, broadcast_groups)
    return rows.mapInArrow(run, MANIFEST)


# Reading --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """A stored member: where its bytes begin in the package, and how many there are."""

    start: int
    size: int


def read_directory(file: pa.NativeFile) -> dict[str, Member]:
    """The stored members of a ZIP file, from its central directory; ZIP64 records are followed."""
    size = file.size()
    tail_size = min(size, 22 + 65_535 + 20)
    tail = file.read_at(tail_size, size - tail_size)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("No end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (place,) = struct.unpack_from("<Q", tail, end - 12)
        wide = file.read_at(56, place)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("No ZIP64 end of central directory where its locator points")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    directory = file.read_at(length, start)
    members, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("Broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, packed, local = _widened(extra, plain, packed, local)
        at += 46 + n_name + n_extra + n_comment
        if method == 0 and not flags & 1 and packed == plain:
            head = file.read_at(30, local)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"No member where the directory places {name}")
            n_name, n_extra = struct.unpack_from("<HH", head, 26)
            members[name] = Member(local + 30 + n_name + n_extra, plain)
    return members


def _widened(extra: bytes, *values: int) -> list[int]:
    """The values, with 64-bit ones from the ZIP64 extra field in place of 0xFFFFFFFF."""
    wide, at = [], 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
        at += 4 + size
    out = []
    for value in values:
        if value == 0xFFFFFFFF:
            if not wide:
                raise ValueError("A ZIP64 size is missing")
            value = wide.pop(0)
        out.append(value)
    return out


def _places(file: pa.NativeFile) -> list[tuple[int, int]]:
    """Start in the package and length of every record that the indexes name, in order."""
    members = read_directory(file)
    archives = {name: m for name, m in members.items() if re.fullmatch(r"archive/.+\.warc(\.gz)?", name)}
    indexes = [m for name, m in sorted(members.items()) if re.fullmatch(r"indexes/.+\.cdxj?(\.gz)?", name)]
    if not archives or not indexes:
        raise ValueError("Stored archive or index is missing")
    places = set()
    for index in indexes:
        text = file.read_at(index.size, index.start)
        lines = (gzip.decompress(text) if text[:2] == b"\x1f\x8b" else text).decode().splitlines()
        for line in lines:
            if line.startswith("!") or "{" not in line:  # a header line of the index, or a blank one
                continue
            entry = json.loads(line[line.index("{") :])
            offset, length = int(entry["offset"]), int(entry["length"])
            archive = archives.get(f"archive/{entry['filename']}") if "filename" in entry else next(iter(archives.values()))
            if archive is None or ("filename" not in entry and len(archives) > 1) or offset < 0 or offset + length > archive.size:
                raise ValueError("The index does not match the archive")
            places.add((archive.start + offset, length))
    return sorted(places)


def _ranges(path: str, range_bytes: int) -> Iterator[tuple[str, int, list[int], list[int]]]:
    """What to read at once: the first byte, and where records start after it and how long they are."""
    fs, name = _open_fs(path)
    with fs.open_input_file(name) as file:
        places = _places(file)
    first, end, starts, lengths = 0, 0, [], []
    for start, length in places:
        if lengths and (start - end > GAP_BYTES or start + length - first > range_bytes):
            yield path, first, starts, lengths
            starts, lengths = [], []
        if not lengths:
            first = start
        starts.append(start - first)
        lengths.append(length)
        end = start + length
    if lengths:
        yield path, first, starts, lengths


def _head(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, fields by names in lower case, and what follows the blank line. A field may go on in lines that begin with blanks."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    fields = (line.partition(":") for line in lines)
    return first, {name.strip().lower(): value.strip() for name, _, value in fields}, rest


def _unchunked(body: bytes) -> bytes | None:
    """The chunks of a body put together; None if it isn't made of chunks up to the last."""
    out, at = [], 0
    while (line := re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(;[^\r\n]*)?\r\n").match(body, at)) is not None:
        size = int(line[1], 16)
        if size == 0:
            return b"".join(out)
        chunk = body[line.end() : line.end() + size]
        if len(chunk) < size or body[line.end() + size : line.end() + size + 2] != b"\r\n":
            return None
        out.append(chunk)
        at = line.end() + size + 2
    return None


def _sha1(data: bytes) -> str:
    return hashlib.sha1(data, usedforsecurity=False).hexdigest()


def _named_digest(field: str | None) -> str | None:
    """A SHA-1 digest as lower-case hex, whichever way it is written; None if there is none."""
    algorithm, _, value = (field or "").partition(":")
    if algorithm.lower().replace("-", "") != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def parse_record(packed: bytes) -> tuple:
    """The values of ``RECORDS`` for one record, a gzip member or plain; the payload of a revisit is null."""
    data = gzip.decompress(packed) if packed[:2] == b"\x1f\x8b" else packed
    version, fields, rest = _head(data)
    if not version.startswith("WARC/"):
        raise ValueError("Not a WARC record")
    kind, length = fields["warc-type"], int(fields["content-length"])
    body = payload = rest[:length]
    if len(body) < length:
        raise ValueError("A record is cut off")
    size, sent = None, None
    if kind in ("response", "revisit") and fields.get("content-type", "").lower().startswith("application/http"):
        _, http, payload = _head(body)
        sent = payload
        if "chunked" in http.get("transfer-encoding", "").lower() and (whole := _unchunked(payload)) is not None:
            payload = whole
        if kind == "revisit" and http.get("content-length", "").isdecimal():
            size = int(http["content-length"])
    digest = _named_digest(fields.get("warc-payload-digest"))
    if kind != "revisit":
        size, own = len(payload), _sha1(payload)
        if digest not in (None, own) and (sent is None or _sha1(sent) != digest):
            raise ValueError("A payload does not match its digest")
        digest = own
    refers = fields.get("warc-refers-to")
    return (
        _page_id(fields.get("warc-record-id", "")),
        fields.get("warc-target-uri"),
        size,
        digest,
        kind,
        _page_id(refers) if refers else None,
        fields.get("warc-record-id"),
        refers,
        payload if kind != "revisit" else None,
    )


def _page_id(urn: str) -> int | None:
    found = re.fullmatch(f"<{ID_URN}(-?[0-9]+)>", urn)
    return int(found[1]) if found else None


def read_packages(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """One row of ``RECORDS`` for each record of the packages that ``manifest`` names in ``path``."""
    ranges_schema, records_schema = to_arrow(RANGES), to_arrow(RECORDS)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    found = list(_ranges(path, range_bytes))
                except Exception as error:
                    raise ValueError(f"{path}: {error}") from error
                if found:
                    yield record_batch(list(zip(*found, strict=True)), ranges_schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in slices(batches, 16):
            for path, offset, starts, lengths in zip(*columns, strict=True):
                try:
                    fs, name = _open_fs(path)
                    with fs.open_input_file(name) as file:
                        data = file.read_at(starts[-1] + lengths[-1], offset)
                    rows = [parse_record(data[at : at + length]) for at, length in zip(starts, lengths, strict=True)]
                except Exception as error:
                    raise ValueError(f"{path} at {offset}: {error}") from error
                if not with_payload:
                    rows = [(*row[:-1], None) for row in rows]
                yield record_batch(list(zip(*rows, strict=True)), records_schema)

    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packages = manifest.select("path").repartition(partitions)
    ranges = packages.mapInArrow(locate, RANGES).repartition(partitions)
    return ranges.mapInArrow(read, RECORDS)

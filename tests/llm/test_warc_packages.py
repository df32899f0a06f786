"""Packages that other writers made, and what describes our own."""

import base64
import gzip
import hashlib
import json
import zipfile

import pytest

from tableflow.llm.warc_zip import DATA, DESCRIPTION, INDEX, parse_record, read_packages, url_key, write_packages


def sha1(data):
    return hashlib.sha1(data).digest()


def record(kind, block, content_type="application/http; msgtype=response", crlf_fields="", **fields):
    names = {k.replace("_", "-"): v for k, v in fields.items()}
    lines = [f"WARC-Type: {kind}", f"Content-Type: {content_type}", f"content-length: {len(block)}", *(f"{k}: {v}" for k, v in names.items())]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + crlf_fields + "\r\n\r\n").encode() + block + b"\r\n\r\n"


CHUNKED = b"HTTP/1.1 200 OK\r\ntransfer-ENCODING: Chunked\r\n\r\n"
CHUNKS = b"5;x=1\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"


def foreign(path, records, compress=True, gap=b"", filename="rec-0.warc.gz", index="indexes/index.cdxj", reverse=False, quoted=True):
    """A package with one archive and an index of the records that have a key."""
    data, lines = b"", []
    for key, raw in records:
        packed = gzip.compress(raw) if compress else raw
        if key:
            place = {"offset": len(data), "length": len(packed)}
            entry = {"url": key, "filename": filename, **({k: str(v) for k, v in place.items()} if quoted else place)}
            lines.append(f"{key} 20240102030405 {json.dumps(entry)}")
        data += packed + gap
    text = "\n".join(["!meta 0 {}", *(reversed(lines) if reverse else lines), ""]).encode()
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("datapackage.json", "{}", compress_type=zipfile.ZIP_DEFLATED)
        package.writestr(index, gzip.compress(text) if index.endswith(".gz") else text)
        package.writestr(f"archive/{filename}", data)
    return str(path)


def read(spark, *paths, **more):
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    return read_packages(frame, with_payload=True, **more).collect()


RECORDS = [
    ("", record("warcinfo", b"software: x\r\n", "application/warc-fields")),
    ("org,a)/", record("response", b"HTTP/1.1 200 OK\r\ncontent-length: 3\r\nX: a\r\n b\r\n\r\nabc", WARC_Record_ID="<urn:uuid:1>",
                       WARC_Target_URI="http://a.org/", WARC_Payload_Digest="sha1:" + base64.b32encode(sha1(b"abc")).decode())),
    ("org,b)/", record("response", CHUNKED + CHUNKS, WARC_Record_ID="<urn:uuid:2>", WARC_Payload_Digest="SHA-1:" + sha1(b"hello world").hex().upper())),
    ("org,c)/", record("response", CHUNKED + CHUNKS, warc_payload_digest="sha1:" + sha1(CHUNKS).hex())),
    ("org,d)/", record("response", CHUNKED + b"already whole")),
    ("org,e)/", record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest="sha1:" + sha1(b"abc").hex())),
    ("org,f)/", record("request", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request")),
    ("org,g)/", record("resource", b"plain", "text/plain", WARC_Payload_Digest="md5:0")),
    ("org,h)/", record("response", b"HTTP/1.1 204 No Content\r\n\r\n")),
]
EXPECTED = [
    ("response", 3, b"abc", "<urn:uuid:1>"),
    ("response", 11, b"hello world", "<urn:uuid:2>"),
    ("response", 11, b"hello world", None),
    ("response", 13, b"already whole", None),
    ("revisit", None, None, None),
    ("request", 18, b"GET / HTTP/1.1\r\n\r\n", None),
    ("resource", 5, b"plain", None),
    ("response", 0, b"", None),
]


@pytest.mark.parametrize(
    "shape",
    [
        {},
        {"compress": False, "filename": "rec.warc", "quoted": False},
        {"index": "indexes/index.cdx.gz", "reverse": True},
        {"compress": False, "filename": "rec.warc", "gap": b"\0" * 70_000},
    ],
)
def test_packages_of_other_writers(spark, tmp_path, shape):
    got = read(spark, foreign(tmp_path / "x.wacz", RECORDS, **shape), range_bytes=400)
    found = sorted(((r["record_type"], r["payload_bytes"], r["payload"] and bytes(r["payload"]), r["record_id"]) for r in got), key=str)
    assert [(k, s, b if s else (b"" if s == 0 else None), i) for k, s, b, i in found] == sorted(EXPECTED, key=str)
    digests = {r["record_id"]: r["payload_digest"] for r in got if r["record_id"]}
    assert digests == {"<urn:uuid:1>": sha1(b"abc").hex(), "<urn:uuid:2>": sha1(b"hello world").hex()}
    (revisit,) = [r for r in got if r["record_type"] == "revisit"]
    assert (revisit["refers_to_record"], revisit["refers_to"], revisit["payload_digest"]) == ("<urn:uuid:1>", None, sha1(b"abc").hex())
    assert all(r["page_id"] is None for r in got)


def test_wrong_digests_and_cut_records_raise(spark, tmp_path):
    wrong = record("response", b"HTTP/1.1 200 OK\r\n\r\nabc", WARC_Payload_Digest="sha1:" + sha1(b"abd").hex())
    with pytest.raises(ValueError, match="digest"):
        parse_record(wrong)
    with pytest.raises(ValueError, match="cut off"):
        parse_record(RECORDS[1][1][:-10])
    path = foreign(tmp_path / "wrong.wacz", [("org,a)/", wrong)])
    with pytest.raises(Exception, match="wrong.wacz"):
        read(spark, path)


def test_index_that_names_another_archive_raises(spark, tmp_path):
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("archive/a.warc.gz", gzip.compress(RECORDS[1][1]))
        package.writestr("indexes/index.cdxj", 'k 2024 {"offset": 0, "length": 10, "filename": "b.warc.gz"}\n')
    with pytest.raises(Exception, match="does not match the archive"):
        read(spark, str(path))


def test_own_packages_are_described_and_sorted(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://b.org/x?q=1", "b"), (2, "https://www.a.org:8080/Y", "a"), (3, None, None)], "page_id long, url string, html string")
    manifest = write_packages(pages.coalesce(1), str(tmp_path / "pk"), describe=True).collect()
    with zipfile.ZipFile(manifest[0]["path"]) as package:
        assert package.testzip() is None and package.namelist() == [DATA, INDEX, DESCRIPTION]
        resources = json.loads(package.read(DESCRIPTION))["resources"]
        for resource in resources:
            data = package.read(resource["path"])
            assert (resource["bytes"], resource["hash"]) == (len(data), "sha256:" + hashlib.sha256(data).hexdigest())
        lines = package.read(INDEX).decode().splitlines()
        archive = package.read(DATA)
    assert [line.split(" ", 2)[0] for line in lines] == ["-", "org,a:8080)/y", "org,b)/x?q=1"]
    for line in lines:
        entry = json.loads(line.split(" ", 2)[2])
        assert gzip.decompress(archive[entry["offset"] : entry["offset"] + entry["length"]]).startswith(b"WARC/1.1\r\n")


def test_keys_of_odd_urls():
    assert [url_key(u) for u in (None, "", "no url", "http://[", "http://a.org:99999999/")] == ["-"] * 5
    assert url_key("http://É.org/a b") == "org,%c3%a9)/a%20b".replace("%c3%a9", "%C3%A9")

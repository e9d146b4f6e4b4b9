"""WARC packages that were made elsewhere."""

import base64
import gzip
import hashlib
import json
import uuid
import zipfile

import pytest

from winnow.llm import warc_zip


def warc(kind, url, body, http=True, digest="sha1"):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" if http else b""
    own = base64.b32encode(hashlib.sha1(body).digest()).decode()
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url)}>", f"WARC-Target-URI: {url}", *([f"WARC-Payload-Digest: {digest}:{own}"] if digest else []), f"Content-Length: {len(head + body)}", "", ""]
    return "\r\n".join(lines).encode() + head + body + b"\r\n\r\n"


def package(path, archives, *, packed_index=False, deflate=()):
    """archives: name -> (records, whether each is a gzip member)."""
    lines = []
    with zipfile.ZipFile(path, "w") as z:
        for name, (records, packed) in archives.items():
            data = b""
            for r in records:
                one = gzip.compress(r) if packed else r
                lines.append(f"com,example)/ 20200101000000 {json.dumps({'url': 'x', 'offset': len(data), 'length': str(len(one)), 'filename': name})}\n")
                data += one
            z.writestr(f"archive/{name}", data, zipfile.ZIP_DEFLATED if name in deflate else zipfile.ZIP_STORED)
        text = ("!meta a header line\n" + "".join(lines)).encode()
        half = text.index(b"\n", len(text) // 2) + 1
        if packed_index:  # two gzip members
            z.writestr("indexes/index.cdx.gz", gzip.compress(text[:half]) + gzip.compress(text[half:]), zipfile.ZIP_STORED)
        else:
            z.writestr("indexes/one.cdxj", text[:half], zipfile.ZIP_STORED)
            z.writestr("indexes/two.cdxj", text[half:], zipfile.ZIP_DEFLATED if "two" in deflate else zipfile.ZIP_STORED)
        z.writestr("pages/pages.jsonl", b"{}" * 50, zipfile.ZIP_DEFLATED)
    return str(path)


BODIES = [b"one", b"", b"x" * 5000, "é".encode() * 100]


@pytest.fixture
def archives():
    made = [warc("response", f"http://example.com/{i}", b) for i, b in enumerate(BODIES)]
    return {
        "part-00.warc.gz": (made[:2], True),
        "part-01.warc.gz": (made[2:], True),
        "plain.warc": ([warc("revisit", "http://example.com/r", b""), warc("metadata", "http://example.com/m", b"note: x", http=False, digest=None), warc("response", "http://example.com/s", b"s", digest="sha256")], False),
    }


@pytest.mark.parametrize("packed_index", [True, False])
@pytest.mark.parametrize("read_bytes", [1, 1 << 20])
def test_foreign_packages(spark, tmp_path, archives, packed_index, read_bytes):
    path = package(tmp_path / "p.wacz", archives, packed_index=packed_index)
    found = {r.url.rsplit("/", 1)[1]: r for r in warc_zip.read_packages(spark.createDataFrame([(path,)], "path string"), read_bytes=read_bytes).collect()}
    assert len(found) == 7
    for i, body in enumerate(BODIES):
        r = found[str(i)]
        assert (r.record_type, bytes(r.payload), r.payload_bytes, r.page_id) == ("response", body, len(body), None) and r.record_id.startswith("<urn:uuid:")
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert found["r"].payload is None and found["r"].record_type == "revisit"
    assert (found["m"].record_type, bytes(found["m"].payload), found["s"].payload_bytes) == ("metadata", b"note: x", 1)


def test_members_that_are_compressed_are_named(spark, tmp_path, archives):
    for deflate, says in ((("part-01.warc.gz",), "archive/part-01.warc.gz is compressed"), (("two",), "indexes/two.cdxj is compressed")):
        path = package(tmp_path / f"{deflate[0]}.wacz", archives, deflate=deflate)
        with pytest.raises(Exception, match=says):
            warc_zip.read_packages(spark.createDataFrame([(path,)], "path string")).collect()
    with zipfile.ZipFile(tmp_path / "none.wacz", "w") as z:
        z.writestr("archive/a.warc", b"")
    with pytest.raises(Exception, match="has no index"):
        warc_zip.read_packages(spark.createDataFrame([(str(tmp_path / "none.wacz"),)], "path string")).collect()


def test_a_wrong_payload_is_an_error(spark, tmp_path):
    bad = warc("response", "http://example.com/b", b"right").replace(b"right", b"wrong")
    path = package(tmp_path / "bad.wacz", {"a.warc.gz": ([bad], True)})
    with pytest.raises(Exception, match="does not match its digest"):
        warc_zip.read_packages(spark.createDataFrame([(path,)], "path string")).collect()


def test_paths_follow_the_default_file_system(spark):
    assert warc_zip._qualified("/ck/x", "hdfs://nn:8020") == "hdfs://nn:8020/ck/x" and warc_zip._qualified("/ck/x", "file:") == "/ck/x"
    assert warc_zip._qualified("s3a://b/x", "hdfs://nn") == "s3a://b/x" and warc_zip._qualified("file:/x", "hdfs://nn") == "file:/x"
    assert warc_zip._root(spark).startswith("file:")
    assert warc_zip._uri("s3a://b/x") == "s3://b/x" and warc_zip._uri("hdfs://nn/s3a://x") == "hdfs://nn/s3a://x"
    assert warc_zip._open("file:///tmp/x")[1] == warc_zip._open("/tmp/x")[1] == "/tmp/x"

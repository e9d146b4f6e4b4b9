"""WARC archives packaged in ZIP files, written and read by tasks.

A package has three stored (not compressed) members: ``archive/data.warc.gz`` with one gzip member for each record,
``indexes/index.cdxj`` with the place of each record, and ``datapackage.json``. The reader never unpacks a package: it
reads the end of the file, follows the ZIP64 locator if there is one, reads the central directory, finds the data
of the stored members behind their local headers, reads the indexes, and then reads ranges of the archives.

Packages made elsewhere are read as well: any number of archives and indexes, whose lines name the archive of each record; indexes packed with gzip; archives of gzip members or of plain records.
Members that are compressed inside the ZIP cannot be read by ranges: an archive or index of that kind is an error that names it.

Packages lie in a folder that all executors can open (``pyarrow.fs``: local or mounted folders, object stores, HDFS). Paths without a scheme belong to Hadoop's default file system, as they do for Spark; ``s3a`` is read as ``s3``. A task
names its package freshly at each attempt and returns the name, so packages of failed attempts are never read.

Null html is an empty payload, a null url is ``urn:none``. A payload that several pages share (at least ``min_bytes``) is stored once, as the
response of the largest page_id; the others are revisits. A page without an id is always a response. Rows that
repeat a page_id with the same payload are all responses or all revisits. Very long pages are records like others. An empty table makes no package and gives an empty result. Other
columns, whatever their names, take no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import store
from winnow.llm.words import blocks

# Fixed values of the formats.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:/")
_INDEXES = re.compile(r"indexes/.*\.cdxj?(\.gz)?")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if not _SCHEME.match(path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(_uri(path))


def _uri(path: str) -> str:
    """Spark's names of schemes in pyarrow's."""
    return re.sub(r"^s3[an]://", "s3://", path)


def _root(spark: SparkSession) -> str:
    """What to put in front of paths without a scheme: Hadoop's default file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf).toString().rstrip("/")


def _qualified(path: str, root: str) -> str:
    return path if _SCHEME.match(path) or root.startswith("file:") else root + path


class ZipWriter:
    """Stored members of any size, written as a stream: sizes follow the data, in descriptors and the directory."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self._write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def data(self, data: bytes) -> None:
        member = self.members[-1]
        member[2], member[3] = zlib.crc32(data, member[2]), member[3] + len(data)
        self._write(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._write(struct.pack("<IIQQ" if size >= FULL32 else "<IIII", DESCRIPTOR, crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            extra = b""
            if self.zip64 or size >= FULL32 or offset >= FULL32:
                extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            small = FULL32 if extra else size
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, FULL32 if extra else offset) + raw + extra)
        size, end64, n = self.at - start, self.at, len(self.members)
        if self.zip64 or start >= FULL32 or size >= FULL32 or n >= FULL16:
            self._write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            n, size, start = FULL16, FULL32, FULL32
        self._write(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


def directory(file) -> dict[str, tuple[int, int]]:
    """(first byte, size) of the data of each stored member of an open ZIP file; only its directories are read."""
    return {name: place for name, place in members(file).items() if place is not None}


def members(file) -> dict[str, tuple[int, int] | None]:
    """As directory(), with None for members that are compressed."""
    total = file.size()
    tail_at = max(0, total - (22 + FULL16 + 20))
    tail = file.read_at(total - tail_at, tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)  # the signature stood in the comment, which must end the file
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, count, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if at >= 20 and struct.unpack_from("<I", tail, at - 20)[0] == LOCATOR64:
        where = struct.unpack_from("<IIQI", tail, at - 20)[2]
        sig, _, _, _, _, _, _, count, size, start = struct.unpack("<IQHHIIQQQQ", file.read_at(56, where))
        if sig != END64:
            raise ValueError("the ZIP64 locator points to no directory")
    raw, p, found = file.read_at(size, start), 0, dict[str, tuple[int, int] | None]()
    for _ in range(count):
        sig, _, _, _, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, p)
        if sig != CENTRAL:
            raise ValueError("a broken central directory")
        name = raw[p + 46 : p + 46 + n_name].decode()
        extra = raw[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # 64-bit values stand for the fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            q += 4 + length
        p += 46 + n_name + n_extra + n_note
        found[name] = None
        if method == 0:
            head = file.read_at(30, offset)
            if struct.unpack_from("<I", head)[0] != LOCAL:
                raise ValueError(f"no local header of {name}")
            found[name] = (offset + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
    return found


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """One WARC record -> its headers (lower-case names), the HTTP headers, the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if not block.startswith(b"HTTP/"):
        return {"headers": headers, "http": {}, "payload": block}
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"headers": headers, "http": fields, "payload": payload}


def write_packages(pages: DataFrame, folder: str | None = None, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zip64: bool = False) -> DataFrame:
    """Writes one package for each partition of pages; (path, records) of those written, saved."""
    spark = pages.sparkSession
    folder = _qualified(folder or store.new_path(spark, "packages"), _root(spark))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    same = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where("n > 1 and keeper is not null").select("sha", "keeper")
    shared = store.saved(same, "shared")
    rows = rows.join(F.broadcast(shared), "sha", "left") if store.is_small(shared) else store.lookup(rows, shared, "sha")
    rows = rows.select("id", "url", "html", F.when(F.col("id") != F.col("keeper"), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, zipped, entries, path = None, None, [], ""
        for batch in batches:
            for row, html in ((row, t) for a, b, texts in blocks(batch, "html") for row, t in zip(batch.select(["id", "url", "refers_to"]).slice(a, b - a).to_pylist(), texts, strict=True)):
                if zipped is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    system, local = _open(path)
                    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(local)
                    zipped = ZipWriter(out, zip64)
                    zipped.begin(ARCHIVE)
                raw = gzip.compress(record(row["id"], row["url"], html, row["refers_to"]), 6, mtime=0)
                entries.append((zipped.members[-1][3], len(raw), row["id"]))
                zipped.data(raw)
        if zipped is not None:
            zipped.end()
            zipped.begin(INDEX)
            for offset, length, page in entries:
                fields = json.dumps({"offset": str(offset), "length": str(length), "filename": "data.warc.gz"})
                zipped.data(f"page:{'' if page is None else page} 20240101000000 {fields}\n".encode())
            zipped.end()
            zipped.begin(PACKAGE)
            zipped.data(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [ARCHIVE, INDEX]}).encode())
            zipped.end()
            zipped.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(entries)], pa.int64())], ["path", "records"])

    try:
        return store.saved(rows.mapInArrow(run, "path string, records long"), "manifest")
    finally:
        store.forget(shared)


def places(file) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of the records of each archive of an open package, by the member's name, as its indexes have them."""
    held, out = members(file), dict[str, set[tuple[int, int]]]()
    indexes = [name for name in held if _INDEXES.fullmatch(name)]
    if not indexes:
        raise ValueError("the package has no index")

    def stored(name: str) -> tuple[int, int]:
        if name not in held:
            raise ValueError(f"the package has no member {name}")
        if held[name] is None:
            raise ValueError(f"{name} is compressed in the package; only stored members can be read by ranges")
        return held[name]

    for name in indexes:
        at, size = stored(name)
        raw = file.read_at(size, at)
        for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines():
            if "{" in line:  # others are comments or headers
                entry = json.loads(line[line.index("{") :])
                archive = entry["filename"] if entry["filename"] in held else f"archive/{entry['filename']}"
                stored(archive)
                out.setdefault(archive, set()).add((int(entry["offset"]), int(entry["length"])))
    return {archive: sorted((held[archive][0] + offset, length) for offset, length in found) for archive, found in out.items()}


def _ranges(read_bytes: int, root: str):
    """(path) -> (path, start, length, ends): neighbouring records of an archive, about read_bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                path = _qualified(path, root)
                system, local = _open(path)
                with system.open_input_file(local) as file:
                    found = places(file)
                rows: list[tuple[int, list[int]]] = []
                for records in found.values():
                    begun = len(rows)
                    for at, length in records:
                        if len(rows) == begun or rows[-1][0] + rows[-1][1][-1] != at or rows[-1][1][-1] + length > read_bytes:
                            rows.append((at, [length]))
                        else:
                            rows[-1][1].append(rows[-1][1][-1] + length)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["path", "start", "ends"])

    return run


def _number(urn: str | None) -> int | None:
    """The page of a record's name; null for records that were not written here."""
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _content(found: dict) -> tuple[int | None, str | None, bytes | None]:
    """(size, digest, payload) of a parsed record. What the record says of its payload is compared with it; a revisit has no payload, and a payload in chunks is given as it is."""
    h, http, payload = found["headers"], found["http"], found["payload"]
    digest = h["warc-payload-digest"].removeprefix("sha1:") if h.get("warc-payload-digest", "").startswith("sha1:") else None
    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    if h["warc-type"] == "revisit":
        return size, digest, None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if h["warc-type"] == "response" and "transfer-encoding" not in http and (size not in (None, len(payload)) or digest not in (None, own)):
        raise ValueError(f"record {h['warc-record-id']} does not match its digest")
    return len(payload), own, payload


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, local = _open(row["path"])
            with system.open_input_file(local) as file:
                raw = file.read_at(row["ends"][-1], row["start"])
            out = []
            for a, b in zip([0, *row["ends"][:-1]], row["ends"], strict=True):
                found = parse(gzip.decompress(raw[a:b]) if raw[a : a + 2] == b"\x1f\x8b" else raw[a:b])
                h = found["headers"]
                size, digest, payload = _content(found)
                out.append((_number(h["warc-record-id"]), h.get("warc-target-uri"), size, digest, h["warc-type"], _number(h.get("warc-refers-to")), payload, h["warc-record-id"]))
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record_id"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(len(kinds))], names)


def read_packages(packages: DataFrame, *, read_bytes: int = 4 << 20) -> DataFrame:
    """packages (path) -> (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, record_id) of every record that the indexes list.

    payload is null for revisits; size and digest are those of the full payload. page_id and refers_to are null where records bear other names; record_id has the name as it is.
    """
    spark = packages.sparkSession
    ranges = store.saved(packages.select("path").mapInArrow(_ranges(read_bytes, _root(spark)), "path string, start long, ends array<long>"), "ranges")
    return ranges.repartition(store.partitions(spark), "path", "start").mapInArrow(_records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string")


def op9_warc_zip(spark, sf_dir: str) -> DataFrame:
    written = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = read_packages(written)
    store.forget(written)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hex digits of the SHA-1 are four base32 digits.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, lower(sha1(coalesce(html, ''))) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""

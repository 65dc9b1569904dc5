"""WARC records in ZIP packages: write them, and range-read them back without extraction.

A package holds four stored (not deflated) members: ``archive/data.warc.gz`` with one gzip member
per record, ``indexes/index.cdxj`` with a line (page id, offset, length) per record,
``datapackage.json``, and, for very many or large members, ZIP64 structures. The reader finds the
end-of-central-directory record (and its ZIP64 locator), walks the central directory, resolves the
stored members' data offsets from their local headers, reads the index, and then reads each record
by its byte range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct as st
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import cut, discard_at_end, shared_path, text_of, width

EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Keys of revisits that are broadcast at most, and bits of a bitmap of more (64 MB).
MOST_BROADCAST, MOST_BITS = 200_000, 1 << 29
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- ZIP, written as a stream --------------------------------------------------------------


class ZipWriter:
    """Writes stored members one after another to a sink with write(); sizes follow in descriptors.

    ``zip64=True`` forces ZIP64 structures; otherwise they appear where a field would overflow.
    """

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at, self.members = sink, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        raw = name.encode()
        self.members.append({"name": raw, "offset": self.at, "crc": 0, "size": 0})
        # sizes are not known yet: bit 3 puts them in a descriptor; bit 11 says that names are UTF-8
        self._put(LOCAL + st.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)
        self.members[-1]["data"] = self.at

    def write(self, data: bytes) -> None:
        m = self.members[-1]
        m["crc"], m["size"] = zlib.crc32(data, m["crc"]), m["size"] + len(data)
        self._put(data)

    def close_member(self) -> None:
        m = self.members[-1]
        m["big"] = self.zip64 or m["size"] >= FULL32
        self._put(b"PK\x07\x08" + st.pack("<IQQ" if m["big"] else "<III", m["crc"], m["size"], m["size"]))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            far = self.zip64 or m["offset"] >= FULL32
            extra = (st.pack("<QQ", m["size"], m["size"]) if m["big"] else b"") + (st.pack("<Q", m["offset"]) if far else b"")
            extra = st.pack("<HH", 1, len(extra)) + extra if extra else b""
            size = FULL32 if m["big"] else m["size"]
            self._put(CENTRAL + st.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, FULL32 if far else m["offset"]) + m["name"] + extra)
        length, n = self.at - start, len(self.members)
        if self.zip64 or start >= FULL32 or length >= FULL32 or n >= FULL16:
            end = self.at
            self._put(EOCD64 + st.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(LOCATOR64 + st.pack("<IQI", 0, end, 1))
            n, length, start = FULL16, FULL32, FULL32
        self._put(EOCD + st.pack("<HHHHIIH", 0, 0, n, n, length, start, 0))


# ---- ZIP, read by ranges -------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    size: int
    stored: int
    header: int


class ZipRanges:
    """Reads a ZIP through read(offset, length) only; nothing is extracted."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - FULL16)  # a comment has up to 65535 bytes
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(EOCD)
        while at >= 0 and at + 22 + st.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(EOCD, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = st.unpack_from("<HII", tail, at + 10)
        base = tail_at + at
        if FULL16 == n or FULL32 in (length, start):
            locator = self.read(base - 20, 20)
            if locator[:4] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            far = st.unpack_from("<Q", locator, 8)[0]
            end = self.read(far, 56)
            if end[:4] != EOCD64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = st.unpack_from("<QQQ", end, 32)
        book, at = self.read(start, length), 0
        for _ in range(n):
            if book[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, _, _, crc, stored, size, n_name, n_extra, n_comment = st.unpack_from("<HHHIIIHHH", book, at + 10)
            header = st.unpack_from("<I", book, at + 42)[0]
            name = book[at + 46 : at + 46 + n_name]
            x, end = at + 46 + n_name, at + 46 + n_name + n_extra
            while x + 4 <= end:
                kind, width_ = st.unpack_from("<HH", book, x)
                if kind == 1:
                    y = x + 4
                    if size == FULL32:
                        size, y = st.unpack_from("<Q", book, y)[0], y + 8
                    if stored == FULL32:
                        stored, y = st.unpack_from("<Q", book, y)[0], y + 8
                    if header == FULL32:
                        header = st.unpack_from("<Q", book, y)[0]
                x += 4 + width_
            yield Member(name.decode("utf-8", "replace"), method, crc, size, stored, header)
            at = end + n_comment

    def data_offset(self, name: str) -> int:
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.read(m.header, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        return m.header + 30 + sum(st.unpack_from("<HH", head, 26))

    def whole(self, name: str) -> bytes:
        return self.read(self.data_offset(name), self.members[name].stored)


# ---- WARC records ---------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def make_record(page_id, url: str, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A response with HTTP head and payload, or, if payload is None, a revisit with the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    kind = "revisit" if payload is None else "response"
    clean = "".join(c for c in url if c >= " ")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {urn(page_id)}\r\nWARC-Target-URI: {clean}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\n"
    if payload is None:
        head += f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {urn(refers_to)}\r\n"
    block = http + (payload or b"")
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8").split("\r\n")[1:])}


def parse_record(raw: bytes) -> dict:
    """What a record says; a response's payload is measured and digested anew and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _fields(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, told, n = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    page = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x != urn(None) else None
    if kind == "response" and (len(payload) != n or payload_digest(payload) != told):
        raise ValueError("a payload disagrees with its record")
    return {"page_id": page(h["warc-record-id"]), "url": h["warc-target-uri"], "payload_bytes": n, "payload_digest": told, "record_type": kind, "refers_to": page(h.get("warc-refers-to")), "payload": payload if kind == "response" else None}


# ---- Spark ----------------------------------------------------------------------------------


def _qualified(spark: SparkSession, where: str) -> str:
    """The folder as a URI; without a scheme it is one of the cluster's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _told(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the payload's size and digest; nulls are empty."""
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), text_of("html").alias("html"))
    return base.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))})


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, size, digest and refers_to of the pages whose payload one of a smaller page_id has.

    A null html is an empty payload. A row without page_id is a response and no revisit refers to
    it. Repeated rows with the smallest page_id are all responses. Only narrow rows are shuffled; a
    payload that very many pages have is added up on the map side, and its rows are spread by the join.
    """
    narrow = cut(_told(pages).drop("html"), "pages")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to <> last")
    return cut(narrow.join(first.drop("last"), "digest").where("page_id <> refers_to").select("page_id", "url", "size", "digest", "refers_to"), "revisits")


def _marks(keys: DataFrame, bits: int) -> DataFrame:
    """A bitmap of the keys (page_id, digest), in pieces of 4 KB."""
    spot = F.pmod(F.xxhash64("page_id", "digest"), F.lit(bits))
    return cut(keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")), "marks")


def _marked(rows: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """The rows with ``marked``: whether their key may be in the bitmap."""
    spot = F.pmod(F.xxhash64("page_id", "digest"), F.lit(bits))
    names = rows.columns
    rows = rows.withColumn("spot", spot).withColumns({"bucket": F.bitmap_bucket_number("spot"), "position": F.bitmap_bit_position("spot").cast("int")})
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright("position", 3) + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.join(F.broadcast(marks), "bucket", "left").withColumn("byte", F.coalesce(byte, F.lit(0)))
    return rows.select(*names, F.expr("shiftright(byte, position & 7) & 1 = 1").alias("marked"))


def responses(pages: DataFrame, again: DataFrame, most_broadcast: int = MOST_BROADCAST, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, url, html, size and digest of the pages that are not in ``again``, as read: no html is shuffled
    where few pages are revisits.

    Up to ``most_broadcast`` keys of revisits are broadcast. Beyond it a bitmap of 16 bits a key (``most_bits``
    at most) tells most responses; a second one, of the keys that the first takes for revisits wrongly, tells
    most revisits. What both mark, some 6 % of 6 % of the rows, is settled by a join.
    """
    rows, keys = _told(pages), again.select("page_id", "digest")
    by = ["page_id", "digest"]
    n = again.count()
    if n <= most_broadcast:
        return rows.join(F.broadcast(keys.distinct()), by, "left_anti")
    bits = min(most_bits, 1 << (16 * n - 1).bit_length())
    flagged = _marked(rows, _marks(keys, bits), bits)
    sure = flagged.where("not marked").drop("marked")
    wrong = cut(flagged.where("marked").select(*by).join(keys, by, "left_anti"), "wrong")
    open_ = _marked(flagged.where("marked").drop("marked"), _marks(wrong, bits), bits).where("marked").drop("marked")
    return sure.unionByName(open_.join(keys, by, "left_anti"))


def write_packages(pages: DataFrame, where: str, zip64: bool = False, level: int = 6, **limits) -> DataFrame:
    """Writes a package per partition below ``where``; returns (path, bytes, records).

    Bounded memory: records go to the package as they come. A package gets its final name when it
    is complete, and a task that runs again writes another; the returned table alone says which
    packages count.
    """
    where = _qualified(pages.sparkSession, where)
    again = revisits(pages)
    rows = responses(pages, again, **limits).select("page_id", "url", "html", "size", "digest", F.lit(None).cast("long").alias("refers_to"))
    rows = rows.unionByName(again.withColumn("html", F.lit(None).cast("string")))

    def write(batches):
        fs, folder = _filesystem(where)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        sink, out, index, n, at = None, None, io.BytesIO(), 0, 0
        for batch in batches:
            for page_id, url, html, size, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    sink = fs.open_output_stream(name)
                    out = ZipWriter(sink, zip64)
                    out.open(DATA)
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                told = base64.b32encode(bytes.fromhex(digest)).decode()
                record = press.compress(make_record(page_id, url, None if html is None else html.encode(), size, told, refers)) + press.flush()
                out.write(record)
                index.write(b"%s %d %d\n" % (json.dumps(page_id).encode(), at, len(record)))
                at, n = at + len(record), n + 1
        if out is not None:
            out.close_member()
            for member, data in ((INDEX, index.getvalue()), (PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA, "records": n}]}).encode())):
                out.open(member)
                out.write(data)
                out.close_member()
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": pa.array([out.at], pa.int64()), "records": pa.array([n], pa.int64())})

    return cut(rows.mapInArrow(write, "path string, bytes long, records long"))


def read_packages(packages: DataFrame, where: str, payloads: bool = False) -> DataFrame:
    """A row per record of the packages in (path, bytes): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and with ``payloads`` the payload (null for revisits)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    where = _qualified(packages.sparkSession, where)

    def read(batches):
        fs, _ = _filesystem(where)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    package = ZipRanges(lambda at, n: f.read_at(n, at), f.size())
                    start, rows, held = package.data_offset(DATA), [], 0
                    for line in package.whole(INDEX).splitlines():
                        _, at, n = line.rsplit(b" ", 2)
                        row = parse_record(zlib.decompress(f.read_at(int(n), start + int(at)), 31))
                        held += len(row["payload"] or b"") if payloads else 0
                        rows.append({k: row[k] for k in names})
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, arrow)

    spread = packages.select("path").repartition(max(1, width(packages.sparkSession)), "path")
    return spread.mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, zip64: bool = False, payloads: bool = False, **limits) -> DataFrame:
    """Writes every page as a WARC record into ZIP packages in the shared folder and reads them back.

    The packages go when the session's driver ends. Nulls: html counts as empty, url as empty; a row with a null page_id is always a response.
    Repeated rows give repeated records. An empty table gives no packages and no rows. Further
    columns are left out.
    """
    where = shared_path(pages.sparkSession, "warc")
    discard_at_end(pages.sparkSession, where)
    return read_packages(write_packages(pages, where, zip64, **limits), where, payloads)

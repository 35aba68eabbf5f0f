"""WARC records in ZIP packages: a writer, and a reader that never extracts a package.

The reader finds the end-of-central-directory record (and its ZIP64 form) from the last bytes, parses the central
directory, locates the stored members `archive/data.warc.gz` and `indexes/index.cdxj` through their local headers, and
reads each record by its range: offset and length in the index, added to where the member begins. Every record is a gzip
member of its own.

Edge cases: null html is an empty payload; null url or page_id leaves its header out and reads as null; rows with equal
page_id are each written. Payloads shorter than `least` bytes are always responses. An empty table gives no packages and
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, fresh_dir, put_in_place, small_batches

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Repeated payloads up to this number are known to all tasks; more are joined by shuffle.
BROADCAST_PAYLOADS = 500_000
_ID = "urn:page:"


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), digest (hex SHA-1), keeper: the page that holds the payload of a repeated one."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    digests = pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("of"), F.octet_length(payload).alias("n"))
    repeated = digests.where(F.col("n") >= least).groupBy("of").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("of", "keeper")
    repeated = repeated.persist()
    few = repeated.count() <= BROADCAST_PAYLOADS
    return rows.join(F.broadcast(repeated) if few else repeated, F.col("digest") == F.col("of"), "left").drop("of")


def _b32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit with the identical-payload-digest profile and the HTTP header only."""
    revisit = keeper is not None and keeper != page_id
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{_ID}{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: {_b32(digest)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{keeper}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a record is shorter than its header says")
    return fields, rest[:size]


class Package:
    """Writes one ZIP package to a stream that can't seek."""

    def __init__(self, out, date: str):
        self.zip, self.date, self.index, self.at = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True), date, [], 0
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None) -> None:
        press = zlib.compressobj(3, wbits=31)
        body = press.compress(record(page_id, url, payload, digest, keeper, self.date)) + press.flush()
        self.member.write(body)
        self.index.append({"page_id": page_id, "url": url, "digest": _b32(digest), "offset": self.at, "length": len(body), "filename": "data.warc.gz"})
        self.at += len(body)

    def close(self) -> None:
        self.member.close()
        stamp = re.sub(r"\D", "", self.date)[:14]
        lines = "".join(f"{x['page_id']} {stamp} {json.dumps(x)}\n" for x in self.index)
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER, (1980, 1, 1, 0, 0, 0)), lines)
        self.zip.close()


class _Forward(io.RawIOBase):
    """What zipfile needs of a stream that only goes forward."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(data)
        self.n += len(data)
        return len(data)

    def tell(self) -> int:
        raise OSError("forward only")


def write_packages(pages: DataFrame, folder: str | None = None, least: int = 1000, date: str = "1970-01-01T00:00:00Z", records: int = 20_000) -> DataFrame:
    """Writes every page as a record, a package for each `records` rows of a task; the files are renamed when complete.
    Rows: file, records, bytes (one for each package). The frame is the table of what was written, not a plan."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_dir(spark, "warc-zip")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, fs_root = TaskContext.get(), file_system(folder)
        fs, root = fs_root
        fs.create_dir(root, recursive=True)
        k, package, stream, temporary = 0, None, None, ""

        def done() -> pa.RecordBatch:
            nonlocal k, package
            package.close()
            stream.close()
            name = f"{root}/part-{context.partitionId():05d}-{k:04d}.zip"
            put_in_place(fs, temporary, name)
            row = pa.RecordBatch.from_pydict({"file": [f"{folder}/{name.rpartition('/')[2]}"], "records": pa.array([len(package.index)], pa.int64()), "bytes": pa.array([package.at], pa.int64())})
            k, package = k + 1, None
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    temporary = f"{root}/.part-{context.partitionId():05d}-{k:04d}.{context.taskAttemptId()}"
                    stream = fs.open_output_stream(temporary)
                    package = Package(_Forward(stream), date)
                package.add(*row)
                if len(package.index) >= records:
                    yield done()
        if package is not None:
            yield done()

    planned = plan_records(pages, least).select("page_id", "url", "payload", "digest", "keeper")
    return spark.createDataFrame(planned.mapInArrow(write, "file string, records long, bytes long").collect(), "file string, records long, bytes long")


@dataclass
class Member:
    name: str
    method: int
    packed: int
    size: int
    crc: int
    header: int


Reader = Callable[[int, int], bytes]


def directory(read: Reader, size: int) -> dict[str, Member]:
    """Members by name. read(offset, length) gives bytes of the package, size is its length."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, n, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        sign, _, end64, _ = struct.unpack("<4sIQI", read(tail_at + at - 20, 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        fields = struct.unpack("<4sQHHIIQQQQ", read(end64, 56))
        if fields[0] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = fields[7], fields[8], fields[9]
    raw, found, p = read(start, length), {}, 0
    for _ in range(n):
        (sign, _, _, _, method, _, _, crc, packed, full, a, b, c, _, _, _, header) = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, p)
        if sign != b"PK\x01\x02":
            raise ValueError("a central directory entry is damaged")
        name, extra = raw[p + 46 : p + 46 + a].decode("utf-8"), raw[p + 46 + a : p + 46 + a + b]
        q = 0
        while q + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                r = q + 4
                if full == 0xFFFFFFFF:
                    full, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, r)[0]
            q += 4 + long
        found[name] = Member(name, method, packed, full, crc, header)
        p += 46 + a + b + c
    return found


def data_offset(read: Reader, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} isn't stored, so its records have no ranges")
    sign, a, b = struct.unpack("<4s22xHH", read(member.header, 30))
    if sign != b"PK\x03\x04":
        raise ValueError(f"{member.name}: no local header")
    return member.header + 30 + a + b


def open_package(path: str) -> tuple[Reader, int, object]:
    fs, p = file_system(path)
    file = fs.open_input_file(p)

    def read(offset: int, length: int) -> bytes:
        return file.read_at(length, offset)

    return read, file.size(), file


def index_of(read: Reader, size: int) -> tuple[list[dict], int]:
    """Entries of a package's index in the order of their offsets, and where its WARC member begins."""
    members = directory(read, size)
    index = members[INDEX_MEMBER]
    raw = read(data_offset(read, index), index.packed)
    if zlib.crc32(raw) != index.crc:
        raise ValueError("the index is damaged")
    entries = [json.loads(line.split(" ", 2)[2]) for line in raw.decode().split("\n") if line]
    return sorted(entries, key=lambda x: x["offset"]), data_offset(read, members[WARC_MEMBER])


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    kind = fields["warc-type"]
    number = lambda x: int(x.strip("<>").removeprefix(_ID)) if x else None
    if kind == "response":
        n = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload doesn't match its digest")
    else:
        n = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", head)[1])
    row = (number(fields.get("warc-record-id")), fields.get("warc-target-uri"), n, digest, kind, number(fields.get("warc-refers-to")))
    return (*row, payload if kind == "response" else None) if with_payload else row


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """packages: `file`. page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if wanted, payload."""
    fields = [("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long")]
    fields += [("payload", pa.binary(), "binary")] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                get, size, file = open_package(path)
                entries, start = index_of(get, size)
                i = 0
                while i < len(entries):
                    j, first = i, entries[i]["offset"]
                    while j < len(entries) and entries[j]["offset"] + entries[j]["length"] - first <= 4 << 20:
                        j += 1
                    j = max(j, i + 1)  # neighbours share a request
                    body = get(start + first, entries[j - 1]["offset"] + entries[j - 1]["length"] - first)
                    rows = []
                    for x in entries[i:j]:
                        at = x["offset"] - first
                        rows.append(_row(*parse_record(zlib.decompress(body[at : at + x["length"]], 31)), with_payload))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _, _ in fields])
                    i = j
                file.close()

    return packages.select("file").mapInArrow(read, ", ".join(f"{n} {t}" for n, _, t in fields))


def package_pages(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    written = write_packages(pages, least=least)
    n = max(1, written.count())
    return read_packages(written.repartition(n)).drop("url")

import hashlib
import io
import os
import zipfile

import pytest
from corpusflow.llm import ziparchive as Z
from corpusflow.llm.common import fresh_dir
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"
BIG = "<p>é" + "x" * 1200


def rows():
    return [(1, "http://a/1", BIG), (2, "http://a/2 b\r\nX: y", BIG), (3, None, BIG + "z"), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "http://a/8", BIG), (None, "u", "lost id"), (9, "u", BIG[:-1] * 500), (6, "u", "short")]


def brute(data, least):
    raw = [(i, (h or "").encode()) for i, _, h in data]
    out = []
    for i, body in raw:
        keeper = max(j for j, b in raw if b == body and j is not None) if len(body) >= least else i
        revisit = keeper != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [Z.BROADCAST_PAYLOADS, 0])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(Z, "BROADCAST_PAYLOADS", limit)
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("of", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("payload", F.lit(3))
    assert found(Z.package_pages(spark, df)) == brute(rows(), 1000)
    assert Z.package_pages(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_and_other_tools_read_it(spark):
    folder = fresh_dir(spark, "zip-test")
    packages = Z.write_packages(spark.createDataFrame(rows(), SCHEMA).coalesce(1), folder, records=4)
    assert packages.count() == 3
    got = {r["page_id"]: r for r in Z.read_packages(packages, with_payload=True).collect()}
    assert bytes(got[9]["payload"]) == (BIG[:-1] * 500).encode() and got[1]["payload"] is None and got[3]["url"] is None
    assert got[2]["url"] == "http://a/2%20b%0D%0AX:%20y"
    for r in packages.collect():
        with zipfile.ZipFile(r["file"].removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert z.namelist() == [Z.WARC_MEMBER, Z.INDEX_MEMBER]


def reader(raw):
    return lambda offset, length: raw[offset : offset + length]


def test_directory_of_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    bodies = {f"m{i}": os.urandom(150 + i) for i in range(5)}
    with zipfile.ZipFile(out, "w") as z:
        for name, body in bodies.items():
            z.writestr(name, body)
        z.comment = b"PK\x05\x06 a comment that looks like a record"
    raw = out.getvalue()
    members = Z.directory(reader(raw), len(raw))
    assert list(members) == list(bodies)
    for name, m in members.items():
        at = Z.data_offset(reader(raw), m)
        assert raw[at : at + m.packed] == bodies[name]


def test_what_it_refuses():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(Z.INDEX_MEMBER, "x" * 100)
    raw = out.getvalue()
    with pytest.raises(ValueError, match="stored"):
        Z.data_offset(reader(raw), Z.directory(reader(raw), len(raw))[Z.INDEX_MEMBER])
    with pytest.raises(ValueError, match="end of central"):
        Z.directory(reader(b"no zip"), 6)
    with pytest.raises(ValueError, match="shorter"):
        Z.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")

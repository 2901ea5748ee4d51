"""Archives that others wrote: bytes in any encoding, header lines and dates of
several shapes, and files that break off."""

import base64
import gzip
import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.llm import warc

IMAGE = b"\x89PNG\r\n\x1a\n\x00\xff\xfe\xd8" * 150
LATIN = "café ".encode("latin-1") * 400
OK = b"HTTP/1.0 200 OK\r\nContent-Type: image/png\r\n\r\n"
BARE = b"HTTP/1.0 200 OK\nServer: caf\xe9\nContent-Type: text/html\n\n"


def archive(version, records, end=b"\n", cut=0):
    """Bytes of an ARC file of (url, date, type, block)."""
    about = f"{version} 0 Crawler\n{warc.ARC_FIELDS[version]}\n\n".encode()
    more = b" 200 - - 0 x.arc" if version == 2 else b""
    out = [b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain" + more + b" %d" % len(about) + end + about]
    for url, date, kind, block in records:
        out.append(b" ".join([url, b"10.0.0.1", date, kind]) + more + b" %d" % len(block) + end + block)
    parts = [out[0], *(b"\n" + x for x in out[1:])]
    parts[-1] = parts[-1][: len(parts[-1]) - cut]
    return parts


RECORDS = [
    (b"http://a/logo.png", b"19970203040506", b"image/png", OK + IMAGE),
    (b"http://b/two words.png", b"199702030405", b"image/png", OK + IMAGE),
    (b"http://c/caf\xe9", b"19970203", b"text/html", BARE + LATIN),
    (b"dns:c", b"1997", b"text/dns", b"19970203\nc. 300 IN A 10.0.0.1\n"),
    (b"http://d/", b"19970203040506", b"text/html", OK + b"0123456789" * 20),
]


def heads(spark, path):
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    return {f["warc-record-id"]: (f, b) for row in files for f, b in warc.warc_records(warc._unpacked(row["content"]))}


@pytest.mark.parametrize("version, end, packing", [(1, b"\n", "plain"), (2, b"\r\n", "file"), (1, b"\r\n", "record"), (2, b"\n", "record")])
def test_archives_of_others(spark, tmp_path, version, end, packing):
    parts = archive(version, RECORDS, end, cut=50)
    data = {"plain": b"".join(parts), "file": gzip.compress(b"".join(parts)), "record": b"".join(map(gzip.compress, parts))}[packing]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.arc").write_bytes(data)
    warc.arc_to_warc(spark, str(tmp_path / "in"), str(tmp_path / "out"), members=packing == "record")
    rows = {r["url"]: r for r in warc.read_warc(spark, str(tmp_path / "out"), infos=True).collect()}
    assert set(rows) == {None, "http://a/logo.png", "http://b/two%20words.png", "http://c/caf%E9", "dns:c", "http://d/"}
    assert rows[None]["record_type"] == "warcinfo" and bytes(rows[None]["payload"]).startswith(b"%d 0 Crawler" % version)
    assert bytes(rows["http://a/logo.png"]["payload"]) == bytes(rows["http://b/two%20words.png"]["payload"]) == IMAGE  # no ids, so neither revisits the other
    assert bytes(rows["http://c/caf%E9"]["payload"]) == LATIN and rows["http://c/caf%E9"]["payload_digest"] == hashlib.sha1(LATIN).hexdigest()
    assert rows["dns:c"]["record_type"] == "resource" and bytes(rows["dns:c"]["payload"]) == RECORDS[3][3]
    assert rows["http://d/"]["truncated"] and bytes(rows["http://d/"]["payload"]) == b"0123456789" * 15
    assert [u for u, r in rows.items() if r["truncated"]] == ["http://d/"]
    found = heads(spark, str(tmp_path / "out"))
    dates = {f.get("warc-target-uri"): f["warc-date"] for f, _ in found.values()}
    assert dates["http://a/logo.png"] == "1997-02-03T04:05:06Z" and dates["http://b/two%20words.png"] == "1997-02-03T04:05:00Z"
    assert dates["http://c/caf%E9"] == "1997-02-03T00:00:00Z" and dates["dns:c"] == "1970-01-01T00:00:00Z"
    whole = {f["warc-target-uri"]: b for f, b in found.values() if "warc-target-uri" in f}
    assert whole["http://c/caf%E9"] == BARE + LATIN
    assert all(f["warc-block-digest"] == "sha1:" + hashlib.sha1(b).hexdigest() for f, b in found.values())


def test_a_member_a_record_is_read_by_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{i}", "x" * 2000 if i % 2 else str(i)) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    warc.write_arc(pages, str(tmp_path / "arc"))
    warc.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), members=True)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert kinds == {0: ("response", None), 1: ("revisit", 5), 2: ("response", None), 3: ("revisit", 5), 4: ("response", None), 5: ("response", None)}
    for file in (tmp_path / "warc").glob("part-*"):
        unpacked = subprocess.run(["gzip", "-dc"], input=file.read_bytes(), capture_output=True)
        assert unpacked.returncode == 0 and unpacked.stdout == warc._unpacked(file.read_bytes())


def test_ids_of_other_types_bytes_and_dates(spark, tmp_path):
    rows = [("b 1", bytearray(IMAGE), "2001-02-03 04:05:06"), ("a", bytearray(IMAGE), None), (None, bytearray(LATIN), None)]
    pages = spark.createDataFrame(rows, "page_id string, html binary, seen string").select("page_id", F.lit("http://x").alias("url"), "html", F.to_timestamp("seen").alias("seen"))
    warc.write_arc(pages, str(tmp_path / "arc"), date_col="seen")
    warc.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), id_type="string")
    found = warc.read_warc(spark, str(tmp_path / "warc"), id_type="string").collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found} == {("b%201", "response", None), ("a", "revisit", "b%201"), (None, "response", None)}
    assert {bytes(r["payload"]) for r in found if r["payload"] is not None} == {IMAGE, LATIN}
    assert {f["warc-date"] for f, _ in heads(spark, str(tmp_path / "warc")).values() if f["warc-type"] == "response"} == {"2001-02-03T04:05:06Z", "2024-01-01T00:00:00Z"}


def test_digests_of_crawlers_and_broken_header_lines(spark, tmp_path):
    body = b"hello"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    record = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha1:{sha}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(record)
    row = warc.read_warc(spark, str(tmp_path / "w")).first()
    assert (row["payload_digest"], row["payload_bytes"], row["page_id"]) == (hashlib.sha1(body).hexdigest(), 5, None)
    parts = archive(1, RECORDS[:2])
    assert len(list(warc.arc_records(b"".join(parts) + b"\nhttp://tail 10.0.0.1 1997"))) == 3
    with pytest.raises(ValueError, match="no ARC header line at byte"):
        list(warc.arc_records(b"".join(parts) + b"\nno header line\nmore"))

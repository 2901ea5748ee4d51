"""Legacy archives: ARC files written, converted to WARC, and read back.

ARC 1 and 2 records are found by their version-specific header line and the
length it declares. Each becomes a WARC 1.1 record with an identifier, a
timestamp, a type and digests made from what the old header holds; an HTTP
message is a response or revisit, another block a resource, and the version block
of a file becomes a warcinfo record. Blocks are bytes all the way, so images and
pages in any encoding stay as they are. Records are gathered into files of about
FILE_CHARS bytes, and Spark's text sink writes each as one row, so a file is never
much larger than one task can hold: a record longer than that stands alone in its
file.

Old archives are read as they come: gzipped as a whole, a member a record or not
at all, header lines that end in LF or CRLF, blanks in urls, dates of 8 to 14
digits. A file that breaks off keeps its last record as far as it goes, marked as
truncated; a header line without a length stops the job, naming file and byte.

Defined cases: a null or empty html has an empty payload, which is a response of
0 bytes; a null url is written as `-`; repeated rows are records of their own;
among equal payloads rows of the largest id are all responses, a null id only
where no other row has one; ids are numbers unless `id_type` says otherwise, and
what isn't of that type is null; an empty table gives an empty archive and an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import discard, new_path, table

LEAST_BYTES = 1000
FILE_CHARS = 16_000_000
ARC_DATE = "20240101000000"
SALTS = 32

# The field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = "\r\n\r\n"
LEVEL = 3  # 5% longer than by the default level, in under half the time
GZIP = {"maxRecordsPerFile": 1, "compression": "gzip", "zlib.compress.level": "THREE"}
MEMBERS = {"maxRecordsPerFile": 1, "compression": "none", "lineSep": "\0"}  # gzip takes zeros at the end of a file as padding
HEAD_END = re.compile(rb"\r?\n\r?\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(records: Iterator, between, opening="") -> Iterator[pd.DataFrame]:
    """Files, of bytes or texts: records one after another, after `opening` in
    each, a new file where the next record would make it longer than FILE_CHARS."""
    parts, size = [], 0
    for record in records:
        if parts and size + len(record) > FILE_CHARS:
            yield pd.DataFrame({"value": [opening + between.join(parts)]})
            parts, size = [], 0
        parts.append(record)
        size += len(record)
    if parts:
        yield pd.DataFrame({"value": [opening + between.join(parts)]})


def _escaped(text: str) -> str:
    """`text` with its white space and control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " else c for c in text)


def write_arc(pages: DataFrame, path: str, version: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> None:
    """Write pages as gzipped ARC files, each with a version block of its own.

    The page's id travels in an HTTP header of its record. Null urls are
    written as `-`; white space in urls and ids is percent-encoded, as header
    lines are split at blanks; a null html has an empty payload. Pages are
    strings or bytes; dates are `date_col`'s, a timestamp, or ARC_DATE.
    """
    extra = " 200 - - 0 -" if version == 2 else ""
    about = f"{version} 0 lodestone\n{ARC_FIELDS[version]}\n"
    opening = f"filedesc://lodestone.arc 0.0.0.0 {ARC_DATE} text/plain{extra} {len(about)}\n{about}\n".encode()

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[bytes]:
        for batch in batches:
            for page_id, url, date, body in zip(batch["page_id"], batch["url"], batch["date"], batch["body"], strict=True):
                body = b"" if body is None else body
                known = f"X-Page-Id: {_escaped(page_id)}\r\n" if isinstance(page_id, str) else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(body)}\r\n\r\n".encode()
                address = _escaped(url) if isinstance(url, str) and url else "-"
                yield f"{address} 0.0.0.0 {date} text/html{extra} {len(head) + len(body)}\n".encode() + head + body

    date = F.lit(ARC_DATE) if date_col is None else F.coalesce(F.date_format(date_col, "yyyyMMddHHmmss"), F.lit(ARC_DATE))
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), date.alias("date"), F.col(html_col).cast("binary").alias("body"))
    _write(rows.mapInPandas(lambda batches: _files(records(batches), b"\n", opening), "value binary"), path, **GZIP)


def _write(files: DataFrame, path: str, **options) -> None:
    """Each row's bytes as a file: the text sink writes a string's bytes as they are."""
    files.select(F.col("value").cast("string")).write.options(**options).text(path)


def _unpacked(content: bytes) -> bytes:
    """A file's bytes, of all its gzip members; one that breaks off, as far as it goes."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts) if parts else bytes(content)


def arc_records(data: bytes) -> Iterator[tuple[str, str, str, str, bytes, bool]]:
    """(url, ip, date, content type, block, truncated) of each record, the
    version block among them, whose field line says how many fields the header
    lines after it have."""
    at, width = 0, 5
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        opens = line.startswith(b"filedesc://")
        head = line.split(b" ") if opens else line.rsplit(b" ", width - 1)
        if end < 0 and (len(head) < width or not head[-1].isdigit()):
            return  # the file breaks off within a header line
        if not head[-1].isdigit() or not opens and len(head) != width:
            raise ValueError(f"no ARC header line at byte {at}: it needs {width} fields, the last one a length")
        start = end + 1 if end >= 0 else len(data)
        length = int(head[-1])
        block = data[start : start + length]
        at = start + length
        if opens:
            fields = block.split(b"\n")[1].split() if block.count(b"\n") else []
            width = len(fields) or width
        yield _address(head[0]), *(x.decode("ascii", "replace") for x in head[1:4]), block, len(block) < length


def _address(url: bytes) -> str:
    """A url as text; bytes that aren't UTF-8, and white space, percent-encoded."""
    try:
        return _escaped(url.decode("utf-8"))
    except UnicodeDecodeError:
        return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url)


def _http(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields of an HTTP message and where its payload begins; none and
    0 if the block isn't one."""
    end = HEAD_END.search(block) if block.startswith(b"HTTP/") else None
    if end is None:
        return {}, 0
    lines = block[: end.start()].decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end.end()


def _frames(rows: Iterator[tuple], columns: list[str], size) -> Iterator[pd.DataFrame]:
    """`rows` in frames of about FILE_CHARS by `size` of a row."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += size(row)
        if held > FILE_CHARS:
            yield pd.DataFrame(out, columns=columns)
            out, held = [], 0
    yield pd.DataFrame(out, columns=columns)


def read_arc(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Records of gzipped or plain ARC files, found by declared length: head
    and body are the bytes of an HTTP message up to its payload and after, and
    an empty head and the block where it is none."""
    columns = ["page_id", "url", "ip", "date", "kind", "truncated", "record", "head", "body", "payload_bytes", "payload_digest"]

    def records(name: str, content: bytes) -> Iterator[tuple]:
        try:
            for n, (url, ip, date, kind, block, truncated) in enumerate(arc_records(_unpacked(content))):
                fields, start = _http(block)
                body = block[start:]
                number = hashlib.sha1(f"{name} {n} {url}".encode()).digest()
                yield fields.get("x-page-id"), url, ip, date, kind, truncated, str(uuid.UUID(bytes=number[:16], version=5)), block[:start], body, len(body), hashlib.sha1(body).hexdigest()
        except (ValueError, zlib.error) as error:
            raise ValueError(f"{name}: {error}") from error

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield from _frames(records(name, content), columns, lambda row: len(row[7]) + len(row[8]))

    schema = "page_id string, url string, ip string, date string, kind string, truncated boolean, record string, head binary, body binary, payload_bytes long, payload_digest string"
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)
    return found.withColumn("page_id", F.col("page_id").try_cast(id_type))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_BYTES, id_type: str = "long", members: bool = False) -> None:
    """Convert ARC files to gzipped WARC 1.1, with a gzip member a file or,
    with `members`, a record.

    Of responses with equal payloads of `least_bytes` or more, the one with the
    largest page id stays one and the others are revisits that point to it;
    smaller payloads are all responses. Rows that repeat the largest page id
    are all responses; records without an id never are while another has one.
    Resources and truncated records neither are revisits nor have any.
    """
    opens, whole = F.col("url").startswith("filedesc://"), (F.octet_length("head") > 0) & ~F.col("truncated")
    records = read_arc(spark, arc_path, id_type).withColumn("shared", whole & ~opens & (F.col("payload_bytes") >= least_bytes))
    groups = (
        records.filter("shared")
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.max_by("record", F.struct("page_id", "record")).alias("first_record"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    again = F.coalesce(F.col("shared") & F.col("first_record").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    digits = F.substring(F.regexp_replace("date", r"\D", ""), 1, 14)
    full = F.when(F.length(digits) >= 8, F.rpad(digits, 14, "0")).otherwise("19700101000000")
    stamp = F.regexp_replace(full, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(F.col("again"), F.col("head")).otherwise(F.concat("head", "body"))
    # One payload may be that of a third of all records: they meet its first record by salt.
    salted = records.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = salted.join(groups, ["payload_digest", "salt"], "left").withColumn("again", again).withColumn("block", block)
    kind = F.when(opens, "warcinfo").when(F.col("again"), "revisit").when(F.octet_length("head") > 0, "response").otherwise("resource")
    content = F.when(F.octet_length("head") > 0, "application/http; msgtype=response").when(F.trim("kind") == "", "application/octet-stream").otherwise(F.col("kind"))
    address = F.concat(line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record", F.lit(">"))),
        line("WARC-Date", stamp),
        F.when(opens, line("WARC-Filename", F.substring_index("url", "/", -1))).otherwise(address),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        F.when(F.col("truncated"), line("WARC-Truncated", F.lit("unspecified"))).otherwise(""),
        F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), "first_record", F.lit(">"))), F.coalesce(line("X-Refers-To-Page-Id", F.col("first_id").cast("string")), F.lit("")))).otherwise(""),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", content),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    made = rows.select(F.concat(F.encode(text, "utf-8"), "block").alias("value"))
    end = RECORD_END.encode()
    if members:
        _write(made.mapInPandas(lambda batches: _files((gzip.compress(r + end, LEVEL) for b in batches for r in b["value"]), b"", b""), "value binary"), warc_path, **MEMBERS)
    else:
        _write(made.mapInPandas(lambda batches: _files((r for b in batches for r in b["value"]), end, b""), "value binary"), warc_path, lineSep=RECORD_END, **GZIP)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by its declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} is not as long as it says")
        yield fields, block
        at = end + 8 + length


def _digest(value: str) -> str:
    """The hex digits of `sha1:` and a digest in hex or, as crawlers write it, base 32."""
    value = value.partition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def read_warc(spark: SparkSession, path: str, id_type: str = "long", infos: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    record, truncated, payload of each record, warcinfo records among them if
    `infos`. A digest is taken from the payload and must equal the header's, if
    that has one; a revisit has the digest and length of the payload it stands
    for, and no payload."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record", "truncated", "payload"]

    def records(content: bytes) -> Iterator[tuple]:
        for fields, block in warc_records(_unpacked(content)):
            if fields["warc-type"] == "warcinfo" and not infos:
                continue
            http, start = _http(block)
            said, declared, payload = fields.get("warc-payload-digest"), fields.get("x-payload-length"), None
            if fields["warc-type"] == "revisit":
                size, digest = declared or http.get("content-length"), said and _digest(said)
            else:
                payload = block[start:]
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                if said and _digest(said) != digest or declared and int(declared) != size:
                    raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest or length")
            yield http.get("x-page-id"), None if size is None else int(size), digest, fields["warc-type"], fields.get("x-refers-to-page-id"), fields.get("warc-target-uri"), fields["warc-record-id"], "warc-truncated" in fields, payload

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from _frames(records(content), columns, lambda row: len(row[8] or b""))

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, record string, truncated boolean, payload binary"
    parsed = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)
    return parsed.withColumns({"page_id": F.col("page_id").try_cast(id_type), "refers_to": F.col("refers_to").try_cast(id_type)})


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files hold."""
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc)
    discard(spark, arc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM g
"""

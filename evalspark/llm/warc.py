"""Legacy archive converter: ARC files to WARC files, and readers of both.

ARC (versions 1 and 2) puts one header line before each record: url, address, date, type and length, in version 2
with status, checksum, location, offset and file name. The reader takes the fields that the file's version block
announces (without one, those that the line's width tells) and exactly as many bytes as the line declares, so text
inside a payload that looks like a header is never taken for one. Each record becomes a WARC record with a
synthesised id, date, type and digests; of records with equal payloads one stays a response, the others revisit it.

Archives are written by Spark's text writer and listed by its binary-file reader, so any file system that Spark
knows will do. One task reads one file at a time, as a stream; a file is about as large as the split it came from.

Edge cases. A null payload is an empty one; a null url or one with white space is escaped or replaced by
``unknown:``. A record whose declared length runs past the end of its file is kept with ``error`` set to
``truncated``; a line that is no header gives a row with ``error`` ``malformed`` and reading goes on at the next
line. Rows with an error are never converted; ``arc_records`` shows them. Repeated rows are separate records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

CRLF = "\r\n"
BATCH_BYTES = 4 << 20
SCAN = r"[\s\x00-\x1f\x7f]"

# Header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

ARC_SCHEMA = (
    "arc_file string, arc_offset long, version int, record_id string, url string, ip string, date string, mime string, "
    "http boolean, order_key long, payload_bytes long, payload_digest string, error string, block binary")
WARC_SCHEMA = (
    "record_id string, record_type string, url string, date string, order_key long, payload_bytes long, "
    "payload_digest string, refers_to_id string, intact boolean, payload binary")


# ---- writing ----

def _first_row() -> F.Column:
    """True for the first row of each task, which is the first record of each file."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0


def _write_gzip(rows: DataFrame, path: str) -> None:
    """Rows of text as they are, each ended by a line feed; fast compression, since archives are read soon and once."""
    rows.write.options(compression="gzip", lineSep="\n", **{"zlib.compress.level": "BEST_SPEED"}).text(path)


def http_block(html: F.Column, key: F.Column) -> F.Column:
    """An HTTP response around a page; the key travels in a header of its own."""
    body = F.coalesce(html, F.lit(""))
    named = F.when(key.isNotNull(), F.concat(F.lit("X-Page-Id: "), key.cast("string"), F.lit(CRLF))).otherwise("")
    return F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF), named,
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF), body)


def write_arc(pages: DataFrame, path: str, version: int, date: str = "20000101000000") -> None:
    """Write pages (page_id, url, html) as gzipped ARC files of one version, a file per input split."""
    safe = F.regexp_replace(F.col("url"), SCAN, "%20")
    url = F.when(F.length(safe) > 0, safe).otherwise(F.concat(F.lit("unknown:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))
    fields = {
        "url": F.col("address"), "ip": F.lit("0.0.0.0"), "date": F.lit(date), "mime": F.lit("text/html"), "status": F.lit("200"),
        "checksum": F.lit("-"), "location": F.lit("-"), "offset": F.lit("0"), "filename": F.lit("pages.arc"),
        "length": F.octet_length("block").cast("string")}
    about = f"{version} 0 origin\n{ARC_TITLES[version]}\n"
    opening = f"filedesc://pages.arc 0.0.0.0 {date} text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}{len(about)}\n{about}\n"
    rows = pages.select(url.alias("address"), http_block(F.col("html"), F.col("page_id")).alias("block"))
    line = F.concat_ws(" ", *[fields[name] for name in ARC_FIELDS[version]])
    _write_gzip(rows.select(F.concat(F.when(_first_row(), opening).otherwise(""), line, F.lit("\n"), F.col("block"))), path)


def _urn(column: str) -> F.Column:
    return F.concat(F.lit("<urn:uuid:"), F.col(column), F.lit(">"))


def _base32(digest: F.Column) -> F.Column:
    """The usual spelling of a hex SHA-1 in WARC headers: base 32, five bits a letter."""
    bits = F.lpad(F.conv(F.substring(digest, 1, 10), 16, 2), 40, "0")
    for i in range(1, 4):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 2), 40, "0"))
    letters = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.array_join(letters, "")


def write_warc(records: DataFrame, path: str) -> None:
    """Write converted records (see ``convert``) as gzipped WARC files, a file per input split."""
    def head(name: str, value: F.Column) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise("")

    block = F.when(F.col("record_type") == "revisit", F.col("http_head")).otherwise(F.col("block"))
    info = "software: evalspark" + CRLF
    opening = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: warcinfo" + CRLF), head("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        head("WARC-Date", F.col("warc_date")), F.lit(f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(info)}{CRLF}{CRLF}{info}{CRLF}{CRLF}"))
    is_revisit = F.col("record_type") == "revisit"
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), head("WARC-Type", F.col("record_type")), head("WARC-Record-ID", _urn("record_id")),
        head("WARC-Date", F.col("warc_date")), head("WARC-Target-URI", F.col("url")), head("WARC-IP-Address", F.col("ip")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest32"))),
        head("WARC-Profile", F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        head("WARC-Refers-To", F.when(is_revisit, _urn("refers_to_id"))),
        head("WARC-Truncated", F.when(F.col("truncated"), "unspecified")),
        head("Content-Type", F.when(F.col("http"), "application/http; msgtype=response").otherwise(F.col("mime"))),
        head("Content-Length", F.octet_length("body").cast("string")), F.lit(CRLF))
    rows = records.withColumn("body", block)
    text = F.concat(F.when(_first_row(), opening).otherwise("").cast("binary"), header.cast("binary"), F.col("body"), F.lit(CRLF + "\r").cast("binary"))
    _write_gzip(rows.select(text.cast("string").alias("value")), path)


# ---- reading ----

def _opened(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else io.BufferedReader(raw)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload of an HTTP response; a block without one is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    if not ends:
        return block, b""
    at, width = min(ends)
    return block[: at + width], block[at + width :]


def http_field(head: bytes, name: bytes) -> int | None:
    for line in head.split(b"\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name and value.strip().removeprefix(b"-").isdigit():
            return int(value)
    return None


# A header line up to its content type: an url may hold blanks, the address and the date after it may not.
OPENING = re.compile(r"(.*) (\S+) (\d{8,17}) (.*)", re.S)


def arc_header(text: str, version: int | None) -> tuple[int, dict[str, str]] | None:
    """Version and fields of a header line, or None. Without a version block the version is told from the line."""
    for kind in [version] if version else sorted(ARC_FIELDS, reverse=True):
        names = ARC_FIELDS[kind]
        opening, *rest = text.rsplit(" ", len(names) - 4)
        exact = text.split(" ")
        found = OPENING.fullmatch(opening)
        if len(exact) == len(names):
            values = exact
        elif found and len(rest) == len(names) - 4:
            values = [*found.groups(), *rest]
        else:
            continue
        if values[-1].isdigit() and (version or len(exact) == len(names) or (kind == 1) or values[4].isdigit()):
            return kind, dict(zip(names, values))
    return None


def parse_arc(name: str, content: bytes, key_header: bytes = b"x-page-id") -> Iterator[dict]:
    """The records of one ARC file, in order, without its version block.

    Lines that are no header give a row with the error ``malformed``; if such a line ends in a length like a header's, as
    many bytes are passed over, so that its payload is not read as headers.
    """
    stream, version, offset = _opened(content), None, 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        text = line.decode("utf-8", "replace").strip("\r\n")
        if not text:
            continue
        header = arc_header(text, version)
        if header is None:
            values = text.split(" ")
            if len(values) >= len(ARC_FIELDS[1]) and values[-1].isdigit():
                offset += len(stream.read(int(values[-1])))
            yield {"arc_file": name, "arc_offset": start, "version": version, "error": "malformed"}
            continue
        kind, fields = header
        block = stream.read(int(fields["length"]))
        offset += len(block)
        whole = len(block) == int(fields["length"])
        if fields["url"].startswith("filedesc:") and fields["mime"] == "text/plain":
            if (mark := block[:1]).isdigit() and int(mark) in ARC_FIELDS:
                version = int(mark)
            continue
        head, payload = split_http(block)
        yield {
            "arc_file": name, "arc_offset": start, "version": kind, "url": fields["url"], "ip": fields["ip"], "date": fields["date"],
            "mime": fields["mime"], "http": bool(head), "order_key": http_field(head, key_header), "payload_bytes": len(payload),
            "record_id": str(uuid.UUID(bytes=hashlib.sha1(f"{name} {start} {text}".encode()).digest()[:16], version=5)),
            "payload_digest": hashlib.sha1(payload).hexdigest(), "error": None if whole else "truncated", "block": block}


def parse_warc(content: bytes, key_header: bytes = b"x-page-id") -> Iterator[dict]:
    """The response, revisit and resource records of one WARC file, in order."""
    stream = _opened(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            fields[key.strip().lower()] = value.strip().decode("utf-8", "replace")
        block = stream.read(int(fields.get(b"content-length", "0")))
        kind = fields.get(b"warc-type")
        if kind not in ("response", "revisit", "resource"):
            continue
        head, payload = split_http(block)
        named = fields.get(b"warc-payload-digest", "").partition(":")[2]
        stated = base64.b32decode(named).hex() if named else None
        own = hashlib.sha1(payload).hexdigest()
        revisit = kind == "revisit"
        yield {
            "record_id": fields.get(b"warc-record-id", "").removeprefix("<urn:uuid:").rstrip(">"), "record_type": kind,
            "url": fields.get(b"warc-target-uri"), "date": fields.get(b"warc-date"), "order_key": http_field(head, key_header),
            "payload_bytes": http_field(head, b"content-length") if revisit else len(payload),
            "payload_digest": stated if revisit else own,
            "refers_to_id": fields[b"warc-refers-to"].removeprefix("<urn:uuid:").rstrip(">") if b"warc-refers-to" in fields else None,
            "intact": revisit or stated in (None, own), "payload": None if revisit else payload}


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def _read(spark: SparkSession, paths: list[str], ddl: str, parse, drop: list[str], extra: str | None = None) -> DataFrame:
    """Parse every file below the paths; rows leave a task in batches of bounded size."""
    kept = ", ".join(f for f in ddl.split(", ") if f.split()[0] not in drop)
    schema = _arrow_schema(kept)

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for row in parse(path.as_py(), content.as_py()):
                    held.append({name: row.get(name) for name in schema.names})
                    size += 300 + sum(len(row.get(n) or b"") for n in ("block", "payload") if n in schema.names)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,arc,warc}").load(paths)
    return files.select("path", "content").mapInArrow(rows, kept)


def arc_records(spark: SparkSession, paths: list[str], with_block: bool = True) -> DataFrame:
    """One row per ARC record (and per malformed header line); without blocks the rows are narrow."""
    return _read(spark, paths, ARC_SCHEMA, parse_arc, [] if with_block else ["block"])


def warc_records(spark: SparkSession, paths: list[str], with_payload: bool = True) -> DataFrame:
    """One row per response, revisit or resource record; ``intact`` says whether payload and digest agree."""
    return _read(spark, paths, WARC_SCHEMA, lambda _, content: parse_warc(content), [] if with_payload else ["payload"])


# ---- conversion ----

def find_revisits(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(record_id, refers_to_id) of the records whose payload another record keeps.

    Of records with equal digest and length of at least ``min_bytes``, the one with the largest order key stays
    (ties: the largest record id). Only digests move; groups are folded in the map tasks, and the join that
    follows has one row per group on one side, so Spark can split a hot digest.
    """
    sound = records.where(F.col("error").isNull() & (F.col("payload_bytes") >= min_bytes))
    first = sound.groupBy("payload_digest", "payload_bytes").agg(
        F.max(F.struct(F.coalesce("order_key", F.lit(-(1 << 63))).alias("order_key"), "record_id")).alias("kept"), F.count(F.lit(1)).alias("n"))
    groups = first.where("n > 1").select("payload_digest", "payload_bytes", F.col("kept.record_id").alias("refers_to_id"))
    return sound.join(groups, ["payload_digest", "payload_bytes"]).where("record_id != refers_to_id").select("record_id", "refers_to_id")


def convert(records: DataFrame, revisits: DataFrame) -> DataFrame:
    """ARC records with their blocks -> rows for ``write_warc``: type, ISO date, digest and what is referred to."""
    digits = F.rpad(F.regexp_replace("date", r"[^0-9]", ""), 14, "0")
    when = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))
    body_start = F.octet_length("block") - F.col("payload_bytes").cast("int")
    return records.where("error is null or error = 'truncated'").join(revisits, "record_id", "left").select(
        "record_id", "url", "ip", "mime", "http", "block", "refers_to_id", F.col("error").isNotNull().alias("truncated"),
        F.when(F.col("refers_to_id").isNotNull(), "revisit").when(F.col("http"), "response").otherwise("resource").alias("record_type"),
        F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("warc_date"),
        F.substring("block", F.lit(1), body_start).alias("http_head"), _base32(F.col("payload_digest")).alias("digest32"))


def convert_archives(spark: SparkSession, paths: list[str], target: str, min_bytes: int = 1000) -> None:
    """Convert all ARC files below ``paths`` to WARC files in ``target``.

    The files are parsed twice: once for the digests alone, once for the blocks. Blocks are shuffled only when
    the table of revisits is too large to broadcast.
    """
    revisits = stored(find_revisits(stored(arc_records(spark, paths, with_block=False), "arc-index"), min_bytes), "revisits")
    write_warc(convert(arc_records(spark, paths), revisits), target)


def archive_pages(spark: SparkSession, pages: DataFrame, label: str = "pages", min_bytes: int = 1000) -> DataFrame:
    """Pages through legacy archives of both versions into WARC files; the records as read back, without payloads.

    Columns: those of ``warc_records`` and ``refers_to``, the order key of the record that a revisit refers to.
    """
    odd = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2))
    legacy = [scratch(spark, f"{label}-arc{v}") for v in (1, 2)]
    for version, path in zip((1, 2), legacy):
        write_arc(pages.where(odd == version - 1), path, version)
    target = scratch(spark, f"{label}-warc")
    convert_archives(spark, legacy, target, min_bytes)
    records = stored(warc_records(spark, [target], with_payload=False), f"{label}-index")
    named = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("order_key").alias("refers_to"))
    pointed = stored(records.where("refers_to_id is not null").select("refers_to_id").distinct(), f"{label}-pointed")
    return records.join(named.join(pointed, "refers_to_id"), "refers_to_id", "left")

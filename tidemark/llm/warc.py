"""Converter from legacy ARC archives to WARC, with revisit records for repeated payloads, and readers for both.

Archives are written by Spark's text writer, a record per row and the format's record separator as the line separator,
and read as whole files, which are kept to about ``FILE_BYTES`` of payload each; so any file system that Spark reaches
will do, and a lost executor costs the files in its hands. Records are cut out by their declared lengths, never by
searching for separators, which payloads may contain.

ARC files begin with a version block that names the fields of the header lines that follow: version 1 has URL, address,
date, type and length, version 2 also result code, checksum, location, offset and file name. A header line is split from
the right by the number of fields of its version, so spaces in an address of a page do no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hint, row_key

FILE_BYTES = 32 << 20
OUT_ROWS = 256
LEAST_REVISIT = 100

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_BLOCK = "application/http; msgtype=response"

ID_HEADER = "X-Record-Id"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for addresses

GZIP = b"\x1f\x8b"
UNPACK_BYTES = 1 << 16
MOST_SAID = 5
DAMAGED = "damaged"
NEEDED = {"warc-record-id", "warc-date", "warc-payload-digest"}
RECORD = (
    "uri string, record_id string, ip string, date string, mime string, status string, kind string, "
    "digest string, payload_bytes long, http binary, payload binary, id string, refers_to string"
)


# --- Writing ARC ----------------------------------------------------------------------------------------------------


def _arc_rows(version: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = version or 1 + part % 2
        name = f"part-{part:05d}-v{kind}.arc"
        about = f"{kind} 0 tidemark\n{ARC_FIELDS[kind]}\n".encode()
        extra = f" 200 - - 0 {name}" if kind == 2 else ""
        head = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{extra} {len(about)}\n".encode()
        out, at = [head + about], len(head) + len(about) + 1
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["payload"] or b""
                http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
                if row["id"] is not None:
                    http.append(f"{ID_HEADER}: {row['id']}")
                block = ("\r\n".join(http) + "\r\n\r\n").encode() + payload
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["uri"] or "-")
                fields = [uri, row["ip"] or "0.0.0.0", row["date"] or "19700101000000", "text/html"]
                if kind == 2:
                    fields += ["200", hashlib.md5(block).hexdigest(), "-", str(at), name]
                line = " ".join([*fields, str(len(block))]).encode("utf-8", "surrogatepass") + b"\n"
                out.append(line + block)
                at += len(line) + len(block) + 1
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_arc(
    pages: DataFrame, path: str, id_col: str, uri_col: str, payload_col: str, date: Column, ip: Column, version: int | None = None
) -> None:
    """Write pages as ARC files of the given version (None: versions in turn), compressed.

    Null payloads are empty, null identifiers leave their header out, a null address is ``-``.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(uri_col).cast("string").alias("uri"),
        F.date_format(date, "yyyyMMddHHmmss").alias("date"), ip.alias("ip"), payload.cast("binary").alias("payload"),
    )
    files = max(1, -(-(pages.agg(F.sum(F.octet_length(payload))).first()[0] or 0) // FILE_BYTES))
    lines = rows.repartition(int(files)).mapInArrow(_arc_rows(version), "value binary")
    lines.select(F.col("value").cast("string")).write.option("compression", "gzip").text(path)


# --- Reading --------------------------------------------------------------------------------------------------------


def _plain(content: bytes, problems: list[str]) -> bytes:
    """The content of a file, unpacked as far as it can be; what stops that is added to ``problems``."""
    if content[:2] != GZIP:
        return content
    parts = []
    while content[:2] == GZIP:
        unpack = zlib.decompressobj(31)
        rest = memoryview(content)
        try:
            while len(rest) and not unpack.eof:
                parts.append(unpack.decompress(rest[:UNPACK_BYTES]))
                rest = rest[UNPACK_BYTES:]
        except zlib.error as error:
            problems.append(f"compressed data is broken: {error}")
            break
        if not unpack.eof:
            problems.append("the file ends within compressed data")
            break
        # Another member may follow.
        content = unpack.unused_data + bytes(rest)
    return b"".join(parts)


def arc_records(content: bytes, problems: list[str] | None = None) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Header fields by name, block and offset of each record after the version block.

    A line that is no header of the file's version is skipped; a block that the file ends within is cut there. Both, and
    a file without a version block, are added to ``problems``.
    """
    problems = [] if problems is None else problems
    at = content.find(b"\n") + 1
    declared = content[:at].strip().rsplit(b" ", 1)[-1]
    if not declared.isdigit():
        problems.append("there is no version block")
        return
    length = int(declared)
    about = content[at : at + length].split(b"\n")
    names = about[1].decode().split(" ") if len(about) > 1 else []
    at += length
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        values = content[at:end].decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        fields = dict(zip(names, values, strict=False))
        if len(values) == len(names) and values[-1].isdigit() and re.fullmatch(r"\d{8,14}", fields["Archive-date"]):
            if end + 1 + int(values[-1]) > len(content):
                problems.append(f"the file ends within the record at {at}")
            yield fields, content[end + 1 : end + 1 + int(values[-1])], at
            at = end + 1 + int(values[-1])
        else:
            if content[at:end].strip():
                problems.append(f"no header at {at}")
            at = end + 1


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """The head of an HTTP message with its blank line, its body, and its header fields in lower case."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    cut = block.find(b"\r\n\r\n")
    cut = len(block) if cut < 0 else cut + 4
    return block[:cut], block[cut:], _fields(block[:cut])


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs if name.strip()}


def _damaged(name: str, problems: list[str]) -> Iterator[tuple]:
    """A row for a file that could not be read in full: its name, and the first problems and their number."""
    if problems:
        said = "; ".join(problems[:MOST_SAID]) + (f"; {len(problems) - MOST_SAID} more" if len(problems) > MOST_SAID else "")
        empty = hashlib.sha256(b"").hexdigest()
        yield (name, str(uuid.uuid5(NAMESPACE, f"{name} damaged")), None, None, said, None, DAMAGED, empty, 0, None, None, None, None)


def _from_arc(name: str, content: bytes, whole: bool) -> Iterator[tuple]:
    problems: list[str] = []
    for fields, block, at in arc_records(_plain(content, problems), problems):
        head, payload, http = _http(block)
        uri = fields["URL"]
        date = fields["Archive-date"].ljust(14, "0")
        digest = hashlib.sha256(payload).hexdigest()
        yield (
            None if uri == "-" else uri,
            str(uuid.uuid5(NAMESPACE, f"{name}#{at} {uri} {date}")),
            fields["IP-address"],
            f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
            fields["Content-type"],
            fields.get("Result-code"),
            "response" if head else "resource",
            digest,
            len(payload),
            head if whole else None,
            payload if whole else None,
            http.get(ID_HEADER.lower()),
            None,
        )
    yield from _damaged(name, problems)


def _from_warc(name: str, content: bytes, whole: bool) -> Iterator[tuple]:
    problems: list[str] = []
    content, at = _plain(content, problems), 0
    while 0 <= (at := content.find(WARC_VERSION.encode(), at)):
        end = content.find(b"\r\n\r\n", at) + 4
        fields = _fields(content[at:end]) if end >= 4 else {}
        kind = fields.get("warc-type")
        if kind is None or not fields.get("content-length", "").isdigit() or (kind != "warcinfo" and not fields.keys() >= NEEDED):
            problems.append(f"no header at {at}")
            at += len(WARC_VERSION)
            continue
        block = content[end : end + int(fields["content-length"])]
        start, at = at, end + len(block)
        if kind == "warcinfo":
            continue
        head, payload, http = _http(block)
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
            problems.append(f"the payload of the record at {start} does not match its digest")
            continue
        yield (
            fields.get("warc-target-uri"),
            fields["warc-record-id"].removeprefix("<urn:uuid:").rstrip(">"),
            fields.get("warc-ip-address"),
            fields["warc-date"],
            fields.get("content-type"),
            None,
            kind,
            digest,
            int(http.get("content-length", "0")) if kind == "revisit" else len(payload),
            head if whole else None,
            payload if whole else None,
            http.get(ID_HEADER.lower()),
            fields.get("warc-refers-to", "").removeprefix("<urn:uuid:").rstrip(">") or None,
        )
    yield from _damaged(name, problems)


def _read(spark: SparkSession, path: str, parse, whole: bool) -> DataFrame:
    schema = [x.split(" ")[0] for x in RECORD.split(", ")]
    types = [pa.int64() if x == "payload_bytes" else pa.binary() if x in ("http", "payload") else pa.string() for x in schema]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, content in zip(files.column("path"), files.column("content"), strict=True):
                rows: list[tuple] = []
                for row in parse(name.as_py().rsplit("/", 1)[1], content.as_py(), whole):
                    rows.append(row)
                    if len(rows) >= OUT_ROWS:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, RECORD)


def read_arc(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """The records of ARC files, as WARC will describe them; without heads and payloads unless ``whole``.

    A file that cannot be read in full gives what can be read and a row of kind ``damaged`` with its name as ``uri`` and
    what is wrong as ``mime``. A file is read whole, which Spark does up to 2 gigabytes.
    """
    return _read(spark, path, _from_arc, whole)


def read_warc(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """The records of WARC files but their descriptions; damaged files as in :func:`read_arc`.

    A record whose payload does not match its digest is one that cannot be read.
    """
    return _read(spark, path, _from_warc, whole)


# --- Writing WARC ---------------------------------------------------------------------------------------------------


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
        lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
        return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block

    first = True
    for rows in batches:
        for start in range(0, rows.num_rows, OUT_ROWS):
            out = []
            for row in rows.slice(start, OUT_ROWS).to_pylist():
                if first:
                    info = b"software: tidemark\r\nformat: WARC File Format 1.0\r\n"
                    made = uuid.uuid5(NAMESPACE, f"warcinfo {row['record_id']}")
                    out.append(
                        record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{made}>"), ("WARC-Date", row["date"]), ("Content-Type", "application/warc-fields")], info)
                    )
                    first = False
                revisit = row["original"] is not None
                head = row["http"] or b""
                block = head if revisit else head + (row["payload"] or b"")
                fields = [
                    ("WARC-Type", "revisit" if revisit else row["kind"]),
                    ("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>"),
                    ("WARC-Date", row["date"]),
                    ("WARC-Target-URI", row["uri"]),
                    ("WARC-IP-Address", row["ip"]),
                    ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
                    ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                    ("WARC-Profile", REVISIT_PROFILE if revisit else None),
                    ("WARC-Refers-To", f"<urn:uuid:{row['original']['record_id']}>" if revisit else None),
                    ("WARC-Refers-To-Target-URI", row["original"]["uri"] if revisit else None),
                    ("WARC-Refers-To-Date", row["original"]["date"] if revisit else None),
                    ("Content-Type", HTTP_BLOCK if head else row["mime"]),
                ]
                out.append(record(fields, block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def convert(spark: SparkSession, arc_path: str, warc_path: str, id_type: str = "bigint", least: int = LEAST_REVISIT) -> None:
    """Convert ARC files to WARC files.

    Of records with equal payloads of at least ``least`` bytes, the one with the smallest identifier stays whole (null
    last; of equal identifiers one); the others become revisit records without payload that refer to it. What becomes
    of a record is decided without payloads, so that many copies of one payload never meet; a record's fate is then
    looked up by its own identifier. Of damaged files all is converted that can be read.
    """
    number = F.col("id").try_cast(id_type)
    rank = row_key(number.isNull().alias("unknown"), number.alias("id"), "record_id", "uri", "date")
    scratch = Scratch(spark, "revisits")
    seen = read_arc(spark, arc_path, whole=False).where((F.col("payload_bytes") >= least) & (F.col("kind") == "response"))
    # Written first: only a join of two plain tables is split where a payload is hot.
    seen = scratch.write(seen.select("digest", "payload_bytes", "record_id", rank.alias("rank")), "seen")
    first = seen.groupBy("digest", "payload_bytes").agg(F.min("rank").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.write(first.drop("n"), "first")
    revisits = seen.join(first, ["digest", "payload_bytes"]).where(F.col("original.record_id") != F.col("record_id")).select("record_id", "original")
    revisits = scratch.write(revisits, "revisits")
    records = read_arc(spark, arc_path).where(F.col("kind") != DAMAGED).join(join_hint(revisits), "record_id", "left")
    # A revisit's payload goes no further.
    records = records.withColumn("payload", F.when(F.col("original").isNull(), F.col("payload")))
    lines = records.mapInArrow(_warc_rows, "value binary")
    lines.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc_path)


def archive(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", fetched: Column | None = None, ip: Column | None = None
) -> DataFrame:
    """Write pages as ARC, convert the archives to WARC, and read these back. One row per page.

    Columns: the identifier, ``uri``, ``payload_bytes`` and ``payload_digest`` (SHA-256) of the full payload,
    ``record_type`` (response or revisit) and ``refers_to`` (identifier of the response a revisit refers to). A null
    payload is empty. Rows with null identifiers are archived like others. Of repeated rows one is the response. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    fetched = F.timestamp_seconds(F.lit(0)) if fetched is None else fetched
    write_arc(pages, scratch.path("arc"), id_col, uri_col, payload_col, fetched, F.lit("0.0.0.0") if ip is None else ip)
    convert(spark, scratch.path("arc"), scratch.path("warc"), kind)
    scratch.drop("arc")
    records = scratch.write(read_warc(spark, scratch.path("warc"), whole=False).drop("http", "payload"), "records")
    damaged = records.where(F.col("kind") == DAMAGED).first()
    if damaged:
        raise RuntimeError(f"{damaged['uri']} was not read back: {damaged['mime']}")
    revisited = records.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_id")).distinct()
    names = records.join(revisited, "record_id", "left_semi")
    names = names.select(F.col("record_id").alias("refers_to"), F.col("id").alias("original"))
    return records.join(names, "refers_to", "left").select(
        F.col("id").cast(kind).alias(id_col),
        "uri",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("original").cast(kind).alias("refers_to"),
    )

"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, and both read back.

An archive is a run of records with a header line and a declared length each, so it can only be read from its start; it is
kept compressed, one file a task, and Spark streams its lines. Lines are put together again and cut by the declared
lengths, so text inside a document is never taken for a header. One record is held at a time.

The first record of an ARC file names its version and the fields of the header lines that follow. The conversion derives what
ARC lacks: record identifiers from the archive's name and the record's number, timestamps from the 14 digits, types from the
block (an HTTP answer, a plain resource, the archive's own description), digests from the bytes; of equal payloads one is
a response and the others revisit it. The library itself keeps no web pages, so this operator is general.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movara.functions.joins import attached
from movara.functions.sharing import written

# The fields of a header line by ARC version, and what the formats call things.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: The HTTP header that keeps a capture's number.
CAPTURE_FIELD = "X-Capture-Id"
CAPTURE = re.compile(rb"(?im)^x-capture-id:[ \t]*(-?[0-9]{1,19})[ \t]*\r?$")
#: How archives are compressed: at the quickest level, as they are written once and read once or twice.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Bytes of records returned at once.
BATCH_BYTES = 1 << 23

ARC_RECORD = (
    "archive string, number long, version int, url string, ip string, archived string, mime string, capture_id long, "
    "http binary, payload binary, payload_bytes long, payload_digest string, problem string"
)
WARC_RECORD = (
    "record_id string, record_type string, url string, archived string, refers_to string, capture_id long, refers_to_capture long, "
    "payload_bytes long, payload_digest string, sound boolean"
)


def base32(hexed: Column) -> Column:
    """A hexadecimal SHA-1 in base 32: five digits hold what four digits hold there."""
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX_DIGITS, BASE32_DIGITS)


def write_arc(captures: DataFrame, folder: str) -> None:
    """Captures as ARC files, one a partition; even partitions in version 1, odd ones in version 2.

    ``captures``: ``capture_id`` (long), ``url``, ``captured_at`` (timestamp) and ``payload``. A missing url is ``about:blank``, blanks and
    control characters in it are escaped; a missing time is the epoch's start, a missing payload empty.
    """
    place = F.monotonically_increasing_id()
    second = F.shiftright(place, 33) % 2 == 1
    url = F.coalesce("url", F.lit("about:blank"))
    escaped = F.array_join(
        F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)), ""
    )
    url = F.when(url.rlike(r"[\x00-\x20\x7F]"), escaped).when(url == "", "about:blank").otherwise(url)
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.coalesce(F.concat(F.lit(f"\r\n{CAPTURE_FIELD}: "), F.col("capture_id").cast("string")), F.lit("")),
        F.lit("\r\n\r\n"),
    )
    date = F.date_format(F.coalesce("captured_at", F.timestamp_seconds(F.lit(0))), "yyyyMMddHHmmss")
    length = (F.octet_length(head) + F.octet_length(payload)).cast("string")
    front = F.concat_ws(" ", url, F.lit("0.0.0.0"), date, F.lit("text/html"))
    line = F.when(second, F.concat_ws(" ", front, F.lit("200 - - 0 -"), length)).otherwise(F.concat_ws(" ", front, length))
    described = {}
    for version, fields in ARC_FIELDS.items():
        body = f"{version} 0 movara\n{fields}\n"
        own = "200 - - 0 - " if version == 2 else ""
        described[version] = f"filedesc://captures.arc 0.0.0.0 19700101000000 text/plain {own}{len(body)}\n{body}\n"
    begin = F.when(place.bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.when(second, described[2]).otherwise(described[1])).otherwise("")
    rows = captures.select(F.concat(begin, line, F.lit("\n"), head, payload.cast("string")).alias("value"))
    rows.write.options(**GZIP).option("lineSep", "\n").text(folder)


def _stream(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[tuple[str, bytes]]:
    """The bytes of the files again, from rows (file, block start, line)."""
    for batch in batches:
        files, lines = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        if any(batch.column(1).to_pylist()):
            raise ValueError("an archive was cut between tasks: keep archives compressed")
        at = 0
        while at < len(files):
            end = at + 1
            while end < len(files) and files[end] == files[at]:
                end += 1
            yield files[at], mark.join(lines[at:end]) + mark
            at = end


def _cut(batches: Iterator[pa.RecordBatch], mark: bytes, start) -> Iterator[tuple]:
    """Records of all files: ``start(file)`` gives a function (buffer, place, ended) to (record or None, next place) or None for more bytes."""
    file, buffer, step = None, bytearray(), None

    def taken(ended: bool) -> Iterator[tuple]:
        at = 0
        while at < len(buffer) and (found := step(buffer, at, ended)):
            record, at = found
            if record is not None:
                yield record
        del buffer[:at]

    for own, data in _stream(batches, mark):
        if own != file:
            if file is not None:
                yield from taken(True)
            file, step = own, start(own)
            buffer.clear()
        buffer += data
        yield from taken(False)
    if file is not None:
        yield from taken(True)


def _batches(records: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for record in records:
        rows.append(record)
        held += 256 + size(record)
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _text(value: bytes) -> str:
    return value.decode("utf-8", "replace")


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and the payload; a block that is no answer is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def _capture(http: bytes) -> int | None:
    found = CAPTURE.search(http)
    number = int(found[1]) if found else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def _arc_steps(content: bool):
    """For each ARC file a function that takes the next record."""

    def start(file: str):
        fields, version, number, lost = ARC_FIELDS[1].split(" "), 1, 0, 0

        def row(*values) -> tuple:
            nonlocal number
            number += 1
            return (file, number - 1, version, *values)

        def step(buffer: bytearray, at: int, ended: bool):
            nonlocal fields, version, lost
            while at < len(buffer) and buffer[at] in b"\r\n":
                at += 1
            end = buffer.find(b"\n", at)
            if end < 0:
                return (None, len(buffer)) if ended and at == len(buffer) else None
            line = bytes(buffer[at:end]).rstrip(b"\r")
            if line.startswith(b"filedesc://"):  # it describes itself: the version is told by the number of its fields
                fields = ARC_FIELDS[2 if line.count(b" ") >= 9 else 1].split(" ")
            values = line.rsplit(b" ", len(fields) - 1)
            named = dict(zip(fields, values)) if len(values) == len(fields) else {}
            date, length = named.get("Archive-date", b""), named.get("Archive-length", b"")
            if not (date.isdigit() and 8 <= len(date) <= 17 and length.isdigit() and len(length) < 16 and named["URL"]):
                lost += end + 1 - at  # no header: look for the next one
                if ended and end + 1 >= len(buffer):
                    gone, lost = lost, 0
                    return row(None, None, None, None, None, None, None, gone, None, "damaged"), end + 1
                return None, end + 1
            body, after = end + 1, end + 1 + int(length)
            if after > len(buffer) and not ended:
                return None
            if lost:
                gone, lost = lost, 0
                return row(None, None, None, None, None, None, None, gone, None, "damaged"), at
            block = bytes(buffer[body:after])
            url = _text(named["URL"])
            if url.startswith("filedesc://"):
                lines = block.split(b"\n")
                version = int(lines[0][:1]) if lines[0][:1].isdigit() else 1
                if len(lines) > 1 and b"Archive-length" in lines[1]:
                    fields = _text(lines[1].strip()).split(" ")
                else:
                    fields = ARC_FIELDS.get(version, ARC_FIELDS[1]).split(" ")
            http, payload = _split_http(block)
            problem = "truncated" if after > len(buffer) else None
            held = (http, payload) if content else (None, None)
            facts = (_text(named.get("IP-address", b"")), _text(date), _text(named.get("Content-type", b"")), _capture(http))
            return row(url, *facts, *held, len(payload), _digest(payload), problem), after

        return step

    return start


def _lines(spark: SparkSession, folder: str, mark: str) -> DataFrame:
    return spark.read.option("lineSep", mark).option("recursiveFileLookup", True).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("line")
    )


def read_arc(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """Every record of the ARC files of a folder, its number in its archive and its payload's size and digest.

    Without ``content`` headers and payloads are left out. Bytes between records that are no header give a row whose ``problem``
    is ``damaged`` (``payload_bytes`` many); a record whose file ends before its declared length is ``truncated``.
    """
    schema = pa.schema(
        [("archive", pa.string()), ("number", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()),
         ("archived", pa.string()), ("mime", pa.string()), ("capture_id", pa.int64()), ("http", pa.binary()), ("payload", pa.binary()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_cut(batches, b"\n", _arc_steps(content)), schema, lambda r: len(r[9] or b""))

    return _lines(spark, folder, "\n").mapInArrow(run, ARC_RECORD)


def record_id(archive: Column, number: Column) -> Column:
    """A name-based identifier: the same whenever the archive is converted."""
    name = F.concat_ws("#", F.regexp_extract(archive, "[^/]*$", 0), number.cast("string"))
    h = F.md5(name.cast("binary"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def warc_date(archived: Column) -> Column:
    """The digits of an ARC date as a timestamp; missing ones are zero."""
    return F.regexp_replace(F.rpad(archived, 14, "0"), r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2}).*$", "$1-$2-$3T$4:$5:$6Z")


def repeated_payloads(captures: DataFrame, least: int) -> DataFrame:
    """(``archive``, ``number``) of the captures that revisit another, with the other's place, number, url and date.

    Of equal payloads of ``least`` bytes or more the capture of the largest number is the response, then the latest, then the last read.
    """
    place = F.struct("capture_id", "archived", "archive", "number", "url")
    same = captures.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max(place).alias("first"), F.count("*").alias("n"))
    groups = same.where("n > 1").drop("n")
    named = attached(captures.drop("url"), groups, ["payload_digest", "payload_bytes"], F.struct("archive", "number"))
    other = (F.col("archive") != F.col("first.archive")) | (F.col("number") != F.col("first.number"))
    return named.where(F.col("first").isNotNull() & other).select("archive", "number", "first")


def convert_arcs(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = 0) -> None:
    """The records of all ARC files of a folder as WARC files.

    Two passes: sizes and digests only, written down to find equal payloads; then the records with their contents, each written as its type says.
    The table of revisits is joined by archive and number, one row a record, so no payload is one task's work however
    often it occurs; Spark broadcasts the table only if its written size is small. Damaged stretches are left out.
    """
    light = read_arc(spark, arc_folder, content=False).where("problem IS NULL AND url NOT LIKE 'filedesc://%'")
    facts = written(light.select("archive", "number", "url", "capture_id", "archived", "payload_bytes", "payload_digest"), "captures")
    revisits = written(repeated_payloads(facts, least), "revisits")
    records = read_arc(spark, arc_folder).where("problem IS NULL OR problem = 'truncated'").join(revisits, ["archive", "number"], "left")

    described = F.col("url").startswith("filedesc://")
    answer = F.octet_length("http") > 0
    again = F.col("first").isNotNull()
    kind = F.when(described, "warcinfo").when(again, "revisit").when(answer, "response").otherwise("resource")
    info = F.concat(F.lit("software: movara\r\nformat: WARC File Format 1.1\r\nconvertedFrom: ARC version "), F.col("version").cast("string"), F.lit("\r\n"))
    block = F.when(described, info.cast("binary")).when(again, F.col("http")).otherwise(F.concat("http", "payload"))
    mime = F.when(described, "application/warc-fields").when(answer, "application/http;msgtype=response").when(again, "application/octet-stream").otherwise(
        F.when(F.col("mime").rlike(r"^[\x21-\x7E]+$"), F.col("mime")).otherwise("application/octet-stream")
    )
    rows = records.select(
        "*", kind.alias("kind"), block.alias("block"), record_id(F.col("archive"), F.col("number")).alias("id"), mime.alias("type")
    )
    field = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("kind"),
        field("WARC-Record-ID", F.col("id")),
        field("WARC-Date", warc_date(F.col("archived"))),
        *[
            F.coalesce(F.when(condition, field(name, value)), F.lit(""))
            for name, condition, value in (
                ("WARC-Filename", described, F.regexp_extract("archive", "[^/]*$", 0)),
                ("WARC-Target-URI", ~described, F.col("url")),
                ("WARC-Warcinfo-ID", ~described, record_id(F.col("archive"), F.lit(0))),
                ("WARC-IP-Address", ~described & F.col("ip").rlike("^[0-9A-Fa-f:.]+$"), F.col("ip")),
                ("WARC-Payload-Digest", ~described, F.concat(F.lit("sha1:"), F.col("payload_digest"))),
                ("X-Payload-Length", ~described, F.col("payload_bytes")),
                ("WARC-Truncated", F.col("problem") == "truncated", F.lit("unspecified")),
                ("WARC-Profile", again, F.lit(PROFILE)),
                ("WARC-Refers-To", again, record_id(F.col("first.archive"), F.col("first.number"))),
                ("WARC-Refers-To-Target-URI", again, F.col("first.url")),
                ("WARC-Refers-To-Date", again, warc_date(F.col("first.archived"))),
                ("X-Refers-To-Capture-Id", again, F.col("first.capture_id")),
            )
        ],
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("block")))),
        field("Content-Type", F.col("type")),
        field("Content-Length", F.octet_length("block")),
        F.lit("\r\n\r\n"),
    )
    text = rows.select(F.concat(header, F.col("block").cast("string")).alias("value"))
    text.write.options(**GZIP).option("lineSep", "\r\n\r\n").text(warc_folder)


def _warc_steps(file: str):
    def step(buffer: bytearray, at: int, ended: bool):
        end = buffer.find(b"\r\n\r\n", at)
        if end < 0:
            return (None, len(buffer)) if ended else None
        lines = bytes(buffer[at:end]).split(b"\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        if not lines[0].startswith(b"WARC/") or not named.get(b"content-length", b"").isdigit():
            raise ValueError(f"{file}: no record where one should begin")
        after = end + 4 + int(named[b"content-length"])
        if after > len(buffer):
            if ended:
                raise ValueError(f"{file}: the last record is cut short")
            return None
        block = bytes(buffer[end + 4 : after])
        kind = _text(named[b"warc-type"])
        http, payload = _split_http(block) if kind in ("response", "revisit") else (b"", block)
        digest = _text(named.get(b"warc-payload-digest", b"")).removeprefix("sha1:") or None
        number = lambda name: int(named[name]) if name in named else None
        whole = kind in ("response", "resource")
        record = (
            _text(named[b"warc-record-id"]),
            kind,
            _text(named.get(b"warc-target-uri", b"")) or None,
            _text(named.get(b"warc-date", b"")) or None,
            _text(named.get(b"warc-refers-to", b"")) or None,
            _capture(http),
            number(b"x-refers-to-capture-id"),
            len(payload) if whole else number(b"x-payload-length"),
            digest,
            digest == _digest(payload) if whole and digest else None,
        )
        return record, after + 4

    return step


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the WARC files of a folder; ``sound`` tells whether a full payload has the digest that its header declares.

    A payload that a revisit leaves out has the size and digest that its header keeps. A file that is no WARC raises an error.
    """
    schema = pa.schema(
        [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("archived", pa.string()), ("refers_to", pa.string()),
         ("capture_id", pa.int64()), ("refers_to_capture", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("sound", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_cut(batches, b"\r\n\r\n", _warc_steps), schema, lambda r: 0)

    return _lines(spark, folder, "\r\n\r\n").mapInArrow(run, WARC_RECORD)

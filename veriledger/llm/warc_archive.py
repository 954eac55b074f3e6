"""Legacy archive converter: pages as ARC volumes, ARC volumes as WARC files, WARC files as rows.

``write_arc`` packs pages into ARC volumes of both versions.  ``convert`` parses them: a ``filedesc`` block names the version,
which decides the fields of the header lines that follow (five in version 1, ten in version 2), and each header's declared
length delimits its document, whatever bytes that holds.  For every record it makes up what a WARC record needs: an
identifier from the volume and offset, an ISO timestamp from the digits of the ARC date, a type, and the digests of block
and payload.  Of equal payloads of at least ``SMALLEST`` bytes the record with the smallest ``page_id`` is a response and the others
revisit it; smaller ones are all responses.  ``read_warc`` parses the files again by their declared lengths, checks both digests of
each response, and finds each revisit's response by its identifier.

Files go through Spark's text writer, which takes strings as bytes, commits whole tasks and reaches any store; a file holds
``VOLUMES`` volumes of about ``VOLUME`` bytes, so reading one file at a time bounds a task's memory.  Revisits are found on rows
of a digest and an id; a payload that a third of all pages share is one row per task before the shuffle.  The volumes meet the
revisits among their records as compressed files.

Edge cases: a null html is an empty payload; a null url is ``-``, spaces and control characters in it are percent-encoded.
Of rows that share ``page_id`` and payload, one is the response.  Null ids are kept and count as the largest.  Texts of any length
are whole records.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm.common import discard, materialise, shared_dir

SMALLEST = 100
VOLUME, VOLUMES = 4 << 20, 4
CAPTURED = "20240101000000"

# Fixed values of the formats: fields of an ARC header line by version, and the names of WARC fields below.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_CONTENT = "-"


def _field(text: str | None) -> str:
    """A value of a header line: no spaces, no control characters, nothing outside ASCII."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m.group()[0], (text or NO_CONTENT).encode()).decode() or NO_CONTENT


# ---------------------------------------------------------------- ARC

def _version_block(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    given = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200",
             "Checksum": NO_CONTENT, "Location": NO_CONTENT, "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(given[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def _http_head(page_id: int | None, size: int) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {size}\r\n\r\n".encode()


def _arc_record(version: str, name: str, offset: int, page_id: int | None, url: str | None, payload: bytes, date: str) -> bytes:
    document = _http_head(page_id, len(payload)) + payload
    given = {"URL": _field(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200",
             "Checksum": f"{zlib.crc32(document):08x}" if version == "2" else NO_CONTENT, "Location": NO_CONTENT, "Offset": str(offset),
             "Filename": name, "Archive-length": str(len(document))}
    return " ".join(given[f] for f in ARC_FIELDS[version]).encode() + b"\n" + document + b"\n"


def write_arc(pages: DataFrame, path: str, date: str = CAPTURED) -> None:
    """ARC volumes of ``pages(page_id, url, html)``, versions 1 and 2 in turn, into the folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = 0, [], 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                version, name = "12"[made % 2], f"volume-{made}"
                if not held:
                    held = [_version_block(version, name, date)]
                    size = len(held[0])
                held.append(_arc_record(version, name, size, page_id.as_py(), url.as_py(), html.as_py() or b"", date))
                size += len(held[-1])
                if size >= VOLUME:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    made, held = made + 1, []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html").cast("binary").alias("html"))
    _write(rows.mapInArrow(run, "value binary"), path)


def _write(volumes: DataFrame, path: str) -> None:
    (volumes.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip")
     .option("maxRecordsPerFile", VOLUMES).text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


class _Bytes:
    """Reads lines and counted bytes from a gzip file, a piece of it at a time."""

    PIECE = 1 << 16

    def __init__(self, content: bytes):
        self.content, self.at, self.buffer, self.pos, self.offset = memoryview(content), 0, b"", 0, 0
        self.inflater = zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.at < len(self.content):
            piece = self.inflater.decompress(self.content[self.at:self.at + self.PIECE])
            self.at += self.PIECE
            if piece:
                self.buffer, self.pos = self.buffer[self.pos:] + piece, 0
                return True
        return False

    def line(self) -> bytes | None:
        """The next line with its end, None at the end of the file."""
        while (end := self.buffer.find(b"\n", self.pos)) < 0:
            if not self._more():
                end = len(self.buffer) - 1
                break
        found = self.buffer[self.pos:end + 1]
        self.pos = end + 1
        self.offset += len(found)
        return found or None

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if self.pos == len(self.buffer) and not self._more():
                raise ValueError(f"a record declares {left} bytes more than its file holds")
            part = self.buffer[self.pos:self.pos + left]
            self.pos += len(part)
            left -= len(part)
            parts.append(part)
        self.offset += n
        return b"".join(parts)


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, document) of every record of a file of ARC volumes, version blocks left out."""
    source, fields = _Bytes(content), None
    while True:
        offset, line = source.offset, source.line()
        if line is None:
            return
        if not line.strip():
            continue
        values = line.decode("latin-1").rstrip("\r\n").split(" ")
        document = source.take(int(values[-1]))
        if values[0].startswith("filedesc://"):
            version = document.split(b" ", 1)[0].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = ARC_FIELDS[version]
        elif fields is None or len(values) != len(fields):
            raise ValueError(f"a header line of {len(values)} fields at {offset}: {line[:80]!r}")
        else:
            yield offset, dict(zip(fields, values, strict=True)), document


def split_http(document: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head with its blank line, fields by lower-case name, payload) of an HTTP message."""
    end = document.find(b"\r\n\r\n") + 4
    if end < 4:
        return b"", {}, document
    lines = document[:end].decode("latin-1").split("\r\n")[1:]
    return document[:end], {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, document[end:]


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


# ---------------------------------------------------------------- WARC

def warc_date(digits: str) -> str:
    """ISO timestamp of an ARC date of 4 to 14 digits."""
    d = digits + "00000101000000"[len(digits):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, offset: int) -> str:
    """Identifier of the record at an offset of a legacy file."""
    return str(uuid.UUID(bytes=hashlib.sha256(f"{file.rsplit('/', 1)[-1]}:{offset}".encode()).digest()[:16], version=5))


def _warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return WARC + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(file: str, offset: int, date: str) -> bytes:
    block = b"software: ARC to WARC converter\r\nformat: WARC File Format 1.1\r\n"
    return _warc_record([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", f"<urn:uuid:{record_id(file + '#info', offset)}>"),
                         ("Content-Type", "application/warc-fields")], block)


def _converted(file: str, offset: int, header: dict[str, str], document: bytes, revisited: tuple[str, str] | None) -> bytes:
    """The WARC record of an ARC record; ``revisited``: identifier and url of the response that it repeats."""
    head, _, payload = split_http(document)
    block = head if revisited else document
    fields = [("WARC-Type", "revisit" if revisited else "response"), ("WARC-Target-URI", header["URL"]), ("WARC-Date", warc_date(header["Archive-date"])),
              ("WARC-Record-ID", f"<urn:uuid:{record_id(file, offset)}>"), ("WARC-IP-Address", header["IP-address"]),
              ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisited:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{revisited[0]}>"), ("WARC-Refers-To-Target-URI", revisited[1])]
    return _warc_record([*fields, ("Content-Type", "application/http; msgtype=response")], block)


def _digests(files: DataFrame) -> DataFrame:
    """``file, offset, page_id, url, size, digest`` of every record of the ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for offset, header, document in arc_records(content.as_buffer()):
                    _, fields, payload = split_http(document)
                    rows.append((file.as_py(), offset, _number(fields.get("x-page-id")), header["URL"], len(payload), hashlib.sha256(payload).digest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                                                     names=["file", "offset", "page_id", "url", "size", "digest"])

    return files.mapInArrow(run, "file string, offset long, page_id long, url string, size long, digest binary")


def _revisits(digests: DataFrame) -> DataFrame:
    """``file, repeats``: per file, the records that revisit another, with that one's file, offset and url."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "offset", "url")
    large = digests.where(F.col("size") >= SMALLEST)
    leads = large.groupBy("digest").agg(F.min(place).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = large.join(leads, "digest").where((F.col("file") != F.col("lead.file")) | (F.col("offset") != F.col("lead.offset")))
    item = F.struct("offset", F.col("lead.file").alias("file"), F.col("lead.offset").alias("at"), F.col("lead.url").alias("url"))
    return again.select("file", item.alias("repeat")).groupBy("file").agg(F.collect_list("repeat").alias("repeats"))


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """WARC files in the folder ``warc_path`` from the ARC files in ``arc_path``, a record for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, repeats in zip(*(batch.column(i) for i in range(3)), strict=True):
                name = file.as_py()
                known = {r["offset"]: (record_id(r["file"], r["at"]), r["url"]) for r in repeats.as_py() or []}
                held, size = [], 0
                for offset, header, document in arc_records(content.as_buffer()):
                    if not held:
                        held = [_info(name, offset, warc_date(header["Archive-date"]))]
                        size = len(held[0])
                    held.append(_converted(name, offset, header, document, known.get(offset)))
                    size += len(held[-1])
                    if size >= VOLUME:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    files = _files(spark, arc_path)
    repeats = _revisits(materialise(_digests(files)))
    _write(files.join(repeats, "file", "left").select("file", "content", "repeats").mapInArrow(run, "value binary"), warc_path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of a gzip file of WARC records."""
    source = _Bytes(content)
    while True:
        line = source.line()
        if line is None:
            return
        if not line.strip():
            continue
        if line != WARC:
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := source.line()) and line.strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, source.take(int(fields["content-length"]))


def _checked(block: bytes, declared: str, what: str) -> str:
    found = hashlib.sha256(block).hexdigest()
    if declared != f"sha256:{found}":
        raise ValueError(f"the {what} digest is {found}, declared {declared}")
    return found


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """``record_id, record_type, page_id, url, date, payload_bytes, payload_digest, refers_to_id`` of the WARC files in ``path``.

    With ``payloads``, ``payload`` too: the bytes of responses, null for revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows, size = [], 0
                for fields, block in warc_records(content.as_buffer()):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    _checked(block, fields["warc-block-digest"], "block")
                    _, head, payload = split_http(block)
                    full = fields["warc-type"] == "response"
                    digest = _checked(payload, fields["warc-payload-digest"], "payload") if full else fields["warc-payload-digest"].partition(":")[2]
                    rows.append((fields["warc-record-id"][10:-1], fields["warc-type"], _number(head.get("x-page-id")), fields["warc-target-uri"], fields["warc-date"],
                                 len(payload) if full else int(head["content-length"]), digest, None if full else fields["warc-refers-to"][10:-1], payload if payloads and full else None))
                    size += len(payload) if payloads else 0
                    if size > VOLUME:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    names = ["record_id", "record_type", "page_id", "url", "date", "payload_bytes", "payload_digest", "refers_to_id", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "record_id string, record_type string, page_id long, url string, date string, payload_bytes long, payload_digest string, refers_to_id string, payload binary"
    found = _files(spark, path).mapInArrow(run, schema)
    return found if payloads else found.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, through ARC and WARC files and back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    read = materialise(read_warc(spark, f"{folder}/warc"))
    discard(spark, folder)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    plain = read.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    named = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    again = read.where("record_type = 'revisit'").join(named, "refers_to_id", "left")
    return plain.unionByName(again.select(*columns, "refers_to"))

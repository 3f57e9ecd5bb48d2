"""Legacy ARC archives converted to WARC, and both formats read.

An ARC file begins with a ``filedesc:`` record that names its version; a version 1 header line
has five fields, a version 2 line ten, the declared length last. The converter takes each
document by its declared length, so separators inside it do no harm, and synthesises what WARC
asks for: record ids, ISO timestamps, record types and digests. Of documents with equal payloads
the one with the largest key stays a response, the others become revisits of it.

Archives are gzip text to Spark: its writer puts raw record bytes and a line feed, its reader
gives the lines of an unsplit file in order, and a task parses them as a stream that holds one
record. So archives may lie in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.llm.common import arrow_batches

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY_HEADER = b"X-Page-Id"
HEADER_LINE = re.compile(rb"^[A-Za-z][A-Za-z0-9+.-]*:\S* .*\d$")


class Stream:
    """Lines and counted bytes of one file."""

    def __init__(self, lines: Iterator[bytes]) -> None:
        self.lines, self.held = lines, b""

    def line(self) -> bytes | None:
        if self.held:
            line, end, rest = self.held.partition(b"\n")
            if end:
                self.held = rest
                return line
            self.held = b""
            more = next(self.lines, None)
            return line if more is None else line + more
        return next(self.lines, None)

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = next(self.lines, None)
            if more is None:
                raise ValueError(f"the archive ends {n - have} bytes before a record does")
            parts.append(more + b"\n")
            have += len(more) + 1
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]


def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Stream]]:
    rows = (row for b in batches for row in zip(b["file"].to_pylist(), b["line"].to_pylist(), strict=True))
    for name, group in itertools.groupby(rows, key=lambda row: row[0]):
        yield name, Stream(line for _, line in group)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    arrow_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))


def write_lines(records: DataFrame, path: str) -> None:
    """Each record's bytes and one line feed."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload; a block that isn't HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, end, payload = block.partition(b"\r\n\r\n")
    return head + end, payload


def http_header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("latin-1")
    return None


# --- ARC ------------------------------------------------------------------------------


def arc_line(version: int, url: str, date: str, kind: str, length: int) -> bytes:
    fields = [url, "0.0.0.0", date, kind, *(["200", "-", "-", "0", "pages.arc"] if version == 2 else []), str(length)]
    return " ".join(fields).encode()


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20080430204825") -> None:
    """Write ``page_id, url, html`` as ARC files of one version, a file for each partition."""
    arrow_batches(pages.sparkSession)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = f"{version} 0 axonframe\n{ARC_FIELDS[version]}\n".encode()
        first = [arc_line(version, "filedesc://pages.arc", date, "text/plain", len(about)) + b"\n" + about]
        for batch in batches:
            out = first
            first = []
            for page_id, url, html in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "html")], strict=True):
                payload = (html or "").encode()
                key = [] if page_id is None else [KEY_HEADER + b": " + str(page_id).encode()]
                head = b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), *key, b"", b""])
                where = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
                where = where if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", where) else f"urn:x-page:{where}"
                out.append(arc_line(version, where, date, "text/html", len(head) + len(payload)) + b"\n" + head + payload)
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    write_lines(rows.mapInArrow(records, "record binary"), path)


def arc_stream(stream: Stream) -> Iterator[tuple[int, dict, bytes]]:
    """Version, header fields and block of each document."""
    version = 1
    while (line := stream.line()) is not None:
        if not HEADER_LINE.match(line):
            continue  # the line feed after a document, or damage: on to the next header
        fields = line.split(b" ")
        block = stream.take(int(fields[-1]))
        if line.startswith(b"filedesc:"):
            version = int(block.split(b" ", 1)[0] or 1)
            continue
        n = len(ARC_FIELDS[version].split())
        if len(fields) < n:
            raise ValueError(f"an ARC {version} header line has {n} fields, not {len(fields)}")
        # Spaces inside a URL, which old crawlers let through, stay with the URL.
        fields = [b" ".join(fields[: len(fields) - n + 1]), *fields[len(fields) - n + 1 :]]
        yield version, dict(zip(ARC_FIELDS[version].split(), (f.decode("latin-1") for f in fields), strict=True)), block


def record_key(head: bytes, uri: str, date: str, digest: str) -> int:
    """The page id that the document carries, else a negative number of its own."""
    own = http_header(head, KEY_HEADER)
    if own is not None and re.fullmatch(r"-?\d{1,19}", own) and -(2**63) <= int(own) < 2**63:
        return int(own)
    return -1 - int.from_bytes(hashlib.sha1(f"{uri} {date} {digest}".encode()).digest()[:8], "big") // 2


def arc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """key, digest, and unless only those are wanted uri, ip, date, head, payload of all documents."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for _, stream in files(batches):
            for _, fields, block in arc_stream(stream):
                head, payload = http_parts(block)
                digest, uri, date = sha1(payload), fields["URL"], fields["Archive-date"]
                row = (record_key(head, uri, date, digest), digest)
                out.append((*row, uri, fields["IP-address"], date, head, payload) if payloads else row)
                size += len(block)
                if size > 4 << 20 or len(out) >= 1000:
                    yield batch()
                    out, size = [], 0
        yield batch()

    names = ["key", "digest", "uri", "ip", "date", "head", "payload"][: 7 if payloads else 2]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary()][: len(names)]
    schema = "key long, digest string, uri string, ip string, date string, head binary, payload binary"
    return lines_of(spark, path).mapInArrow(parse, ", ".join(schema.split(", ")[: len(names)]))


# --- WARC -----------------------------------------------------------------------------


def record_id(key: int, salt: str) -> str:
    """A version 8 UUID: the 64 bits of the key, then 58 bits of a digest."""
    rest = int.from_bytes(hashlib.sha1(salt.encode()).digest()[:8], "big") >> 6
    bits = (key & (1 << 64) - 1) << 58 | rest
    high, middle, low = bits >> 74, bits >> 62 & 0xFFF, bits & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=high << 80 | 8 << 76 | middle << 64 | 2 << 62 | low)}>"


def key_of(identifier: str) -> int:
    number = uuid.UUID(identifier.strip("<>").rpartition(":")[2]).int
    key = (number >> 80) << 16 | (number >> 64 & 0xFFF) << 4 | (number >> 58 & 0xF)
    return key - (1 << 64) if key >> 63 else key


def iso(date: str) -> str:
    """An ARC date of 8 to 14 digits as WARC writes it."""
    d = re.sub(r"\D", "", date)[:14]
    d = d + "00010101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its last line feed, which the writer adds."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def as_warc(row: dict, least: int) -> bytes:
    digest, date = row["digest"], iso(row["date"])
    ident = record_id(row["key"], digest)
    revisit = row["response"] != row["key"] and len(row["payload"]) >= least
    kind = "revisit" if revisit else "response" if row["head"] else "resource"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"])]
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    block = row["head"] if revisit else row["head"] + row["payload"]
    if revisit:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", record_id(row["response"], digest)))
    headers.append(("WARC-Block-Digest", f"sha1:{sha1(block)}"))
    headers.append(("Content-Type", "application/http; msgtype=response" if row["head"] else "application/octet-stream"))
    return warc_record(headers, block)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """ARC files to WARC files: one record per document, one warcinfo record per file.

    Payloads of at least ``least`` bytes that are equal leave one response, that of the largest
    key; rows that share this key are responses all, under one id. The largest keys are found from
    keys and digests alone, folded before they move. Ids are made of key and digest, so a revisit
    names its response without a look at it.
    """
    responses = arc_records(spark, arc_path, payloads=False).groupBy("digest").agg(F.max("key").alias("response"))
    records = arc_records(spark, arc_path).join(responses, "digest")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: axonframe\r\nformat: WARC File Format 1.1\r\n"
        first = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'axonframe')}>"), ("WARC-Date", iso("20080430")), ("Content-Type", "application/warc-fields")], about)]
        for batch in batches:
            out = first + [as_warc(row, least) for row in batch.to_pylist()]
            first = []
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    write_lines(records.mapInArrow(build, "record binary"), warc_path)


def warc_stream(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.line()) not in (None, b"\r", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.take(int(headers.get("content-length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Documents of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, uri, warc_date.

    Digests of payloads are counted anew; one that differs from its header is an error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for name, stream in files(batches):
            for headers, block in warc_stream(stream):
                kind = headers["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = http_parts(block)
                digest = headers["warc-payload-digest"].partition(":")[2]
                own, refers, size = http_header(head, KEY_HEADER), None, len(payload)
                if kind == "revisit":
                    refers = key_of(headers["warc-refers-to"])
                    size = int(http_header(head, b"Content-Length") or 0)
                elif sha1(payload) != digest:
                    raise ValueError(f"{name}: the payload of {headers['warc-record-id']} does not have its digest")
                out.append((int(own) if own else None, size, digest, kind, refers, headers["warc-target-uri"], headers["warc-date"]))
                if len(out) >= 1000:
                    yield batch()
                    out = []
        yield batch()

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "warc_date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return lines_of(spark, path).mapInArrow(
        parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, warc_date string"
    )

"""Legacy ARC archives to WARC records, WARC files and back.

An ARC record is a header line of fields that its archive's version defines, a declared length, and as many bytes of network
response (HTTP status line, headers, blank line, payload):

    version 1: URL IP-address archive-date content-type length
    version 2: URL IP-address archive-date content-type result-code checksum location offset filename length

The converter synthesises what WARC wants and ARC lacks: a record id (a name-based UUID over key and payload digest, so that a
retried task makes the same record and a revisit can name the record that it refers to), an ISO timestamp, a record type, a content type, payload and block digests. Of
records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest key is a response; the others revisit it and
carry headers only.

WARC files are written by Spark's text sink: a record without its trailer is a row's bytes, and the record trailer, two line ends, is the
line separator. So they go through the committer to any file system that Spark reaches, and a lost executor leaves nothing half
written. Reading frames records by their declared lengths, never by the separator.

Defined results: a null payload is an empty payload; a null URL is written as ``about:blank``; repeated rows are
records of their own (of two with the smallest key both are responses); a declared length beyond the data, a bad header line or an unknown version raises, and names the record.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm.common import bounded_batches, cut

REVISIT_BYTES = 100
#: Bytes of records in a WARC file on average; a file is read as one row.
FILE_BYTES = 16 << 20
#: Of a file if all its records were as long as the longest.
MOST_BYTES = 1 << 30
#: Rows of about 100 bytes.
BROADCAST_ROWS = 50_000
TRAILER = "\r\n\r\n"
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes

    @property
    def timestamp(self) -> str:
        """ISO 8601 in UTC, of an archive date of 4 to 14 digits."""
        date = self.fields["date"]
        if not date.isdigit() or not 4 <= len(date) <= 14 or len(date) % 2:
            raise ValueError(f"bad archive date {date!r}")
        full = date + "00000101000000"[len(date) :]
        return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"

    def response(self) -> tuple[bytes, bytes]:
        """HTTP headers with their blank line (empty if there are none), and the payload."""
        if not self.block.startswith(b"HTTP/"):
            return b"", self.block
        for end in (b"\r\n\r\n", b"\n\n"):
            if (at := self.block.find(end)) >= 0:
                return self.block[: at + len(end)], self.block[at + len(end) :]
        return self.block, b""


def parse_arc(data: bytes, version: int) -> Iterator[ArcRecord]:
    """The records of a run of ARC records of one version, by their declared lengths."""
    if version not in FIELDS:
        raise ValueError(f"ARC version {version} is unknown")
    names, at = FIELDS[version], 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8")
        # Spaces within an URL aren't escaped in old archives: the other fields are counted from the right.
        parts = line.rsplit(" ", len(names) - 1)
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"bad ARC header line {line[:200]!r}")
        fields, at = dict(zip(names, parts, strict=True)), end + 1
        length = int(fields["length"])
        if at + length > len(data):
            raise ValueError(f"{fields['url']}: {length} bytes declared, {len(data) - at} left")
        yield ArcRecord(version, fields, data[at : at + length])
        at += length


def parse_arc_file(data: bytes) -> Iterator[ArcRecord]:
    """The records of a whole ARC file; its first record, ``filedesc:``, states the version."""
    end = data.find(b"\n")
    first = data[: max(end, 0)].decode("utf-8").rsplit(" ", 4)
    if len(first) != 5 or not first[0].startswith("filedesc:") or not first[4].isdigit():
        raise ValueError("an ARC file begins with a filedesc record")
    body = data[end + 1 : end + 1 + int(first[4])]
    version = body.split(b" ", 1)[0]
    if not version.isdigit():
        raise ValueError("the filedesc record states no version")
    yield from parse_arc(data[end + 1 + int(first[4]) :], int(version))


def arc_record(url: str, date: str, content_type: str, payload: bytes, version: int) -> bytes:
    """One ARC record, as crawlers of that version wrote it."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    middle = "" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - 0 pages.arc "
    return f"{url} 0.0.0.0 {date} {content_type} {middle}{len(block)}\n".encode() + block + b"\n"


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{key} {digest}')}>"


def warc_record(arc: ArcRecord, key: str, refers: str | None) -> bytes:
    """A WARC record without its trailer. ``refers``: the key of the record that it revisits."""
    head, payload = arc.response()
    digest = hashlib.sha256(payload).hexdigest()
    url = arc.fields["url"]
    own = record_id(key or f"{url} {arc.timestamp}", digest)
    block = head if refers else head + payload
    kind = "application/http; msgtype=response" if head else arc.fields["content_type"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {arc.timestamp}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {arc.fields['ip']}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Archive-Key: {key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, digest)}", f"X-Refers-To-Key: {refers}"]
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        _, *lines = data[at:end].decode("utf-8").split("\r\n")
        headers = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        at = end + 4 + length + len(TRAILER)
        if len(block) < length or data[at - len(TRAILER) : at] != TRAILER.encode():
            raise ValueError(f"the record of {headers.get('warc-target-uri')} isn't as long as declared")
        yield headers, block


def _clean_url(url: Column) -> Column:
    """An URL on one line; a missing one can't be left out of a header line."""
    return F.coalesce(F.nullif(F.regexp_replace(url, r"[\r\n]", ""), F.lit("")), F.lit("about:blank"))


def arc_records(pages: DataFrame, key: str, url: str, html: str, date: str = "20240101000000") -> DataFrame:
    """(key, version, digest, size, arc): each page as an ARC record, of version 1 or 2 by its key's hash: what the converter takes."""
    bounded_batches(pages.sparkSession)
    own = pages.select(F.col(key).cast("long").alias("key"), _clean_url(F.col(url)).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = h.encode()
                version = 1 + (k or 0) % 2
                rows.append((k, version, hashlib.sha256(data).hexdigest(), len(data), arc_record(u, date, "text/html", data, version)))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "version", "digest", "size", "arc"])

    return own.mapInArrow(run, "key long, version int, digest string, size long, arc binary")


def payloads(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, digest, size) of pages, without making records."""
    data = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    return pages.select(F.col(key).cast("long").alias("key"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))


def arc_files(spark: SparkSession, path: str) -> DataFrame:
    """(version, digest, size, key, arc) of the records of ARC files, gzipped or not; a key is the file's number, by path, and the record's in it.

    A file is read as one row, so it has less than 2 GiB; a file has fewer than 2**31 records.
    """
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    # Only paths go to one task.
    numbered = cut(files.select("path").withColumn("number", F.row_number().over(Window.orderBy("path"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(*(batch.column(c).to_pylist() for c in ("number", "content")), strict=True):
                base = number << 31
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for i, arc in enumerate(parse_arc_file(data)):
                    _, payload = arc.response()
                    line = " ".join(arc.fields.values()).encode() + b"\n"
                    row = (base + i, arc.version, hashlib.sha256(payload).hexdigest(), len(payload), line + arc.block)
                    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, kinds, strict=True)], names=["key", "version", "digest", "size", "arc"])

    met = files.select("path", "content").join(numbered, "path").select("number", "content")
    return met.mapInArrow(run, "key long, version int, digest string, size long, arc binary")


def copies(payloads: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(digest, first): the smallest key of each payload digest that several records of (key, digest, size) share."""
    own = payloads.filter(F.col("size") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    return own.filter("n > 1 AND first IS NOT NULL").select("digest", "first")


def convert(arcs: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, record) of ARC records (key, version, digest, size, arc): the bytes of one WARC record each, without trailer.

    ``shared`` is what copies() finds of them. It is broadcast if it has at most BROADCAST_ROWS rows; else records move once, by digest,
    in a join that adaptive execution splits for a digest with very many. A record with a null key revisits the smallest key, if there is one.
    """
    bounded_batches(arcs.sparkSession)
    shared = cut(shared)
    small = shared.count() <= BROADCAST_ROWS
    met = arcs.join(F.broadcast(shared) if small else shared, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, versions, firsts, arcs_ = (batch.column(c).to_pylist() for c in ("key", "version", "first", "arc"))
            out = []
            for key, version, first, data in zip(keys, versions, firsts, arcs_, strict=True):
                (arc,) = parse_arc(data, version)
                refers = None if first is None or first == key else str(first)
                out.append(warc_record(arc, "" if key is None else str(key), refers))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, type=pa.binary())], names=["key", "record"])

    return met.mapInArrow(run, "key long, record binary")


def file_records(payloads: DataFrame) -> int:
    """Records of a file, so that files have about FILE_BYTES and never over MOST_BYTES, whatever the order of (key, digest, size)."""
    mean, most = payloads.agg(F.avg("size"), F.max("size")).first()
    return max(1, int(min(FILE_BYTES // ((mean or 0) + 1024), MOST_BYTES // ((most or 0) + 4096))))


def write(records: DataFrame, path: str, file_records: int) -> None:
    """WARC files of at most ``file_records`` records each, from rows with a ``record``."""
    # A cast from binary to string keeps the bytes as they are.
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", TRAILER).option("maxRecordsPerFile", file_records).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, record_type, url, date, payload_digest, payload_bytes, refers_to, payload): a row a record; a revisit's payload is null."""
    bounded_batches(spark)
    schema = "key long, record_type string, url string, date string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for headers, block in parse_warc(data):
                    kind, http = headers["warc-type"], headers["content-type"].startswith("application/http")
                    payload = None if kind == "revisit" else ArcRecord(0, {}, block).response()[1] if http else block
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {headers['warc-target-uri']} doesn't match its digest")
                    size = int(headers["x-payload-length"]) if payload is None else len(payload)
                    key, refers = headers["x-archive-key"], headers.get("x-refers-to-key")
                    rows.append((int(key) if key else None, kind, headers["warc-target-uri"], headers["warc-date"], digest, size, int(refers) if refers else None, payload))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


#: What writing, converting and reading back gives for the pages, in DuckDB's SQL.
SQL = f"""
WITH known AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT payload_digest, min(page_id) AS first, count(*) AS n FROM known WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN n > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM known LEFT JOIN firsts USING (payload_digest)
"""

"""WARC archives: one gzip member for each record, and a sequential reader.

Writing. Pages with equal payloads (by SHA-256) are one group; the page with the
largest id is its response, the others are revisits of it, which have the HTTP
headers but no payload. Each task appends its records to archives of its own,
a new one whenever the last is large enough. A file's name is drawn by the
attempt that writes it and reaches the list of archives only if that attempt is
committed, so a lost executor leaves at most a file that nobody reads.

Reading. A file is inflated piece by piece, member after member. Each member
has one record: header lines, as many bytes as Content-Length says, an end
mark. The digests of block and payload are computed from the pieces and held
against the headers. Only what is asked for is kept: without payloads a worker
holds one piece, however long a record is.

Results by case: a null html is an empty payload, which takes part like any
other; a null page_id is smaller than all others and its record has no
Page-ID; rows of the largest id of a group are responses, all of them if the id
is repeated; a null url gives no target; control characters and blanks of
a url are written as %XX; columns besides page_id, url and html are not written;
an empty table gives no archive and no rows; a payload of any length is one record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: Bytes that are read and inflated at once, of the headers of a record at most, of records that are handed on together, and of an archive from which on the next one is begun.
PIECE, MOST_HEADER, TOGETHER, ROLL = 1 << 16, 1 << 20, 4 << 20, 256 << 20

FILES = "path string, records long, bytes long"
_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS = "path string, offset long, record_type string, record_id string, target_uri string, page_id long, refers_to string, refers_to_page long, payload_bytes long, payload_digest string, payload binary, problem string"
_RECORDS = pa.schema(
    [("path", pa.string()), ("offset", pa.int64())]
    + [(c, pa.string()) for c in ("record_type", "record_id", "target_uri")]
    + [("page_id", pa.int64()), ("refers_to", pa.string()), ("refers_to_page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())]
)


class Broken(ValueError):
    """A record that can't be read."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the path in it."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


# ---- writing


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + END) + packer.compress(block) + packer.compress(END) + packer.flush()


def _address(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, response: int | None, date: str) -> bytes:
    digest = base32_sha1(hashlib.sha1(payload).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    headers = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_name(page_id, digest)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _address(url))] if url is not None else []
    headers += [("Page-ID", str(page_id))] if page_id is not None else []
    if revisits:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(response, digest)), ("Refers-To-Page-ID", str(response))]
    else:
        block += payload
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).digest())}")]
    return member(headers, block)


class _Archives:
    """The archives of one task, one open at a time."""

    def __init__(self, folder: str, roll: int, date: str):
        self.folder, self.roll, self.date, self.out = folder, roll, date, None

    def add(self, record: bytes) -> None:
        if self.out is None:
            system, at = filesystem(self.folder)
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.path, self.records, self.bytes, self.out = f"{self.folder}/{name}", 0, 0, system.open_output_stream(f"{at}/{name}", compression=None)
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.records += 1

    def _put(self, record: bytes) -> None:
        self.out.write(record)
        self.bytes += len(record)

    def full(self) -> bool:
        return self.out is not None and self.bytes >= self.roll

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.out = None
        return C.record(_FILES, {"path": [self.path], "records": [self.records], "bytes": [self.bytes]})


def _write(folder: str, roll: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder, roll, date)
        for batch in batches:
            ids, urls, payloads, revisits, tops = (batch.column(c) for c in ("page_id", "url", "payload", "revisits", "top"))
            payloads = payloads.cast(pa.large_binary())
            for i in range(batch.num_rows):
                archives.add(page_record(ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), revisits[i].as_py(), tops[i].as_py(), date))
                if archives.full():
                    yield archives.close()
        if archives.out is not None:
            yield archives.close()

    return run


def with_responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, top, revisits): top is the page that a group's others revisit, null for a payload that only one row has."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    groups = C.checkpoint(rows.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).filter("n > 1 AND top IS NOT NULL"))
    met = C.meet(rows, groups, "sha", "page_id")
    return met.select("page_id", "url", "payload", "top", (F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))).alias("revisits"))


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to archives below a new folder that driver and executors share; (path, records, bytes) of the archives.

    The list is written first of all, so reading it never writes again.
    """
    system, at = filesystem(folder)
    system.create_dir(f"{at}/archives", recursive=True)
    with_responses(pages).mapInArrow(_write(f"{folder}/archives", roll, date), FILES).write.parquet(f"{folder}/list")
    return pages.sparkSession.read.schema(FILES).parquet(f"{folder}/list")


# ---- reading


class _Source:
    """A file's bytes, with what a member left over put back."""

    def __init__(self, stream):
        self.stream, self.left, self.offset = stream, b"", 0

    def read(self) -> bytes:
        piece, self.left = self.left or self.stream.read(PIECE), b""
        self.offset += len(piece)
        return piece

    def put_back(self, piece: bytes) -> None:
        self.left = piece
        self.offset -= len(piece)


class _Member:
    """One gzip member, inflated as far as it is asked for."""

    def __init__(self, source: _Source, first: bytes):
        self.source, self.inflate, self.raw, self.ahead = source, zlib.decompressobj(31), first, b""

    def more(self) -> bool:
        """Inflates another piece; False at the member's end."""
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self.raw or self.source.read()
            self.raw = b""
            try:
                piece = self.inflate.decompress(raw, PIECE)
            except zlib.error as e:
                raise Broken(f"not a gzip member: {e}") from None
            self.ahead += piece
            if piece:
                return True
            if not raw and not self.inflate.eof:
                raise Broken("the file ends inside a record")
        return False

    def close(self) -> None:
        self.source.put_back(self.inflate.unused_data)

    def until(self, mark: bytes, most: int) -> bytes:
        """All up to the mark, which goes too."""
        seen = 0
        while (at := self.ahead.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ahead)
            if seen > most or not self.more():
                raise Broken("no end of the headers")
        out, self.ahead = self.ahead[:at], self.ahead[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ahead and not self.more():
                raise Broken("the record is shorter than its length")
            piece, self.ahead = self.ahead[:n], self.ahead[n:]
            n -= len(piece)
            yield piece


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("a header line without a colon")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(text: str | None) -> int | None:
    if text is None:
        return None
    if not text.removeprefix("-").isascii() or not text.removeprefix("-").isdigit():
        raise Broken(f"not a number: {text[:40]}")
    return int(text)


def _record(source: _Member, keep_payload: bool) -> dict:
    head = source.until(END, MOST_HEADER)
    if not head.startswith(b"WARC/"):
        raise Broken("no WARC version")
    fields = _fields(head)
    length = _number(fields.get("content-length"))
    if length is None or length < 0:
        raise Broken("no length")
    block, payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, bytearray()
    http = fields.get("content-type", "").startswith("application/http")
    lines, waits = b"", http
    for piece in source.take(length):
        block.update(piece)
        if waits:  # the payload begins behind the HTTP headers
            lines += piece
            at = lines.find(END)
            if at < 0:
                if len(lines) > MOST_HEADER:
                    raise Broken("no end of the HTTP headers")
                continue
            lines, piece, waits = lines[:at], lines[at + len(END) :], False
        payload.update(piece)
        size += len(piece)
        if keep_payload:
            kept += piece
    if b"".join(source.take(len(END))) != END or source.ahead or source.more():
        raise Broken("the record is longer than its length")
    if waits:
        raise Broken("no end of the HTTP headers")
    found = {"block": block, "payload": payload}
    revisit = fields.get("warc-type") == "revisit"
    for part, digest in found.items():
        said = fields.get(f"warc-{part}-digest")
        if said is not None and not (revisit and part == "payload") and said != f"sha1:{base32_sha1(digest.digest())}":
            raise Broken(f"the {part}'s digest differs")
    digest = base32_sha1(payload.digest())
    if revisit:  # its own payload isn't there: what the headers say of it
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size = _number(_fields(lines).get("content-length"))
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "page_id": _number(fields.get("page-id")),
        "refers_to": fields.get("warc-refers-to"),
        "refers_to_page": _number(fields.get("refers-to-page-id")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": bytes(kept) if keep_payload and not revisit else None,
        "problem": None,
    }


def records_of(stream, path: str, keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, one after another; a record that can't be read tells its problem and ends the file."""
    source = _Source(stream)
    while first := source.read():
        offset = source.offset - len(first)
        one = _Member(source, first)
        try:
            row = _record(one, keep_payload)
        except Broken as e:
            yield dict.fromkeys(_RECORDS.names) | {"path": path, "offset": offset, "problem": str(e)}
            return
        one.close()
        yield {"path": path, "offset": offset} | row


def _read(keep_payload: bool, strict: bool):
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return C.record(_RECORDS, {c: [r[c] for r in rows] for c in _RECORDS.names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for files in batches:
            for path in files.column("path").to_pylist():
                system, at = filesystem(path)
                with system.open_input_stream(at, compression=None) as stream:
                    for row in records_of(stream, path, keep_payload):
                        if strict and row["problem"]:
                            raise Broken(f"{path} at {row['offset']}: {row['problem']}")
                        rows.append(row)
                        held += 500 + len(row["payload"] or b"")
                        if held > TOGETHER:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))


def read_archives(files: DataFrame, keep_payload: bool = False, strict: bool = True) -> DataFrame:
    """RECORDS of all records in files (path, bytes). strict: a broken record fails the job; else it has a row with its problem."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(files.sparkSession.sparkContext.defaultParallelism, size >> 27)))
    return files.select("path").repartition(tasks).mapInArrow(_read(keep_payload, strict), RECORDS)


def lost_revisits(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes, n): what revisits say of a response that isn't there or says otherwise."""
    said = records.filter("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.count("*").alias("n"))
    there = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return said.join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def digest(records: DataFrame) -> DataFrame:
    """What the archives say of each page."""
    rows = records.filter("record_type IN ('response', 'revisit')")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "record_id", "target_uri")


def round_trip(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes pages below folder, reads the archives back and deletes them: digest() of their records, kept in a checkpoint."""
    out = C.checkpoint(digest(read_archives(write_archives(pages, folder, roll))))
    context = pages.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    return out

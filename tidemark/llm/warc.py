"""Web archives: a Python data source that writes and reads WARC files, and the deduplicating archive of a page table.

Reading plans partitions of whole files by size, takes predicates on record type and other headers down to the files,
parses a record's headers first and decodes its payload only if the record is wanted and its type is among those whose
payloads are asked for. Each record is a gzip member of its own whose "sl" extra field holds its compressed length, so
an unwanted record is skipped without inflating the rest of it; members without that field and plain files are read too.

Each write task makes files of its own; those of successful tasks are named in a manifest when the job commits, and only
these are read, so files of failed or repeated tasks do no harm. Nulls in url leave the header out; a null id gives an
empty id; null html is an empty payload. Of equal payloads the record with the largest page_id is the response (all of
them, should rows repeat that id; a null id only if there is no other), the others revisit it; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from tidemark.llm.common import staged
from tidemark.session import scratch_dir

MIN_REVISIT_BYTES = 0
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 64 << 20, 64 << 20, 4 << 20
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "_committed.json"
#: Fixed values of the format.
VERSION, END = b"WARC/1.0", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SCHEMA = "record_type string, record_id string, url string, date string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Columns that equal a header, and so can be tested before the payload.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "url": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def _line(name: str, value: str | None) -> str:
    clean = None if value is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
    return "" if clean is None else f"{name}: {clean}\r\n"


def record_bytes(row: dict) -> bytes:
    """One record; revisits keep the HTTP header of their payload, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http + ((row["payload"] or b"") if row["record_type"] == "response" else b"")
    wrap = lambda x: None if x is None else f"<{x}>"
    digest = row["payload_digest"] and f"sha1:{row['payload_digest']}"
    head = (
        _line("WARC-Type", row["record_type"]) + _line("WARC-Record-ID", wrap(row["record_id"])) + _line("WARC-Date", row["date"])
        + _line("WARC-Target-URI", row["url"]) + _line("WARC-Payload-Digest", digest)
        + (_line("WARC-Refers-To", wrap(row["refers_to"])) + _line("WARC-Profile", PROFILE) if row["record_type"] == "revisit" else "")
        + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return VERSION + b"\r\n" + head.encode() + block + END


def member(raw: bytes) -> bytes:
    """A gzip member with the skip-lengths extra field."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class _Source:
    """Bytes of a file from a position on, inflated if it holds gzip members."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def _from(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(headers, block) of the records for which ``wanted(headers)`` isn't None; block is None where it gives False."""
        while self.at < self.size:
            first = self._from(self.at, 4)
            if first[:2] == b"\x1f\x8b":
                yield from self._packed(wanted, first[3])
            elif first.strip():
                yield from self._plain(wanted)
            else:
                self.at += max(1, len(first) - len(first.lstrip()))

    def _packed(self, wanted, flags: int):
        start, skip = self.at, None
        if flags & 4:
            extra = self._from(start + 10, 2)
            fields = self._from(start + 12, struct.unpack("<H", extra)[0])
            while len(fields) >= 4:
                n = struct.unpack("<H", fields[2:4])[0]
                if fields[:2] == b"sl" and n == 8:
                    skip = struct.unpack("<I", fields[4:8])[0]
                fields = fields[4 + n :]
        z, out, at = zlib.decompressobj(31), b"", start
        while END not in out and not z.eof and at < self.size:
            part = self._from(at, 2048)
            out += z.decompress(part)
            at += len(part)
        headers = parse_headers(out[: out.index(END)])
        choice = wanted(headers)
        if not choice and skip:
            self.at = start + skip
        else:
            rest = [out]
            while not z.eof and at < self.size:
                part = self._from(at, 1 << 16)
                rest.append(z.decompress(part) if choice else z.decompress(part)[:0])
                at += len(part)
            self.at = at - len(z.unused_data)
            out = b"".join(rest)
        if choice is not None:
            body = out.index(END) + len(END)
            yield headers, out[body : body + int(headers.get("content-length", 0))] if choice else None

    def _plain(self, wanted):
        start, out, at = self.at, b"", self.at
        while END not in out and at < self.size:
            out += self._from(at, 4096)
            at = start + len(out)
        skip = len(out) - len(out.lstrip())
        body = out.index(END) + len(END)
        headers = parse_headers(out[skip : body - len(END)])
        n = int(headers.get("content-length", 0))
        choice = wanted(headers)
        self.at = start + body + n + len(END)
        if choice is not None:
            yield headers, self._from(start + body, n) if choice else None


def _open(path: str):
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]

    def __init__(self, names):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        kinds = options.get("payloads", "*")
        self.payloads = None if kinds == "*" else set(kinds.split(","))
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | In):
                self.tests.append((name, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        system, root = _open(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        out, held, size = [], [], 0
        for name, n in sorted(files):
            if held and size + n > PARTITION_BYTES:
                out, held, size = [*out, Files(held)], [], 0
            held, size = [*held, (name, n)], size + n
        return [*out, Files(held)]

    def _wanted(self, headers: dict[str, str]) -> bool | None:
        for name, values in self.tests:
            if _column(headers, name) not in values:
                return None
        return self.payloads is None or headers.get("warc-type") in self.payloads

    def read(self, partition):
        system, root = _open(self.path)
        rows, held = [], 0
        for name, size in partition.names:
            with system.open_input_file(f"{root}/{name}") as file:
                for headers, block in _Source(file, size).records(self._wanted):
                    rows.append(_row(headers, block))
                    held += len(block or b"") + 500
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _column(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(HEADERS[name])
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.rpartition(":")[2] if name == "payload_digest" else value


def _row(headers: dict[str, str], block: bytes | None) -> tuple:
    """Fields of a record; a response's payload is its block after the HTTP header, of other types the block."""
    length, payload = None, block
    if block is not None and headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(END)
        m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        length = int(m[1]) if m else len(payload)
        payload = payload if headers.get("warc-type") == "response" else None
    elif block is not None:
        length = len(block)
    return (*(_column(headers, c) for c in HEADERS), length, payload)


_ARROW = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        system, root = _open(self.path)
        system.create_dir(root)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                packed = member(record_bytes(row))
                out.write(packed)
                size += len(packed)
                if size >= FILE_BYTES:
                    out.close()
                    files.append((name, size))
                    out, size = None, 0
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages):
        system, root = _open(self.path)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages):
        system, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``format("warc")``; options: path, and payloads (record types to decode, by comma; default all)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_archives(records: DataFrame, path: str) -> None:
    """Writes rows of SCHEMA to a new folder of archives."""
    _register(records.sparkSession)
    records.select(*_ARROW.names).write.format("warc").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, payloads: str = "*") -> DataFrame:
    _register(spark)
    return spark.read.format("warc").option("path", path).option("payloads", payloads).load()


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of five hex digits give four letters each."""
    digest = F.sha1(payload)
    letters = []
    for g in range(8):
        group = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(group, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of SCHEMA for a page table: a response for each distinct payload, revisits for its other pages."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_length": F.length("payload").cast("long")})
    # Only payloads that occur twice or more have revisits; minima and counts are combined in the tasks.
    shared = rows.where(F.col("payload_length") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = staged(shared.where("n > 1").select("payload_digest", "first", F.lit(True).alias("shared")), "payloads")
    found = rows.join(shared, "payload_digest", "left")
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return found.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        "url",
        F.lit(DATE).alias("date"),
        "payload_digest",
        F.when(revisit, urn("first")).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) as read back from the archives.

    Responses are read with their payloads, which give size and digest. Revisits, whose block is an HTTP header, are read by
    a pushed record type that passes over the responses undecoded.
    """
    path = scratch_dir(pages.sparkSession, "warc")
    write_archives(page_records(pages, page_id, url, html), path)
    kind = pages.schema[page_id].dataType
    page = lambda c: F.nullif(F.regexp_replace(F.col(c), "^urn:page:", ""), F.lit("")).cast(kind)
    responses = read_archives(pages.sparkSession, path, "response").where("record_type = 'response'")
    revisits = read_archives(pages.sparkSession, path, "revisit").where("record_type = 'revisit'")
    read = responses.unionByName(revisits)
    return read.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(base32_sha1(F.col("payload")), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        "url",
    )


ROUND_TRIP_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(COALESCE(html, '')))::BIGINT AS payload_bytes, sha1(COALESCE(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, url, payload_bytes, hex, list_aggregate(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)),
    'string_agg', '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM m
"""

"""Recorded responses as a Spark source: spark.read.format("recorded").load(folder), a row a response, with the reason why one is of no use.

A folder holds files of JSON lines: source_id, url, status, content_type, final_url, last_modified, body. Fetching is not part of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LARGEST = 5_000_000
KINDS = ("html", "json", "xml", "text", "pdf")
SCHEMA = "source_id long, url string, status int, content_type string, size long, last_modified date, redirect string, payload string, error string"
ARROW = pa.schema(
    [("source_id", pa.int64()), ("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("size", pa.int64()), ("last_modified", pa.date32()), ("redirect", pa.string()), ("payload", pa.string()), ("error", pa.string())]
)


def host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def judged(line: bytes, largest: int = LARGEST) -> tuple:
    """A row of SCHEMA for one line. A response of no use has its reason and no payload; where several hold, the first counts."""
    try:
        r = json.loads(line)
        url, final = r.get("url") or "", r.get("final_url") or ""
        status, kind, body = int(r.get("status") or 0), (r.get("content_type") or "").lower(), r.get("body") or ""
        source, changed = r.get("source_id"), r.get("last_modified")
        size = len(body.encode())
    except (ValueError, AttributeError, TypeError):
        return None, None, None, None, len(line), None, None, None, "no record"
    redirect = urljoin(url, final) if final and final != url else None
    try:
        modified = parsedate_to_datetime(changed).date() if changed else None
    except (TypeError, ValueError):
        modified = None
    error = (
        f"HTTP {status}" if status != 200
        else "redirected to another host" if redirect and host(redirect) != host(url)
        else "unusable content" if not any(k in kind for k in KINDS)
        else f"larger than {largest} bytes" if size > largest
        else None
    )
    return source, url, status, kind, size, modified, redirect, None if error else body, error


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    """A partition a file, opened where it is read by whatever file system its URI names; batches are cut by bytes, so that large bodies do not meet."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.largest, self.batch = options["path"], int(options.get("largest", LARGEST)), int(options.get("batchbytes", 16 << 20))

    def partitions(self) -> list[File]:
        where, path = fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")
        names = [x.path for x in where.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and x.size and not x.base_name.startswith((".", "_"))]
        return [File(x) for x in sorted(names)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")
        rows, held = [], 0
        with where.open_input_stream(partition.path) as stream:
            for line in lines(stream):
                if line.strip():
                    rows.append(judged(line, self.largest))
                    held += len(line)
                if held > self.batch:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


def lines(stream) -> Iterator[bytes]:
    """The lines of a stream, read a megabyte at a time."""
    left = b""
    while chunk := stream.read(1 << 20):
        *whole, left = (left + chunk).split(b"\n")
        yield from whole
    if left:
        yield left


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recorded)

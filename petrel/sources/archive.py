"""``webarchive``: WARC and ARC files as a Spark data source and sink.

Reading: one partition per file, or with ``splitBytes`` several per file of gzip members: a
split begins at the first member found after its start whose first line is a version line
and which ends where another member or the file ends, and takes the records that begin before its
end. Plain files are never split, because a payload may itself be an archive; nor are files
whose name ends in ``.arc`` or ``.arc.gz``, because their field names stand at the front.
``path`` and ``offset`` equalities are pushed into the scan, so a record is read by seeking.
Files must be reachable as local or mounted paths; ``read_objects`` takes any Hadoop path.
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from petrel.codec import archive
from petrel.codec.archive import Record

RECORD_SCHEMA = (
    "path string, record_index bigint, offset bigint, container string, compression string, version string, headers array<struct<name:string,value:string>>, "
    "type string, record_id string, url string, date_raw string, date_ts timestamp, content_type string, content_length bigint, content binary, "
    "errors array<struct<code:string,args:array<string>>>, fatal string, preamble binary, description_index bigint"
)
_PAIR = pa.struct([("name", pa.string()), ("value", pa.string())])
ARROW_SCHEMA = pa.schema(
    [("path", pa.string()), ("record_index", pa.int64()), ("offset", pa.int64()), ("container", pa.string()), ("compression", pa.string()), ("version", pa.string()), ("headers", pa.list_(_PAIR))]
    + [("type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date_raw", pa.string()), ("date_ts", pa.timestamp("us", "UTC")), ("content_type", pa.string()), ("content_length", pa.int64()), ("content", pa.binary())]
    + [("errors", pa.list_(pa.struct([("code", pa.string()), ("args", pa.list_(pa.string()))]))), ("fatal", pa.string()), ("preamble", pa.binary()), ("description_index", pa.int64())]
)
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def clean_date(text: str | None) -> datetime | None:
    """Instant of a date in a format's own clean form."""
    for form, pattern in (("%Y-%m-%dT%H:%M:%SZ", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ"), ("%Y%m%d%H%M%S", r"\d{14}"), ("%Y%m%d", r"\d{8}")):
        if text and re.fullmatch(pattern, text):
            try:
                return datetime.strptime(text, form).replace(tzinfo=timezone.utc)
            except ValueError:
                return None
    return None


def as_row(r: Record, path: str | None, index: int | None, description: int | None = None) -> dict:
    """``preamble`` is what of an ARC file description precedes its content; ``description``: which record of the file describes this one."""
    return {
        "path": path, "record_index": index, "offset": r.offset, "container": r.container, "compression": r.compression, "version": r.version, "headers": [{"name": n, "value": v} for n, v in r.headers],
        "type": r.type if r.headers else None, "record_id": r.record_id, "url": r.url, "date_raw": r.date, "date_ts": clean_date(r.date), "content_type": r.content_type, "content_length": r.content_length, "content": r.content,
        "errors": [{"code": c, "args": a} for c, a in r.errors], "fatal": r.fatal, "preamble": r.preamble or None, "description_index": description,
    }


def file_rows(found: Iterator[Record], path: str | None, numbered: bool = True) -> Iterator[dict]:
    """Records of one file in order; without numbers where reading began inside the file."""
    description = None
    for i, r in enumerate(found):
        if numbered and r.container == "arc" and r.type == "filedesc":
            description = i
        yield as_row(r, path, i if numbered else None, description)


def batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["content"] or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, ARROW_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, ARROW_SCHEMA)


def _is_members(path: str) -> bool:
    """Whether a file may be split: gzip, and no ARC."""
    if re.search(r"\.arc(\.gz)?$", path):
        return False
    with open(path, "rb") as raw:
        return raw.read(2) == archive.GZIP_MAGIC


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.only_path: str | None = None
        self.only_offset: int | None = None
        if "offset" in self.options:
            self.only_offset = int(self.options["offset"])

    def flag(self, name: str, default: str) -> bool:
        return str(self.options.get(name, default)).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only_path = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("offset",):
                self.only_offset = int(f.value)
            yield f  # still checked after the scan

    def files(self) -> list[str]:
        given = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        out: list[str] = []
        for p in given:
            p = p.removeprefix("file://")
            if os.path.isdir(p):
                out += sorted(os.path.join(d, f) for d, _, names in os.walk(p) for f in names if not f.startswith((".", "_")))
            else:
                out += sorted(glob.glob(p)) or [p]
        return [p for p in out if self.only_path in (None, p)]

    def partitions(self) -> list[Split]:
        split = int(self.options.get("splitbytes", 0))
        out = []
        for p in self.files():
            size = os.path.getsize(p)
            whole = not split or size <= split or self.only_offset is not None or "limitperfile" in self.options or self.options.get("compression") == "file" or not _is_members(p)
            out += [Split(p, 0, None)] if whole else [Split(p, a, min(a + split, size)) for a in range(0, size, split)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        compat, keep = self.flag("compat", "false"), self.flag("includecontent", "true")
        strict = str(self.options.get("mode", "PERMISSIVE")).upper() == "FAILFAST"
        limit = int(self.options["limitperfile"]) if "limitperfile" in self.options else None

        def rows() -> Iterator[dict]:
            with open(partition.path, "rb") as raw:
                compression = archive.sniff(raw.peek(2), partition.path, str(self.options.get("compression", "auto")))
                size = os.path.getsize(partition.path)
                start, parser, most = partition.start, None, limit
                if self.only_offset is not None:
                    if partition.path.endswith((".arc", ".arc.gz")) and self.only_offset:
                        parser = archive.Parser(compat, False)
                        next(archive.records(raw, compression, limit=1, parser=parser), None)  # its field names
                    start, most = self.only_offset, 1
                elif start:
                    start = archive.find_start(raw, start, size)
                    if partition.end is not None and start >= partition.end:
                        return
                raw.seek(start)
                for row in file_rows(archive.records(raw, compression, start, most, compat, keep, partition.end, parser), partition.path, not start):
                    if strict and (row["fatal"] or row["errors"]):
                        raise ValueError(f"{partition.path} at {row['offset']}: {row['fatal'] or row['errors']}")
                    yield row

        yield from batches(rows())


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None
    rows: int


class ArchiveWriter(DataSourceWriter):
    """One file per partition, visible only once the whole job has succeeded."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        options = {k.lower(): v for k, v in options.items()}
        self.folder = options["path"].removeprefix("file://")
        self.compressed = str(options.get("gzip", "false")).lower() == "true"
        self.verbatim = str(options.get("verbatim", "false")).lower() == "true"
        self.overwrite = overwrite

    def write(self, iterator) -> Written:  # noqa: ANN001
        os.makedirs(self.folder, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed
        temporary, n = os.path.join(self.folder, f".{name}"), 0
        with open(temporary, "wb") as out:
            for row in iterator:
                row = row.asDict()
                headers = [(h["name"], h["value"]) for h in row.get("headers") or []]
                out.write(archive.serialize(row.get("version") or "WARC/1.0", headers, bytes(row.get("content") or b""), row.get("content_type"), self.verbatim, compressed=self.compressed))
                n += 1
        if not n:
            os.remove(temporary)
            return Written(None, None, 0)
        return Written(temporary, os.path.join(self.folder, name), n)

    def commit(self, messages: list[Written | None]) -> None:
        kept = [m for m in messages if m and m.temporary]
        if self.overwrite and os.path.isdir(self.folder):
            for old in glob.glob(os.path.join(self.folder, "part-*.warc*")):
                os.remove(old)
        for m in kept:
            os.replace(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)


class WebArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webarchive"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("webarchive")`` known, with filters pushed into its scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebArchive)


def parse_objects(files: DataFrame, compression: str = "auto", compat: bool = False) -> DataFrame:
    """Records of whole files held in rows (path, content), such as those of ``binaryFile``."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for path, data in zip(batch["path"].to_pylist(), batch["content"]):
                if data.is_valid:
                    found = archive.records(io.BufferedReader(io.BytesIO(data.as_py())), compression, compat=compat)
                    yield from batches(file_rows(found, path))

    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def read_objects(spark: SparkSession, path: str, **options: str | bool) -> DataFrame:
    """Records of files on any Hadoop file system; each file is one row on the way, so below 2 GB."""
    return parse_objects(spark.read.format("binaryFile").load(path), **options)


def stream_objects(spark: SparkSession, path: str, **options: str | bool) -> DataFrame:
    """A stream of the records of files as they arrive in a folder."""
    schema = spark.read.format("binaryFile").load(path).schema
    return parse_objects(spark.readStream.format("binaryFile").schema(schema).load(path), **options)

"""Trees of source files as a data source: ``register(spark)``, then ``spark.read.format("pages").load(folder)`` or ``spark.readStream`` alike.

A row has page_id (the path below the folder without its suffix), path, suffix, kind, size, modified, text and metadata, as readers.extract() finds them; a file
that can't be read has an error in its metadata. Files are dealt out by size, up to splitBytes a partition, and read by the tasks. Conditions of equality or
membership on suffix, kind and page_id, and on beginnings of page_id, are applied to the listing, so that other files are never opened (with
spark.sql.python.filterPushdown.enabled; otherwise Spark applies them afterwards). Hidden files and folders are left out.

A stream's offset is a time: a batch has the files modified since the last one, up to some seconds ago (lag, 2 unless given), so that files of one moment are
in one batch and no file is read twice. A file that is changed is read again; one that comes with an older time than the stream has reached isn't seen.
The listing of a folder is the driver's; folders must be such that driver and executors see them alike.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from tessarium.sources import readers

SCHEMA = "page_id string, path string, suffix string, kind string, size long, modified timestamp, text string, metadata map<string,string>"
FIELDS = pa.schema([("page_id", pa.string()), ("path", pa.string()), ("suffix", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])
#: Bytes of a partition, and of a batch of rows.
SPLIT, BATCH = 64 << 20, 8 << 20


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


@dataclass(frozen=True)
class File:
    page_id: str
    path: str
    suffix: str
    kind: str
    size: int
    #: Nanoseconds.
    modified: int


@dataclass
class Split(InputPartition):
    files: list[File]

    def __init__(self, files: list[File]):
        self.files = files


def kind_of(name: str, suffix: str) -> str:
    return "code" if name.lower() == "dockerfile" else readers.KINDS.get(suffix, "web" if suffix in ("html", "htm") else "markdown")


def listed(folder: str) -> Iterator[File]:
    system, base = opened(folder)
    base = base.rstrip("/")
    for x in system.get_file_info(fs.FileSelector(base, recursive=True)):
        inner = x.path.removeprefix(base).lstrip("/")
        if x.type == fs.FileType.File and not any(part.startswith(".") for part in inner.split("/")):
            stem, dot, suffix = inner.rpartition(".")
            suffix = suffix.lower() if dot and "/" not in suffix else ""
            yield File(stem if suffix else inner, x.path, suffix, kind_of(x.base_name, suffix), x.size, x.mtime_ns)


def splits(files: Iterable[File], most: int) -> list[Split]:
    """Files in order of their path, up to some bytes together; at least one each."""
    out: list[Split] = []
    held = most + 1
    for file in sorted(files, key=lambda f: f.path):
        if held + file.size > most:
            out.append(Split([]))
            held = 0
        out[-1].files.append(file)
        held += file.size
    return out


def rows(folder: str, files: list[File]) -> Iterator[pa.RecordBatch]:
    system, _ = opened(folder)
    out: list[tuple] = []
    held = 0
    for f in files:
        try:
            with system.open_input_stream(f.path, compression=None) as stream:
                text, about, _ = readers.extracted(f.kind, f.path, stream.read())
        except Exception as error:  # one bad file must not end the job
            text, about = None, {"error": str(error)}
        out.append((f.page_id, f.path, f.suffix, f.kind, f.size, datetime.fromtimestamp(f.modified / 1e9, timezone.utc), text, list(about.items())))
        held += f.size
        if held > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), FIELDS)], schema=FIELDS)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), FIELDS)], schema=FIELDS)


class Reader(DataSourceReader):
    #: Columns that a listing knows.
    KNOWN = ("suffix", "kind", "page_id")

    def __init__(self, options: dict):
        self.folder, self.most, self.conditions = options["path"], int(options.get("splitbytes", SPLIT)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 else None
            if name not in self.KNOWN:
                yield f
            elif isinstance(f, StringStartsWith):
                self.conditions.append((name, None, f.value))
            else:
                self.conditions.append((name, set(f.value) if isinstance(f, In) else {f.value}, None))

    def wanted(self, file: File) -> bool:
        return all(getattr(file, name) in values if values is not None else getattr(file, name).startswith(start) for name, values, start in self.conditions)

    def partitions(self) -> list[Split]:
        return splits(filter(self.wanted, listed(self.folder)), self.most) or [Split([])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from rows(self.folder, partition.files)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.most, self.lag = options["path"], int(options.get("splitbytes", SPLIT)), float(options.get("lag", 2))

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.lag * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return splits((f for f in listed(self.folder) if start["until"] <= f.modified < end["until"]), self.most) or [Split([])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from rows(self.folder, partition.files)

    def commit(self, end: dict) -> None: ...


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> StreamReader:
        return StreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)

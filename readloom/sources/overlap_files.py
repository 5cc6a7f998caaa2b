"""Overlap records as files: a data source that Spark reads and writes in partitions, with a commit and with ranges of reads that are left out unread.

A folder holds one file for each written partition and a list of them. A file is a row of records: a head of fixed size, the number of trace numbers, and these,
a byte each where all fit and two where not. The list names each file with its records, bytes, and least and greatest aread; it is written last, when all
files are there, so that a folder without one was never committed.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "overlap_files"
SCHEMA = "aread long, bread long, comp boolean, band long, abpos long, aepos long, bbpos long, bepos long, diffs long, trace array<struct<d:long,b:long>>"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: A record's head: reads, band, places, differences, whether the contig is complemented, bytes of a trace number, trace numbers.
_HEAD = struct.Struct("<qqqqqqqqBBI")
_LIST, _PART = "_overlaps.json", "part"
#: Records of an Arrow batch.
BATCH = 4096
_ARROW = pa.schema([*((c, pa.bool_() if c == "comp" else pa.int64()) for c in _NAMES[:-1]), ("trace", pa.list_(pa.struct([("d", pa.int64()), ("b", pa.int64())])))])


def place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def packed(r: Row) -> bytes:
    """A record; trace numbers over 65535 are an error."""
    flat = [int(v) for t in r["trace"] or [] for v in (t["d"], t["b"])]
    width = 1 if max(flat, default=0) < 256 else 2
    head = _HEAD.pack(r["aread"], r["bread"], r["band"], r["abpos"], r["aepos"], r["bbpos"], r["bepos"], r["diffs"], bool(r["comp"]), width, len(flat))
    return head + struct.pack(f"<{len(flat)}{'BH'[width - 1]}", *flat)


def unpacked(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        aread, bread, band, a0, a1, b0, b1, diffs, comp, width, n = _HEAD.unpack_from(data, at)
        flat = struct.unpack_from(f"<{n}{'BH'[width - 1]}", data, at + _HEAD.size)
        at += _HEAD.size + n * width
        yield aread, bread, bool(comp), band, a0, a1, b0, b1, diffs, [{"d": d, "b": b} for d, b in zip(flat[::2], flat[1::2], strict=True)]


@dataclass
class Written(WriterCommitMessage):
    """A file: its name, records, bytes, least and greatest key."""

    name: str
    n: int
    size: int
    low: int | None
    high: int | None


@dataclass
class Part(InputPartition):
    name: str
    size: int


class Writer(DataSourceWriter):
    LIST = _LIST

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        """A task's file, under a name of its own: of two attempts only the committed one is in the list."""
        fs, path = place(self.path)
        fs.create_dir(path)
        name, n, size, low, high = f"{_PART}-{uuid.uuid4().hex}", 0, 0, None, None
        with fs.open_output_stream(f"{path}/{name}") as out:
            for r in iterator:
                record = packed(r)
                out.write(record)
                n, size = n + 1, size + len(record)
                low, high = min(r["aread"], r["aread"] if low is None else low), max(r["aread"], r["aread"] if high is None else high)
        return Written(name, n, size, low, high)

    def commit(self, messages: Sequence[Written | None]) -> None:
        fs, path = place(self.path)
        fs.create_dir(path)
        had = [] if self.overwrite else listed(self.path, self.LIST, missing=True)
        gone = listed(self.path, self.LIST, missing=True) if self.overwrite else []
        files = [*had, *(vars(m) for m in messages if m is not None)]
        with fs.open_output_stream(f"{path}/{self.LIST}") as out:
            out.write(json.dumps(files).encode())
        for f in gone:
            fs.delete_file(f"{path}/{f['name']}")

    def abort(self, messages: Sequence[Written | None]) -> None:
        fs, path = place(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{path}/{m.name}")


def listed(path: str, name: str = _LIST, missing: bool = False) -> list[dict]:
    """The committed files of a folder; one without a list is an error unless it may be missing."""
    fs, at = place(path)
    if fs.get_file_info(f"{at}/{name}").type == pa.fs.FileType.NotFound:
        if missing:
            return []
        raise FileNotFoundError(f"no committed files in {path}")
    with fs.open_input_stream(f"{at}/{name}") as file:
        return json.loads(file.read())


class Reader(DataSourceReader):
    KEY, LIST = "aread", _LIST

    def __init__(self, path: str):
        self.path, self.low, self.high = path, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the key leave out whole files; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.KEY,) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self) -> list[Part]:
        return [Part(f["name"], f["size"]) for f in listed(self.path, self.LIST) if f["n"] and self.wanted(f["low"], f["high"])]

    def wanted(self, low: int, high: int) -> bool:
        """Whether keys from low to high may be within the bounds."""
        return (self.low is None or high >= self.low) and (self.high is None or low <= self.high)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is left to read
            return
        fs, path = place(self.path)
        with fs.open_input_stream(f"{path}/{partition.name}") as file:
            data = file.read()
        if len(data) != partition.size:
            raise ValueError(f"{partition.name} has {len(data)} bytes, not {partition.size}")
        rows: list[tuple] = []
        for r in unpacked(data):
            rows.append(r)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class OverlapFiles(DataSource):
    """spark.read.format("overlap_files").load(folder), and df.write.format("overlap_files").mode("append" or "overwrite").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if schema.names != _NAMES:
            raise ValueError(f"overlaps have the columns {', '.join(_NAMES)}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OverlapFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

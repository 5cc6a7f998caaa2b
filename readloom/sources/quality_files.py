"""Quality entries as files: their text, read in ranges of bytes, and packed blocks, each with codes of its own, written and read in partitions.

Text: six lines an entry, a head and five of equal length. A head holds a space, which no other line does, so that a range of bytes finds its first entry by
itself, and each entry is read by the range in which it begins.

Packed: a folder holds one file for each written partition and a list of them, as for overlaps. A file is a row of blocks: a head of fixed size (bytes,
entries, least and greatest well), the codes, the entries. A block's codes come from its own entries, so that a task needs one pass and holds one block; a block
whose wells a filter leaves out is skipped without being read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from readloom.functions.quality_codec import LINES, Packed, block_codes, pack_entry, unpack_entry
from readloom.sources import overlap_files
from readloom.sources.overlap_files import Part, Written, place

NAME, TEXT = "quality_files", "quality_text"
SCHEMA = "well long, header string, del string, tag string, ins string, mrg string, sub string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = pa.schema([("well", pa.int64()), *((c, pa.string()) for c in _NAMES[1:])])
#: Fixed format of a head: movie, well, range of the read, quality.
_HEADER = re.compile(rb"@[^ ]*/(\d+)/\d+_\d+ RQ=0\.\d+")
#: A block's head: bytes behind it, entries, least and greatest well. An entry's: well, length, runs, bytes of the head and of the six streams.
_BLOCK, _ENTRY = struct.Struct("<IIqq"), struct.Struct("<q9I")
#: Bytes of lines in a block or batch, at least, unless no more come; bytes of a range of text.
BLOCK_BYTES, SPLIT_BYTES = 4 << 20, 64 << 20


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 5 * len(r[2]) + 1
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


# ---------------------------------------------------------------- text


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int


def text_entries(file: BinaryIO, start: int, end: int) -> Iterator[tuple]:
    """The entries whose head begins in [start, end). Lines of unequal length, an entry cut short, and lines where a head should stand are errors."""
    file.seek(max(start - 1, 0))
    if start:
        file.readline()
    inside = start == 0
    while True:
        at, line = file.tell(), file.readline()
        told = _HEADER.fullmatch(line.rstrip(b"\r\n"))
        if not line or not inside and at >= end:
            return
        if not told:
            if inside:
                raise ValueError(f"no head of an entry at byte {at}")
            continue
        if at >= end:
            return
        inside = True
        raw = [file.readline() for _ in LINES]
        lines = [x.rstrip(b"\r\n").decode("ascii") for x in raw]
        header = told.group().decode("ascii")
        if not all(raw):
            raise ValueError(f"cut short: {header}")
        if len({len(x) for x in lines}) > 1:
            raise ValueError(f"lines of unequal length: {header}")
        yield (int(told.group(1)), header, *lines)


class TextReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        fs, path = place(self.path)
        told = fs.get_file_info(path)
        if told.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [told] if told.is_file else [f for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "_."]
        return [Range(f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no bytes at all
            return
        fs, _ = place(self.path)
        with io.BufferedReader(fs.open_input_file(partition.name), 1 << 20) as file:
            yield from _batches(text_entries(file, partition.start, partition.end))


class QualityText(DataSource):
    """spark.read.format("quality_text").option("split", bytes).load(file or folder); wells come from the heads."""

    @classmethod
    def name(cls) -> str:
        return TEXT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TextReader:
        return TextReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))


# ---------------------------------------------------------------- packed blocks


def packed_block(rows: Sequence[Row]) -> bytes:
    """A block of rows; nulls and lines of unequal length are errors."""
    lines = [[r[c] for c in LINES] for r in rows]
    for r, five in zip(rows, lines, strict=True):
        if len({len(x.encode("ascii")) for x in five}) > 1:
            raise ValueError(f"lines of unequal length: {r['header']}")
    codes, char = block_codes(lines)
    head = json.dumps({"char": char, "codes": {c: list(x.items()) for c, x in codes.items()}}).encode()
    parts = [struct.pack("<I", len(head)), head]
    for r, (dele, tag, *others) in zip(rows, lines, strict=True):
        p = pack_entry([dele.encode(), *(x.encode() for x in others)], tag, codes, char)
        name = r["header"].encode()
        parts += [_ENTRY.pack(r["well"], p.n, p.pairs, len(name), *map(len, p[2:])), name, *p[2:]]
    data, wells = b"".join(parts), [r["well"] for r in rows]
    return _BLOCK.pack(len(data), len(rows), min(wells), max(wells)) + data


def unpacked_block(data: bytes) -> Iterator[tuple]:
    """The rows of a block without its head."""
    (size,) = struct.unpack_from("<I", data)
    told = json.loads(data[4 : 4 + size])
    codes, char, at = {c: dict(map(tuple, x)) for c, x in told["codes"].items()}, told["char"], 4 + size
    while at < len(data):
        well, n, pairs, *sizes = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        parts = []
        for s in sizes:
            parts.append(data[at : at + s])
            at += s
        yield (well, parts[0].decode(), *unpack_entry(Packed(n, pairs, *parts[1:]), codes, char))


class Writer(overlap_files.Writer):
    LIST = "_qualities.json"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, path = place(self.path)
        fs.create_dir(path)
        name, n, size, low, high = f"part-{uuid.uuid4().hex}", 0, 0, None, None
        with fs.open_output_stream(f"{path}/{name}") as out:
            for rows in _blocks(iterator):
                data = packed_block(rows)
                out.write(data)
                _, count, first, last = _BLOCK.unpack_from(data)
                n, size = n + count, size + len(data)
                low, high = first if low is None else min(low, first), last if high is None else max(high, last)
        return Written(name, n, size, low, high)


def _blocks(rows: Iterator[Row]) -> Iterator[list[Row]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 5 * len(r["del"]) + 1
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Reader(overlap_files.Reader):
    KEY, LIST = "well", Writer.LIST

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _batches(self._rows(partition))

    def _rows(self, partition: Part) -> Iterator[tuple]:
        fs, path = place(self.path)
        with fs.open_input_file(f"{path}/{partition.name}") as file:
            if file.size() != partition.size:
                raise ValueError(f"{partition.name} has {file.size()} bytes, not {partition.size}")
            at = 0
            while at < partition.size:
                file.seek(at)
                size, _, low, high = _BLOCK.unpack(file.read(_BLOCK.size))
                if self.wanted(low, high):
                    yield from unpacked_block(file.read(size))
                at += _BLOCK.size + size


class QualityFiles(DataSource):
    """spark.read.format("quality_files").load(folder), and df.write.format("quality_files").mode("append" or "overwrite").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if schema.names != _NAMES:
            raise ValueError(f"quality entries have the columns {', '.join(_NAMES)}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QualityText)
    spark.dataSource.register(QualityFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

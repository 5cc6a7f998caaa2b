"""Packing of tokenised documents into fixed-length sequences: large items are matched first, small ones best-fit the gaps.

Lengths are integers up to the capacity, so the whole plan follows from the histogram of lengths: runs of equal bins are planned together on the
driver (at most `capacity` lengths, a few runs each), and every item finds its place from its length and its rank among the items of that length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from readloom.llm.bpe import PATTERN, ByteBpe, Pieces, read_vocabulary
from readloom.llm.util import give_back, short_batches, small_side, written

CAPACITY = 1024
_FAR = 1 << 50


class Plan:
    """Runs of equal bins. A segment (length, first rank, items, items a bin, first bin, offset) places consecutive ranks of one length."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first bin, bins)
        self.gaps: list[int] = []
        self.placed: dict[int, int] = {}

    def put(self, size: int, items: int, each: int, bin_: int, offset: int) -> None:
        rank = self.placed.get(size, 0)
        self.segments.append((size, rank, items, each, bin_, offset))
        self.placed[size] = rank + items

    def leave(self, gap: int, bin_: int, bins: int) -> None:
        if bins and gap:
            if not self.open.setdefault(gap, []):
                insort(self.gaps, gap)
            self.open[gap].append((bin_, bins))

    def new(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins

    def match(self, counts: dict[int, int]) -> None:
        """Items above a third of the capacity, at most two in a bin: the largest goes with the largest other that still fits beside it."""
        large = sorted((s for s in counts if 3 * s > self.capacity), reverse=True)
        left = {s: counts[s] for s in large}
        for i, a in enumerate(large):
            for b in large[i:]:
                if a + b > self.capacity:
                    continue
                pairs = left[a] // 2 if a == b else min(left[a], left[b])
                if not pairs:
                    if not left[a]:
                        break
                    continue
                at = self.new(pairs)
                self.put(a, pairs, 1, at, 0)
                self.put(b, pairs, 1, at, a)
                left[a] -= pairs
                left[b] -= pairs
                self.leave(self.capacity - a - b, at, pairs)
            if n := left[a]:
                at = self.new(n)
                self.put(a, n, 1, at, 0)
                left[a] = 0
                self.leave(self.capacity - a, at, n)

    def fill(self, size: int, items: int) -> None:
        """Items of one length: each time into the smallest gap that takes them, as often as it does; then into new bins."""
        while items:
            i = bisect_left(self.gaps, size)
            if i < len(self.gaps):
                gap = self.gaps[i]
                at, bins = self.open[gap].pop()
                if not self.open[gap]:
                    del self.gaps[i]
            else:
                gap, bins = self.capacity, -(-items // (self.capacity // size))
                at = self.new(bins)
            each = gap // size
            full = min(bins, items // each)
            if full:
                self.put(size, full * each, each, at, self.capacity - gap)
                self.leave(gap - each * size, at, full)
                items -= full * each
            rest = bins - full
            if items and rest:
                self.put(size, items, items, at + full, self.capacity - gap)
                self.leave(gap - items * size, at + full, 1)
                full, rest, items = full + 1, rest - 1, 0
            self.leave(gap, at + full, rest)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    out = Plan(capacity)
    out.match(counts)
    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        out.fill(size, counts[size])
    return out


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset. items: any columns and length (1 to capacity); rows may repeat, each is packed.

    Other columns pass through, whatever their names, but for sequence_id and offset, which are replaced. Equal lengths are ranked chunk by
    chunk (an Arrow batch), so that no task sees all items of a length, however many there are.
    """
    items = items.drop("sequence_id", "offset")
    given = items.columns
    items = items.toDF(*["length" if c == "length" else f"c{k}" for k, c in enumerate(given)])  # no name clashes with the steps' own
    long = lambda *names: [StructField(n, LongType()) for n in names]

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            yield batch.assign(_chunk=part + k, _rank=batch.groupby("length").cumcount())

    kept = written(items.mapInPandas(ranked, StructType([*items.schema.fields, *long("_chunk", "_rank")])))
    sums = written(kept.groupBy("length", "_chunk").agg(F.count("*").alias("_n")).withColumn("_task", F.shiftright("_chunk", 32)))
    upto = lambda n, order, *by: F.sum(n).over(Window.partitionBy("length", *by).orderBy(order)) - F.col(n)
    tasks = sums.groupBy("length", "_task").agg(F.sum("_n").alias("_t"))  # so that the window over a length has a row a task, not one a chunk
    tasks = written(tasks.select("length", "_task", "_t", upto("_t", "_task").alias("_first")))
    inside = sums.select("length", "_task", "_chunk", upto("_n", "_chunk", "_task").alias("_inside")).join(small_side(tasks), ["length", "_task"])
    before = written(inside.select("length", "_chunk", (F.col("_first") + F.col("_inside")).alias("_before")))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("_t").alias("n")).collect()}  # at most capacity rows
    segments = np.array(sorted(plan(counts, capacity).segments), np.int64).reshape(-1, 6)
    firsts = segments[:, 0] * _FAR + segments[:, 1]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = (batch["_rank"] + batch["_before"]).to_numpy(np.int64)
            size = batch["length"].to_numpy(np.int64)
            seg = segments[np.searchsorted(firsts, size * _FAR + rank, "right") - 1]
            i = rank - seg[:, 1]
            out = batch.drop(columns=["_chunk", "_rank", "_before"])
            yield out.assign(sequence_id=seg[:, 4] + i // seg[:, 3], offset=seg[:, 5] + i % seg[:, 3] * size)

    joined = kept.join(small_side(before), ["length", "_chunk"]).select(*kept.columns, "_before")
    return joined.mapInPandas(placed, StructType([*items.schema.fields, *long("sequence_id", "offset")])).toDF(*given, "sequence_id", "offset")


class Encoder:
    """The ids of whole texts for a byte-level BPE file of the tokenizers library, found by tiktoken with that file's vocabulary: the ids are the same,
    in a fifth of the time. tiktoken's pattern overflows its stack on thousands of blanks in a row; such a text goes to this library's own encoder."""

    def __init__(self, path: str):
        self.path = path
        ids, merges, special = read_vocabulary(path)
        made = [ids[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path}: ids don't follow the ranks")
        self.pieces = Pieces(special)
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; none for a null or empty text."""
        out = []
        for x in self.pieces(text or ""):
            if isinstance(x, int):
                out.append(x)
                continue
            try:
                out += self.encoding.encode_ordinary(x)
            except BaseException as error:
                if type(error).__name__ != "PanicException":
                    raise
                out += _own(self.path).encode(x)
        return array("I", out).tobytes() if sys.byteorder == "little" else np.array(out, "<u4").tobytes()


@lru_cache(maxsize=1)
def _own(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces: its ids and end_id, cut into pieces of capacity if longer, of which
    the first may be shorter. A null or empty text is one piece with end_id; rows that repeat a doc_id have pieces each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, of = [], []
            for k, text in enumerate(batch["text"]):
                data = encode(text) + end
                n = len(data) // 4
                length = (n - 1) % capacity + 1
                start = piece = 0
                while start < n:
                    rows.append((piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                    of.append(k)
                    start, piece, length = start + length, piece + 1, capacity
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", batch["doc_id"].array.take(of))
            yield out
        give_back()

    short_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset. An empty table gives an empty result."""
    return pack(token_pieces(docs, vocabulary, end_id, capacity), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece: see token_pieces() and pack()."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

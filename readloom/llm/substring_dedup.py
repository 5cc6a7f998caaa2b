"""Removal of word sequences that occur more than once: fixed-block anchors, probed by every rolling window, extended to maximal repeats.

Any window of WINDOW words holds a whole block of BLOCK words of its own document's grid (WINDOW >= 2 * BLOCK - 1). So
1. all documents' grid blocks are the index, all rolling windows of BLOCK words the probes; both meet by hash, packed by slice of documents and
   partition of the hash, distinct within a slice, so that a passage of all documents is one entry a slice;
2. around each block that occurs elsewhere too, hits are extended: the windows of WINDOW words that hold it are counted by 96 bits of two independent
   hashes, and runs of windows that occur twice are the maximal repeats.
Rows are numbered once, and results find their row by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from readloom.llm.simhash import whole_groups
from readloom.llm.util import WORD_BASE, numbered, pack, partitions, ranges, rolling, small_side, steps, unpack, window_hash, word_hashes, word_spans, written

WINDOW, BLOCK = 35, 18
_SECOND = 0xB5297A4D3F84D5B5
_HITS = "q int, probes binary, multi binary, index binary, keys binary, blocks binary"
_RUNS = "q int, chunk long, single binary, place binary, multi binary, keys binary, starts binary, counts binary, seen binary"


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """A partition below n from a hash's top bits."""
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def by_q(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole q, one at a time."""

    def same(x: pa.RecordBatch) -> np.ndarray:
        q = x.column("q").to_numpy()
        return np.concatenate(([False], q[1:] == q[:-1]))

    for batch in whole_groups(batches, same, 1):
        cuts = np.append(np.flatnonzero(~same(batch)), batch.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def joined(column: pa.Array, dtype) -> np.ndarray:
    """The numbers of all rows of a binary column, one after another."""
    return np.frombuffer(utf8_bytes(column), dtype)


def utf8_bytes(column: pa.Array) -> bytes:
    return b"".join(x.as_py() for x in column)


def _wide(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit and the 32-bit halves of packed hashes, which stand apart in each cell."""
    cells = [x.as_py() for x in column]
    return tuple(np.frombuffer(b"".join(x), kind) for x, kind in (([c[: len(c) // 12 * 8] for c in cells], "<u8"), ([c[len(c) // 12 * 8 :] for c in cells], "<u4")))  # type: ignore[return-value]


def block_hits(docs: DataFrame, block: int) -> DataFrame:
    """_key, blocks: the grid blocks of each document (docs: _key, text) whose words occur elsewhere too, at any place of any document."""
    n = partitions(docs.sparkSession)
    wide = 4 * n

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                starts, ends, rows = word_spans(data, offsets)
                per_row = np.maximum(np.diff(rows) - block + 1, 0)
                if not per_row.any():
                    continue
                first = ranges(rows[:-1], per_row)
                h = window_hash(rolling(word_hashes(data, starts, ends), WORD_BASE), first, first + block, WORD_BASE)
                of = np.repeat(np.arange(len(per_row)), per_row)
                word = first - rows[:-1][of]
                grid = np.flatnonzero(word % block == 0)
                q = part_of(h, wide).astype(np.uint64)
                own, where, count = np.unique((q << np.uint64(40)) | (h & np.uint64(0xFFFFFFFFFF)), return_inverse=True, return_counts=True)
                cuts = np.searchsorted(own >> np.uint64(40), np.arange(wide + 1, dtype=np.uint64))
                grid = grid[np.argsort(where[grid], kind="stable")]
                spot = where[grid]
                grid_cuts = np.searchsorted(spot, cuts)
                keys = part.column("_key").to_numpy()[of[grid]]
                number = (word[grid] // block).astype("<u4")
                made = []
                for p in np.flatnonzero(np.diff(cuts)):
                    a, b, c, d = cuts[p], cuts[p + 1], grid_cuts[p], grid_cuts[p + 1]
                    made.append((p, pack(own[a:b], 5), np.packbits(count[a:b] > 1).tobytes(), (spot[c:d] - a).astype("<u4").tobytes(), keys[c:d].tobytes(), number[c:d].tobytes()))
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *map(binary, cols[1:])], [x.split()[0] for x in _HITS.split(", ")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_q(batches):
            sizes = np.array([len(x.as_py()) // 5 for x in batch.column("probes")])
            index = [np.frombuffer(x.as_py(), "<u4") for x in batch.column("index")]
            if not any(len(x) for x in index):
                continue
            multi = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=k) for x, k in zip(batch.column("multi"), sizes, strict=True)])
            _, where, count = np.unique(unpack(utf8_bytes(batch.column("probes")), 5), return_inverse=True, return_counts=True)
            again = (count > 1) | (np.bincount(where, multi, len(count)) > 0)
            base = np.repeat(np.cumsum(sizes) - sizes, [len(x) for x in index])
            hit = again[where[base + np.concatenate(index)]]
            keys, blocks = joined(batch.column("keys"), "<i8")[hit], joined(batch.column("blocks"), "<u4")[hit]
            pairs = np.unique(np.stack((keys, blocks.astype(np.int64)), 1), axis=0) if len(keys) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1].astype(np.int32))], ["_key", "block"])

    hits = docs.mapInArrow(probe, _HITS).repartition(n, "q").sortWithinPartitions("q").mapInArrow(meet, "_key long, block int")
    return hits.groupBy("_key").agg(F.sort_array(F.collect_set("block")).alias("blocks"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """_key, starts, counts (arrays): the runs of windows (first word, number) of each row of docs (_key, text) that also start elsewhere. Written."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block at any place")
    docs = docs.select("_key", "text").where("text is not null")
    n = partitions(docs.sparkSession)
    hits = written(block_hits(docs, block))
    found = docs.join(small_side(hits, 6 << 20), "_key").select("_key", "text", "blocks")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                starts, ends, rows = word_spans(data, offsets)
                per_row = np.maximum(np.diff(rows) - window + 1, 0)
                if not per_row.any():
                    continue
                grid = np.diff(rows) // block + 1
                grid_at = np.cumsum(grid) - grid
                lists = part.column("blocks")
                hit = np.zeros(int(grid.sum()), bool)
                hit[lists.flatten().to_numpy() + np.repeat(grid_at, np.diff(lists.offsets.to_numpy()))] = True
                of = np.repeat(np.arange(len(per_row)), per_row)
                word = ranges(np.zeros(len(per_row), np.int64), per_row)
                mine = hit[grid_at[of] + (word + block - 1) // block]
                of, word = of[mine], word[mine]
                if not len(of):
                    continue
                first = rows[:-1][of] + word
                h = window_hash(rolling(word_hashes(data, starts, ends), WORD_BASE), first, first + window, WORD_BASE)
                h2 = window_hash(rolling(word_hashes(data, starts, ends, 2), _SECOND), first, first + window, _SECOND)
                q = part_of(h, n)
                h2 &= np.uint64(0xFFFFFFFF)
                order = np.lexsort((h2, h, q))
                hs, rest, qs = h[order], h2[order].astype("<u4"), q[order]
                new = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (rest[1:] != rest[:-1]))))
                count = np.diff(np.append(new, len(hs)))
                seen = np.zeros(len(h), bool)
                seen[order] = np.repeat(count > 1, count)
                one, many = new[count == 1], new[count > 1]
                cut1, cut2 = (np.searchsorted(qs[x], np.arange(n + 1)) for x in (one, many))
                run = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (word[1:] != word[:-1] + 1))))
                keys = part.column("_key").to_numpy()[of[run]]
                chunk = part.column("_key")[0].as_py()  # its first row names a slice
                made = [(chunk % n, chunk, b"", b"", b"", keys.tobytes(), word[run].astype("<u4").tobytes(), np.diff(np.append(run, len(of))).astype("<u4").tobytes(), np.packbits(seen).tobytes())]
                for p in np.flatnonzero(np.diff(cut1) + np.diff(cut2)):
                    a, b = one[cut1[p] : cut1[p + 1]], many[cut2[p] : cut2[p + 1]]
                    made.append((p, chunk, hs[a].tobytes() + rest[a].tobytes(), order[a].astype("<u4").tobytes(), hs[b].tobytes() + rest[b].tobytes(), b"", b"", b"", b""))
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *map(binary, cols[2:])], [x.split()[0] for x in _RUNS.split(", ")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_q(batches):
            sizes = np.array([len(x.as_py()) // 12 for x in batch.column("single")])
            high, low = (np.concatenate((x, y, y)) for x, y in zip(_wide(batch.column("single")), _wide(batch.column("multi")), strict=True))
            order = np.lexsort((low, high))
            new = np.concatenate(([True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))[: len(order)]
            again = np.zeros(len(order), bool)
            again[order] = np.repeat(np.diff(np.append(np.flatnonzero(new), len(order))) > 1, np.diff(np.append(np.flatnonzero(new), len(order))))
            again = again[: int(sizes.sum())]
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            place = joined(batch.column("place"), "<u4")
            places = [place[a:b][again[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            keep = np.array([bool(p) or bool(len(k.as_py())) for p, k in zip(places, batch.column("keys"), strict=True)])
            out = pa.RecordBatch.from_arrays([batch.column("chunk"), binary(places), *(batch.column(c) for c in ("keys", "starts", "counts", "seen"))], ["chunk", "place", "keys", "starts", "counts", "seen"])
            yield out.filter(pa.array(keep))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renamed = (b.rename_columns(["q", *b.schema.names[1:]]) for b in batches)
        for batch in by_q(renamed):
            place = joined(batch.column("place"), "<u4")
            for i in [i for i, k in enumerate(batch.column("keys")) if len(k.as_py())][:1]:
                keys, word, size = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("keys", "<i8"), ("starts", "<u4"), ("counts", "<u4")))
                seen = np.unpackbits(np.frombuffer(batch.column("seen")[i].as_py(), np.uint8), count=int(size.sum())).astype(bool)
                seen[place] = True
                run = np.repeat(np.arange(len(keys)), size)
                at = word[run] + ranges(np.zeros(len(size), np.int64), size.astype(np.int64))
                run, at = run[seen], at[seen]
                if not len(run):
                    continue
                key = keys[run]
                new = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1))))
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(at[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(at))).astype(np.int32))], ["_key", "start", "count"])

    counted = found.mapInArrow(extend, _RUNS).repartition(n, "q").sortWithinPartitions("q").mapInArrow(count, "chunk long, place binary, keys binary, starts binary, counts binary, seen binary")
    runs = counted.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(collect, "_key long, start int, count int")
    each = F.sort_array(F.collect_set(F.struct("start", "count"))).alias("_r")
    return written(runs.groupBy("_key").agg(each).select("_key", F.col("_r.start").alias("starts"), F.col("_r.count").alias("counts")))


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_removed and kept (the remaining words joined by one space; null where nothing is removed and text null).

    A word goes if a window of `window` words that covers it also starts at any other place, in the same document too; windows are judged on the
    texts as given. Null texts have no words; texts shorter than a window keep all. Rows that repeat doc_id and text are copies of each other like
    any other rows; doc_id isn't read, so nulls in it don't matter. An empty table gives an empty result. Other columns pass through; columns named
    as the new ones are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    names, rows = docs.columns, numbered(docs)
    runs = repeated_runs(rows.select("_key", F.col("_row.text").alias("text")), window, block)
    told = rows.join(small_side(runs, 6 << 20), "_key", "left").select("_row", "starts", "counts")
    at_text, width = names.index("text"), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([*batch.column(0).flatten(), batch.column(1), batch.column(2)], [str(i) for i in range(width + 2)])
            for part, data, offsets in steps(batch, at_text):
                starts, ends, rows = word_spans(data, offsets)
                lists, sizes = (x.fill_null([]) if x.null_count else x for x in (part.column(width), part.column(width + 1)))
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                first = rows[:-1][of] + lists.flatten().to_numpy()
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + sizes.flatten().to_numpy() - 1 + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[rows])
                s, e = starts[~gone], ends[~gone]
                inside = np.zeros(len(data) + 1, np.int32)
                inside[s] += 1
                inside[e] -= 1
                inside = np.cumsum(inside[:-1]) > 0
                row_end = np.repeat(offsets[1:], np.diff(np.concatenate(([0], np.cumsum(~gone)))[rows]))
                take = inside.copy()
                take[e[e < row_end]] = True
                text = np.where(inside, data, np.uint8(0x20))[take].tobytes()
                at = np.concatenate(([0], np.cumsum(take)))[offsets].tolist()
                kept = [text[a:b].rstrip(b" ") for a, b in zip(at[:-1], at[1:], strict=True)]
                rest = part.columns[:width]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(rows)), pa.array(removed), pa.array([x.decode() for x in kept], pa.string())], [*names, "n_words", "n_removed", "kept"])

    return told.mapInArrow(cut, StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document: see without_repeats() for nulls, repeats and empty texts (sha256 of nothing)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') as w from documents),
s as (select rid, doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
g as (select rid, i, hash(list_aggregate(w[i:i + 34], 'string_agg', ' ')) as h from s),
r as (select rid, i from g join (select h from g group by h having count(*) > 1) using (h)),
c as (select distinct rid, unnest(range(i, i + 35)) as p from r),
u as (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
k as (select u.rid, count(c.p) as n_removed, string_agg(case when c.p is null then u.x end, ' ' order by u.p) as kept
  from u left join c on c.rid = u.rid and c.p = u.p group by u.rid)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (rid)
"""

"""Removal of repeated byte strings by a sparse suffix array, sorted deep-shallow: multikey quicksort to a shallow depth, blind tries below.

Every window of LENGTH bytes has one anchor: of the strings of SEED bytes in it, the one with the least hash (leftmost of equals). Equal windows have
equal anchors at the same place, so
1. anchors are counted by hash over all documents, packed by slice; those that occur once have no repeated window;
2. the others go, with the bytes that their windows cover, to the partition of their hash. There equal contexts are one class: they meet by hash and are
   compared byte by byte. In groups with several classes the suffixes from the anchor on are sorted, and so are the bytes before it, read backwards;
   windows are equal where the common prefixes of both orders cover them. Hashes decide what is compared, bytes what is equal;
3. contexts of an anchor that occurs very often are narrowed first: their windows are parted by how far before the anchor they begin, and each part goes to the
   partition of the bytes that all its windows share, most of a window. So a common line with different bytes around it is spread over all tasks.
The first occurrence by (doc_id, start) of each window stays, and the windows of all others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from readloom.llm.substring_dedup import binary, by_q, joined, part_of, utf8_bytes
from readloom.llm.util import _BYTE, BYTE_BASE, mixed, numbered, pack, partitions, powers, ranges, rolling, small_side, steps, unpack, window_hash, written

LENGTH, SEED = 100, 32
#: Bytes that the shallow sort covers, in words of eight.
SHALLOW = 16
_STEP = 1 << 20
#: Occurrences from which on an anchor's contexts are narrowed, parts of the windows then, anchors so treated at most (the most frequent; it bounds memory alone).
HOT, PARTS, MOST_HOT = 100_000, 6, 1 << 20
#: Bytes of contexts that are judged at once, groups of one anchor staying whole.
_JUDGED = 2 << 20
_TOP = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
_COUNTS = "q int, chunk long, single binary, keys binary, place binary, multi binary, times binary"
_CONTEXTS = "q int, blob binary, rel binary, wins binary, doc binary, keys binary, lo binary, gone_keys binary, gone_lo binary, gone_wins binary"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """row, anchor, first window, number of windows and hash of every anchor of the rows, in order."""
    none = np.zeros(0, np.int64)
    per_row = np.maximum(np.diff(offsets) - length + 1, 0)
    if not per_row.any():
        return none, none, none, none, none.astype(np.uint64)
    prefix = rolling(_BYTE[data], BYTE_BASE)
    h = prefix[seed:] - prefix[:-seed]
    h *= powers(BYTE_BASE, len(prefix))[1][: len(h)]
    del prefix
    h = mixed(h)
    least = h & _TOP
    least |= np.arange(len(h), dtype=np.uint64)
    width, have = length - seed + 1, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    start = ranges(offsets[:-1], per_row)
    at = (least[start] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    row = np.repeat(np.arange(len(per_row)), per_row)[new]
    return row, at[new], start[new], np.diff(np.append(new, len(start))), mixed(h[at[new]])  # anchors have small hashes; these are spread


def twins(same: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which rows are at the same place as the first of their class: the same doc_id, come twice. same: not a class's first."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return same & (doc == doc[first]) & (lo == lo[first])


def narrowed(prefix: np.ndarray, at: np.ndarray, first: np.ndarray, wins: np.ndarray, length: int, seed: int, parts: int = PARTS) -> tuple[np.ndarray, ...]:
    """which, first window, number of windows and hash of the parts of contexts: windows that begin near to far bytes before the anchor share the bytes from
    near before it to the end of the farthest, and the hash is of these. Equal windows begin equally far before it, so that they meet."""
    span, made = length - seed + 1, []
    step = -(-span // parts)
    for near in range(0, span, step):
        far = min(near + step, span) - 1
        a, b = np.maximum(first, at - far), np.minimum(first + wins - 1, at - near)
        k = np.flatnonzero(a <= b)
        made.append((k, a[k], b[k] - a[k] + 1, window_hash(prefix, at[k] - near, at[k] - far + length, BYTE_BASE)))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def repeated_anchors(docs: DataFrame, length: int, seed: int, hot: int = HOT) -> DataFrame:
    """_key, places: the ordinals of each document's anchors whose hash occurs at least twice. Rows with a _key below zero are no documents: -1 - _key is the hash
    (low 40 bits) of an anchor that occurs `hot` times or more, and places says how often."""
    n = partitions(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text", _STEP):
                row, _, _, _, h = anchors(data, offsets, length, seed)
                if not len(row):
                    continue
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keys = part.column("_key").to_numpy()
                q = part_of(h, n)
                order = np.lexsort((h, q))
                hs, qs = h[order], q[order]
                new = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (qs[1:] != qs[:-1]))))
                size = np.diff(np.append(new, len(hs)))
                one, many, times = new[size == 1], new[size > 1], size[size > 1].astype("<u4")
                several = order[np.repeat(size > 1, size)]
                cut1, cut2 = (np.searchsorted(qs[x], np.arange(n + 1)) for x in (one, many))
                chunk = int(keys[0])  # its first row names a slice
                made = [(chunk % n, chunk, b"", keys[row[several]].tobytes(), place[several].astype("<u4").tobytes(), b"", b"")]
                for p in range(n):
                    a, b = one[cut1[p] : cut1[p + 1]], many[cut2[p] : cut2[p + 1]]
                    a = a[np.argsort(order[a])]  # by document
                    if len(a) or len(b):
                        made.append((p, chunk, pack(hs[a], 5), keys[row[order[a]]].tobytes(), place[order[a]].astype("<u4").tobytes(), pack(hs[b], 5), times[cut2[p] : cut2[p + 1]].tobytes()))
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *map(binary, cols[2:])], [x.split()[0] for x in _COUNTS.split(", ")])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_q(batches):
            single, multi = (unpack(utf8_bytes(batch.column(c)), 5) for c in ("single", "multi"))
            have, where = np.unique(np.concatenate((single, multi)), return_inverse=True)
            total = np.bincount(where, np.concatenate((np.ones(len(single)), joined(batch.column("times"), "<u4"))), len(have))
            again = (total > 1)[where[: len(single)]]
            at, keys, places = 0, [], []
            for s, k, p in zip(batch.column("single"), batch.column("keys"), batch.column("place"), strict=True):
                k, p, size = np.frombuffer(k.as_py(), "<i8"), np.frombuffer(p.as_py(), "<u4"), len(s.as_py()) // 5
                keep = again[at : at + size] if size else np.ones(len(k), bool)
                at += size
                keys.append(k[keep].tobytes())
                places.append(p[keep].tobytes())
            often = np.flatnonzero(total >= hot)
            keys.append((-1 - have[often].astype("<i8")).tobytes())
            places.append(np.minimum(total[often], (1 << 31) - 1).astype("<u4").tobytes())
            chunks = pa.concat_arrays([batch.column("chunk"), batch.column("chunk").slice(0, 1)])
            yield pa.RecordBatch.from_arrays([chunks, binary(keys), binary(places)], ["q", "keys", "place"])

    found = docs.mapInArrow(count, _COUNTS).repartition(n, "q").sortWithinPartitions("q").mapInArrow(repeated, "q long, keys binary, place binary")
    pairs = found.repartition(n, "q").sortWithinPartitions("q").mapInArrow(_lists("place"), "_key long, place array<int>")
    return pairs.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("place")))).alias("places"))


def _lists(*columns: str):
    """Turns packed rows of a chunk (q) into one row per key with arrays of its values."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_q(batches):
            keys = joined(batch.column("keys"), "<i8")
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
            cuts = pa.array(np.append(new, len(keys)).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(cuts, pa.array(joined(batch.column(c), "<u4")[order].astype(np.int32))) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(keys[order][new]), *arrays], ["_key", *columns])

    return lists


class BlindTrie:
    """Orders distinct strings that share a long prefix: an inner node keeps only the depth at which its strings part and a branch per byte there
    (none where a string ends). A string goes down by those bytes alone, is compared once with a leaf below, and is hung in at the common depth."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: int | tuple[int, dict] = 0
        for k in range(1, len(strings)):
            self.insert(k)

    def sign(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def insert(self, k: int) -> None:
        node = self.root
        while not isinstance(node, int):
            node = node[1].get(self.sign(k, node[0]), next(iter(node[1].values())))
        a, b = self.strings[k], self.strings[node]
        depth = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < depth:
            above, node = node, node[1][self.sign(k, node[0])]
        if not isinstance(node, int) and node[0] == depth:
            node[1][self.sign(k, depth)] = k
            return
        below = node
        while not isinstance(below, int):
            below = next(iter(below[1].values()))
        fresh = (depth, {self.sign(below, depth): node, self.sign(k, depth): k})
        if above is None:
            self.root = fresh
        else:
            above[1][self.sign(k, above[0])] = fresh

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][sign] for sign in sorted(node[1], reverse=True)]
        return out


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the rows of words in order within each group, and which of them differ from the one before. All segments of rows whose first
    words agree are parted at once, each in three about the next word of a row drawn from it; only the middle part goes on to the word after."""
    n, depth = words.shape
    order = np.argsort(group, kind="stable")
    new = np.concatenate(([True], group[order][1:] != group[order][:-1]))[:n]
    level = np.zeros(n, np.int64)
    draw = np.random.default_rng(7)
    while True:
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        live = (size > 1) & (level[begin] < depth)
        begin, size = begin[live], size[live]
        if not len(begin):
            return order, new
        slot, of = ranges(begin, size), np.repeat(np.arange(len(begin)), size)
        row, deep = order[slot], level[slot]
        word = words[row, deep]
        pivot = begin + draw.integers(0, size)
        pivot = words[order[pivot], level[pivot]][of]
        to, at = np.empty(len(slot), np.int64), begin.copy()
        for side in (word < pivot, word == pivot, word > pivot):
            upto = np.concatenate(([0], np.cumsum(side)))
            first = np.cumsum(size) - size
            to[side] = (at[of] + upto[:-1] - upto[first][of])[side]
            count = upto[first + size] - upto[first]
            new[at[count > 0]] = True
            at += count
        order[to], level[to] = row, deep + (word == pivot)


def sort_suffixes(group: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): text[start : start + size] (size <= depth) in order within each group, and the common prefix of each with the one before
    (-1 where a group begins). Multikey quicksort orders the first `shallow` bytes, blind tries what is still equal."""
    cols = np.arange(depth)
    signs = np.zeros((len(start), max(depth, shallow)), np.uint8)
    for at in range(0, len(start), 4096):
        some = slice(at, at + 4096)
        signs[some, :depth] = np.where(cols < size[some, None], text[np.minimum(start[some, None] + cols, len(text) - 1)], np.uint8(0))
    words = np.ascontiguousarray(signs[:, :shallow]).view(">u8").astype(np.uint64)
    order, new = multikey_quicksort(np.column_stack((words, np.minimum(size, shallow).astype(np.uint64))), group)
    cuts = np.flatnonzero(new)
    ends = np.append(cuts[1:], len(order))
    for a, b in zip(cuts[ends - cuts > 1], ends[ends - cuts > 1], strict=True):
        mine = order[a:b]
        if size[mine[0]] < shallow:
            continue
        strings: dict[bytes, list[int]] = {}
        for k in mine.tolist():
            strings.setdefault(signs[k, shallow : size[k]].tobytes(), []).append(k)
        if len(strings) > 1:
            distinct = list(strings)
            order[a:b] = [k for i in BlindTrie(distinct).order() for k in strings[distinct[i]]]
    a, b = signs[order[:-1], :depth], signs[order[1:], :depth]
    common = np.minimum(np.where((a == b).all(axis=1), depth, (a != b).argmax(axis=1)), np.minimum(size[order[:-1]], size[order[1:]]))
    return order, np.concatenate(([-1], np.where(group[order[1:]] == group[order[:-1]], common, -1)))[: len(order)]


def unlike(blob: np.ndarray, start: np.ndarray, size: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which rows belong to a class in which not all of blob[start : start + size] agree byte by byte. same: not a class's first."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    of, bad = np.flatnonzero(same), np.zeros(len(same), bool)
    for at in range(0, len(of), 4096):
        k = of[at : at + 4096]
        differ = blob[ranges(start[k], size[k])] != blob[ranges(start[first[k]], size[k])]
        bad[first[k[np.add.reduceat(differ, np.cumsum(size[k]) - size[k], dtype=np.int64) > 0]]] = True
    return bad[first]


def later_windows(blob: np.ndarray, rel: np.ndarray, wins: np.ndarray, doc: np.ndarray, key: np.ndarray, lo: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first window and number of windows of all runs of windows that aren't their string's first occurrence. blob holds the contexts one
    after another (wins + length - 1 bytes each), rel the anchor's place in each."""
    size = wins + length - 1
    off = np.cumsum(size) - size
    prefix = rolling(_BYTE[blob], BYTE_BASE)
    rank = np.empty(len(rel), np.int64)
    rank[np.lexsort((key, lo + rel, doc))] = np.arange(len(rel))
    anchor = window_hash(prefix, off + rel, off + rel + seed, BYTE_BASE)
    whole = window_hash(prefix, off, off + size, BYTE_BASE)
    order = np.lexsort((rank, rel, size, whole, anchor))
    cols = [x[order] for x in (rel, size, whole, anchor)]
    new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in cols], axis=0)))
    new |= unlike(blob, off[order], size[order], ~new)
    twin = twins(~new, doc[order], lo[order])
    copies = order[~new & ~twin]
    leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))][twin]
    key_out, lo_out, n_out = [key[copies]], [lo[copies]], [wins[copies]]
    firsts = order[new]
    _, group, members = np.unique(anchor[firsts], return_inverse=True, return_counts=True)
    mixed_up = members[group] > 1
    c, group = firsts[mixed_up], group[mixed_up]
    if len(c):
        deep, here = length - seed, off[c] + rel[c]
        behind, ahead = np.empty((2, len(c)), np.int64)
        by, lcp = sort_suffixes(group, blob, here, np.minimum(off[c] + size[c] - here, length), length, -(-seed // 8) * 8 + SHALLOW)
        by_left, lcp_left = sort_suffixes(group, blob[::-1], len(blob) - here, np.minimum(rel[c], deep), deep)
        later = np.zeros((len(c), deep + 3), np.int8)  # a column for each window of a context, and one on either side
        for before in range(deep + 1):
            at = rel[c] - before  # the window's place in its context
            live = np.flatnonzero((at >= 0) & (at < wins[c]))
            if len(live) < 2:
                continue
            behind[by], ahead[by_left] = np.cumsum(lcp < length - before), np.cumsum(lcp_left < before)
            right, left = behind[live], ahead[live]
            sort = np.lexsort((rank[c[live]], left, right))
            again = np.concatenate(([False], (right[sort][1:] == right[sort][:-1]) & (left[sort][1:] == left[sort][:-1])))
            again = live[sort[again]]
            later[again, at[again] + 1] = 1
        edge = np.diff(later, axis=1)
        which, begin = np.nonzero(edge == 1)
        size = np.nonzero(edge == -1)[1] - begin
        key_out.append(key[c[which]])
        lo_out.append(lo[c[which]] + begin)
        n_out.append(size)
        if len(leader):  # what holds for a context holds for its twins
            by = np.argsort(c[which], kind="stable")
            a, b = (np.searchsorted(c[which][by], leader, side) for side in ("left", "right"))
            k = by[ranges(a, b - a)]
            key_out.append(key[np.repeat(order[twin], b - a)])
            lo_out.append(lo[c[which[k]]] + begin[k])
            n_out.append(size[k])
    return tuple(np.concatenate(x) for x in (key_out, lo_out, n_out))  # type: ignore[return-value]


def anchored(blob: np.ndarray, rel: np.ndarray, wins: np.ndarray, length: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts in parts of about _JUDGED bytes, those of one anchor together: their indices and their bytes."""
    size = wins + length - 1
    off = np.cumsum(size) - size
    anchor = np.zeros(len(rel), np.uint64)
    at = 0
    while at < len(rel):
        end = max(at + 1, int(np.searchsorted(off, off[at] + _JUDGED)))
        base = off[at]
        prefix = rolling(_BYTE[blob[base : off[end - 1] + size[end - 1]]], BYTE_BASE)
        start = off[at:end] + rel[at:end] - base
        anchor[at:end] = window_hash(prefix, start, start + seed, BYTE_BASE)
        at = end
    order = np.argsort(anchor, kind="stable")
    upto = np.cumsum(size[order])
    new = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        before = upto[at - 1] if at else 0
        end = int(np.searchsorted(upto, before + _JUDGED)) + 1
        later = new[(new > at) & (new <= end)]
        end = int(later[-1]) if len(later) else int(next(iter(new[new > at]), len(order)))
        if upto[-1] - before <= _JUDGED:
            end = len(order)
        k = order[at:end]
        yield k, blob[ranges(off[k], size[k])]
        at = end


def later_runs(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """_key, starts, counts: the runs of windows of each document (docs: doc_id, _key, text) that also start earlier. Written."""
    n = partitions(docs.sparkSession)
    wide = 4 * n
    places = written(repeated_anchors(docs, length, seed, hot))
    often = places.where("_key < 0").orderBy(F.desc(F.element_at("places", -1)), "_key").limit(MOST_HOT).select("_key").toPandas()["_key"].to_numpy(np.int64)
    often = docs.sparkSession.sparkContext.broadcast(np.sort(-1 - often).astype(np.uint64))
    found = docs.join(small_side(places, 6 << 20), "_key").select("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), "text", "places")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part, data, offsets in steps(batch, "text", _STEP):
                row, at, first, wins, h = anchors(data, offsets, length, seed)
                lists = part.column("places")
                mine = np.searchsorted(row, np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))) + lists.flatten().to_numpy()
                row, at, first, wins, h = (x[mine] for x in (row, at, first, wins, h))
                if not len(row):
                    continue
                keys, ids = part.column("_key").to_numpy(), part.column("doc_id").to_numpy()
                prefix = rolling(_BYTE[data], BYTE_BASE)
                narrow = np.isin(h & np.uint64(0xFFFFFFFFFF), often.value)
                if narrow.any():
                    which, begin, count, shared = narrowed(prefix, at[narrow], first[narrow], wins[narrow], length, seed)
                    parts = row[narrow][which], at[narrow][which], begin, count, shared
                    row, at, first, wins, h = (np.concatenate((x[~narrow], y)) for x, y in zip((row, at, first, wins, h), parts, strict=True))
                # of equal contexts only the first leaves this slice; the windows of the others are known to be repeats
                whole = window_hash(prefix, first, first + wins + length - 1, BYTE_BASE)
                order = np.lexsort((keys[row], first - offsets[row], ids[row], at - first, wins, whole, h))
                same = np.concatenate(([False], np.all([x[order][1:] == x[order][:-1] for x in (at - first, wins, whole, h)], axis=0)))
                same &= ~unlike(data, first[order], wins[order] + length - 1, same)
                later = same & ~twins(same, ids[row[order]], first[order] - offsets[row[order]])
                gone, order = order[later], order[~later]
                q = part_of(h[order], wide)
                order = order[np.argsort(q, kind="stable")]
                cuts = np.searchsorted(np.sort(q), np.arange(wide + 1))
                lo = (first - offsets[row]).astype("<u4")
                packed = keys[row[gone]].tobytes(), lo[gone].tobytes(), wins[gone].astype("<u4").tobytes()
                made = [(int(keys[0]) % wide, *[b""] * 6, *packed)] if len(gone) else []
                for p in np.flatnonzero(np.diff(cuts)):
                    k = order[cuts[p] : cuts[p + 1]]
                    blob = data[ranges(first[k], wins[k] + length - 1)].tobytes()
                    made.append((p, squeeze(blob), (at - first)[k].astype(np.uint8).tobytes(), wins[k].astype(np.uint8).tobytes(), ids[row[k]].tobytes(), keys[row[k]].tobytes(), lo[k].tobytes(), b"", b"", b""))
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *map(binary, cols[1:])], [x.split()[0] for x in _CONTEXTS.split(", ")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in by_q(batches):
            blob = np.frombuffer(b"".join(expand(x.as_py()) for x in batch.column("blob") if len(x.as_py())), np.uint8)
            rel, wins = (joined(batch.column(c), np.uint8).astype(np.int64) for c in ("rel", "wins"))
            doc, keys, lo = joined(batch.column("doc"), "<i8"), joined(batch.column("keys"), "<i8"), joined(batch.column("lo"), "<u4").astype(np.int64)
            found = [(joined(batch.column("gone_keys"), "<i8"), joined(batch.column("gone_lo"), "<u4").astype(np.int64), joined(batch.column("gone_wins"), "<u4").astype(np.int64))]
            for k, part in anchored(blob, rel, wins, length, seed):
                found.append(later_windows(part, rel[k], wins[k], doc[k], keys[k], lo[k], length, seed))
            key, lo, count = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(key):  # dealt by document
                to = part_of(mixed(key.view(np.uint64)), n)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(n + 1))
                some = np.flatnonzero(np.diff(cuts))
                pick = lambda x, kind: binary([x[order[cuts[p] : cuts[p + 1]]].astype(kind).tobytes() for p in some])
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pick(key, "<i8"), pick(lo, "<u4"), pick(count, "<u4")], ["q", "keys", "starts", "counts"])

    runs = found.mapInArrow(contexts, _CONTEXTS).repartition(n, "q").sortWithinPartitions("q").mapInArrow(judge, "q long, keys binary, starts binary, counts binary")
    return written(runs.repartition(n, "q").sortWithinPartitions("q").mapInArrow(_lists("starts", "counts"), "_key long, starts array<int>, counts array<int>"))


def without_repeated_bytes(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary, the remaining bytes).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of smaller doc_id, or earlier in its own. Null texts
    are empty; null doc_ids come last. Rows that share a doc_id (null too) are one document: a string at the same start in both is no repeat, and
    rows that repeat doc_id and text have the same result. An empty table gives an empty result. Other columns pass through; columns named as the
    new ones are replaced. The result doesn't depend on hot, the occurrences from which on an anchor's contexts are spread over all tasks.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    names, rows = docs.columns, numbered(docs)
    runs = later_runs(rows.select(F.col("_row.doc_id").alias("doc_id"), "_key", F.col("_row.text").alias("text")).where("text is not null"), length, seed, hot)
    told = rows.join(runs, "_key", "left").select("_row", "starts", "counts")
    at_text, width = names.index("text"), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([*batch.column(0).flatten(), batch.column(1), batch.column(2)], [str(i) for i in range(width + 2)])
            for part, data, offsets in steps(batch, at_text):
                lists, sizes = (x.fill_null([]) if x.null_count else x for x in (part.column(width), part.column(width + 1)))
                first = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + sizes.flatten().to_numpy() - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                before = np.concatenate(([False], gone[:-1]))
                before[offsets[:-1][offsets[:-1] < len(data)]] = False
                sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[offsets]) for x in (gone, gone & ~before)]
                rest, at = data[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[offsets].tolist()
                kept = [rest[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(np.diff(offsets)), *map(pa.array, sums), binary(kept)], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    fields = [*docs.schema.fields, *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())]
    return told.mapInArrow(cut, StructType(fields))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document: see without_repeated_bytes() for nulls, repeats and empty texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

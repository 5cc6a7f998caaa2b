"""Periodic runs of words, by the runs theorem: every run has a root that is the longest Lyndon word at its place, under an order of the words or its reverse.

Each document is taken as a sequence of numbered words. Its suffixes are sorted by doubling; the longest Lyndon word at a place ends where the inverse suffix
array next has a smaller value, or, under the reverse order, a greater one. A root is extended to the right by the longest common prefix of the suffixes at its
start and end (the least of the LCP array between them, by a sparse table), and to the left in the same way on the reversed sequence. All of it is vectorised
over the documents of an Arrow slice; nothing leaves a document's row, so that no shuffle is needed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.util import ranges, steps, word_spans

#: Words that a run has at least, and rounds of jumps for smaller values before the rest is found in a tree of minima.
LEAST, ROUNDS = 12, 8
_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    size = ends - starts
    cuts = np.concatenate(([0], np.cumsum(size)))
    text = data[ranges(starts, size)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def suffix_order(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lcp): the place of each suffix in the order of all suffixes, first by row, then by content (a prefix comes first), and the length of what the
    suffix at each place shares with the one before (0 across rows). rows: where each row of ids begins, one more than rows."""
    n = len(ids)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    end = rows[1:][row]
    key = row * (int(ids.max()) + 1 if n else 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1

    def settle(some: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Gives the suffixes `some`, in order at the places `at`, the place of their class's first one (new: it begins one); returns those not alone."""
        first = np.flatnonzero(new)
        rank[some] = at[first][np.cumsum(new) - 1]
        return ~(new & np.append(new[1:], True))

    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if n else np.zeros(0, bool)
    live = settle(order, np.arange(n), new)
    place, some = np.flatnonzero(live), order[live]
    levels, h = [rank.copy()], 1
    while len(some):
        beyond = some + h
        second = np.where(beyond < end[some], rank[np.minimum(beyond, n)], -1)
        first = rank[some]
        by = np.lexsort((second, first))
        some, first, second = some[by], first[by], second[by]
        order[place] = some
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        live = settle(some, place, new)
        place, some = place[live], some[live]
        levels.append(rank.copy())
        h *= 2
    lcp = np.zeros(n, np.int32)
    if n:  # of neighbours in the order, by the classes of halving lengths
        a, b = order[:-1].copy(), order[1:].copy()
        pair = np.flatnonzero(row[a] == row[b])
        a, b = a[pair], b[pair]
        got = np.zeros(len(pair), np.int32)
        last = end[a]
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < last
            same = inside & (levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)])
            # equal classes at level k share 2**k words at least, unless the class is a suffix of its own
            step = same.astype(np.int32) << np.int32(k)
            a, b, got = a + step, b + step, got + step
        lcp[pair + 1] = got
    return rank[:n], lcp


def next_smaller(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value (all differ), up to its row's end (ends: for each place). All places jump at once along what others have found."""
    n = len(values)
    out = np.append(np.arange(1, n + 1), n)
    padded = np.append(values, -1)
    live = np.flatnonzero(out[:n] < ends)
    live = live[padded[out[live]] > values[live]]
    for _ in range(ROUNDS):
        if not len(live):
            return out[:n]
        out[live] = np.minimum(out[out[live]], ends[live])
        live = live[(out[live] < ends[live]) & (padded[out[live]] > values[live])]
    out[live] = np.minimum(first_smaller(values, out[live], values[live]), ends[live])
    return out[:n]


def first_smaller(values: np.ndarray, at: np.ndarray, than: np.ndarray) -> np.ndarray:
    """The first place from at on whose value is smaller than `than`, by a tree of minima of which all searches climb and descend at once; else the number
    of values or more."""
    levels = [np.append(values, np.iinfo(values.dtype).max)]
    while len(levels[-1]) > 1:
        x = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], levels[-1][-1])
        levels.append(np.minimum(x[::2], x[1::2]))
    base = np.cumsum([0, *(len(x) for x in levels)])
    tree = np.concatenate(levels)
    level, node = np.zeros(len(at), np.int64), at.astype(np.int64)
    live = np.flatnonzero(tree[node] >= than)
    while len(live):  # up and to the right, to the first node that holds a smaller value
        node[live] += 1
        up = (node[live] & 1) == 0
        level[live] += up
        node[live] >>= up
        gone = node[live] >= (base[1:] - base[:-1])[level[live]]
        level[live[gone]], node[live[gone]] = 0, len(values)
        live = live[~gone]
        live = live[tree[base[level[live]] + node[live]] >= than[live]]
    live = np.flatnonzero(level)
    while len(live):  # and down to its first leaf that does
        level[live] -= 1
        node[live] *= 2
        node[live] += tree[base[level[live]] + node[live]] >= than[live]
        live = live[level[live] > 0]
    return node


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first:last] for each pair, first < last, by a sparse table of which one level is held at a time."""
    out = np.zeros(len(first), values.dtype)
    level = np.frexp((last - first).astype(float))[1] - 1
    table = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[first[mine]], table[last[mine] - (1 << k)])
    return out


def shared_prefix(place: np.ndarray, lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b share."""
    p, q = place[a], place[b]
    return least_between(lcp, np.minimum(p, q) + 1, np.maximum(p, q) + 1)


def runs_of(ids: np.ndarray, rows: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of at least max(least, 2 * period) words, by row, start and period; start counts from the row's first word."""
    n = len(ids)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    begin, end = rows[:-1][row], rows[1:][row]
    place, lcp = suffix_order(ids, rows)
    roots = [next_smaller(v, end) for v in (place, n - 1 - place)]
    a, b = np.tile(np.arange(n), 2), np.concatenate(roots)
    period = b - a
    # a repeat of period words touches the root on its left or right, and 2 * period words fit the row
    fits = 2 * period <= (end - begin)[a]
    a, b, period = a[fits], b[fits], period[fits]
    inner = b < end[a]
    right = inner & (ids[np.minimum(b, n - 1)] == ids[a])
    left = (a > begin[a]) & (ids[a - 1] == ids[b - 1])
    some = right | left
    a, b, period, right, left = (x[some] for x in (a, b, period, right, left))
    on = np.zeros(len(a), np.int64)
    on[right] = shared_prefix(place, lcp, a[right], b[right])
    back = np.zeros(len(a), np.int64)
    need = left & (on + (a - begin[a]) >= period)
    if need.any():  # the reversed sequence is only of the rows that need it
        back[need] = _shared_suffix(ids, rows, row, a[need] - 1, b[need] - 1)
    start, length = a - back, on + back + period
    found = (on + back >= period) & (length >= least)
    table = np.stack((row[a], start - begin[a], length, period), 1)[found]
    table = np.unique(table, axis=0) if len(table) else table
    if len(table):  # the smallest period of a stretch
        by = np.lexsort((table[:, 3], table[:, 2], table[:, 1], table[:, 0]))
        table = table[by]
        table = table[np.concatenate(([True], (table[1:, :3] != table[:-1, :3]).any(axis=1)))]
        table = table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]
    return tuple(table.T) if len(table) else tuple(np.zeros((4, 0), np.int64))  # type: ignore[return-value]


def _shared_suffix(ids: np.ndarray, rows: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the prefixes that end with a and b share at their ends."""
    wanted = np.unique(row[a])
    size = rows[wanted + 1] - rows[wanted]
    cuts = np.concatenate(([0], np.cumsum(size)))
    back = np.repeat(rows[wanted + 1] - 1, size) - ranges(np.zeros(len(size), np.int64), size)
    place, lcp = suffix_order(ids[back], cuts)
    k = np.searchsorted(wanted, row[a])
    at = lambda x: cuts[k] + rows[wanted[k] + 1] - 1 - x
    return shared_prefix(place, lcp, at(a), at(b))


def periodic_tail(n: int, h: int) -> np.ndarray:
    """Which word each place of a document of n words has, if its tail is made periodic by its hash."""
    g = h // 10
    out = np.arange(n)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[a:] = a + (out[a:] - a) % p
    return out


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def periodic_runs(docs: DataFrame, planted: bool = False, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row of docs (doc_id, text).

    Words are runs without ASCII white space. A run is a stretch of words of smallest period q and at least max(least, 2 * q) words that can't be extended;
    the four numbers are the longest run's (ties: first start, then period), null without runs. The digests are of all runs' `start,length,period` lines and of
    the words without those that a run repeats, joined by one space. planted: the tails of a tenth of the documents, by their doc_id's CRC, are made periodic
    first. A null or empty text has no words and no runs; a null doc_id counts as an empty text in the CRC; repeated rows come out as often as they occur; an
    empty table gives an empty result; further columns are ignored.
    """
    names = [x.split()[0] for x in _OUT.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                starts, ends, rows = word_spans(data, offsets)
                if planted:
                    n = np.diff(rows)
                    said = [b"" if x is None else str(x).encode() for x in part.column("doc_id").to_pylist()]
                    hashes = np.array([zlib.crc32(x) for x in said], np.int64)
                    source = np.arange(len(starts))
                    for k in np.flatnonzero((hashes % 10 == 0) & (n > 0)):
                        source[rows[k] : rows[k + 1]] = rows[k] + periodic_tail(int(n[k]), int(hashes[k]))
                    starts, ends = starts[source], ends[source]
                row, start, length, period = runs_of(word_ids(data, starts, ends), rows, least)
                cuts = np.searchsorted(row, np.arange(len(rows)))
                many = np.diff(cuts)
                # words that a run repeats
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, rows[row] + start + period, 1)
                np.add.at(change, rows[row] + start + length, -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                size = ends[kept] - starts[kept] + 1  # a space behind each
                text = np.full(int(size.sum()), 0x20, np.uint8)
                at = np.cumsum(size) - size
                text[ranges(at, size - 1)] = data[ranges(starts[kept], size - 1)]
                edge = np.append(at, len(text))[np.searchsorted(kept, rows)]
                best = np.full((len(rows) - 1, 4), -1, np.int64)
                by = np.lexsort((period, start, -length, row))
                first = by[cuts[:-1][many > 0]]
                best[many > 0] = np.stack((start[first], length[first], period[first], 1000 * length[first] // period[first]), 1)
                none = pa.array(many == 0)
                lines = [f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
                told = [sha("".join(lines[a:b]).encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                collapsed = [sha(text[a : max(a, b - 1)].tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                numbers = [pa.array(x, mask=none.to_numpy(zero_copy_only=False)) for x in best.T]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(many.astype(np.int64)), *numbers, pa.array(told), pa.array(collapsed)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, _OUT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, the tails of a tenth of them made periodic: see periodic_runs()."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted=True)

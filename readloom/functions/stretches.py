"""Stretches of neighbouring k-mers that share a minimizer, the runs of seeds that they make, and columns of numbers packed in bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from readloom.sources.tables import _BITS, codes_of, windows

#: Bases of a minimizer, and seeds that are made at once.
M, SEEDS = 12, 1 << 21
#: Where the number of k-mers (less one) and the minimizer's place stand above a stretch's bases, of which 28 are the most.
_N, _O, _FOUR = np.uint64(56), np.uint64(60), np.uint64(15)
_SPREAD = 0x9E3779B97F4A7C15


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of rows of whole numbers, below 2^31."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(_SPREAD)
            h ^= h >> np.uint64(29)
        return (h * np.uint64(_SPREAD) >> np.uint64(33)).astype(np.int64)


def stretches(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, minimizer, code) of a column's stretches: k-mers (k from 16 to 20) side by side whose least M-mer, in an order by hash, is the same one. place is
    that of the first base; code has the bases, the number of k-mers and the minimizer's place in the stretch. Each k-mer is in one stretch, and equal k-mers
    are in stretches of equal minimizers, at equal places from them."""
    w = k - M + 1
    for first, at, some in windows(column, k):
        row, place, code = codes_of(some, M)
        if len(row) < w:
            continue
        h = (code * 0x9E3779B1) & 0xFFFFFF  # different for different M-mers
        h = ((h ^ (h >> 13)) * 0x85EBCB) & 0xFFFFFF
        least, have = (h << 39) | np.arange(len(h)), 1
        while have < w:  # the least of `have` values from each on
            step = min(have, w - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        here = np.flatnonzero(row[: len(least)] == row[w - 1 :])
        if not len(here):
            continue
        by = least[here] & ((1 << 39) - 1)
        starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        n, begin = np.diff(np.r_[starts, len(here)]), here[starts]
        wide = pa.types.is_large_string(some.type)
        offsets = np.frombuffer(some.buffers()[1], np.int64 if wide else np.int32)[some.offset : some.offset + len(some) + 1].astype(np.int64)
        bits = np.r_[_BITS[np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]], np.zeros(k + w, np.uint64)]
        byte, bases = (offsets[:-1] - offsets[0])[row[begin]] + place[begin], np.zeros(len(begin), np.uint64)
        for j in range(k + w - 1):
            bases = (bases << np.uint64(2)) | bits[byte + j]
        bases >>= (2 * (w - n)).astype(np.uint64)
        told = bases | ((n - 1).astype(np.uint64) << _N) | ((by[starts] - begin).astype(np.uint64) << _O)
        yield row[begin] + first, place[begin] + at, least[begin] >> 39, told.view(np.int64)


def kmers_by_code(told: np.ndarray, kind: np.ndarray, k: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(stretch, place in it) of every k-mer of stretches (alive: of those whose bit is set), those of a code one after the other, of kind 0 first; where each code
    starts, its k-mers of kind 0, and its others."""
    told = told.view(np.uint64)
    n = ((told >> _N) & _FOUR).astype(np.int64) + 1
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    if alive is not None:
        here = (alive[of] >> i & 1).astype(bool)
        of, i = of[here], i[here]
    code = ((told[of] >> (2 * (n[of] - 1 - i)).astype(np.uint64)) & np.uint64(4**k - 1)).astype(np.int64)
    other = kind > 0
    bits = len(code).bit_length()
    if 2 * k + 1 + bits < 64:  # numbers that hold their own place sort faster than places do
        order = np.sort((code << 1 | other[of]) << bits | np.arange(len(code))) & ((1 << bits) - 1)
    else:
        order = np.argsort(code << 1 | other[of])
    code, of, i = code[order], of[order], i[order]
    at = np.flatnonzero(np.diff(code, prepend=-1))
    upto = np.r_[0, np.cumsum(other[of])]
    end = np.r_[at[1:], len(code)]
    nb = upto[end] - upto[at] if len(at) else at
    return of, i, at, end[: len(at)] - at - nb, nb


def living(told: np.ndarray, kind: np.ndarray, k: int, most: int, times: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(bits of each stretch's k-mers that make seeds, seeds that they make): those of codes that make less than `most`. All stretches of a minimizer are given
    together; what they say of a k-mer holds when stretches without any are gone, while the counts don't. times: how often each stretch counts, as it stands for so
    many equal ones; the seeds are those that it makes itself."""
    of, i, at, na, nb = kmers_by_code(told, kind, k)
    all_a, all_b = na, nb
    if times is not None and len(at):
        other, n = kind[of] > 0, times[of]
        all_a, all_b = np.add.reduceat(np.where(other, 0, n), at), np.add.reduceat(np.where(other, n, 0), at)
    kept = (na * nb > 0) & (all_a * all_b < most)
    here = np.repeat(kept, na + nb)
    return np.bincount(of[here], 1 << i[here], len(told)).astype(np.int64), int((na * nb)[kept].sum())


def seed_runs(key: np.ndarray, place: np.ndarray, told: np.ndarray, kind: np.ndarray, k: int, most: int, alive: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(aread, bread, kind of b, apos, diag, n): runs of n seeds one after the other on a diagonal, apos the end of the first, between stretches of kind 0 and all
    others, of the k-mers (alive: of these alone) that make less than `most` seeds. All stretches of a minimizer are given together. Two stretches share k-mers on one
    diagonal alone, that of their minimizers, so that a seed is named by both and its place in the first."""
    by = (told.view(np.uint64) >> _O).astype(np.int64) + place
    of, i, at, na, nb = kmers_by_code(told, kind, k, alive)
    kept = (na * nb > 0) & (na * nb < most)
    at, na, nb = at[kept], na[kept], nb[kept]
    upto = np.cumsum(na * nb)
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(upto, SEEDS + (upto[low - 1] if low else 0), "right")))
        g = np.repeat(np.arange(low, high), na[low:high] * nb[low:high])
        within = np.arange(len(g)) - (upto - na * nb)[g] + (upto[low - 1] if low else 0)
        a = at[g] + within // nb[g]
        b = at[g] + na[g] + within % nb[g]
        seeds = np.sort(of[a] << 34 | of[b] << 5 | i[a])
        runs = np.flatnonzero(np.r_[True, np.diff(seeds) != 1])
        s, t, first = seeds[runs] >> 34, (seeds[runs] >> 5) & ((1 << 29) - 1), seeds[runs] & 31
        yield key[s], key[t], kind[t], place[s] + first + k, by[s] - by[t], np.diff(np.r_[runs, len(seeds)])
        low = high


def _banded(aread, bread, kind, apos, diag, n, k: int, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(the columns of runs and their bands, band by band; where each begins; what it covers of the read). What seeds cover is the union of their bases, so that
    runs may be cut anywhere."""
    band = diag // width
    order = np.lexsort((apos, band, kind, bread, aread))
    aread, bread, kind, apos, diag, n, band = (c[order] for c in (aread, bread, kind, apos, diag, n, band))
    new = np.r_[True, (np.diff(aread) != 0) | (np.diff(bread) != 0) | (np.diff(kind) != 0) | (np.diff(band) != 0)]
    at, end = np.flatnonzero(new), apos + n - 1
    far = np.maximum.accumulate((np.cumsum(new) << 32) + end) & ((1 << 32) - 1)  # the furthest end so far of the band
    before = np.where(new, 0, np.r_[0, far[:-1]])
    return [aread, bread, kind, band, apos, diag, n], at, np.add.reduceat(np.maximum(0, end - np.maximum(before, apos - k)), at)


def strong_runs(aread, bread, kind, apos, diag, n, k: int, width: int, least: int) -> list[np.ndarray]:
    """aread, bread, kind, band, apos, diag, n of the runs of the bands that cover at least `least` bases of the read, in this order."""
    columns, at, covered = _banded(aread, bread, kind, apos, diag, n, k, width)
    strong = np.repeat(covered >= least, np.diff(np.r_[at, len(n)]))
    return [c[strong] for c in columns]


def run_boxes(aread, bread, kind, apos, diag, n, k: int, width: int, least: int) -> list[np.ndarray]:
    """aread, bread, kind, band, seeds, covered, abpos, aepos, bbpos, bepos of the bands of runs that cover at least `least` bases of the read."""
    (aread, bread, kind, band, apos, diag, n), at, covered = _banded(aread, bread, kind, apos, diag, n, k, width)
    end = apos + n - 1
    made = [np.add.reduceat(n, at), covered, np.minimum.reduceat(apos, at) - k, np.maximum.reduceat(end, at), np.minimum.reduceat(apos - diag, at) - k, np.maximum.reduceat(end - diag, at)]
    strong = covered >= least
    return [c[strong] for c in (aread[at], bread[at], kind[at], band[at], *made)]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length as bytes: steps from row to row, byte by byte, compressed."""
    steps = [np.diff(c, prepend=0) for c in columns]
    planes = b"".join(((s << 1) ^ (s >> 63)).view(np.uint8).reshape(-1, 8).T.tobytes() for s in steps)
    return len(columns[0]).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 8 * n * columns, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    steps = [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]
    return [np.cumsum((s >> 1) & ((1 << 63) - 1) ^ -(s & 1)) for s in steps]


def dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """bucket, data: columns of whole numbers, packed by bucket, in the order that they are in."""
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [c[order] for c in columns], bucket[order]
    cut = [*np.flatnonzero(np.r_[True, np.diff(bucket) != 0]).tolist(), len(bucket)]
    data = [packed(*(c[p:q] for c in columns)) for p, q in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(data, pa.binary())], ["bucket", "data"])


def in_masses(parts: Iterator[tuple[np.ndarray, ...]], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of parts, put together to at least so many rows."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        if sum(len(h[0]) for h in held) >= rows:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def gathered(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """The columns of one bucket after the other, of batches in order of bucket."""
    held, now = [], None
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and bucket != now:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = bucket
            held.append(unpacked(data.as_py(), columns))
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]

"""SimHash near-duplicates: fingerprints compared bit-sliced, 64 at a time, within buckets that no close pair escapes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.components import components
from readloom.llm.util import _SPACE, mixed, partitions, small_side, steps, with_row, word_spans, written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of the rows in order, and the offsets of the rows among them. A-Z is lower-cased; words are joined by
    one space; a row of fewer words than width has one shingle, a row of none has none."""
    data = _LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    n = np.diff(rows)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    keep = inside | np.concatenate(([False], inside[:-1]))
    data = np.where(inside, data, np.uint8(0x20))[keep]
    place = np.concatenate(([0], np.cumsum(keep)))
    starts, ends = place[starts], place[ends]
    # where a row ends in a word and the next begins with one, no space stands between them; no shingle spans rows
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    cuts = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(rows[:-1], count) + np.arange(cuts[-1]) - np.repeat(cuts[:-1], count)
    last = np.minimum(first + width, np.repeat(rows[1:], count)) - 1
    text, digest = data.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(text[s:e], 42) for s, e in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], np.uint64), cuts


def fingerprint(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of each row, the bits that over half its shingles' hashes have; zero for a row with none."""
    out = np.zeros((len(cuts) - 1, 8), np.uint8)
    for i in np.flatnonzero(np.diff(cuts)):
        part = hashes[cuts[i] : cuts[i + 1]]
        total = np.zeros(64, np.int64)
        for at in range(0, len(part), 1 << 16):
            total += np.unpackbits(part[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * total > len(part), bitorder="little")
    return out.reshape(-1).view("<u8")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, print (a signed 64-bit fingerprint) for each row of docs. A null or empty text has fingerprint zero."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                prints = fingerprint(*shingle_hashes(data, offsets, width))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, print long")


def bands(radius: int, spare: int = 2) -> list[int]:
    """Masks of a fingerprint such that two within radius agree on all bits of one mask at least: of radius + spare blocks, spare are equal."""
    blocks = np.array_split(np.arange(64), radius + spare)
    masks = [sum(1 << int(b) for b in block) for block in blocks]
    return [sum(some) for some in combinations(masks, spare)]


def close_lanes(prints: np.ndarray, groups: np.ndarray, radius: int, pairs: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i > j, of one group (groups: sorted labels) whose prints differ in at most radius bits, without a loop over pairs.

    prints: uint64, one row of words per print. planes[b] holds bit b of all prints, 64 to a word. A row is held against each word that its group
    reaches: carry-save counters count the differing bits of all 64 lanes at once, lanes over radius are marked, and words with no lane left are
    abandoned."""
    if not len(prints):
        return
    prints = prints.reshape(len(prints), -1)
    n, width = len(prints), 64 * prints.shape[1]
    words = -(-n // 64)
    bits = np.zeros((words * 64, width // 8), np.uint8)
    bits[:n] = np.ascontiguousarray(prints.astype("<u8")).view(np.uint8).reshape(n, -1)
    bits = np.unpackbits(bits, axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T.reshape(width, words, 64), axis=2, bitorder="little")).reshape(width, -1).view("<u8")
    begin = np.searchsorted(groups, groups, "left")
    rows = np.flatnonzero(np.arange(n) > begin)  # lanes before the row: begin .. row - 1
    span = (rows - 1) // 64 - begin[rows] // 64 + 1
    cuts = np.concatenate(([0], np.cumsum(span)))
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + pairs, "right")) - 1)
        some, wide = rows[at:end], span[at:end]
        row = np.repeat(some, wide)
        word = np.repeat(begin[some] // 64, wide) + np.arange(len(row)) - np.repeat(cuts[at:end] - cuts[at], wide)
        at = end
        low = np.clip(begin[row] - word * 64, 0, 63).astype(np.uint64)
        high = np.clip(row - word * 64, 0, 64)
        live = (_ONES << low) & np.where(high == 64, _ONES, (np.uint64(1) << (np.minimum(high, 63)).astype(np.uint64)) - np.uint64(1))
        counters = [np.zeros(len(row), np.uint64) for _ in range(max(1, radius.bit_length()))]
        for b in range(width):
            carry = planes[b][word] ^ (np.uint64(0) - ((prints[row, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
            for k, plane in enumerate(counters):
                counters[k], carry = plane ^ carry, plane & carry
            live &= ~carry
            if b % 8 == 7:
                live &= ~_above(counters, radius)
                left = live != 0
                if not left.all():
                    row, word, live, *counters = (x[left] for x in (row, word, live, *counters))
                    if not len(row):
                        break
        if len(row):
            hits = np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(hits)
            yield row[k], word[k] * 64 + lane


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (least bit first) is over radius."""
    over, equal = np.zeros(len(counters[0]), np.uint64), np.full(len(counters[0]), _ONES)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            over = over | (equal & counters[k])
            equal = equal & ~counters[k]
    return over


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label with the sets of i and j joined, pair by pair; every label is its set's least member and points to itself."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


#: Bytes that the 32-bit offsets of an Arrow binary column reach.
OFFSET_BYTES = (1 << 31) - 1


def as_one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Batches as one with all their rows; binary columns get 64-bit offsets where 32 bits don't reach."""
    if len(held) == 1:
        return held[0]
    columns = []
    for i, field in enumerate(held[0].schema):
        parts = [x.column(i) for x in held]
        if pa.types.is_binary(field.type) or pa.types.is_string(field.type):
            if sum(x.nbytes for x in parts) > OFFSET_BYTES:
                parts = [x.cast(pa.large_binary() if pa.types.is_binary(field.type) else pa.large_string()) for x in parts]
        columns.append(pa.concat_arrays(parts))
    return pa.RecordBatch.from_arrays(columns, held[0].schema.names)


def whole_groups(batches: Iterator[pa.RecordBatch], same: Callable[[pa.RecordBatch], np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least `least` rows that don't cut a group, from sorted ones; same: whether each row is of its predecessor's group. A row is copied once,
    however many batches its group spans, and none is lost, however many bytes it has."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(~same(batch))[-1])  # where the last group of the batch begins
        ends = last > 0 or (held and not same(as_one([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))[1])
        if ends and n + last >= least:
            yield as_one([*held, *([batch.slice(0, last)] if last else [])])
            held, n, batch = [], 0, batch.slice(last)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield as_one(held)


#: Rows of a bucket that are compared as one; a larger bucket is dealt out in tiles.
BUCKET = 16_384


def same_group(*columns: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    def same(x: pa.RecordBatch) -> np.ndarray:
        cols = [x.column(c).to_numpy() for c in columns]
        return np.concatenate(([False], np.all([c[1:] == c[:-1] for c in cols], axis=0)))

    return same


def in_tiles(rows: DataFrame, member: str) -> DataFrame:
    """rows (with _blocks, null for 1) with i, j in its place: a group of several blocks is dealt by member, and any two of its blocks meet in the tile
    i, j. So every pair of a group meets, and no task needs to hold more than two blocks of it."""
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_blocks", "_own", "_other")


def near_links(prints: DataFrame, radius: int = 4, column: str = "print", bucket: int = BUCKET) -> DataFrame:
    """a, b: links that join the distinct fingerprints of a table just as all pairs within radius would (a tile gives at most one link a row, not its
    pairs). Buckets of over `bucket` rows are counted first and compared in tiles."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(column).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(bands(radius))]))
    rows = prints.select(column).where(F.col(column).isNotNull()).distinct().select(each.alias("_b"), column).select("_b.band", "_b.key", F.col(column).alias("print"))
    n = partitions(prints.sparkSession)
    large = rows.groupBy("band", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > bucket)
    large = written(large.select("band", "key", F.ceil(F.col("_n") / bucket).cast("int").alias("_blocks")))
    rows = in_tiles(rows.join(small_side(large), ["band", "key"], "left"), "print")
    group_by = ["band", "key", "i", "j"]
    same = same_group(*group_by)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, same, 100_000):
            again = same(batch)
            group = np.cumsum(~again)
            alone = ~again & np.concatenate((~again[1:], [True]))
            group, values = group[~alone], batch.column("print").to_numpy()[~alone].view(np.uint64)
            label = np.arange(len(values))
            for i, j in close_lanes(values, group, radius):
                label = merged(label, i, j)
            far = np.flatnonzero(label != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[far].view(np.int64)), pa.array(values[label[far]].view(np.int64))], ["a", "b"])

    return rows.repartition(n, *group_by).sortWithinPartitions(*group_by).mapInArrow(link, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs: component_id is the smallest doc_id reachable over links of at
    most radius differing bits, itself included.

    Rows with a null doc_id take part; component_id is null only if no row of the component has a doc_id. Null and empty texts share fingerprint
    zero and link like any other. Repeated rows come out as often as they occur. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, width))
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("_least")))
    roots = components(near_links(classes, radius), "a", "b")
    rooted = classes.join(roots, F.col("print") == F.col("node"), "left").select("print", "_least", F.coalesce("component", "print").alias("_root"))
    least = written(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")))
    named = written(rooted.join(small_side(least), "_root").select("print", "component_id"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return prints.join(small_side(named), "print").select("doc_id", hexed, "component_id")


# ---------------------------------------------------------------- copies above a similarity of shingle sets

#: Bits of the fingerprint that is compared before the sets, and the bits in which sets of similarity 0.8 differ at most, small ones (up to SMALL
#: shingles, whose bits vary more) and others. 19 of 128 are usual; more than these have a chance below 1 in 100,000.
WIDE, WIDE_RADIUS, SET_RADIUS, SMALL = 128, 48, 44, 64
#: Bits of the sketch that proves sets of up to about a thousand shingles to be unlike before whole sets are fetched.
PARITY = 512
#: Count of a common shingle, common ones at most, and shingles that a task counts at once.
COMMON, MOST_COMMON, TALLY = 3, 250_000, 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes() without repeats, sorted in each row."""
    h, cuts = shingle_hashes(data, offsets, width)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
    return h[fresh], np.searchsorted(row[fresh], np.arange(len(cuts)))


def parities(h: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """A sketch of each row's set: of PARITY bits each, whether an odd number of its shingles hash there. Two sketches differ in at most as many bits as
    there are shingles in one set alone, so that a larger difference proves a lower similarity."""
    n = len(cuts) - 1
    at = np.repeat(np.arange(n), np.diff(cuts)) * PARITY + (mixed(h ^ np.uint64(PARITY)) % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * PARITY) & 1).astype(bool).reshape(n, PARITY)
    return [x.tobytes() for x in np.packbits(odd, axis=1)]


def prefixes(h: np.ndarray, cuts: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): of each row's set the first shingles in one order of all shingles, so many that two sets of the similarity share one of them.

    The order is by count among the common ones (sorted), which come last, then by hash; any order is right, this one keeps buckets small."""
    n = np.diff(cuts)
    row = np.repeat(np.arange(len(n)), n)
    level = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        level = np.where(common[at] == h, counts[at], 0)
    order = np.lexsort((h, level, row))
    # sets of the similarity share ceil(similarity * n) at least, more than are left after these
    take = np.where(n == 0, 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)
    first = order[np.arange(len(h)) - cuts[:-1][row] < take[row]]
    return h[first], row[first]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of all parts, each hash once, in order."""
    h, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.add.reduceat(counts[order], at)


def shingle_counts(texts: DataFrame, width: int, parts: int) -> DataFrame:
    """h, count: the shingles that COMMON or more of all texts have, and how many do. A task adds up TALLY shingles at a time and deals them by hash in so many
    parts, sorted and as steps, so that a shingle is some six bytes of the shuffle and not a row; a part is counted by one task, which holds its different
    shingles."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def masses() -> Iterator[np.ndarray]:
            held, n = [], 0
            for batch in batches:
                for _, data, offsets in steps(batch, "text"):
                    held.append(shingle_sets(data, offsets, width)[0])
                    n += len(held[-1])
                    if n >= TALLY:
                        yield np.concatenate(held)
                        held, n = [], 0
            if n:
                yield np.concatenate(held)

        for h in masses():
            h, counts = np.unique(h, return_counts=True)
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cut = [*np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist(), len(h)]
            data = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                planes = [np.diff(h[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8), counts[a:b].astype("<u4").view(np.uint8).reshape(-1, 4)]
                data.append((b - a).to_bytes(4, "little") + pa.compress(b"".join(x.T.tobytes() for x in planes), codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array(data, pa.binary())], ["part", "data"])

    def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = int.from_bytes(data[:4], "little")
        planes = np.frombuffer(pa.decompress(data[4:], 12 * n, codec="zstd", asbytes=True), np.uint8)
        told = [np.ascontiguousarray(x.reshape(-1, n).T) for x in (planes[: 8 * n], planes[8 * n :])]
        return np.cumsum(told[0].view("<u8").ravel(), dtype=np.uint64), told[1].view("<u4").ravel().astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, now = [], None
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if held and part != now:
                        yield added(held)
                        held = []
                    now = part
                    held.append(unpacked(data.as_py()))
                    if sum(len(x[0]) for x in held[1:]) > max(TALLY, len(held[0][0])):
                        held = [added(held)]
            if held:
                yield added(held)

        for h, counts in whole():
            often = counts >= COMMON
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(counts[often])], ["h", "count"])

    return texts.select("text").mapInArrow(tally, "part long, data binary").repartition("part").sortWithinPartitions("part").mapInArrow(count, "h long, count long")


def _key() -> Column:
    """128 bits that stand for a row's doc_id and text; whether there is a doc_id is said first, so that no text reads like one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string"), F.lit(":")), F.lit("-")), F.coalesce("text", F.lit(""))))).alias("_key")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """_key, keep_id, kept for each distinct (doc_id, text) that has a near copy: words in shingles of width, sets with a Jaccard similarity of at
    least similarity; of each component the smallest doc_id stays (null last).

    Equal sets are one node. Sets meet in a bucket for each shingle of their prefix, which no pair of the similarity escapes, and their fingerprints are
    compared there bit-sliced. First, a set is held against its nearest and the first within reach in each bucket, of which one that the counts show to be
    larger than `bucket` is split; then, in buckets that verified links haven't joined as a whole, all pairs within reach are, tile by tile, but those
    joined already or whose sketches prove them unlike. Each link is verified on the whole sets, so nothing below similarity is joined. Texts without
    words have no copies. _key is _key() of the row.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def identity(h: np.ndarray, cuts: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(h[cuts[i] : cuts[i + 1]].tobytes()) for i in some.tolist()], np.uint64).view(np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                h, cuts = shingle_sets(data, offsets, width)
                some = np.flatnonzero(np.diff(cuts))
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([part.column("_key").take(take), part.column("doc_id").take(take), pa.array(identity(h, cuts, some)), pa.array(parities(h, cuts), pa.binary()).take(take), pa.array(np.diff(cuts)[some])], ["_key", "doc_id", "node", "sketch", "shingles"])

    prints = written(rows.mapInArrow(of, "_key binary, doc_id long, node long, sketch binary, shingles long").dropDuplicates(["_key"]))
    parts = max(n, (prints.agg(F.sum("shingles")).first()[0] or 0) // TALLY + 1)
    counted = written(shingle_counts(rows, width, parts))
    total, least = 0, COMMON
    for r in counted.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():
        total += r["n"]
        if total > MOST_COMMON:
            least = r["count"] + 1
            break
    told = counted.where(F.col("count") >= least).toArrow()
    common, counts = told["h"].to_numpy().view(np.uint64), told["count"].to_numpy()
    order = np.argsort(common)
    common, counts = common[order], counts[order]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in steps(batch, "text"):
                h, cuts = shingle_sets(data, offsets, width)
                node = np.zeros(len(cuts) - 1, np.int64)
                some = np.flatnonzero(np.diff(cuts))
                node[some] = identity(h, cuts, some)
                prints = [fingerprint(x, cuts).view(np.int64) for x in (h, mixed(h + np.uint64(WIDE)))]
                key, row = prefixes(h, cuts, similarity, common, counts)
                part = np.full(len(key), -1, np.int32)  # of a bucket that isn't split
                if len(large):
                    at = np.minimum(np.searchsorted(large, key), len(large) - 1)
                    hot = np.flatnonzero(large[at] == key)
                    part[hot] = mixed(node[row[hot]].view(np.uint64) ^ key[hot]) % blocks[at[hot]]
                columns = [key.view(np.int64), part, node[row], *(x[row] for x in prints), np.diff(cuts)[row].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "part", "node", "p0", "p1", "size"])

    over = counts > bucket
    large, blocks = common[over], (-(-counts[over] // bucket)).astype(np.uint64)
    dealt = rows.select("text").mapInArrow(deal, "key long, part int, node long, p0 long, p1 long, size int")

    def close(batch: pa.RecordBatch, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, differing bits) of the rows of one group (labels, sorted), i and j within reach of one another."""
        size = batch.column("size").to_numpy()
        values = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("p0", "p1")], 1)
        for i, j in close_lanes(values, group, WIDE_RADIUS, 1 << 13):
            fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
            far = np.bitwise_count(values[i] ^ values[j]).sum(axis=1)
            fits &= (far <= SET_RADIUS) | (size[i] <= SMALL)
            yield i[fits], j[fits], far[fits]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, equal, rest = same_group("key", "part"), same_group("key", "part", "node"), ["key", "a", "b", "p0", "p1", "size"]
        for batch in whole_groups(batches, same, 100_000):
            batch = batch.filter(pa.array(~equal(batch)))
            split = batch.filter(pa.array(batch.column("part").to_numpy() >= 0))
            if split.num_rows:  # what is near may lie in another part, so all of a split bucket are kept
                yield pa.RecordBatch.from_arrays([split.column("key"), split.column("node"), pa.nulls(split.num_rows, pa.int64()), *(split.column(c) for c in ("p0", "p1", "size"))], rest)
            again = same(batch)
            batch = batch.filter(pa.array(again | np.concatenate((again[1:], [False]))))
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            for i, j, far in close(batch, np.cumsum(~same(batch))):
                i, j, far = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((far, far))
                for by in (np.lexsort((j, far, i)), np.lexsort((j, i))):
                    if len(by):
                        first = by[np.concatenate(([True], i[by][1:] != i[by][:-1]))]
                        whole = batch.take(pa.array(i[first]))
                        yield pa.RecordBatch.from_arrays([whole.column("key"), whole.column("node"), pa.array(node[j[first]]), *(whole.column(c) for c in ("p0", "p1", "size"))], rest)

    shape = "key long, a long, b long, p0 long, p1 long, size int"
    met = written(dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(link, shape))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                h, cuts = shingle_sets(data, offsets, width)
                own = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(identity(h, cuts, np.arange(len(own)))), pa.array(own, pa.binary())], ["node", "own"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = written(prints.join(wanted, "node").groupBy("node").agg(F.min("_key").alias("_key")).select("_key"))
        texts = rows.join(small_side(wanted), "_key", "left_semi").dropDuplicates(["_key"]).select("text")
        own = written(texts.mapInArrow(sets, "node long, own binary"))
        side = lambda c, as_: own.select(F.col("node").alias(c), F.col("own").alias(as_))
        return written(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"))

    pairs = written(met.where("b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links = verified(pairs)
    roots = written(components(links, "a", "b"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = same_group("key", "i", "j")
        for batch in whole_groups(batches, same, 2 * bucket):
            if not batch.num_rows:
                continue
            node, root, size = (batch.column(c).to_numpy() for c in ("node", "root", "size"))
            sketch = np.frombuffer(b"".join(x.as_py() for x in batch.column("sketch")), np.uint64).reshape(len(node), -1)
            for i, j, _ in close(batch, np.cumsum(~same(batch))):
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= (size[i] + size[j]) * (1 - similarity) / (1 + similarity) + 1e-9
                i, j = node[i[apart]], node[j[apart]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(i, j)), pa.array(np.minimum(i, j))], ["a", "b"])

    members = met.select("key", F.col("a").alias("node"), "p0", "p1", "size").distinct()
    members = members.join(small_side(roots), "node", "left").withColumn("root", F.coalesce("component", "node"))
    several = members.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_n")).where("_lo != _hi")
    several = written(several.select("key", F.ceil(F.col("_n") / bucket).cast("int").alias("_blocks")))
    members = written(members.join(small_side(several), "key").select("key", "node", "p0", "p1", "size", "root", "_blocks"))
    sketches = written(prints.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch")))
    members = in_tiles(members, "node").join(small_side(sketches), "node").select("key", "i", "j", "node", "p0", "p1", "size", "root", "sketch")
    others = members.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(rest, "a long, b long").distinct()
    others = written(others.join(pairs, ["a", "b"], "left_anti"))
    roots = written(components(links.unionByName(verified(others)), "a", "b"))
    named = written(prints.join(small_side(roots), "node", "left").select("_key", "doc_id", F.coalesce("component", "node").alias("component")))
    best = named.groupBy("component").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))).alias("_b")).where("_n > 1")
    return named.join(best, "component").select("_key", F.col("_b.doc_id").alias("keep_id"), (F.col("_key") == F.col("_b._key")).alias("kept"))


def without_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs but near copies of a row that stays; all columns pass through. Rows that repeat doc_id and text stay or go together."""
    gone = written(near_copies(docs, width, similarity, bucket).where("not kept").select("_key"))
    return with_row(docs, _key()).join(small_side(gone), "_key", "left_anti").select("_row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: see simhash_groups()."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

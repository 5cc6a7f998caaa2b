"""Overlaps of sequences: records with traces, their checks, orders, scores, chains, zones and renderings.

The fixture maps documents of odd id onto those of even id by the k-mers that they share, but for codes over the product cap. An overlap is a band of
diagonals; its trace has, for each stretch of SPACE bases of the read, the differences and the bases of the contig that lie there.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.alignments import BIAS, aligned, edit_script, reached_together, rendered, trace_points, walked_together
from readloom.functions.bases import reverse_complement
from readloom.functions.scripts import DIFF_ALIGN, align, crossing, improved, linear_script, passes
from readloom.functions.stretches import dealt, gathered, in_masses, kmers_by_code, living, mixed, packed, run_boxes, seed_runs, stretches, strong_runs, unpacked
from readloom.operators.seeds import K, MOST_CAP, MOST_KMERS
from readloom.sources.overlap_files import NAME, register
from readloom.sources.scratch import discard, scratch_path, stored
from readloom.sources.tables import BROADCAST_KMERS, RC_SQL, READS_SQL, STRANDED_SQL, complemented, kmers, kmers_sql, reads, spread, stranded

#: Diagonals of a band, spacing of trace points, k-mers that an overlap covers at least, share of identity of the alignments.
BAND, SPACE, LEAST_KMERS, IDENTITY = 16, 100, 3, 0.85
#: Fixed values of chains: cost of a difference, allowed overlap, offset and ratio of gaps, score and gap of ties, slack of zones.
DIFF, LAP, OFF, PLAY, TIE, TIE_GAP, ZONE = 2.3, 400, 500, 1.4, 50, 500, 100
#: Share of its zone's best score that a chain has at least.
NEAR = 0.95
#: Bases of a bucket of stretches, stretches or runs that a task packs at once, turns in which the buckets are made.
BUCKET, MASS, TURNS = 1_000_000, 1 << 19, 2
#: Bytes that a seed leaves as packed runs at most, and bytes of runs that a turn may put on disk, or half a byte for each base if that is more.
SEED_BYTES, TURN_BYTES = 3, 1 << 28
PACKED = "bucket long, data binary"
_PAIR = ["aread", "bread", "band"]
_BOX = ["abpos", "aepos", "bbpos", "bepos"]


def overlap_seeds(spark: SparkSession, sf_dir: str, most: int = MOST_CAP, strands: bool = False) -> DataFrame:
    """aread, bread, comp, apos, bpos, diag of k-mers that reads (odd ids) and contigs (even ids) share, of the codes that make less than `most` seeds. Of
    strands, a third of all sequences are complements, and comp says that the contig's complement was matched, in whose coordinates bpos is.

    The seeds of a code are known from its counts before the join; no code is dropped for its count on one side alone. K-mers are made once: those that make
    seeds are stored and joined from there."""
    table = reads(spark, sf_dir)
    table = stranded(table) if strands else table
    a = kmers(table.where("read_id % 2 = 1"), "read_id", K).select("read_id", "rpos", "code", F.lit(False).alias("comp"), F.lit(True).alias("is_a"))
    even = table.where("read_id % 2 = 0")
    b = kmers(even, "read_id", K).select("read_id", "rpos", "code", F.lit(False).alias("comp"), F.lit(False).alias("is_a"))
    if strands:
        b = b.unionByName(kmers(complemented(even), "read_id", K).select("read_id", "rpos", "code", F.lit(True).alias("comp"), F.lit(False).alias("is_a")))
    each = a.unionByName(b)
    counts = each.groupBy("code").agg((F.count_if("is_a") * F.count_if(~F.col("is_a"))).alias("seeds"))
    kept = stored(each.join(counts.where((F.col("seeds") > 0) & (F.col("seeds") < most)).select("code"), "code"))
    left = kept.where("is_a").select(F.col("read_id").alias("aread"), (F.col("rpos") + 1).alias("apos"), "code")
    right = kept.where("not is_a").select(F.col("read_id").alias("bread"), "comp", (F.col("rpos") + 1).alias("bpos"), "code")
    return left.join(right, "code").select("aread", "bread", "comp", "apos", "bpos", (F.col("apos") - F.col("bpos")).alias("diag"))


def twins(table: DataFrame) -> DataFrame:
    """read_id, rep, times: of the reads (odd ids) and of the contigs (even ids) of which another has the same sequence, the least id with it, and how many have it."""
    told = table.where("read_id % 2 in (0, 1)").groupBy("read_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("seq", 256))), ""), 256).alias("h"))
    same = Window.partitionBy(F.col("read_id") % 2, "h")
    return told.select("read_id", F.min("read_id").over(same).alias("rep"), F.count("*").over(same).alias("times")).where("times > 1")


def spelled_out(found: DataFrame, same: DataFrame) -> DataFrame:
    """found, of pairs of one read of each sequence (aread) and one contig of each (bread), with the rows of all reads and contigs: those of equal sequences are equal."""
    for side in ("aread", "bread"):
        others = same.select(F.col("rep").alias(side), F.col("read_id").alias("_id"))
        found = found.join(others, side, "left").withColumn(side, F.coalesce("_id", side)).drop("_id")
    return found


def live_stretches(spark: SparkSession, sf_dir: str, most: int, strands: bool) -> tuple[DataFrame, int, int]:
    """(bucket, data, seeds: the packed stretches that make seeds, with the bits of the k-mers that do, a row for each bucket; buckets; bases). Stretches of
    neighbouring k-mers of one minimizer are dealt by it, so that all of a code meet and are counted in one task. There is a bucket for so many bases, and a task
    holds one. The buckets are made in TURNS, so that no more than a part of all stretches lies on disk. Of reads with one sequence, and of contigs, the one of the
    least id is cut, and counts as often as there are such (twins())."""
    table = reads(spark, sf_dir)
    n, rows = table.agg(F.coalesce(F.sum("rlen"), F.lit(0)), F.count("*")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 + strands) * n // BUCKET + 1)
    table = stranded(table) if strands else table
    same = twins(table)
    table = table.join(F.broadcast(same) if rows <= BROADCAST_KMERS else same, "read_id", "left").where("rep is null or rep = read_id")
    kind = F.when(F.col("read_id") % 2 == 1, 0).when(F.col("read_id") % 2 == 0, 1)
    kinds = F.when(kind == 1, F.array(F.lit(1), F.lit(2))).when(kind == 0, F.array(F.lit(0))) if strands else F.array(kind)
    each = table.select("read_id", "seq", F.explode(kinds).alias("kind"), F.coalesce("times", F.lit(1)).alias("times")).where("kind is not null")
    each = each.withColumn("seq", F.when(F.col("kind") == 2, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    each = spread(each).where(F.length("seq") >= K)

    def cut(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                key, kind, times = (batch.column(c).to_numpy().astype(np.int64) for c in (0, 2, 3))
                for row, place, by, told in stretches(batch.column(1), K):
                    bucket = mixed(by) % buckets
                    now = bucket % TURNS == turn
                    yield bucket[now], key[row[now]], kind[row[now]], place[now], told[now], times[row[now]]

        for bucket, *columns in in_masses(parts(), MASS):
            yield dealt(bucket, columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, kind, place, told, times in gathered(batches, 5):
            alive, seeds = living(told, kind, K, most, times)
            if seeds:
                here = alive > 0
                data = packed(*(c[here] for c in (key, kind, place, told, alive)))
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([data], pa.binary()), pa.array([seeds])], ["bucket", "data", "seeds"])

    made = [stored(lambda t=t: gather(each.mapInArrow(lambda x: cut(x, t), PACKED)).mapInArrow(judge, f"{PACKED}, seeds long")) for t in range(TURNS)]
    live = reduce(DataFrame.unionByName, made)
    live._made, live._same = made, same  # type: ignore[attr-defined]
    return live, buckets, n


def gather(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")


def runs_of(live: DataFrame, buckets: int, most: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """bucket, data: the seeds of live_stretches() as packed runs, all of a pair in one bucket, of the reads of one turn of all."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for data in batch.column(1):
                    columns = unpacked(data.as_py(), 5)
                    mine = (columns[1] > 0) | (mixed(columns[0]) % turns == turn)
                    key, kind, place, told, alive = (c[mine] for c in columns)
                    yield from seed_runs(key, place, told, kind, K, most, alive)

        for aread, bread, *columns in in_masses(parts(), MASS):
            order = np.lexsort((bread, aread))
            aread, bread, *columns = (c[order] for c in (aread, bread, *columns))
            yield dealt(mixed(aread, bread) % buckets, [aread, bread, *columns])

    return gather(live.select("bucket", "data").mapInArrow(meet, PACKED))


def packed_runs(spark: SparkSession, sf_dir: str, most: int = MOST_CAP, strands: bool = False) -> DataFrame:
    """bucket, data: the seeds of overlap_seeds() between different sequences as packed runs, all of a pair in one bucket. Neither a k-mer nor a seed is a row: seeds one after the other on
    a diagonal leave the task that makes them as one run."""
    live, buckets, _ = live_stretches(spark, sf_dir, most, strands)
    return runs_of(live, buckets, most)


def strong_bands(spark: SparkSession, sf_dir: str, most: int = MOST_CAP, strands: bool = False, spelled: bool = True) -> DataFrame:
    """aread, bread, comp, band, seeds, covered, abpos, aepos, bbpos, bepos: boxes() of overlap_seeds(), made from runs. Most runs are of weak bands, and there may be
    many more of them than bases: they are made for a part of the reads at a time, in as many turns as the seeds, which are counted before, ask for, and what a
    turn has shuffled is removed after it, the stretches after the last. So what lies on disk grows with the bases, not with the seeds. They are made of one read and
    contig of each sequence, and are then spelled out for all, unless they are asked for as they are."""
    names = ["aread", "bread", "comp", "band", "seeds", "covered", *_BOX]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in gathered(batches, 6):
            aread, bread, kind, *others = run_boxes(*runs, K, BAND, LEAST_KMERS * K)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (aread, bread, kind == 2, *others)], names)

    live, buckets, n = live_stretches(spark, sf_dir, most, strands)
    seeds = live.agg(F.coalesce(F.sum("seeds"), F.lit(0)).alias("n")).first()["n"]
    turns = max(1, math.ceil(SEED_BYTES * seeds / max(TURN_BYTES, n // 2)))
    shape = ", ".join(f"{c} {'boolean' if c == 'comp' else 'long'}" for c in names)
    whole = lambda found: spelled_out(found, live._same).select(names) if spelled else found
    found = [stored(lambda t=t: whole(runs_of(live, buckets, most, t, turns).mapInArrow(of, shape))) for t in range(turns)]
    discard(*live._made)
    bands = reduce(DataFrame.unionByName, found)
    bands._bases, bands._same = n, None if spelled else live._same  # type: ignore[attr-defined]
    return bands


def boxes(seeds: DataFrame, *keys: str) -> DataFrame:
    """keys (aread, bread, band unless given), seeds, covered, abpos, aepos, bbpos, bepos of bands that cover at least LEAST_KMERS k-mers."""
    keys = keys or tuple(_PAIR)
    banded = seeds.withColumn("band", F.floor(F.col("diag") / BAND).cast("long"))
    step = F.least(F.coalesce(F.col("apos") - F.lag("apos").over(Window.partitionBy(*keys).orderBy("apos", "bpos")), F.lit(K)), F.lit(K))
    found = banded.withColumn("gain", step).groupBy(*keys).agg(
        F.count("*").alias("seeds"), F.sum("gain").cast("long").alias("covered"), (F.min("apos") - K).cast("long").alias("abpos"),
        F.max("apos").cast("long").alias("aepos"), (F.min("bpos") - K).cast("long").alias("bbpos"), F.max("bpos").cast("long").alias("bepos"),
    )
    return found.where(F.col("covered") >= LEAST_KMERS * K)


def cuts(found: DataFrame, *more: Column) -> DataFrame:
    """boxes() cut at the multiples of SPACE in the read: i, a0, a1, b0, b1, b's cuts in proportion, and more."""
    at = F.explode(F.sequence(F.floor(F.col("abpos") / SPACE), F.floor((F.col("aepos") - 1) / SPACE))).alias("i")
    cut = found.select(*_PAIR, *_BOX, *more, at).withColumns({"a0": F.greatest("abpos", F.col("i") * SPACE), "a1": F.least("aepos", (F.col("i") + 1) * SPACE)})
    place = lambda a: F.col("bbpos") + F.floor((F.col(a) - F.col("abpos")) * (F.col("bepos") - F.col("bbpos")) / (F.col("aepos") - F.col("abpos"))).cast("long")
    return cut.withColumns({"b0": place("a0"), "b1": place("a1")})


def segments(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """made() of cuts() with both strings, in the turns of _boxed()."""
    part = lambda s, p, q, start: F.substring(F.col(s), (F.col(p) - F.col(start) + 1).cast("int"), (F.col(q) - F.col(p)).cast("int"))

    def of(boxed: DataFrame) -> DataFrame:
        cut = cuts(boxed, F.col("a").alias("x"), F.col("b").alias("y"))
        return made(cut.select(*_PAIR, *_BOX, "i", "a0", "a1", "b0", "b1", part("x", "a0", "a1", "abpos").alias("a"), part("y", "b0", "b1", "bbpos").alias("b")))

    return _boxed(spark, sf_dir, of)


def overlaps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aread, bread, band, abpos, aepos, bbpos, bepos, diffs, trace (array of d, b): the fixture's overlap records."""

    def of(each: DataFrame) -> DataFrame:
        trace = F.sort_array(F.collect_list(F.struct("i", "d", (F.col("b1") - F.col("b0")).alias("b"))))
        records = each.withColumn("d", F.levenshtein("a", "b").cast("long")).groupBy(*_PAIR, *_BOX).agg(F.sum("d").cast("long").alias("diffs"), trace.alias("t"))
        return records.withColumn("trace", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["b"].alias("b")))).drop("t")

    return segments(spark, sf_dir, of)


def said(trace: Column) -> Column:
    return F.array_join(F.transform(trace, lambda t: F.concat_ws(":", t["d"].cast("string"), t["b"].cast("string"))), ",")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps_of(spark, sf_dir).withColumn("trace", said(F.col("trace")))


# ---------------------------------------------------------------- records


_HEAD = "<qqqiiiii"


def write_records(found: DataFrame) -> DataFrame:
    """record (binary), small: overlap records with their traces, in one byte a number where all fit, else in two; numbers over 65535 are an error."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                flat = [int(v) for t in r.trace for v in (t["d"], t["b"])]
                small = max(flat, default=0) < 256
                head = struct.pack(_HEAD, r.aread, r.bread, r.band, r.abpos, r.aepos, r.bbpos, r.bepos, r.diffs)
                out.append((head + struct.pack("<i", len(flat)) + (bytes(flat) if small else struct.pack(f"<{len(flat)}H", *flat)), small))
            yield pd.DataFrame(out, columns=["record", "small"])

    return found.select(*_PAIR, *_BOX, "diffs", "trace").mapInPandas(pack, "record binary, small boolean")


def read_records(records: DataFrame) -> DataFrame:
    """The overlaps of write_records()."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data, small in zip(batch["record"], batch["small"], strict=True):
                (n,) = struct.unpack_from("<i", data, struct.calcsize(_HEAD))
                flat = struct.unpack_from(f"<{n}{'B' if small else 'H'}", data, struct.calcsize(_HEAD) + 4)
                out.append((*struct.unpack_from(_HEAD, data), [{"d": d, "b": b} for d, b in zip(flat[::2], flat[1::2], strict=True)]))
            yield pd.DataFrame(out, columns=[*_PAIR, *_BOX, "diffs", "trace"])

    return records.mapInPandas(unpack, "aread long, bread long, band long, abpos long, aepos long, bbpos long, bepos long, diffs long, trace array<struct<d:long,b:long>>")


def las_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps after they were packed as binary records and read again."""
    return read_records(write_records(overlaps_of(spark, sf_dir))).withColumn("trace", said(F.col("trace")))


def overlap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps after they were written as files, a range of reads a file, and read back through the data source."""
    register(spark)
    path = scratch_path(spark)
    found = overlaps_of(spark, sf_dir).withColumn("comp", F.lit(False)).select("aread", "bread", "comp", "band", *_BOX, "diffs", "trace")
    found.repartitionByRange("aread", "bread", "band").sortWithinPartitions("aread", "bread", "band").write.format(NAME).mode("append").save(path)
    return spark.read.format(NAME).load(path).withColumn("trace", said(F.col("trace")))


def check_trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record read back: numbers in its trace, how many there should be, the contig bases they sum to, and whether both are right."""
    found = read_records(write_records(overlaps_of(spark, sf_dir)))
    want = (F.floor((F.col("aepos") - 1) / SPACE) - F.floor(F.col("abpos") / SPACE)) * 2 + 2
    total = F.aggregate("trace", F.lit(0).cast("long"), lambda s, t: s + t["b"])
    told = found.select(*_PAIR, (2 * F.size("trace")).cast("long").alias("n"), want.cast("long").alias("want"), total.alias("bsum"), (F.col("bepos") - F.col("bbpos")).alias("bases"))
    return told.withColumn("right", (F.col("n") == F.col("want")) & (F.col("bsum") == F.col("bases")))


def compress_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a trace's numbers all fit a byte, and those bytes in hex (null where they don't)."""
    flat = F.flatten(F.transform("trace", lambda t: F.array(t["d"], t["b"])))
    found = overlaps_of(spark, sf_dir).select(*_PAIR, flat.alias("f")).withColumn("fits", F.forall("f", lambda x: x < 256))
    return found.select(*_PAIR, "fits", F.when(F.col("fits"), F.array_join(F.transform("f", lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("packed"))


def print_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for every record, and its trace as differences and running places in the contig."""
    head = F.format_string("%d vs. %d [%d,%d] x [%d,%d] : <%d diffs>", "aread", "bread", *_BOX, "diffs")
    step = F.transform("trace", lambda t, i: F.concat(t["d"].cast("string"), F.lit("@"), (F.col("bbpos") + F.aggregate(F.slice("trace", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["b"])).cast("string")))
    return overlaps_of(spark, sf_dir).select(*_PAIR, head.alias("line"), F.array_join(step, " ").alias("points"))


def flip_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the roles of read and contig swapped; the pair isn't complemented, so coordinates trade places."""
    return overlaps_of(spark, sf_dir).select(F.col("bread").alias("aread"), F.col("aread").alias("bread"), "band", F.col("bbpos").alias("abpos"), F.col("bepos").alias("aepos"), F.col("abpos").alias("bbpos"), F.col("aepos").alias("bepos"), "diffs")


# ---------------------------------------------------------------- scores, orders, common points


def score(found: DataFrame) -> DataFrame:
    """found with score, the length in the read less DIFF a difference, cut towards zero."""
    return found.withColumn("score", ((F.col("aepos") - F.col("abpos")) - F.lit(DIFF) * F.col("diffs")).cast("long"))


def score_nonneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(overlaps_of(spark, sf_dir)).where("score >= 0").select(*_PAIR, "score")


def sort_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a pair's overlaps from the last to the first in the read."""
    order = Window.partitionBy("aread", "bread").orderBy(F.desc("abpos"), F.desc("bbpos"), "band")
    return strong_bands(spark, sf_dir).select(*_PAIR, F.row_number().over(order).cast("long").alias("place"))


def sort_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a read's overlaps from the best score down; ties by place in the read, contig and place there."""
    order = Window.partitionBy("aread").orderBy(F.desc("score"), "abpos", "bread", "bbpos", "band")
    return score(overlaps_of(spark, sf_dir)).select(*_PAIR, "score", F.row_number().over(order).cast("long").alias("place"))


def entwine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For two overlaps of one read and contig: the least distance of their traces at a common point, and the last point at which they meet (-1: none)."""
    each = cuts(strong_bands(spark, sf_dir)).where("i > floor(abpos / 100)").select(*_PAIR, "a0", "b0")  # places alone, no sequence is read again
    other = each.select(F.col("aread").alias("r"), F.col("bread").alias("c"), F.col("band").alias("band2"), F.col("a0").alias("p"), F.col("b0").alias("q"))
    both = each.join(other, (F.col("aread") == F.col("r")) & (F.col("bread") == F.col("c")) & (F.col("a0") == F.col("p")) & (F.col("band") < F.col("band2")))
    apart = F.abs(F.col("b0") - F.col("q"))
    return both.groupBy(*_PAIR, "band2").agg(F.min(apart).alias("apart"), F.count("*").alias("points"), F.coalesce(F.max(F.when(apart == 0, F.col("a0"))), F.lit(-1)).cast("long").alias("meet"))


def zone_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read, the pairs of overlaps that lie in one zone: their intervals overlap by more than ZONE bases."""
    found = strong_bands(spark, sf_dir).select(*_PAIR, "abpos", "aepos")
    other = found.select(F.col("aread").alias("r"), F.col("bread").alias("b2"), F.col("band").alias("d2"), F.col("abpos").alias("f2"), F.col("aepos").alias("l2"))
    lap = (F.col("abpos") < F.col("l2") - ZONE) & (F.col("aepos") > F.col("f2") + ZONE)
    return found.join(other, (F.col("aread") == F.col("r")) & (F.struct("bread", "band") < F.struct("b2", "d2")) & lap).groupBy("aread").agg(F.count("*").alias("pairs"))


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalars of an alignment specification for IDENTITY and the reads' share of A and T: bias, least matches of 60, match score, cost."""
    at = reads(spark, sf_dir).agg((F.sum(F.length("seq") - F.length(F.translate("seq", "AT", ""))) / F.sum("rlen")).alias("at")).select(F.least("at", 1 - F.col("at")).alias("at"))
    factor = reduce(lambda otherwise, step: F.when(F.col("bias") == step[0], F.lit(step[1])).otherwise(otherwise), enumerate(BIAS), F.lit(1.0))
    told = at.select(F.when(F.col("at") < 0.2, 3).otherwise(F.floor((F.col("at") + 0.025) * 20 - 1)).cast("long").alias("bias")).withColumn("f", factor * F.lit(round(1 - IDENTITY, 9)))
    match = F.floor(1000 * F.col("f") + 1e-9).cast("long")
    return told.select("bias", F.floor(60 * (1 - F.col("f")) + 1e-9).cast("long").alias("ave_path"), match.alias("mscore"), (1000 - match).alias("dscore"))


def seed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers, those kept by the frequency filter, codes kept, and the seeds they make between reads and contigs. As in live_stretches(), packed stretches are dealt
    by minimizer, in TURNS, and all of a code are counted in one task, so that no k-mer is a row."""
    table = reads(spark, sf_dir)
    n = table.agg(F.coalesce(F.sum("rlen"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET + 1)
    each = spread(table.select("read_id", "seq")).where(F.length("seq") >= K).select("seq", F.when(F.col("read_id") % 2 == 1, 0).otherwise(1).alias("kind"))
    names = ["kmers", "revised", "codes", "hits"]

    def cut(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                kind = batch.column(1).to_numpy().astype(np.int64)
                for row, _, by, told in stretches(batch.column(0), K):
                    bucket = mixed(by) % buckets
                    now = bucket % TURNS == turn
                    yield bucket[now], kind[row[now]], told[now]

        for bucket, *columns in in_masses(parts(), MASS):
            yield dealt(bucket, columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, told in gathered(batches, 2):
            _, _, _, na, nb = kmers_by_code(told, kind, K)
            low = na + nb < MOST_KMERS
            yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in ((na + nb).sum(), (na + nb)[low].sum(), low.sum(), (na * nb)[low].sum())], names)

    made = [stored(lambda t=t: gather(each.mapInArrow(lambda x: cut(x, t), PACKED)).mapInArrow(judge, ", ".join(f"{c} long" for c in names))) for t in range(TURNS)]
    sums = reduce(DataFrame.unionByName, made).agg(*(F.sum(c).cast("long").alias(c) for c in names))
    # sums of nothing are null where no code is kept, as in SQL
    kept = lambda c: F.when(F.col("codes") > 0, F.col(c)).alias(c)
    return sums.select("kmers", kept("revised"), F.coalesce("codes", F.lit(0)).cast("long").alias("codes"), kept("hits"))


# ---------------------------------------------------------------- alignments and scripts


def _scripts(cut: DataFrame) -> DataFrame:
    """cut with d and gaps of each segment's exact edit script, in places of the whole sequences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [edit_script(a, b, a0, b0) for a, b, a0, b0 in zip(batch["a"], batch["b"], batch["a0"], batch["b0"], strict=True)]
            yield batch.drop(columns=["a", "b"]).assign(d=[f[0] for f in found], gaps=[f[1] for f in found])

    fields = ", ".join(f"{c} {t}" for c, t in cut.drop("a", "b").dtypes)
    return cut.mapInPandas(run, fields + ", d long, gaps array<long>")


def trace_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per overlap the exact script between its trace points: differences, gaps in either sequence."""
    dashes = lambda sign: F.sum(F.size(F.filter("gaps", lambda g: g * sign > 0))).cast("long")
    return segments(spark, sf_dir, lambda cut: _scripts(cut).groupBy(*_PAIR).agg(F.sum("d").cast("long").alias("diffs"), (dashes(-1) - dashes(1)).alias("shift")))


def irregular_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same between every second trace point alone, a spacing that the trace itself names."""
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c]), "").alias(c)

    def of(cut: DataFrame) -> DataFrame:
        pair = cut.withColumn("h", F.floor(F.col("i") / 2))
        wide = pair.groupBy(*_PAIR, "h").agg(F.min("a0").alias("a0"), F.min("b0").alias("b0"), F.max("a1").alias("a1"), F.max("b1").alias("b1"), text("a"), text("b"))
        return _scripts(wide).groupBy(*_PAIR).agg(F.sum("d").cast("long").alias("diffs"), F.sum(F.col("a1") - F.col("a0")).cast("long").alias("asteps"))

    return segments(spark, sf_dir, of)


def mid_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per overlap the exact scripts between the middles of its segments, the places where a best path leaves the first half of the read's bases: differences,
    shift, and the sum of the middles' places in the contig. Cuts at middles lie on best paths, those at trace points need not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(c=[crossing(a, b) for a, b in zip(batch["a"], batch["b"], strict=True)])

    def of(cut: DataFrame) -> DataFrame:
        found = cut.select(*_PAIR, "i", "a0", "b0", "a", "b").mapInPandas(run, "aread long, bread long, band long, i long, a0 long, b0 long, a string, b string, c long")
        half = F.floor(F.length("a") / 2).cast("int")
        part = lambda s, p, q: F.substring(F.col(s), p + 1, q - p)
        c = F.col("c").cast("int")
        halves = found.select(
            *_PAIR, "i", "a0", "b0", (F.col("a0") + half).alias("am"), (F.col("b0") + F.col("c")).alias("bm"),
            part("a", F.lit(0), half).alias("a1"), part("a", half, F.length("a")).alias("a2"), part("b", F.lit(0), c).alias("b1"), part("b", c, F.length("b")).alias("b2"),
        )
        along = Window.partitionBy(*_PAIR).orderBy("i")
        before = lambda x, other: F.coalesce(F.lag(x).over(along), other)
        none, last = F.lit(""), F.lead("i").over(along).isNull()
        each = halves.select(
            *_PAIR, before("am", F.col("a0")).alias("a0"), before("bm", F.col("b0")).alias("b0"), F.concat(before("a2", none), F.col("a1")).alias("a"),
            F.concat(before("b2", none), F.col("b1")).alias("b"), "am", "bm", F.when(last, F.col("a2")).alias("ra"), F.when(last, F.col("b2")).alias("rb"),
        )
        piece = lambda *x: F.struct(*(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in zip(("a0", "b0", "a", "b", "bm"), x, strict=True)))
        both = F.array(piece("a0", "b0", "a", "b", "bm"), F.when(F.col("ra").isNotNull(), piece("am", "bm", "ra", "rb", F.lit(0).cast("long"))))
        pieces = _scripts(each.select(*_PAIR, F.inline(F.array_compact(both))))
        dashes = lambda sign: F.sum(F.size(F.filter("gaps", lambda g: g * sign > 0))).cast("long")
        return pieces.groupBy(*_PAIR).agg(F.sum("d").cast("long").alias("diffs"), (dashes(-1) - dashes(1)).alias("shift"), F.sum("bm").cast("long").alias("middles"))

    return segments(spark, sf_dir, of)


def _boxed(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame], DataFrame] = lambda each: each) -> DataFrame:
    """made() of aread, bread, band, abpos, aepos, bbpos, bepos, a, b: every overlap's box, cut from both sequences, each before the next join. Boxes may hold many
    times the bases of all sequences: they are cut for a part of the reads at a time, in as many turns as their lengths ask for, and of a turn no more stays on
    disk than what is made of it. made() may join or group what is of one read, as a read is in one turn, and is asked once for equal sequences (twins())."""
    table = reads(spark, sf_dir)
    bands = strong_bands(spark, sf_dir, MOST_CAP, False, False)
    whole = lambda found: found if bands._same is None else spelled_out(found, bands._same).select(found.columns)
    bases = bands.agg(F.coalesce(F.sum(F.col("aepos") - F.col("abpos")), F.lit(0)).alias("n")).first()["n"]
    turns = max(1, math.ceil(bases / max(TURN_BYTES, bands._bases)))
    part = lambda p, q: F.substring(F.col("seq"), (F.col(p) + 1).cast("int"), (F.col(q) - F.col(p)).cast("int"))
    side = lambda odd, name: table.where(f"read_id % 2 = {odd}").select(F.col("read_id").alias(name), "seq")
    out = []
    for t in range(turns):
        mine = lambda df, t=t: df.where(F.pmod(F.xxhash64("aread"), F.lit(turns)) == t)
        a = stored(lambda m=mine: m(bands).join(m(side(1, "aread")), "aread").select(*_PAIR, *_BOX, part("abpos", "aepos").alias("a")))
        out.append(stored(lambda a=a: whole(made(a.join(side(0, "bread"), "bread").select(*_PAIR, *_BOX, "a", part("bbpos", "bepos").alias("b"))))))
        discard(a)
    return reduce(DataFrame.unionByName, out)


def linear_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap's box aligned as a whole, in memory that grows with its length alone: differences, shift, trace points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                diffs, gaps = align(r.a, r.b, DIFF_ALIGN)
                trace = trace_points(r.a, r.b, SPACE, r.abpos, gaps)
                out.append((r.aread, r.bread, r.band, diffs, sum(1 if g < 0 else -1 for g in gaps), len(trace), sum(b for _, b in trace)))
            yield pd.DataFrame(out, columns=[*_PAIR, "diffs", "shift", "points", "bases"])

    return _boxed(spark, sf_dir, lambda each: each.mapInPandas(run, "aread long, bread long, band long, diffs long, shift long, points long, bases long"))


def gap_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap's whole script with its gaps improved: gap bases and substitutions that the box needs at least (diffs), shift, whether passes rose, gap
    bases changed, or the rows aren't the bases any more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                diffs, gaps = linear_script(r.a, r.b)
                better = improved(r.a, r.b, gaps)
                x, y = aligned(r.a, r.b, better)
                rose = sum(passes(r.a, r.b, better)) > sum(passes(r.a, r.b, gaps))
                out.append((r.aread, r.bread, r.band, diffs, sum(1 if g < 0 else -1 for g in better), rose, len(better) != len(gaps), x.replace("-", "") != r.a or y.replace("-", "") != r.b))
            yield pd.DataFrame(out, columns=[*_PAIR, "diffs", "shift", "rose", "changed", "broken"])

    return _boxed(spark, sf_dir, lambda each: each.mapInPandas(run, "aread long, bread long, band long, diffs long, shift long, rose boolean, changed boolean, broken boolean"))


def render_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's alignment as text: columns that differ, and both rows without dashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                lines = rendered(a, b, edit_script(a, b)[1], 1 << 20).split("\n")
                out.append((lines[1].count("*"), lines[0].replace("-", ""), lines[2].replace("-", "")) if len(lines) == 3 else (0, "", ""))
            yield batch[[*_PAIR, "i"]].assign(marked=[o[0] for o in out], first=[o[1] for o in out], second=[o[2] for o in out])

    shape = "aread long, bread long, band long, i long, marked long, first string, second string"
    return segments(spark, sf_dir, lambda cut: cut.select(*_PAIR, "i", "a", "b").mapInPandas(run, shape))


#: Bases of pairs that a task aligns side by side.
PAIR_BASES = 1 << 22
ALIGNED = "aread long, bread long, comp boolean, band long, abpos long, aepos long, bbpos long, bepos long, diffs long, trace array<struct<d:long,b:long>>"
_TRACE = pa.list_(pa.struct([("d", pa.int64()), ("b", pa.int64())]))
#: A band's pair (its number among those at hand) and its row, its number, and its seeds (apos, bpos).
Band = tuple[int, dict, int, np.ndarray]


def _bands_at_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[str, str]], list[Band]]]:
    """Both sequences of pairs, PAIR_BASES at a time, and their bands, of rows with packed runs."""
    pairs: list[tuple[str, str]] = []
    bands: list[Band] = []
    bases = 0
    for batch in batches:
        for row in range(batch.num_rows):
            r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            x, y = r.pop("x"), r.pop("y")
            band, apos, diag, n = unpacked(r.pop("data"), 4)
            a = np.repeat(apos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seeds, of = np.stack([a, a - np.repeat(diag, n)], axis=1), np.repeat(band, n)
            for each in np.unique(band).tolist():
                bands.append((len(pairs), r, each, seeds[of == each]))
            pairs.append((x, y))
            bases += len(x) + len(y)
            if bases >= PAIR_BASES:
                yield pairs, bands
                pairs, bands, bases = [], [], 0
    if pairs:
        yield pairs, bands


def _seeded(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame, tuple[int, int, int, int]], DataFrame], strands: bool = False, spelled: bool = True) -> DataFrame:
    """made() of (aread, bread, comp, data (the packed runs of its strong bands), x, y (both sequences, y complemented if comp)) and the alignment specification: of
    the pairs with bands of LEAST_KMERS k-mers and more. Its rows are spelled out for all reads and contigs of equal sequences, unless they are asked for as they are.

    No seed is a row, and weak bands leave the task that makes their runs as little as strong_bands() lets them. Runs and sequences are on disk for the pairs of a
    turn alone. A pair goes to a task by both its ids, so that a read's or a contig's many pairs are aligned by many tasks."""
    live, buckets, n = live_stretches(spark, sf_dir, MOST_CAP, strands)
    seeds = live.agg(F.coalesce(F.sum("seeds"), F.lit(0)).alias("n")).first()["n"]
    turns = max(1, math.ceil(SEED_BYTES * seeds / max(TURN_BYTES, n // 2)))
    at = spec(spark, sf_dir).first()
    means = (at["bias"], at["ave_path"], at["mscore"], at["dscore"])
    table = reads(spark, sf_dir)
    table = stranded(table) if strands else table
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    side = lambda key, *columns: table.select(F.col("read_id").alias(key), *columns)
    names = ["aread", "bread", "comp", "data"]

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in gathered(batches, 6):
            aread, bread, kind, *others = strong_runs(*runs, K, BAND, LEAST_KMERS * K)
            if not len(aread):
                continue
            cut = np.flatnonzero(np.r_[True, (np.diff(aread) != 0) | (np.diff(bread) != 0) | (np.diff(kind) != 0)])
            data = [packed(*(c[p:q] for c in others)) for p, q in zip(cut, np.r_[cut[1:], len(aread)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (aread[cut], bread[cut], kind[cut] == 2)] + [pa.array(data, pa.binary())], names)

    def whole(found: DataFrame) -> DataFrame:
        return spelled_out(found, live._same).select(found.columns) if spelled else found

    out = []
    for t in range(turns):
        pairs = stored(lambda t=t: runs_of(live, buckets, MOST_CAP, t, turns).mapInArrow(strong, "aread long, bread long, comp boolean, data binary"))
        bases = pairs.join(side("aread", "rlen"), "aread").select("bread", F.col("rlen").alias("n")).join(side("bread", "rlen"), "bread").agg(F.sum(F.col("n") + F.col("rlen")).alias("n")).first()["n"] or 0
        parts = max(1, math.ceil(bases / max(TURN_BYTES, n)))
        for p in range(parts):
            mine = pairs.where(F.pmod(F.xxhash64("aread", "bread"), F.lit(parts)) == p)
            both = mine.join(side("bread", F.col("seq").alias("y")), "bread").join(side("aread", F.col("seq").alias("x")), "aread").repartition(tasks, "aread", "bread")
            both = both.select(*names, "x", F.when(F.col("comp"), reverse_complement(F.col("y"))).otherwise(F.col("y")).alias("y"))
            out.append(stored(lambda b=both: whole(made(b, means))))
        discard(pairs)
    discard(*live._made)
    found = reduce(DataFrame.unionByName, out)
    found._same = None if spelled else live._same  # type: ignore[attr-defined]
    return found


def aligned_of(spark: SparkSession, sf_dir: str, strands: bool = False, spelled: bool = True) -> DataFrame:
    """aread, bread, comp, band, abpos, aepos, bbpos, bepos, diffs, trace: the local alignments that the seeds of each band extend to."""

    def made(found: DataFrame, means: tuple[int, int, int, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pairs, bands in _bands_at_hand(batches):
                out = []
                walks = walked_together(pairs, [(p, seeds) for p, _, _, seeds in bands], means, K, LEAST_KMERS * K)
                for (p, r, band, _), walk in zip(bands, walks, strict=True):
                    for (a0, a1, b0, b1), diffs, _ in walk:
                        trace = trace_points(pairs[p][0][a0:a1], pairs[p][1][b0:b1], SPACE, a0, most=diffs)
                        out.append((r["aread"], r["bread"], r["comp"], band, a0, a1, b0, b1, sum(d for d, _ in trace), [{"d": d, "b": b} for d, b in trace]))
                yield _as_batch(out, ALIGNED)

        return found.mapInArrow(run, ALIGNED)

    return _seeded(spark, sf_dir, made, strands, spelled)


def _as_batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    fields = [f.split(" ", 1) for f in shape.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(kind, _TRACE)) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def local_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_of(spark, sf_dir).drop("comp").withColumn("trace", said(F.col("trace")))


def pebbled_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local alignments of both strands with the traces of the searches that found them, and what the box needs at least (best): differences are never fewer,
    and no script is sought a second time."""
    shape = ALIGNED + ", x string, y string"

    def made(found: DataFrame, means: tuple[int, int, int, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pairs, bands in _bands_at_hand(batches):
                out = []
                walks = walked_together(pairs, [(p, seeds) for p, _, _, seeds in bands], means, K, LEAST_KMERS * K, SPACE)
                for (p, r, band, _), walk in zip(bands, walks, strict=True):
                    for box, diffs, trace in walk:
                        a0, a1, b0, b1 = box
                        out.append((r["aread"], r["bread"], r["comp"], band, *box, diffs, [{"d": d, "b": b} for d, b in trace], pairs[p][0][a0:a1], pairs[p][1][b0:b1]))
                for at in range(0, len(out), 1000):  # boxes may overlap, and so be more than the bases at hand
                    yield _as_batch(out[at : at + 1000], shape)

        # the least is at most diffs, so that cells further from the diagonal needn't be looked at
        best = F.expr("levenshtein(x, y, cast(diffs as int))").cast("long")
        return found.mapInArrow(run, shape).select("aread", "bread", "comp", "band", *_BOX, "diffs", best.alias("best"), said(F.col("trace")).alias("trace"))

    return _seeded(spark, sf_dir, made, strands=True)


def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each band's first seed extends towards the ends of both sequences, and its last one towards their starts."""
    shape = "aread long, bread long, band long, aend long, bend long, abegin long, bbegin long"

    def made(found: DataFrame, means: tuple[int, int, int, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pairs, bands in _bands_at_hand(batches):
                asked = []
                for p, _, _, seeds in bands:
                    order = np.lexsort((seeds[:, 1], seeds[:, 0]))
                    first, last = seeds[order[0]].tolist(), seeds[order[-1]].tolist()
                    asked += [(p, True, *first), (p, False, *last)]
                far = reached_together(pairs, asked, means)
                ends = [(i + x, j + y) if ahead else (i - x, j - y) for (_, ahead, i, j), (x, y) in zip(asked, far, strict=True)]
                yield _as_batch([(r["aread"], r["bread"], band, *on, *back) for (_, r, band, _), on, back in zip(bands, ends[::2], ends[1::2], strict=True)], shape)

        return found.mapInArrow(run, shape)

    return _seeded(spark, sf_dir, made)


# ---------------------------------------------------------------- chains and zones


def chain_links(rows: list[tuple]) -> list[tuple[int, int]]:
    """(score, next) of overlaps (abpos, aepos, bbpos, bepos, diffs) of one read, contig and strand from the last to the first in the read: each goes on
    with the later one that makes the best chain, near ties by the lesser gap; scores are cut towards zero at each step.

    All later overlaps that may follow come from one mask. They are tried from the nearest on; of two whose scores are within TIE of each other the one with a
    gap smaller by more than TIE_GAP wins, else the better one, then the one nearer in the read."""
    table = np.array(rows, float).reshape(-1, 5)
    own = (table[:, 1] - table[:, 0]) - DIFF * table[:, 4]
    made = np.zeros(len(table), np.int64)
    out: list[tuple[int, int]] = []
    for c, (_, aend, bbeg, bend, _) in enumerate(table):
        gap, leap = table[:c, 0] - aend, table[:c, 2] - bend
        stretch = (gap + OFF) / np.where(leap == -OFF, np.inf, leap + OFF)
        may = np.flatnonzero((gap > -LAP) & (leap > -LAP) & (table[:c, 2] >= bbeg) & (stretch * PLAY >= 1) & (stretch <= PLAY))[::-1]
        held = (int(own[c]), 0.0, -1)  # score, gap, overlap
        for d, total, by in zip(may.tolist(), np.trunc(made[may] + own[c]).astype(np.int64).tolist(), gap[may].tolist(), strict=True):
            closer = np.sign(by - held[1]) if abs(by - held[1]) > TIE_GAP else 0
            rank = (0, total - held[0], held[1] - by) if closer == 0 else (-closer,)
            if total > held[0] + TIE or (total >= held[0] - TIE and rank > (0,) * len(rank)):
                held = (total, by, d)
        made[c] = held[0]
        out.append((held[0], held[2]))
    return out


def zones(chains: list[tuple[int, int, int, int]], near: float = NEAR) -> list[tuple[int, int, bool]]:
    """(chain, zone, best) of a read's chains (score, begin, end, name), the best score first: a chain belongs to the first zone that it overlaps by more
    than ZONE bases, and stays if its score is at least near times the zone's top; with none it opens a zone."""
    made: list[tuple[int, int, int]] = []
    out = []
    for total, beg, end, name in sorted(chains, key=lambda x: (-x[0], *x[1:])):
        z = next((k for k, (b, e, _) in enumerate(made) if beg < e - ZONE and end > b + ZONE), None)
        if z is None:
            made.append((beg, end, total))
            out.append((name, len(made) - 1, True))
        elif total >= near * made[z][2]:
            out.append((name, z, total == made[z][2]))
    return out


# ---------------------------------------------------------------- redundancy


def fused(rows: list[dict]) -> list[dict]:
    """Overlaps (abpos, aepos, bbpos, bepos, points {a: b, differences before a}) of one pair without redundant ones: two that meet at a common point are
    spliced there if the later one goes further, else the contained one goes."""
    live: list[dict | None] = [dict(r) for r in sorted(rows, key=lambda r: (r["abpos"], r["bbpos"]))]
    for j in range(1, len(live)):
        for k in range(j - 1, -1, -1):
            if live[k] is None:
                continue
            p, q = (live[k], live[j]) if live[k]["abpos"] <= live[j]["abpos"] else (live[j], live[k])
            common = [a for a in p["points"] if a in q["points"] and p["points"][a][0] == q["points"][a][0]]
            if q["abpos"] > p["aepos"] or q["bbpos"] > p["bepos"] or not common:
                continue
            if q["aepos"] > p["aepos"]:
                w = max(common)
                late = q["diffs"] - q["points"][w][1]
                points = {a: v for a, v in p["points"].items() if a <= w} | {a: (b, p["points"][w][1] + d - q["points"][w][1]) for a, (b, d) in q["points"].items() if a > w}
                p = {**p, "aepos": q["aepos"], "bepos": q["bepos"], "diffs": p["points"][w][1] + late, "points": points}
            live[j], live[k] = p, None
            break
    return [r for r in live if r is not None]


def fused_of(spark: SparkSession, sf_dir: str, strands: bool = False) -> DataFrame:
    """aread, bread, comp, abpos, aepos, bbpos, bepos, diffs of every pair's and strand's local alignments after fusion; equal ones, found from two bands, are
    one."""
    keys = [*_BOX, "diffs"]

    def fuse(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {}
        for r in pdf.itertuples(index=False):
            at, b, before, points = r.abpos // SPACE * SPACE, r.bbpos, 0, {}
            for t in r.trace:
                if at > r.abpos:
                    points[at] = (b, before)
                at, b, before = at + SPACE, b + int(t["b"]), before + int(t["d"])
            rows.setdefault((r.abpos, r.aepos, r.bbpos, r.bepos), {**{c: getattr(r, c) for c in keys}, "points": points})
        out = [[*(pdf[c].iloc[0] for c in ("aread", "bread", "comp")), *(r[c] for c in keys)] for r in fused(list(rows.values()))]
        return pd.DataFrame(out, columns=["aread", "bread", "comp", *keys])

    each = aligned_of(spark, sf_dir, strands, False)
    fused_ = each.groupBy("aread", "bread", "comp").applyInPandas(fuse, "aread long, bread long, comp boolean, abpos long, aepos long, bbpos long, bepos long, diffs long")
    return spelled_out(fused_, each._same).select(fused_.columns)


def nonredundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_of(spark, sf_dir).drop("comp")


def chosen_of(spark: SparkSession, sf_dir: str, strands: bool = False) -> DataFrame:
    """Per read the alignments of chains that stay: chain, place in it (0 starts), zone, score, best. Chains are of one contig and strand, zones of all of a
    read's chains. A read's alignments meet in one task; the product cap bounds the seeds that they come from."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bread", "comp", "abpos", "bbpos", "aepos"], ascending=[True, True, False, False, True]).reset_index(drop=True)
        links: list[tuple[int, int]] = []
        for _, g in pdf.groupby(["bread", "comp"], sort=False):
            base = len(links)
            links += [(s, n + base if n >= 0 else -1) for s, n in chain_links(list(g[[*_BOX, "diffs"]].itertuples(index=False, name=None)))]
        followed = {n for _, n in links}
        heads = [k for k in range(len(links)) if k not in followed and links[k][0] >= 0]
        path = {}
        for k in heads:
            path[k] = [k]
            while (n := links[path[k][-1]][1]) >= 0:
                path[k].append(n)
        out, taken = [], set()
        kept = {name: (z, best) for name, z, best in zones([(links[k][0], int(pdf["abpos"][k]), int(pdf["aepos"][path[k][-1]]), k) for k in heads])}
        for k in sorted(kept, key=lambda k: (-links[k][0], k)):
            for place, n in enumerate(path[k]):
                if n in taken:  # shared with a better chain, which ends this one
                    break
                taken.add(n)
                out.append((int(pdf["aread"][n]), int(pdf["bread"][n]), bool(pdf["comp"][n]), *(int(pdf[c][n]) for c in _BOX), k, place, kept[k][0], links[k][0], kept[k][1]))
        return pd.DataFrame(out, columns=["aread", "bread", "comp", *_BOX, "chain", "place", "zone", "score", "best"])

    return fused_of(spark, sf_dir, strands).groupBy("aread").applyInPandas(choose, "aread long, bread long, comp boolean, abpos long, aepos long, bbpos long, bepos long, chain long, place long, zone long, score long, best boolean")


def chosen_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_of(spark, sf_dir).drop("comp")


# ---------------------------------------------------------------- both strands

_STRAND = ["aread", "bread", "comp", "band"]


def forward(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """found with bbpos, bepos of complemented contigs turned into places of the contig itself; lengths: read_id, rlen."""
    sized = found.join(lengths.select(F.col("read_id").alias("bread"), "rlen"), "bread")
    flip = lambda c, other: F.when(F.col("comp"), F.col("rlen") - F.col(other)).otherwise(F.col(c)).cast("long")
    return sized.withColumns({"_b0": flip("bbpos", "bepos"), "_b1": flip("bepos", "bbpos")}).drop("bbpos", "bepos", "rlen").withColumnsRenamed({"_b0": "bbpos", "_b1": "bepos"})


def strand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of both strands of reads of which a third are complements, contig places on the forward strand."""
    found = strong_bands(spark, sf_dir, strands=True)
    return forward(found, reads(spark, sf_dir)).select(*_STRAND, "seeds", "covered", *_BOX)


def strand_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of each read that covers most, on whichever strand; ties to the lesser contig, the forward strand, the lesser band."""
    order = Window.partitionBy("aread").orderBy(F.desc("covered"), "bread", "comp", "band")
    return strand_candidates(spark, sf_dir).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def sort_alignments_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a pair's and strand's candidates: from the last to the first in the read, and in the contig's own direction, which on its complement is from
    the least end up."""
    found = strand_candidates(spark, sf_dir)
    along = F.when(F.col("comp"), F.col("bepos")).otherwise(-F.col("bbpos"))
    order = Window.partitionBy("aread", "bread", "comp").orderBy(F.desc("abpos"), along, "band")
    return found.select(*_STRAND, F.row_number().over(order).cast("long").alias("place"))


def strand_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chosen_of() both strands, contig places on the forward strand."""
    columns = ["aread", "bread", "comp", *_BOX, "chain", "place", "zone", "score", "best"]
    return forward(chosen_of(spark, sf_dir, strands=True), reads(spark, sf_dir)).select(*columns)


def strand_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen alignments of both strands, judged per strand: how many, those with more differences than their identity allows, and those that leave their
    sequences. Differences are taken anew, from the places on the forward strand."""
    table = stranded(reads(spark, sf_dir)).select("read_id", "seq", "rlen")
    found = strand_chosen(spark, sf_dir)
    x, y = (table.select(F.col("read_id").alias(k), F.col("seq").alias(v), F.col("rlen").alias(f"{v}len")) for k, v in (("aread", "x"), ("bread", "y")))
    part = lambda s, p, q: F.substring(F.col(s), (F.col(p) + 1).cast("int"), (F.col(q) - F.col(p)).cast("int"))
    other = part("y", "bbpos", "bepos")
    # each cut before the next join
    cut = found.join(x, "aread").select("aread", "bread", "comp", *_BOX, "xlen", part("x", "abpos", "aepos").alias("x")).join(y, "bread")
    edits = F.levenshtein("x", F.when(F.col("comp"), reverse_complement(other)).otherwise(other))
    cut = cut.select("aread", "abpos", "aepos", "comp", edits.alias("edits"), ((F.col("aepos") > F.col("xlen")) | (F.col("bepos") > F.col("ylen")) | (F.col("abpos") < 0) | (F.col("bbpos") < 0)).alias("out"))
    return cut.groupBy("comp").agg(F.count("*").alias("n"), F.count_if(F.col("edits") > (1 - IDENTITY + 0.1) * (F.col("aepos") - F.col("abpos"))).alias("poor"), F.count_if("out").alias("out"))


_CODES = f"k2 as ({kmers_sql('', 'reads', 'read_id', K)[5:-1]}), low as (select code from k2 group by code having count(*) filter (read_id % 2 = 1) * count(*) filter (read_id % 2 = 0) < {MOST_CAP}), kr as (select k2.* from k2 semi join low using (code))"
_SEEDS = f"with {READS_SQL}, {_CODES}, s as (select a.read_id as aread, b.read_id as bread, a.rpos + 1 as apos, b.rpos + 1 as bpos, a.rpos - b.rpos as diag from kr a join kr b using (code) where a.read_id % 2 = 1 and b.read_id % 2 = 0)"
_BOXES = (
    f"{_SEEDS}, g as (select *, cast(floor(diag / {BAND}) as bigint) as band from s), h as (select *, least(coalesce(apos - lag(apos) over (partition by aread, bread, band order by apos, bpos), {K}), {K}) as gain from g), "
    f"o as (select aread, bread, band, min(apos) - {K} as abpos, max(apos) as aepos, min(bpos) - {K} as bbpos, max(bpos) as bepos from h group by aread, bread, band having sum(gain) >= {LEAST_KMERS * K})"
)
_SEGS = (
    f"{_BOXES}, c1 as (select o.*, x.seq as x, y.seq as y, unnest(range(abpos // {SPACE}, (aepos - 1) // {SPACE} + 1)) as i from o join reads x on x.read_id = aread join reads y on y.read_id = bread), "
    f"c2 as (select *, greatest(abpos, i * {SPACE}) as a0, least(aepos, (i + 1) * {SPACE}) as a1 from c1), c3 as (select *, bbpos + (a0 - abpos) * (bepos - bbpos) // (aepos - abpos) as b0, bbpos + (a1 - abpos) * (bepos - bbpos) // (aepos - abpos) as b1 from c2), "
    "seg as (select aread, bread, band, abpos, aepos, bbpos, bepos, i, a0, a1, b0, b1, substring(x, a0 + 1, a1 - a0) as a, substring(y, b0 + 1, b1 - b0) as b from c3)"
)
_OVL = f"{_SEGS}, e as (select *, levenshtein(a, b) as d from seg), r as (select aread, bread, band, abpos, aepos, bbpos, bepos, cast(sum(d) as bigint) as diffs, string_agg(d || ':' || (b1 - b0), ',' order by i) as trace from e group by all)"
_SCORE = f"sc as (select *, cast(trunc((aepos - abpos) - cast({DIFF} as double) * diffs) as bigint) as score from r)"
_FACTOR = "case bias " + " ".join(f"when {k} then {x}::double" for k, x in enumerate(BIAS)) + " else 1.0::double end"

_SK = (
    f"kb as (select *, false as comp from ({kmers_sql('', 'sreads', 'read_id', K)[5:-1]}) where read_id % 2 = 0 union all select *, true from ({kmers_sql('', 'sreads', 'read_id', K, RC_SQL)[5:-1]}) where read_id % 2 = 0), ka as (select * from ({kmers_sql('', 'sreads', 'read_id', K)[5:-1]}) where read_id % 2 = 1)"
)
_STRANDS = (
    f"with {READS_SQL}, {STRANDED_SQL}, {_SK}, low as (select code from (select code, count(*) as na from ka group by code) join (select code, count(*) as nb from kb group by code) using (code) where na * nb < {MOST_CAP}), "
    f"s as (select ka.read_id as aread, kb.read_id as bread, comp, ka.rpos + 1 as apos, kb.rpos + 1 as bpos, cast(floor((ka.rpos - kb.rpos) / {BAND}) as bigint) as band from ka join kb using (code) semi join low using (code)), "
    f"h as (select *, least(coalesce(apos - lag(apos) over (partition by aread, bread, comp, band order by apos, bpos), {K}), {K}) as gain from s), "
    f"o as (select aread, bread, comp, band, count(*) as seeds, cast(sum(gain) as bigint) as covered, min(apos) - {K} as abpos, max(apos) as aepos, min(bpos) - {K} as b0, max(bpos) as b1 from h group by aread, bread, comp, band having sum(gain) >= {LEAST_KMERS * K}), "
    "f as (select aread, bread, comp, band, seeds, covered, abpos, aepos, case when comp then length(seq) - b1 else b0 end as bbpos, case when comp then length(seq) - b0 else b1 end as bepos from o join reads on read_id = bread)"
)

_BOXED = f"{_BOXES}, w as (select aread, bread, band, abpos, bbpos, substring(x.seq, abpos + 1, aepos - abpos) as a, substring(y.seq, bbpos + 1, bepos - bbpos) as b from o join reads x on x.read_id = aread join reads y on y.read_id = bread)"
_MIDS = (
    f"{_SEGS}, m as (select *, length(a) // 2 as h, unnest(range(0, length(b) + 1)) as c from seg), m1 as (select * from m qualify row_number() over (partition by aread, bread, band, i order by levenshtein(substring(a, 1, h), substring(b, 1, c)) + levenshtein(substring(a, h + 1), substring(b, c + 1)), c) = 1), "
    "m2 as (select *, coalesce(lag(substring(a, h + 1)) over p, '') || substring(a, 1, h) as pa, coalesce(lag(substring(b, c + 1)) over p, '') || substring(b, 1, c) as pb, lead(i) over p is null as final from m1 window p as (partition by aread, bread, band order by i)), "
    "pc as (select aread, bread, band, pa, pb, b0 + c as mid from m2 union all select aread, bread, band, substring(a, h + 1), substring(b, c + 1), 0 from m2 where final)"
)

QUERIES = {
    "mid_traces": (mid_traces, f"{_MIDS} select aread, bread, band, cast(sum(levenshtein(pa, pb)) as bigint) as diffs, cast(sum(length(pb) - length(pa)) as bigint) as shift, cast(sum(mid) as bigint) as middles from pc group by aread, bread, band"),
    "linear_alignments": (linear_alignments, f"{_BOXED} select aread, bread, band, levenshtein(a, b) as diffs, length(b) - length(a) as shift, (abpos + length(a) - 1) // {SPACE} - abpos // {SPACE} + 1 as points, length(b) as bases from w"),
    "gap_improved": (gap_improved, f"{_BOXED} select aread, bread, band, levenshtein(a, b) as diffs, length(b) - length(a) as shift, false as rose, false as changed, false as broken from w"),
    "strand_candidates": (strand_candidates, f"{_STRANDS} select * from f"),
    "strand_best": (strand_best, f"{_STRANDS} select * from f qualify row_number() over (partition by aread order by covered desc, bread, comp, band) = 1"),
    "sort_alignments_rc": (sort_alignments_rc, f"{_STRANDS} select aread, bread, comp, band, row_number() over (partition by aread, bread, comp order by abpos desc, case when comp then bepos else -bbpos end, band) as place from f"),
    "strand_chosen": (strand_chosen, None),
    "strand_checked": (strand_checked, None),
    "overlaps": (overlaps, f"{_OVL} select * from r"),
    "las_roundtrip": (las_roundtrip, f"{_OVL} select * from r"),
    "overlap_files": (overlap_files, f"{_OVL} select *, false as comp from r"),
    "check_trace_points": (check_trace_points, f"{_SEGS}, t as (select aread, bread, band, 2 * count(*) as n, ((aepos - 1) // {SPACE} - abpos // {SPACE}) * 2 + 2 as want, cast(sum(b1 - b0) as bigint) as bsum, bepos - bbpos as bases from seg group by aread, bread, band, abpos, aepos, bbpos, bepos) select *, n = want and bsum = bases as \"right\" from t"),
    "compress_trace": (compress_trace, f"{_SEGS}, e as (select *, levenshtein(a, b) as d from seg), t as (select aread, bread, band, max(greatest(d, b1 - b0)) < 256 as fits, string_agg(printf('%02X%02X', d, b1 - b0), '' order by i) as packed from e group by aread, bread, band) select aread, bread, band, fits, case when fits then packed end as packed from t"),
    "print_overlap": (print_overlap, f"{_SEGS}, e as (select *, levenshtein(a, b) as d from seg), t as (select aread, bread, band, abpos, aepos, bbpos, bepos, sum(d)::bigint as diffs, string_agg(d || '@' || b1, ' ' order by i) as points from e group by aread, bread, band, abpos, aepos, bbpos, bepos) select aread, bread, band, printf('%d vs. %d [%d,%d] x [%d,%d] : <%d diffs>', aread, bread, abpos, aepos, bbpos, bepos, diffs) as line, points from t"),
    "flip_overlaps": (flip_overlaps, f"{_OVL} select bread as aread, aread as bread, band, bbpos as abpos, bepos as aepos, abpos as bbpos, aepos as bepos, diffs from r"),
    "score_nonneg": (score_nonneg, f"{_OVL}, {_SCORE} select aread, bread, band, score from sc where score >= 0"),
    "sort_alignments": (sort_alignments, f"{_BOXES} select aread, bread, band, row_number() over (partition by aread, bread order by abpos desc, bbpos desc, band) as place from o"),
    "sort_chains": (sort_chains, f"{_OVL}, {_SCORE} select aread, bread, band, score, row_number() over (partition by aread order by score desc, abpos, bread, bbpos, band) as place from sc"),
    "entwine": (entwine, f"{_SEGS}, n as (select * from seg where i > abpos // {SPACE}) select x.aread, x.bread, x.band, y.band as band2, min(abs(x.b0 - y.b0)) as apart, count(*) as points, coalesce(max(case when x.b0 = y.b0 then x.a0 end), -1) as meet from n x join n y on x.aread = y.aread and x.bread = y.bread and x.a0 = y.a0 and x.band < y.band group by all"),
    "zone_overlap_pairs": (zone_overlap_pairs, f"{_BOXES} select x.aread, count(*) as pairs from o x join o y on x.aread = y.aread and (x.bread < y.bread or (x.bread = y.bread and x.band < y.band)) and x.abpos < y.aepos - {ZONE} and x.aepos > y.abpos + {ZONE} group by x.aread"),
    "align_spec": (spec, f"with {READS_SQL}, p as (select sum(length(seq) - length(translate(seq, 'AT', ''))) / sum(length(seq)) as p from reads), q as (select least(p, 1 - p) as p from p), w as (select cast(case when p < 0.2 then 3 else floor((p + 0.025) * 20 - 1) end as bigint) as bias from q), f as (select bias, {_FACTOR} * {round(1 - IDENTITY, 9)}::double as f from w) select bias, cast(floor(60 * (1 - f) + 1e-9) as bigint) as ave_path, cast(floor(1000 * f + 1e-9) as bigint) as mscore, 1000 - cast(floor(1000 * f + 1e-9) as bigint) as dscore from f"),
    "seed_statistics": (seed_statistics, f"with {READS_SQL}, k2 as ({kmers_sql('', 'reads', 'read_id', K)[5:-1]}), c as (select code, count(*) as n, count(*) filter (read_id % 2 = 1) as na from k2 group by code) select cast(sum(n) as bigint) as kmers, cast(sum(n) filter (n < {MOST_KMERS}) as bigint) as revised, count(*) filter (n < {MOST_KMERS}) as codes, cast(sum(na * (n - na)) filter (n < {MOST_KMERS}) as bigint) as hits from c"),
    "trace_scripts": (trace_scripts, f"{_SEGS} select aread, bread, band, cast(sum(levenshtein(a, b)) as bigint) as diffs, cast(sum(length(b) - length(a)) as bigint) as shift from seg group by aread, bread, band"),
    "irregular_scripts": (irregular_scripts, f"{_SEGS}, w as (select aread, bread, band, i // 2 as h, string_agg(a, '' order by i) as a, string_agg(b, '' order by i) as b from seg group by aread, bread, band, i // 2) select aread, bread, band, cast(sum(levenshtein(a, b)) as bigint) as diffs, cast(sum(length(a)) as bigint) as asteps from w group by aread, bread, band"),
    "render_alignments": (render_alignments, f"{_SEGS} select aread, bread, band, i, levenshtein(a, b) as marked, a as first, b as second from seg"),
    "local_alignments": (local_alignments, None),
    "pebbled_alignments": (pebbled_alignments, None),
    "extensions": (extensions, None),
    "chosen_overlaps": (chosen_overlaps, None),
    "nonredundant": (nonredundant, None),
}

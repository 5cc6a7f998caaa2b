"""Candidates of reads while contigs arrive: a stream of contig files, and per read a state of what has been found so far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from readloom.operators.seeds import _SIG, BAND, LEAST, NEAR, SEED_K, SPACING, allowed_hits
from readloom.sources.scratch import scratch_path, stored
from readloom.sources.tables import BROADCAST_KMERS, as_side, contigs, kmers

#: Files that a registered query deals the contigs to, one a micro-batch, and where the state store is set.
FILES, STORE = 4, "spark.sql.streaming.stateStore.providerClass"
#: Low bits of a read's id that are left out in the key of a state.
GROUP = 6
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTIG = "contig_id long, seq string, clen int"
OUT = "aread long, version long, bread long, band long, covered long, near long, candidates long, significant long, deepest long"


def bands_of(seeds: pd.DataFrame) -> pd.DataFrame:
    """bread, band, covered, afirst, alast of one read's seeds (bread, apos, bpos), as band_candidates() has them: windows don't run on streams. Of seeds with an
    aread, aread too, of each read."""
    names = ["aread", "bread"] if "aread" in seeds else ["bread"]
    a, at = (seeds[c].to_numpy(np.int64) for c in ("apos", "bpos"))
    by = [seeds[c].to_numpy(np.int64) for c in names] + [(a - at) // BAND]
    order = np.lexsort((at, a, *by[::-1]))
    by, a = [c[order] for c in by], a[order]
    new = np.r_[True, np.any([np.diff(c) != 0 for c in by], axis=0)]
    gain = np.where(new, SEED_K, np.minimum(np.diff(a, prepend=a[:1]), SEED_K))
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(a)] - 1
    told = dict(zip([*names, "band"], (c[starts] for c in by), strict=True))
    return pd.DataFrame(told | {"covered": np.add.reduceat(gain, starts), "afirst": a[starts] - SEED_K, "alast": a[ends]})


def summed(held: bytes, reads: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Three rows, reads and keys in order and their numbers, of what is held after more are added; a number of zero goes."""
    reads, keys, n = np.c_[np.frombuffer(held, np.int64).reshape(3, -1), np.stack([reads, keys, n])]
    order = np.lexsort((keys, reads))
    reads, keys, n = reads[order], keys[order], n[order]
    at = np.flatnonzero(np.r_[len(n) > 0, (np.diff(reads) != 0) | (np.diff(keys) != 0)][: len(n)])
    told = np.stack([reads[at], keys[at], np.add.reduceat(n, at) if len(at) else n])
    return told[:, told[2] != 0]


class ReadState(StatefulProcessor):
    """Of the reads of a group: the best candidate with the counts so far, how many candidates cover what (those that are near the best or may still be), and where
    the profile rises and falls. None grows with the contigs seen: coverages are at most a read's length, steps at most one for SPACING bases. Up to 2**GROUP reads
    of neighbouring ids are one state, read and written once a micro-batch, as each state asks for its own messages and batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "best binary, near binary, steps binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = bands_of(pd.concat(list(rows), ignore_index=True))  # a contig's seeds are all in one micro-batch
        read, bread, band, covered, afirst, alast = (found[c].to_numpy(np.int64) for c in ("aread", "bread", "band", "covered", "afirst", "alast"))
        held, near, steps = self.state.get() or (b"", b"", b"")
        strong = covered >= LEAST * SEED_K
        reads, at = np.unique(read, return_inverse=True)  # those that this micro-batch touches
        order = np.lexsort((band, bread, -covered, read))
        best = order[np.searchsorted(read[order], reads)]
        new = np.stack([reads, bread[best], band[best], covered[best], np.bincount(at), np.bincount(at, strong).astype(np.int64), np.ones(len(reads), np.int64)])
        old = np.frombuffer(held, np.int64).reshape(7, -1)
        both = np.c_[old, new]
        both = both[:, np.lexsort((both[2], both[1], -both[3], both[0]))]  # of a read's two, the better one first
        first = np.flatnonzero(np.diff(both[0], prepend=both[0][:1] - 1))
        told = both[:, first]
        told[4:] = np.add.reduceat(both[4:], first, axis=1)
        near = summed(near, read, covered, np.ones(len(read), np.int64))
        near = near[:, near[1] >= NEAR * told[3][np.searchsorted(told[0], near[0])]]  # the best only rises
        rises, falls = afirst[strong] // SPACING, (alast[strong] - 1) // SPACING + 1
        steps = summed(steps, np.r_[read[strong], read[strong]], np.r_[rises, falls], np.repeat([1, -1], len(rises)))
        self.state.update((told.tobytes(), near.tobytes(), steps.tobytes()))
        deepest = np.zeros(told.shape[1], np.int64)  # the steps of a read add up to zero
        np.maximum.at(deepest, np.searchsorted(told[0], steps[0]), np.cumsum(steps[2]))
        count = np.bincount(np.searchsorted(told[0], near[0]), near[2], told.shape[1]).astype(np.int64)
        now = np.searchsorted(told[0], reads)
        aread, bread, band, covered, candidates, significant, version = told[:, now]
        yield pd.DataFrame(dict(zip((c.split()[0] for c in OUT.split(", ")), (aread, version, bread, band, covered, count[now], candidates, significant, deepest[now]), strict=True)))

    def close(self) -> None:
        pass


class CandidateStream:
    """Reads against a folder to which files of contigs (CONTIG) are added. advance() takes what is new since the last call, one micro-batch for each so many
    files; state and progress are in the stream's own folder, so that a new session goes on where the last one ended. latest() is the result so far, the same
    however the contigs were split over files, micro-batches and calls.

    index: aread, apos, code, the reads' k-mers that may make seeds; it is joined with each micro-batch, which is broadcast if `broadcast` says that its k-mers are
    few (BROADCAST_KMERS), else the join shuffles."""

    def __init__(self, index: DataFrame, incoming: str, folder: str, files: int = 1, broadcast: bool = False):
        self.spark, self.index, self.incoming, self.folder, self.files, self.broadcast = index.sparkSession, index, incoming, folder, files, broadcast

    def advance(self) -> None:
        coming = self.spark.readStream.schema(CONTIG).option("maxFilesPerTrigger", self.files).parquet(self.incoming)
        side = kmers(coming, "contig_id", SEED_K).select(F.col("contig_id").alias("bread"), (F.col("rpos") + 1).alias("bpos"), "code")
        seeds = (F.broadcast(side) if self.broadcast else side.hint("merge")).join(self.index, "code").select("aread", "bread", "apos", "bpos")
        grouped = seeds.withColumn("group", F.shiftright("aread", GROUP)).groupBy("group")
        states = grouped.transformWithStateInPandas(statefulProcessor=ReadState(), outputStructType=OUT, outputMode="Append", timeMode="None")
        before = self.spark.conf.get(STORE)
        self.spark.conf.set(STORE, ROCKS)
        try:
            started = states.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start(f"{self.folder}/states")
            started.awaitTermination()
        finally:
            self.spark.conf.set(STORE, before)

    def latest(self) -> DataFrame:
        """Each read's last state; reads that share no k-mer with a contig have none."""
        names = [c.split()[0] for c in OUT.split(", ")][1:]
        states = self.spark.read.schema(OUT).parquet(f"{self.folder}/states")
        last = states.groupBy("aread").agg(F.max_by(F.struct(*names), "version").alias("s"))
        return last.select("aread", *[f"s.{c}" for c in names if c != "version"])


def read_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads' k-mers whose codes are in contigs and under the product cap, stored. They meet the contigs' counts where they are made, and are counted from what
    is left, so that no k-mer is shuffled that makes no seed, unless the contigs are too many to broadcast."""
    hits, allowed = allowed_hits(spark, sf_dir)
    return stored(hits.join(as_side(allowed, contigs(spark, sf_dir), SEED_K), "code").select("aread", "apos", "code"))


def streamed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read: its best candidate, how many are near it, all and significant ones, and the greatest depth of its profile, from contigs that come in FILES files."""
    table = contigs(spark, sf_dir).select("contig_id", "seq", "clen")
    n = table.agg(F.coalesce(F.sum("clen"), F.lit(0)).alias("n")).first()["n"]
    incoming = scratch_path(spark)
    table.repartition(FILES, "contig_id").write.parquet(incoming)
    stream = CandidateStream(read_index(spark, sf_dir), incoming, scratch_path(spark), broadcast=n <= BROADCAST_KMERS)
    stream.advance()
    return stream.latest()


_DEPTH = (
    f"e as (select aread, afirst // {SPACING} as bin, 1 as s from f union all select aread, (alast - 1) // {SPACING} + 1, -1 from f), st as (select aread, bin, sum(s) as s from e group by aread, bin), "
    "dp as (select aread, max(depth) as deepest from (select aread, sum(s) over (partition by aread order by bin) as depth from st) group by aread)"
)
_SUMS = f"b as (select aread, bread, band, covered from c qualify row_number() over (partition by aread order by covered desc, bread, band) = 1), n as (select c.aread, count(*) filter (c.covered >= {NEAR} * b.covered) as near, count(*) as candidates, count(*) filter (c.covered >= {LEAST * SEED_K}) as significant from c join b using (aread) group by c.aread)"

QUERIES = {"streamed_candidates": (streamed_candidates, f"{_SIG}, {_DEPTH}, {_SUMS} select b.*, near, candidates, significant, cast(coalesce(deepest, 0) as bigint) as deepest from b join n using (aread) left join dp using (aread)")}

"""Chains of seeds per read and contig: the sequential rule as a grouped map, and what is kept of its candidates."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.seeds import LEAST, SEED_K, seeds_of
from readloom.sources.tables import reads, stranded

#: Bases within which a seed looks back, k-mers that a chain covers at least, share of a step that the diagonal may move when it replaces its predecessor.
LOOK_BACK, LEAST_KMERS, DRIFT = 1000, LEAST, 0.2
SCHEMA = "aread long, bread long, score long, afirst long, alast long, bfirst long, blast long"


def chain(seeds: list[tuple[int, int]], k: int = SEED_K, least: int = LEAST_KMERS * SEED_K) -> list[tuple[int, int, int, int, int]]:
    """Chains (score, afirst, alast, bfirst, blast) of seeds (apos, bpos) in order of apos.

    A seed joins the active seed on the nearest larger diagonal whose bpos isn't more than LOOK_BACK behind (gaining min(k, step in a)), or on the
    nearest smaller or equal diagonal whose bpos isn't ahead (gaining min(k, step in b)), whichever scores more, the second on a tie; with neither
    it starts a chain of score k. Each start gives one chain, to the seed at which it scored highest, the last of equals.
    """
    active: list[tuple[int, int, int, int, int]] = []  # diagonal, order, apos, score, start
    best: dict[int, tuple[int, int]] = {}
    for at, (a, b) in enumerate(seeds):
        active = [x for x in active if x[2] >= a - LOOK_BACK]
        diag = a - b
        found = None
        for x in active[bisect_right(active, (diag, 1 << 60)) :]:
            if x[2] - x[0] >= b - LOOK_BACK:
                same = [y for y in active if y[0] == x[0] and y[2] - y[0] >= b - LOOK_BACK]
                found = (same[-1][3] + min(k, a - same[-1][2]), same[-1])
                break
        for x in reversed(active[: bisect_right(active, (diag, 1 << 60))]):
            if x[2] - x[0] <= b:
                score = x[3] + min(k, b - (x[2] - x[0]))
                if found is None or score >= found[0]:
                    found = (score, x)
                break
        score, start = (k, at) if found is None else (found[0], found[1][4])
        if start not in best or score >= best[start][0]:
            best[start] = (score, at)
            if found is not None and abs(diag - found[1][0]) <= DRIFT * (a - found[1][2]):
                del active[bisect_left(active, found[1])]
        insort(active, (diag, at, a, score, start))
    out = []
    for start, (score, end) in best.items():
        if score >= least:
            (a0, b0), (a1, b1) = seeds[start], seeds[end]
            out.append((score, a0 - k, a1, b0 - k, b1))
    return sorted(out, key=lambda x: (-x[0], *x[1:]))


def chains_of(seeds: DataFrame) -> DataFrame:
    """Candidates of every read and contig. Pairs with a single seed can't reach the least score and are dropped before the grouped map."""
    several = seeds.groupBy("aread", "bread").agg(F.count("*").alias("_n")).where("_n > 1").select("aread", "bread")
    pairs = seeds.join(several, ["aread", "bread"], "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(columns=["aread", "bread", "apos", "bpos"])
        for batch in [*batches, None]:
            rows = held if batch is None else pd.concat([held, batch]) if len(held) else batch
            if not len(rows):
                continue
            last = (rows["aread"].iloc[-1], rows["bread"].iloc[-1])
            done = rows if batch is None else rows[(rows["aread"] != last[0]) | (rows["bread"] != last[1])]
            held = rows.iloc[:0] if batch is None else rows[(rows["aread"] == last[0]) & (rows["bread"] == last[1])]
            out = [(a, b, *c) for (a, b), g in done.groupby(["aread", "bread"], sort=False) for c in chain(list(zip(g["apos"].tolist(), g["bpos"].tolist(), strict=True)))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    ordered = pairs.select("aread", "bread", "apos", "bpos").repartition("aread", "bread").sortWithinPartitions("aread", "bread", "apos", "bpos")
    return ordered.mapInPandas(run, SCHEMA)


def chain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of all seeds, however many a code makes."""
    return chains_of(seeds_of(spark, sf_dir))


def chain_candidates_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on complemented contigs, for reads of which a third are complements."""
    return chains_of(seeds_of(spark, sf_dir, comp=True, table=stranded(reads(spark, sf_dir))))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose box is out of order or whose score exceeds what it covers, by kind: a chain never has any."""
    found = chain_candidates(spark, sf_dir)
    spans = F.greatest(F.col("alast") - F.col("afirst"), F.col("blast") - F.col("bfirst"))
    return found.agg(F.count("*").alias("n"), F.count_if((F.col("alast") <= F.col("afirst")) | (F.col("blast") <= F.col("bfirst"))).alias("inverted"), F.count_if(F.col("score") > spans).alias("overscored"))


QUERIES = {"chain_candidates": (chain_candidates, None), "chain_candidates_rc": (chain_candidates_rc, None), "chain_validated": (validated, None)}

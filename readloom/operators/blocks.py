"""Seeds of blocks of reads against blocks of contigs: frequent k-mers judged within each block and side, and a run's own counts taken while it runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from readloom.operators.reads import BLOCK_BASES, running
from readloom.operators.seeds import BAND, LEAST, SEED_K, band_candidates
from readloom.sources.scratch import stored
from readloom.sources.tables import BATCH, CONTIGS_SQL, READS_SQL, as_side, codes_in_parts, contigs, kmers, kmers_sql, reads

#: K-mers of a block at which a code is dropped from it in the registered queries.
MOST = 8
#: Setting of the rules that adaptive execution leaves out, and the one that prunes what has turned out to be empty.
EXCLUDED, EMPTY = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def blocked(table: DataFrame, key: str, bases: int = BLOCK_BASES) -> DataFrame:
    """key, block, seq: a sequence is of the block in which it starts when all lie one after the other by key."""
    placed = running(table.select(key, "seq", F.length("seq").alias("_len")), key, "_len", "_upto")
    return placed.select(key, (F.floor((F.col("_upto") - F.col("_len")) / bases).cast("long") + 1).alias("block"), "seq")


class Counted:
    """Counts that Spark takes while a run's rows go by (Observation): no second pass. A count is known after the first action that has read its rows."""

    def __init__(self):
        self.taken: list[Observation] = []

    def of(self, df: DataFrame, **counts) -> DataFrame:
        self.taken.append(Observation())
        return df.observe(self.taken[-1], *[c.cast("long").alias(name) for name, c in counts.items()])

    def values(self) -> dict[str, int]:
        return {name: value or 0 for o in self.taken for name, value in o.get.items()}


def side(table: DataFrame, key: str, k: int, most: int | None, counted: Counted, name: str) -> DataFrame:
    """(key, block), rpos, code of the k-mers of a side, those left out that occur `most` times or more in their block of this side (None: none are).

    Blocks are of bounded size: the sequences of one meet in a task, which counts their k-mers, so that bases are shuffled and k-mers are not. A code that is dropped is
    never joined with the other side. What is frequent in one block stays in others, so that the answer depends on how the sequences are dealt to blocks:
    that is what the filter means, and why it is off unless asked for."""
    whole = blocked(table, key).select(F.struct(key, "block").alias("id"), "seq")
    size = F.coalesce(F.length("seq"), F.lit(0))
    whole = counted.of(whole, **{f"{name}_bases": F.sum(size), f"{name}_kmers": F.sum(F.greatest(size - (k - 1), F.lit(0)))})
    each = kmers(whole, "id", k) if most is None else few_in_blocks(whole, k, most)
    return counted.of(each.select(F.col(f"id.{key}").alias(key), F.col("id.block").alias(f"{name}block"), "rpos", "code"), **{f"{name}_kept": F.count(F.lit(1))})


def few_in_blocks(whole: DataFrame, k: int, most: int) -> DataFrame:
    """id, rpos, code of the k-mers of whole (id with block, seq) whose code occurs less than `most` times in their block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            blocks = np.array(batch.column(0).field("block").to_pylist(), object)
            cut = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for p, q in zip(cut[:-1], cut[1:], strict=True):
                if held and blocks[p] != now:
                    yield from few(pa.Table.from_batches(held))
                    held = []
                if q > p:
                    now = blocks[p]
                    held.append(batch.slice(p, q - p))
        if held:
            yield from few(pa.Table.from_batches(held))

    def few(block: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, seq = (c.combine_chunks() for c in block.columns)
        row, place, code = (np.concatenate(c) for c in zip(*codes_in_parts(seq, k), strict=True))
        _, which, n = np.unique(code, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(n[which] < most)
        for at in range(0, len(kept), BATCH):
            some = kept[at : at + BATCH]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[some])), pa.array((place[some] + k - 1).astype(np.int32)), pa.array(code[some])], ["id", "rpos", "code"])

    dealt = whole.where(F.length("seq") >= k).repartition("id.block").sortWithinPartitions("id.block")
    return dealt.mapInArrow(of, StructType([whole.schema["id"], StructField("rpos", IntegerType()), StructField("code", LongType())]))


def block_seeds(spark: SparkSession, sf_dir: str, most: int | None, counted: Counted) -> DataFrame:
    """aread, ablock, bread, bblock, apos, bpos, diag. The reads' k-mers meet the contigs' where they are made, unless the contigs are too many to broadcast."""
    table = contigs(spark, sf_dir)
    a = side(reads(spark, sf_dir), "read_id", SEED_K, most, counted, "a").select(F.col("read_id").alias("aread"), "ablock", (F.col("rpos") + 1).alias("apos"), "code")
    b = side(table, "contig_id", SEED_K, most, counted, "b").select(F.col("contig_id").alias("bread"), "bblock", (F.col("rpos") + 1).alias("bpos"), "code")
    seeds = a.join(as_side(stored(b), table, SEED_K), "code").select("aread", "ablock", "bread", "bblock", "apos", "bpos", (F.col("apos") - F.col("bpos")).alias("diag"))
    return counted.of(seeds, seeds=F.count(F.lit(1)))


def block_filtered_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of each pair of blocks after the filter."""
    return block_seeds(spark, sf_dir, MOST, Counted()).groupBy("ablock", "bblock").agg(F.count("*").alias("seeds"), F.countDistinct("aread", "bread").alias("pairs"))


def observed_candidates(spark: SparkSession, sf_dir: str, most: int | None = MOST) -> tuple[DataFrame, dict[str, int]]:
    """The candidates, stored, and what the run counted: bases, k-mers and k-mers kept of either side (a, b), seeds, candidates, significant ones.

    A stage that is run again after a lost executor may count twice; results are not touched by that. While the run lasts, adaptive execution keeps plans of
    empty tables as they are: it would leave their counters out."""
    counted, rules = Counted(), spark.conf.get(EXCLUDED, "")
    spark.conf.set(EXCLUDED, f"{rules},{EMPTY}" if rules else EMPTY)
    try:
        found = band_candidates(block_seeds(spark, sf_dir, most, counted))
        found = stored(counted.of(found, candidates=F.count(F.lit(1)), significant=F.count_if(F.col("covered") >= LEAST * SEED_K)))
        return found, counted.values()
    finally:
        spark.conf.set(EXCLUDED, rules) if rules else spark.conf.unset(EXCLUDED)


def mapping_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the counts of a run, and seeds for a million pairs of bases."""
    _, n = observed_candidates(spark, sf_dir)
    density = 1e6 * n["seeds"] / max(n["a_bases"], 1) / max(n["b_bases"], 1)
    names = sorted(n)
    return spark.createDataFrame([(*[n[c] for c in names], density)], ", ".join(f"{c} long" for c in names) + ", density double")


def _side_sql(name: str, table: str, key: str) -> str:
    return (
        f"{name}p as (select {key}, length(seq) as len, sum(length(seq)) over (order by {key}) as upto from {table}), {name}k as (select * from ({kmers_sql('', table, key, SEED_K)[5:-1]}) join (select {key}, cast((upto - len) // {BLOCK_BASES} + 1 as bigint) as {name}block from {name}p) using ({key})), "
        f"{name}f as (select {name}block, code from {name}k group by all having count(*) < {MOST}), {name}kept as (select * from {name}k semi join {name}f using ({name}block, code))"
    )


_SQL = (
    f"with {READS_SQL}, {CONTIGS_SQL}, {_side_sql('a', 'reads', 'read_id')}, {_side_sql('b', 'contigs', 'contig_id')}, "
    "s as (select read_id as aread, ablock, contig_id as bread, bblock, a.rpos + 1 as apos, b.rpos + 1 as bpos, a.rpos - b.rpos as diag from akept a join bkept b using (code))"
)
_CANDIDATES = (
    f"g as (select *, cast(floor(diag / {BAND}) as bigint) as band from s), h as (select *, least(coalesce(apos - lag(apos) over (partition by aread, bread, band order by apos, bpos), {SEED_K}), {SEED_K}) as gain from g), "
    "c as (select aread, bread, band, sum(gain) as covered from h group by all)"
)
_TOTALS = {
    "a_bases": "select sum(length(seq)) from reads", "b_bases": "select sum(length(seq)) from contigs", "a_kmers": "select count(*) from ak", "b_kmers": "select count(*) from bk",
    "a_kept": "select count(*) from akept", "b_kept": "select count(*) from bkept", "seeds": "select count(*) from s", "candidates": "select count(*) from c",
    "significant": f"select count(*) from c where covered >= {LEAST * SEED_K}",
}

QUERIES = {
    "block_filtered_seeds": (block_filtered_seeds, f"{_SQL} select ablock, bblock, count(*) as seeds, count(distinct (aread, bread)) as pairs from s group by all"),
    "mapping_statistics": (mapping_statistics, f"{_SQL}, {_CANDIDATES}, t as (select {', '.join(f'cast(({q}) as bigint) as {n}' for n, q in _TOTALS.items())}) select *, 1e6::double * seeds / a_bases / b_bases as density from t"),
}

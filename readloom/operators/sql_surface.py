"""The engine from SQL: functions on bases that Spark inlines, table functions for what SQL has no operator for, views of reads and contigs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf

from readloom.operators import chains, dominance, seeds
from readloom.operators.seeds import BAND, LEAST, SEED_K
from readloom.sources.tables import codes_in_parts, contigs, reads

#: Functions of one expression: name and parameters, type, expression.
EXPRESSIONS = {
    "to_bases(text string)": ("string", "regexp_replace(translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '')"),
    "reverse_complement(seq string)": ("string", "reverse(translate(seq, 'ACGT', 'TGCA'))"),
    "diagonal_band(apos bigint, bpos bigint)": ("bigint", f"floor((apos - bpos) / {BAND})"),
}


@arrow_udtf(returnType="id long, rpos long, code long")
class KmersOf:
    """kmers(table(id, seq), k): every k-mer (k up to 31) of every sequence, by its last base and its two-bit code. Rows need no partitioning."""

    def eval(self, table: pa.RecordBatch, k: pa.Array) -> Iterator[pa.Table]:
        if not table.num_rows:
            return
        size = k[0].as_py()
        seq = table.column("seq")
        whole = table.filter(pc.fill_null(pc.greater_equal(pc.binary_length(seq), size), False))
        if not whole.num_rows:
            return
        ids = whole.column("id").cast(pa.int64())
        for row, place, code in codes_in_parts(whole.column("seq"), size):
            yield pa.table({"id": ids.take(pa.array(row)), "rpos": pa.array(place + size - 1), "code": pa.array(code)})


@arrow_udtf(returnType=chains.SCHEMA)
class SeedChains:
    """seed_chains(table(aread, bread, apos, bpos) partition by (aread, bread) order by (apos, bpos)): the chains of each read and contig."""

    def __init__(self):
        self.pair, self.seeds = None, []

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        if table.num_rows:
            self.pair = table.column("aread")[0].as_py(), table.column("bread")[0].as_py()
            self.seeds += zip(table.column("apos").to_pylist(), table.column("bpos").to_pylist(), strict=True)
        return
        yield

    def terminate(self) -> Iterator[pa.Table]:
        found = chains.chain(self.seeds)
        if found:
            columns = zip(*[(*self.pair, *c) for c in found], strict=True)
            yield pa.table({name.split()[0]: pa.array(c, pa.int64()) for name, c in zip(chains.SCHEMA.split(", "), columns, strict=True)})


@arrow_udtf(returnType="aread long, bread long, band long, covered long, afirst long, alast long")
class Undominated:
    """undominated(table(aread, bread, band, covered, afirst, alast) partition by aread order by (covered desc, afirst, alast, ..)): the candidates of each read
    that stay. Rows stream through, so that a read is never held whole."""

    def __init__(self):
        self.sweep = dominance.Sweep()

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        names = ["aread", "bread", "band", "covered", "afirst", "alast"]
        stay = [self.sweep.stays(*r) for r in zip(*(table.column(c).to_pylist() for c in names[3:]), strict=True)]
        yield pa.table({c: table.column(c).cast(pa.int64()) for c in names}).filter(pa.array(stay, pa.bool_()))


TABLE_FUNCTIONS = {"kmers": KmersOf, "seed_chains": SeedChains, "undominated": Undominated}


def register(spark: SparkSession, sf_dir: str | None = None, prefix: str = "readloom_") -> None:
    """Makes the functions known to the session's SQL, under prefix; of a sf_dir, also views {prefix}reads (read_id, seq, rlen), {prefix}contigs (contig_id,
    seq, clen) and {prefix}seeds (aread, bread, apos, bpos, diag: all of them). Registering again replaces."""
    for head, (kind, said) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {prefix}{head} returns {kind} return {said}")
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(prefix + name, function)
    if sf_dir is not None:
        reads(spark, sf_dir).createOrReplaceTempView(f"{prefix}reads")
        contigs(spark, sf_dir).createOrReplaceTempView(f"{prefix}contigs")
        seeds.seeds_of(spark, sf_dir).createOrReplaceTempView(f"{prefix}seeds")


SEED_COUNTS = f"""
select /*+ merge(a, b) */ a.id as aread, b.id as bread, count(*) as seeds
from readloom_kmers(table(select read_id as id, seq from readloom_reads), {SEED_K}) a
join readloom_kmers(table(select contig_id as id, seq from readloom_contigs), {SEED_K}) b on a.code = b.code
group by a.id, b.id
"""
CHAINS = "select * from readloom_seed_chains(table(select aread, bread, apos, bpos from readloom_seeds) partition by (aread, bread) order by (apos, bpos))"
STAYING = f"""
with banded as (select *, readloom_diagonal_band(apos, bpos) as band from readloom_seeds),
gains as (select *, least(coalesce(apos - lag(apos) over (partition by aread, bread, band order by apos, bpos), {SEED_K}), {SEED_K}) as gain from banded),
found as (
  select aread, bread, band, cast(sum(gain) as bigint) as covered, cast(min(apos) - {SEED_K} as bigint) as afirst, cast(max(apos) as bigint) as alast, min(bpos) - {SEED_K} as bfirst
  from gains group by aread, bread, band having sum(gain) >= {LEAST * SEED_K}
)
select * from readloom_undominated(table(found) partition by aread order by (covered desc, afirst, alast, bread, bfirst, band))
"""


def _said(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(text)

    return query


QUERIES = {
    "sql_seed_counts": (_said(SEED_COUNTS), seeds.QUERIES["seed_count"][1]),
    "sql_chains": (_said(CHAINS), None),
    "sql_dominance": (_said(STAYING), dominance.ALL_SQL),
}

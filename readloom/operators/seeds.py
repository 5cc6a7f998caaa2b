"""K-mers, seeds (equal k-mers of a read and a contig), and what is built from them: counts, caps, diagonals, candidates, profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from readloom.functions import bases as B
from readloom.operators.reads import _TRACKS, mask_tracks, merged_masks, unmasked
from readloom.sources.scratch import stored
from readloom.sources.tables import CONTIGS_SQL, RC_SQL, READS_SQL, as_side, codes_of, complemented, contigs, kmers, kmers_sql, reads, rows_at_once, spread

#: k of the index queries and of the seed queries, k-mers of a code at which it is dropped, greatest product cap, width of a diagonal band, near-best
#: share, spacing of the profile, slack and scores' ratio of dominance, k-mers that a significant candidate covers.
K, SEED_K, MOST_KMERS, MOST_CAP, BAND, NEAR, SPACING, SLACK, RATIO, LEAST = 20, 12, 20, 10_000, 64, 0.95, 100, 300, 0.9, 3
#: Bytes that the seeds of a run may fill, and the seeds of 16 bytes that fill 0.98 of them. A cluster passes what its executors hold together.
MEMORY = 16 << 30
BUDGET = MEMORY * 98 // 100 // 16


def explode_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read: its k-mers, distinct codes and the sum of their places. All of it is the read's own, so that no k-mer leaves its row."""
    table = spread(reads(spark, sf_dir).select("read_id", "seq", "rlen")).where(F.col("rlen") >= K)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, column in rows_at_once(batch.column("seq")):
                some = batch.slice(at, len(column))
                row, place, code = codes_of(column, K)
                same = np.sort(row << (2 * K) | code)
                each = same >> (2 * K)
                distinct = np.bincount(each[np.concatenate((np.ones(min(1, len(same)), bool), same[1:] != same[:-1]))], minlength=some.num_rows)
                places = np.bincount(row, place + (K - 1), some.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("read_id"), pa.array(np.bincount(row, minlength=some.num_rows)), pa.array(distinct), pa.array(places)], ["read_id", "n", "codes", "places"])

    return table.select("read_id", "seq").mapInArrow(of, StructType([table.schema["read_id"], *(StructField(c, LongType()) for c in ("n", "codes", "places"))]))


def masked_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read: the k-mers that touch no masked base, taken from the unmasked stretches alone."""
    table = reads(spark, sf_dir)
    gaps = unmasked(merged_masks(mask_tracks(table)), table).where(F.col("end") - F.col("beg") >= K)
    whole = gaps.join(table, "read_id").select(F.struct("read_id", "beg").alias("id"), F.substring("seq", F.col("beg") + 1, (F.col("end") - F.col("beg")).cast("int")).alias("seq"))
    found = kmers(whole, "id", K).select(F.col("id.read_id").alias("read_id"), (F.col("id.beg") + F.col("rpos")).alias("rpos"))
    return found.groupBy("read_id").agg(F.count("*").alias("n"), F.sum("rpos").cast("long").alias("places"))


def kmer_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers by their code's low byte, which is their last four bases."""
    return kmers(reads(spark, sf_dir), "read_id", K).groupBy(F.col("code").bitwiseAND(F.lit(255)).alias("bucket")).agg(F.count("*").alias("n"))


def rare(index: DataFrame, most: int = MOST_KMERS) -> DataFrame:
    """The codes of an index that occur less than most times, with their number."""
    return index.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") < most)


def kmer_freq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rare(kmers(reads(spark, sf_dir), "read_id", K))
    return counts.groupBy("n").agg(F.count("*").alias("codes"), F.sum("n").cast("long").alias("kmers"))


def _sides(spark: SparkSession, sf_dir: str, k: int, comp: bool = False, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aread, apos, code of the reads (table: of these); bread, bpos, code of the contigs (comp: their complements); the contigs)."""
    b = contigs(spark, sf_dir)
    left = kmers(reads(spark, sf_dir) if table is None else table, "read_id", k).select(F.col("read_id").alias("aread"), (F.col("rpos") + 1).alias("apos"), "code")
    right = kmers(complemented(b) if comp else b, "contig_id", k).select(F.col("contig_id").alias("bread"), (F.col("rpos") + 1).alias("bpos"), "code")
    return left, right, b


def seeds_of(spark: SparkSession, sf_dir: str, k: int = SEED_K, comp: bool = False, table: DataFrame | None = None) -> DataFrame:
    """aread, bread, apos, bpos (k-mer ends), diag of every equal k-mer of a read (table: of these) and a contig (comp: its reverse complement). A very frequent code is split
    by the adaptive skew join, where the contigs are too many to broadcast."""
    left, right, b = _sides(spark, sf_dir, k, comp, table)
    return left.join(as_side(right, b, k), "code").select("aread", "bread", "apos", "bpos", (F.col("apos") - F.col("bpos")).alias("diag"))


def allowed_hits(spark: SparkSession, sf_dir: str, comp: bool = False, budget: int = BUDGET, most: int | None = None, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(aread, apos, code, cb of the reads' k-mers that are in contigs, stored; the codes of these under the product cap)."""
    left, right, b = _sides(spark, sf_dir, SEED_K, comp, table)
    counts = right.groupBy("code").agg(F.count("*").alias("cb"))
    counts = counts if most is None else counts.where(F.col("cb") < most)
    hits = stored(left.join(as_side(counts, b, SEED_K), "code"))  # the reads' k-mers are made once
    products = hits.groupBy("code").agg((F.count("*") * F.first("cb")).alias("product"))
    return hits, products.join(F.broadcast(cap_limit(products, budget)), F.col("product") < F.col("limit")).select("code")  # one row


def mapping_seeds(spark: SparkSession, sf_dir: str, comp: bool = False, budget: int = BUDGET, most: int | None = None, table: DataFrame | None = None) -> DataFrame:
    """The seeds that candidates are made of: those of the codes under the product cap. The cap follows from how many seeds a run may hold (budget), and is
    MOST_CAP at most; it is taken on the counts of both sides before a seed is made, and no copy of a contig or read changes it by itself. most: also drops
    codes that occur so often in the contigs; off unless asked for.

    The reads' k-mers meet the contigs' counts first. What is left, the k-mers that make seeds at all, is stored, counted for the cap, and joined for the seeds."""
    hits, allowed = allowed_hits(spark, sf_dir, comp, budget, most, table)
    _, right, b = _sides(spark, sf_dir, SEED_K, comp, table)
    kept = right.join(as_side(allowed, b, SEED_K), "code", "left_semi")
    return hits.join(as_side(kept, b, SEED_K), "code").select("aread", "bread", "apos", "bpos", (F.col("apos") - F.col("bpos")).alias("diag"))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})


def seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(seeds_of(spark, sf_dir), "apos", "bpos", "diag")


def seed_join_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(seeds_of(spark, sf_dir, comp=True), "apos", "bpos", "diag")


def seed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds_of(spark, sf_dir).groupBy("aread", "bread").agg(F.count("*").alias("seeds"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, product: the seeds that each shared code makes, from counts alone."""
    a = kmers(reads(spark, sf_dir), "read_id", SEED_K).groupBy("code").agg(F.count("*").alias("ca"))
    b = kmers(contigs(spark, sf_dir), "contig_id", SEED_K).groupBy("code").agg(F.count("*").alias("cb"))
    return a.join(b, "code").select("code", (F.col("ca") * F.col("cb")).alias("product"))


def seed_product_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).groupBy("product").agg(F.count("*").alias("codes"))


def cap_limit(products: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row, limit: the least product at which the seeds of codes up to it exceed the budget, MOST_CAP at most. The histogram has less than
    MOST_CAP rows, whatever the input."""
    small = products.where(F.col("product") < MOST_CAP).groupBy("product").agg(F.sum("product").alias("s"))
    upto = small.select("product", F.sum("s").over(Window.orderBy("product")).alias("upto"))
    return upto.where(F.col("upto") > budget).agg(F.coalesce(F.min("product"), F.lit(MOST_CAP)).cast("long").alias("limit"))


def auto_cap_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_limit(_products(spark, sf_dir))


def seed_product_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes under the cap and their seeds, by product."""
    products = _products(spark, sf_dir)
    kept = products.join(F.broadcast(cap_limit(products)), F.col("product") < F.col("limit"))  # one row
    return kept.groupBy("product").agg(F.count("*").alias("codes"), F.sum("product").cast("long").alias("seeds"))


def capped_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds per read and contig, of the codes under the product cap alone: codes are judged on counts before any of their seeds is made."""
    products = _products(spark, sf_dir)
    kept = products.join(F.broadcast(cap_limit(products)), F.col("product") < F.col("limit")).select("code")  # one row
    a = kmers(reads(spark, sf_dir), "read_id", SEED_K).select(F.col("read_id").alias("aread"), "code").join(kept, "code")
    b = kmers(contigs(spark, sf_dir), "contig_id", SEED_K).select(F.col("contig_id").alias("bread"), "code")
    return a.join(b, "code").groupBy("aread", "bread").agg(F.count("*").alias("seeds"))


def seed_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("aread", "bread").orderBy("apos", "bpos")
    return seed_join(spark, sf_dir).withColumn("rank", F.row_number().over(order).cast("long"))


def band_candidates(seeds: DataFrame, band: int = BAND) -> DataFrame:
    """aread, bread, band, seeds, covered (bases of the read under seeds), and the box of each band of diagonals."""
    banded = seeds.withColumn("band", F.floor(F.col("diag") / band).cast("long"))
    order = Window.partitionBy("aread", "bread", "band").orderBy("apos", "bpos")
    step = F.least(F.coalesce(F.col("apos") - F.lag("apos").over(order), F.lit(SEED_K)), F.lit(SEED_K))
    sums = banded.withColumn("gain", step).groupBy("aread", "bread", "band")
    k = F.lit(SEED_K)
    return sums.agg(
        F.count("*").alias("seeds"), F.sum("gain").cast("long").alias("covered"), (F.min("apos") - k).cast("long").alias("afirst"),
        F.max("apos").cast("long").alias("alast"), (F.min("bpos") - k).cast("long").alias("bfirst"), F.max("bpos").cast("long").alias("blast"),
    )


def diag_band_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of all seeds, however many a code makes."""
    return band_candidates(seeds_of(spark, sf_dir))


def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of the seeds under the product cap."""
    return band_candidates(mapping_seeds(spark, sf_dir))


def best_contig_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which contig each read maps to best, and where: the band that covers most, ties to the lesser contig and band."""
    order = Window.partitionBy("aread").orderBy(F.desc("covered"), "bread", "band")
    return diag_band_candidates(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def near_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a read that cover at least NEAR of what its best one covers."""
    found = capped_candidates(spark, sf_dir)
    top = found.groupBy("aread").agg(F.max("covered").alias("top"))
    return found.join(top, "aread").where(F.col("covered") >= NEAR * F.col("top")).select("aread", "bread", "band", "covered", (F.col("covered") == F.col("top")).alias("best"))


#: Flags of a record that is its read's best, and of one to be ignored.
BEST_FLAG, ELIM_FLAG = 0x10, 0x20


def flagged(found: DataFrame) -> DataFrame:
    """found (aread, covered, any others) with flags: the best of a read, and those that cover less than NEAR of it, to be ignored. One shuffle, by read."""
    top = F.max("covered").over(Window.partitionBy("aread"))
    return found.withColumn("flags", F.when(F.col("covered") == top, F.lit(BEST_FLAG)).when(F.col("covered") < NEAR * top, F.lit(ELIM_FLAG)).otherwise(F.lit(0)))


def unflagged(found: DataFrame) -> DataFrame:
    """The records that no flag says to ignore."""
    return found.where(F.col("flags").bitwiseAND(F.lit(ELIM_FLAG)) == 0)


def elim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after those flagged to be ignored are gone."""
    return unflagged(flagged(diag_band_candidates(spark, sf_dir))).select("aread", "bread", "band", "flags")


def strong(found: DataFrame) -> DataFrame:
    return found.where(F.col("covered") >= LEAST * SEED_K)


def significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the seeds under the product cap that cover at least LEAST k-mers."""
    return strong(capped_candidates(spark, sf_dir))


def dominance_orderfree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no other of the read covers with a slack of SLACK bases at a higher score, of which RATIO is at least theirs."""
    found = strong(diag_band_candidates(spark, sf_dir))
    d = found.select(F.col("aread").alias("r"), F.col("afirst").alias("df"), F.col("alast").alias("dl"), F.col("covered").alias("ds"))
    over = (F.col("aread") == F.col("r")) & (F.col("df") < F.col("afirst") + SLACK) & (F.col("dl") > F.col("alast") - SLACK) & (RATIO * F.col("ds") >= F.col("covered"))
    return found.join(d, over, "left_anti").select("aread", "bread", "band", "covered")


def la_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates c, d of one read and contig that may be chained: d goes on after c in both, by gaps of a ratio up to 1.4."""
    found = capped_candidates(spark, sf_dir)
    d = found.select(F.col("aread").alias("ra"), F.col("bread").alias("rb"), F.col("band").alias("dband"), F.col("afirst").alias("dab"), F.col("bfirst").alias("dbb"))
    agap, bgap = F.col("dab") - F.col("alast"), F.col("dbb") - F.col("blast")
    ratio = (agap + 500) / (bgap + 500).cast("double")
    after = (F.col("dab") > F.col("afirst")) & (F.col("dbb") > F.col("bfirst")) & (agap > -400) & (bgap > -400) & ratio.between(1 / 1.4, 1.4)
    pairs = found.join(d, (F.col("aread") == F.col("ra")) & (F.col("bread") == F.col("rb")) & after)
    return pairs.select("aread", "bread", F.col("band").alias("cband"), "dband")


def repeat_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many significant candidates cover each stretch of SPACING bases of a read, on the logarithmic scale."""
    table = reads(spark, sf_dir).where("rlen > 0").select("read_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("rlen") - 1) / SPACING).cast("int") + 1)).alias("bin"))
    found = significant(spark, sf_dir).select(F.col("aread").alias("read_id"), F.floor(F.col("afirst") / SPACING).alias("a"), (F.floor((F.col("alast") - 1) / SPACING) + 1).alias("b"))
    steps = found.select("read_id", F.col("a").alias("bin"), F.lit(1).alias("s")).unionByName(found.select("read_id", F.col("b").alias("bin"), F.lit(-1).alias("s")))
    steps = steps.groupBy("read_id", "bin").agg(F.sum("s").alias("s"))
    cover = F.sum(F.coalesce("s", F.lit(0))).over(Window.partitionBy("read_id").orderBy("bin"))
    return table.join(steps, ["read_id", "bin"], "left").select("read_id", F.col("bin").cast("long").alias("bin"), B.special_log(cover).alias("level"))


def special_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale's value of every code's count among the reads' k-mers."""
    counts = kmers(reads(spark, sf_dir), "read_id", SEED_K).groupBy("code").agg(F.count("*").alias("c")).select("c").distinct()
    return counts.select("c", B.special_log(F.col("c")).alias("level"))


def string_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hamming, common prefix and suffix, and edit distance of each contig and the next."""
    a = contigs(spark, sf_dir).select("contig_id", "seq")
    b = a.select((F.col("contig_id") - 1).alias("contig_id"), F.col("seq").alias("other"))
    x, y = F.col("seq"), F.col("other")
    both = spread(a.join(b, "contig_id"))
    return _long(both.select("contig_id", B.hamming(x, y).alias("hamming"), B.snake(x, y).alias("prefix"), B.rsnake(x, y).alias("suffix"), F.levenshtein(x, y).alias("edits")), "hamming", "prefix", "suffix", "edits")


def _flip(found: DataFrame, clen: Column) -> DataFrame:
    return found.select("aread", "bread", "band", (clen - F.col("blast")).alias("abpos"), (clen - F.col("bfirst")).alias("aepos"), (F.col("rlen") - F.col("alast")).alias("bbpos"), (F.col("rlen") - F.col("afirst")).alias("bepos"))


def flip_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on complemented contigs with the roles of read and contig swapped."""
    found = band_candidates(mapping_seeds(spark, sf_dir, comp=True))
    sizes = reads(spark, sf_dir).select(F.col("read_id").alias("aread"), "rlen")
    of = contigs(spark, sf_dir).select(F.col("contig_id").alias("bread"), "clen")
    return _flip(found.join(sizes, "aread").join(of, "bread"), F.col("clen"))


def sort_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read's candidates in map order: by where they begin in the read."""
    order = Window.partitionBy("aread").orderBy("afirst", "bread", "band")
    return capped_candidates(spark, sf_dir).select("aread", "bread", "band", F.row_number().over(order).cast("long").alias("place"))


def sort_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read's candidates in pile order: by contig, then by where they begin in the read."""
    order = Window.partitionBy("aread").orderBy("bread", "afirst", "band")
    return capped_candidates(spark, sf_dir).select("aread", "bread", "band", F.row_number().over(order).cast("long").alias("place"))


_RK, _AK, _BK = kmers_sql("k", "reads", "read_id", K), kmers_sql("ka", "reads", "read_id", SEED_K), kmers_sql("kb", "contigs", "contig_id", SEED_K)
_BRK = kmers_sql("kb", "contigs", "contig_id", SEED_K, RC_SQL)
_S = "s as (select ka.read_id as aread, kb.contig_id as bread, ka.rpos + 1 as apos, kb.rpos + 1 as bpos, ka.rpos - kb.rpos as diag from ka join kb using (code))"
_L = f"l as (select coalesce(min(product), {MOST_CAP}) as lim from (select product, sum(sum(product)) over (order by product) as upto from p where product < {MOST_CAP} group by product) where upto > {BUDGET})"
_FEW = f"pa as (select code, count(*) as ca from ka group by code), pb as (select code, count(*) as cb from kb group by code), p as (select code, ca * cb as product from pa join pb using (code)), {_L}, kc as (select code from p, l where product < lim), s as (select ka.read_id as aread, kb.contig_id as bread, ka.rpos + 1 as apos, kb.rpos + 1 as bpos, ka.rpos - kb.rpos as diag from ka join kb using (code) semi join kc using (code))"
_SEEDS = f"with {READS_SQL}, {CONTIGS_SQL}, {_AK}, {_BK}, {_S}"
_SEEDS_RC = f"with {READS_SQL}, {CONTIGS_SQL}, {_AK}, {_BRK}, {_S}"
_C = (
    f"g as (select *, cast(floor(diag / {BAND}) as bigint) as band from s), h as (select *, least(coalesce(apos - lag(apos) over (partition by aread, bread, band order by apos, bpos), {SEED_K}), {SEED_K}) as gain from g), "
    f"c as (select aread, bread, band, count(*) as seeds, cast(sum(gain) as bigint) as covered, min(apos) - {SEED_K} as afirst, max(apos) as alast, min(bpos) - {SEED_K} as bfirst, max(bpos) as blast from h group by aread, bread, band)"
)
_ALL = f"{_SEEDS}, {_C}"
_CAND = f"with {READS_SQL}, {CONTIGS_SQL}, {_AK}, {_BK}, {_FEW}, {_C}"
_STRONG = f"f as (select * from c where covered >= {LEAST * SEED_K})"
_SIG = f"{_CAND}, {_STRONG}"
_P = f"with {READS_SQL}, {CONTIGS_SQL}, {_AK}, {_BK}, a as (select code, count(*) as ca from ka group by code), b as (select code, count(*) as cb from kb group by code), p as (select code, ca * cb as product from a join b using (code))"
_LOG = "cast(case when {0} <= 1 then {0} when {0} >= 10000 then 40 else floor(10 * log10({0}) + 1e-9) end as int)"

QUERIES = {
    "explode_kmers": (explode_kmers, f"with {READS_SQL}, {_RK} select read_id, count(*) as n, count(distinct code) as codes, cast(sum(rpos) as bigint) as places from k group by read_id"),
    "masked_kmers": (masked_kmers, f"with {READS_SQL}, {_RK}, {_TRACKS}, bad as (select distinct k.read_id, k.rpos from k join good g on g.read_id = k.read_id and g.beg <= k.rpos and g.fin > k.rpos - {K - 1}) select read_id, count(*) as n, cast(sum(rpos) as bigint) as places from k anti join bad using (read_id, rpos) group by read_id"),
    "kmer_bucket_histogram": (kmer_bucket_histogram, f"with {READS_SQL}, {_RK} select cast(list_aggregate(list_transform(range(1, 5), lambda i: (instr('ACGT', substring(code, {K} - 4 + i, 1)) - 1) * (4 ** (4 - i))), 'sum') as bigint) as bucket, count(*) as n from k group by 1"),
    "kmer_freq_filter": (kmer_freq_filter, f"with {READS_SQL}, {_RK}, c as (select code, count(*) as n from k group by code having count(*) < {MOST_KMERS}) select n, count(*) as codes, cast(sum(n) as bigint) as kmers from c group by n"),
    "seed_join": (seed_join, f"{_SEEDS} select * from s"),
    "seed_join_rc": (seed_join_rc, f"{_SEEDS_RC} select * from s"),
    "seed_count": (seed_count, f"{_SEEDS} select aread, bread, count(*) as seeds from s group by aread, bread"),
    "seed_product_histogram": (seed_product_histogram, f"{_P} select product, count(*) as codes from p group by product"),
    "auto_cap_limit": (auto_cap_limit, f'{_P}, {_L} select cast(lim as bigint) as "limit" from l'),
    "seed_product_cap": (seed_product_cap, f"{_P}, {_L} select product, count(*) as codes, cast(sum(product) as bigint) as seeds from p, l where product < lim group by product"),
    "capped_seeds": (capped_seeds, f"{_P}, {_L}, kc as (select code from p, l where product < lim) select ka.read_id as aread, kb.contig_id as bread, count(*) as seeds from ka semi join kc using (code) join kb using (code) group by ka.read_id, kb.contig_id"),
    "seed_sort_rank": (seed_sort_rank, f'{_SEEDS} select *, row_number() over (partition by aread, bread order by apos, bpos) as "rank" from s'),
    "diag_band_candidates": (diag_band_candidates, f"{_ALL} select * from c"),
    "best_contig_per_read": (best_contig_per_read, f"{_ALL} select * from c qualify row_number() over (partition by aread order by covered desc, bread, band) = 1"),
    "near_best": (near_best, f"{_CAND}, t as (select aread, max(covered) as top from c group by aread) select aread, bread, band, covered, covered = top as best from c join t using (aread) where covered >= {NEAR} * top"),
    "elim_filter": (elim_filter, f"{_ALL}, t as (select aread, max(covered) as top from c group by aread), m as (select aread, bread, band, case when covered = top then {BEST_FLAG} when covered < {NEAR} * top then {ELIM_FLAG} else 0 end as flags from c join t using (aread)) select * from m where flags & {ELIM_FLAG} = 0"),
    "dominance_orderfree": (dominance_orderfree, f"{_ALL}, {_STRONG} select aread, bread, band, covered from f n where not exists (select 1 from f d where d.aread = n.aread and d.afirst < n.afirst + {SLACK} and d.alast > n.alast - {SLACK} and {RATIO} * d.covered >= n.covered)"),
    "la_chain_edges": (la_chain_edges, f"{_CAND} select c.aread, c.bread, c.band as cband, d.band as dband from c join c d on c.aread = d.aread and c.bread = d.bread and d.afirst > c.afirst and d.bfirst > c.bfirst and d.afirst - c.alast > -400 and d.bfirst - c.blast > -400 and (d.afirst - c.alast + 500) / cast(d.bfirst - c.blast + 500 as double) between 1 / 1.4 and 1.4"),
    "repeat_profile": (repeat_profile, f"{_SIG}, t as (select read_id, unnest(range(0, (length(seq) - 1) // {SPACING} + 2)) as bin from reads where length(seq) > 0), e as (select aread as read_id, afirst // {SPACING} as bin, 1 as s from f union all select aread, (alast - 1) // {SPACING} + 1, -1 from f), st as (select read_id, bin, sum(s) as s from e group by read_id, bin), cv as (select t.read_id, t.bin, sum(coalesce(s, 0)) over (partition by t.read_id order by t.bin) as cover from t left join st using (read_id, bin)) select read_id, bin, {_LOG.format('cover')} as level from cv"),
    "special_log": (special_log, f"with {READS_SQL}, {_AK}, c as (select distinct count(*) as c from ka group by code) select c, {_LOG.format('c')} as level from c"),
    "string_distances": (string_distances, f"with {CONTIGS_SQL}, p as (select a.contig_id, a.seq as x, b.seq as y, least(length(a.seq), length(b.seq)) as n from contigs a join contigs b on b.contig_id = a.contig_id + 1), d as (select contig_id, n, levenshtein(x, y) as edits, list_transform(range(1, n + 1), lambda i: substring(x, i, 1) = substring(y, i, 1)) as f, list_transform(range(1, n + 1), lambda i: substring(x, length(x) - i + 1, 1) = substring(y, length(y) - i + 1, 1)) as r from p) select contig_id, cast(len(list_filter(f, lambda q: not q)) as bigint) as hamming, cast(coalesce(list_position(f, false) - 1, n) as bigint) as prefix, cast(coalesce(list_position(r, false) - 1, n) as bigint) as suffix, edits from d"),
    "flip_alignment": (flip_alignment, f"with {READS_SQL}, {CONTIGS_SQL}, {_AK}, {_BRK}, {_FEW}, {_C} select aread, bread, band, length(k.seq) - blast as abpos, length(k.seq) - bfirst as aepos, length(r.seq) - alast as bbpos, length(r.seq) - afirst as bepos from c join reads r on r.read_id = aread join contigs k on k.contig_id = bread"),
    "sort_map": (sort_map, f"{_CAND} select aread, bread, band, row_number() over (partition by aread order by afirst, bread, band) as place from c"),
    "sort_pile": (sort_pile, f"{_CAND} select aread, bread, band, row_number() over (partition by aread order by bread, afirst, band) as place from c"),
}

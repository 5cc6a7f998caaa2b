"""Lookups of reads, blocks and tracks, and how trimming, lengths and metadata bear on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import bases as B
from readloom.operators.reads import _BLOCKS, _FLAGGED, _PLACED, _TRACKS, BLOCK_BASES, CUTOFF, _flagged, mask_tracks, running
from readloom.sources.tables import CONTIGS_SQL, READS_SQL, contigs, reads

#: Lengths that reads are held against.
LENGTHS = (12, 20, 32, 500)
#: Block arguments, as a name, its first and its last block (null: all; one number: that block).
ARGS = (("reads@", None, None), ("reads@2", 2, 2), ("reads@3-5", 3, 5), ("reads@9999", 9999, 9999))
#: Tracks and what their size equals.
TRACKS = (("all", "nreads"), ("kept", "treads"), ("odd", "other"), ("gone", None))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).where(f"best and rlen >= {CUTOFF}")


def fetch_block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every block number from 0 to one past the last, trimmed or not: its first read and the one behind its last, -1 and -1 outside. Untrimmed
    numbers count all reads, trimmed ones those that trimming keeps."""
    placed = running(reads(spark, sf_dir).select("read_id", "rlen"), "read_id", "rlen", "upto")
    block = (F.floor((F.col("upto") - F.col("rlen")) / BLOCK_BASES).cast("long") + 1).alias("block")
    kept = _kept(spark, sf_dir).select("read_id", F.lit(1).alias("k"))
    sums = placed.join(kept, "read_id", "left").groupBy(block).agg(F.count("*").alias("u"), F.count("k").alias("t"))
    ends = running(running(sums, "block", "u", "ulast"), "block", "t", "tlast")  # a row a block
    both = F.explode(F.array(F.struct(F.lit(False).alias("trim"), (F.col("ulast") - F.col("u")).alias("first"), F.col("ulast").alias("last")), F.struct(F.lit(True).alias("trim"), (F.col("tlast") - F.col("t")).alias("first"), F.col("tlast").alias("last")))).alias("r")
    inside = ends.select("block", both).select("block", "r.trim", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))
    edge = ends.agg(F.max("block").alias("m")).select(F.explode(F.array(F.lit(0).cast("long"), F.col("m") + 1)).alias("block"))
    outside = edge.select("block", F.explode(F.array(F.lit(False), F.lit(True))).alias("trim"), F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"))
    return inside.unionByName(outside)


def block_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that each argument names, of those that exist."""
    placed = running(reads(spark, sf_dir).select("read_id", "rlen"), "read_id", "rlen", "upto")
    blocks = placed.select((F.floor((F.col("upto") - F.col("rlen")) / BLOCK_BASES).cast("long") + 1).alias("block")).distinct()
    args = F.array(*[F.struct(F.lit(a).alias("arg"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for a, lo, hi in ARGS])
    named = blocks.select("block", F.explode(args).alias("a")).where("a.lo is null or block between a.lo and a.hi")
    return named.select(F.col("a.arg").alias("arg"), "block", F.concat(F.lit("reads."), F.col("block").cast("string")).alias("path"))


def late_track_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track opened after trimming: the intervals of the reads that were kept, under their new numbers."""
    kept = running(_kept(spark, sf_dir).select("read_id", F.lit(1).alias("k")), "read_id", "k", "n").select("read_id", (F.col("n") - 1).cast("long").alias("number"))
    lists = mask_tracks(reads(spark, sf_dir)).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("beg", "end"))).alias("m"))
    said = F.array_join(F.transform("m", lambda x: F.concat_ws("-", x["beg"].cast("string"), x["end"].cast("string"))), ",")
    return kept.join(lists, "read_id", "left").select("read_id", "number", F.coalesce(said, F.lit("")).alias("mask"))


def guarded(table: DataFrame, k: int) -> DataFrame:
    """table, which fails when it is read if any sequence is shorter than k."""
    short = F.length("seq") < k
    return table.withColumn("seq", F.when(short, F.raise_error(F.concat(F.lit(f"a read is shorter than {k}: "), F.length("seq").cast("string")))).otherwise(F.col("seq")))


def min_length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of LENGTHS, the reads that are shorter and whether guarded() would let the table pass."""
    counts = reads(spark, sf_dir).agg(*[F.count_if(F.col("rlen") < k).alias(f"n{k}") for k in LENGTHS])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"n{k}").alias("short")) for k in LENGTHS])).alias("g")
    return counts.select(each).select("g.k", "g.short", (F.col("g.short") == 0).alias("passes"))


def load_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads asked for (those labelled 1), each as digits and as letters of either case."""
    asked = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("read_id")).distinct()
    digits = B.number_read(F.col("seq"))
    found = reads(spark, sf_dir).join(asked, "read_id", "left_semi")
    return found.select("read_id", F.md5(digits).alias("numeric_md5"), F.md5(B.lower_read(digits)).alias("lower_md5"), F.md5(B.upper_read(digits)).alias("upper_md5"))


def track_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a track fits the reads: 0 all of them, 1 the trimmed ones, -1 neither, -2 there is no such track (size -1)."""
    n = reads(spark, sf_dir).agg(F.count("*").alias("nreads")).crossJoin(F.broadcast(_kept(spark, sf_dir).agg(F.count("*").alias("treads"))))  # one row each
    size = {"nreads": F.col("nreads"), "treads": F.col("treads"), "other": F.col("nreads") + 1, None: F.lit(None).cast("long")}
    told = n.select("nreads", "treads", F.explode(F.array(*[F.struct(F.lit(t).alias("track"), size[s].alias("size")) for t, s in TRACKS])).alias("x"))
    status = F.when(F.col("x.size").isNull(), -2).when(F.col("x.size") == F.col("treads"), 1).when(F.col("x.size") == F.col("nreads"), 0).otherwise(-1)
    return told.select("x.track", F.coalesce("x.size", F.lit(-1)).cast("long").alias("size"), status.cast("long").alias("status"))


def track_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read with its pulse letters, its merged list of mask intervals and its quality, -1 without."""
    table = reads(spark, sf_dir)
    lists = mask_tracks(table).groupBy("read_id").agg(F.count("*").alias("intervals"), F.sum(F.col("end") - F.col("beg")).cast("long").alias("masked"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("read_id"), F.col("quality").cast("long").alias("quality"))
    arrow = table.select("read_id", F.md5(B.letter_arrow(B.number_read(F.col("seq")))).alias("arrow_md5"))
    return arrow.join(lists, "read_id", "left").join(labels, "read_id", "left").select("read_id", "arrow_md5", F.coalesce("intervals", F.lit(0)).alias("intervals"), F.coalesce("masked", F.lit(0)).alias("masked"), F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"))


def complement_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base frequencies of the complemented reads, which are the reads' own with A and T, C and G exchanged."""
    sums = reads(spark, sf_dir).agg(F.sum("rlen").alias("n"), *[F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(x)))).alias(x) for x in "ACGT"])
    return sums.select(*[F.round(F.col(y) / F.col("n"), 9).alias(f"freq_{x.lower()}") for x, y in zip("ACGT", "TGCA", strict=True)])


def uncompress_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs after packing to two bits a base and back."""
    packed = contigs(spark, sf_dir).select("contig_id", B.pack_bases(F.col("seq")).alias("p"), F.length("seq").alias("n"))
    return packed.select("contig_id", F.md5(B.unpack_bases(F.col("p"), F.col("n"))).alias("seq_md5"))


def reduced_extras(extras: DataFrame, strict: bool = True) -> DataFrame:
    """name, vtype, accum, value, agrees of blocks' metadata (name, vtype, accum, value): values of accum 'sum' add up, those of 'exact' must be equal in
    all blocks, and so must a name's type and way; strict: the query fails where they aren't."""
    folded = extras.groupBy("name").agg(F.min("vtype").alias("vtype"), F.min("accum").alias("accum"), ((F.min("vtype") == F.max("vtype")) & (F.min("accum") == F.max("accum"))).alias("same"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    agrees = F.col("same") & ((F.col("accum") == "sum") | (F.col("lo") == F.col("hi")))
    told = folded.select("name", "vtype", "accum", F.when(F.col("accum") == "sum", F.col("s")).otherwise(F.col("lo")).cast("long").alias("value"), agrees.alias("agrees"))
    return told.withColumn("value", F.when(F.col("agrees"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("blocks disagree on "), F.col("name"))))) if strict else told


def read_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the reads' blocks (here sources), folded: their reads and bases, the cutoff, and a field in which they disagree."""
    docs = reads(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), "source"), "read_id")
    blocks = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("rlen").alias("bases"))
    field = lambda name, accum, value: F.struct(F.lit(name).alias("name"), F.lit("int").alias("vtype"), F.lit(accum).alias("accum"), value.cast("long").alias("value"))
    each = F.explode(F.array(field("reads", "sum", F.col("n")), field("bases", "sum", F.col("bases")), field("cutoff", "exact", F.lit(CUTOFF)), field("size", "exact", F.col("n")))).alias("x")
    return reduced_extras(blocks.select(each).select("x.*"), strict=False)


def read_db_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a stub that lists files (here sources) with the reads up to their end, parsed back to last, file and prolog."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("source"))  # a row a file
    lines = docs.select(F.format_string("  %9d %s %s", upto, F.col("source"), F.concat(F.col("source"), F.lit("_1"))).alias("line"))
    part = lambda i: F.regexp_extract("line", r"^ *(\d+) (.*) (\S+)$", i)
    return lines.select(part(1).cast("long").alias("last"), part(2).alias("file"), part(3).alias("prolog"))


_SUMS = f"{_PLACED}, ks as (select read_id from kept), bk as (select cast((upto - rlen) // {BLOCK_BASES} + 1 as bigint) as block, count(*) as u, count(ks.read_id) as t from placed left join ks using (read_id) group by 1), en as (select *, sum(u) over (order by block) as ul, sum(t) over (order by block) as tl from bk)"
_EXTRAS = f"b as (select source, count(*) as n, sum(length(seq)) as bases from reads join documents on doc_id = read_id group by source), x as (select 'reads' as name, 'sum' as accum, n::bigint as value from b union all select 'bases', 'sum', bases::bigint from b union all select 'cutoff', 'exact', {CUTOFF} from b union all select 'size', 'exact', n from b)"

QUERIES = {
    "fetch_block_range": (fetch_block_range, f"with {READS_SQL}, {_FLAGGED}, {_SUMS}, r as (select block, false as trim, ul - u as first, ul as last from en union all select block, true, tl - t, tl from en union all select m, trim, -1, -1 from (select unnest([0, max(block) + 1]) as m from en), (values (false), (true)) v(trim)) select cast(block as bigint) as block, trim as \"trim\", cast(first as bigint) as \"first\", cast(last as bigint) as \"last\" from r"),
    "block_args": (block_args, f"with {READS_SQL}, {_PLACED}, {_BLOCKS} select arg, block, 'reads.' || block as path from blocks, (values " + ", ".join(f"('{a}', {'null' if lo is None else lo}, {'null' if hi is None else hi})" for a, lo, hi in ARGS) + ") v(arg, lo, hi) where lo is null or block between lo and hi"),
    "late_track_trim": (late_track_trim, f"with {READS_SQL}, {_FLAGGED}, {_TRACKS}, m as (select read_id, string_agg(beg || '-' || fin, ',' order by beg, fin) as mask from good group by read_id) select read_id, row_number() over (order by read_id) - 1 as number, coalesce(mask, '') as mask from kept left join m using (read_id)"),
    "min_length_guard": (min_length_guard, f"with {READS_SQL} select cast(k as bigint) as k, count(*) filter (length(seq) < k) as short, count(*) filter (length(seq) < k) = 0 as passes from reads, (values {', '.join(f'({k})' for k in LENGTHS)}) v(k) group by k"),
    "load_read": (load_read, f"with {READS_SQL}, a as (select read_id, translate(seq, 'ACGT', '0123') as d from reads semi join (select doc_id as read_id from labels where quality = 1) using (read_id)) select read_id, md5(d) as numeric_md5, md5(translate(d, '0123', 'acgt')) as lower_md5, md5(translate(d, '0123', 'ACGT')) as upper_md5 from a"),
    "track_status": (track_status, f"with {READS_SQL}, {_FLAGGED}, n as (select (select count(*) from reads) as nreads, (select count(*) from kept) as treads), x as (select 'all' as track, nreads as size, 0 as status from n union all select 'kept', treads, 1 from n union all select 'odd', nreads + 1, -1 from n union all select 'gone', -1, -2 from n) select track, size, cast(status as bigint) as status from x"),
    "track_attach": (track_attach, f"with {READS_SQL}, {_TRACKS}, m as (select read_id, count(*) as intervals, cast(sum(fin - beg) as bigint) as masked from good group by read_id) select r.read_id, md5(translate(seq, 'ACGT', '1234')) as arrow_md5, coalesce(intervals, 0) as intervals, coalesce(masked, 0) as masked, cast(coalesce(quality, -1) as bigint) as quality from reads r left join m using (read_id) left join labels on doc_id = r.read_id"),
    "complement_freq": (complement_freq, f"with {READS_SQL}, c as (select translate(seq, 'ACGT', 'TGCA') as seq from reads) select " + ", ".join(f"round(sum(length(seq) - length(replace(seq, '{x}', ''))) / sum(length(seq)), 9) as freq_{x.lower()}" for x in "ACGT") + " from c"),
    "uncompress_read": (uncompress_read, f"with {CONTIGS_SQL} select contig_id, md5(seq) as seq_md5 from contigs"),
    "read_extra": (read_extra, f"with {READS_SQL}, {_EXTRAS} select name, 'int' as vtype, accum, cast(case when accum = 'sum' then sum(value) else min(value) end as bigint) as value, accum = 'sum' or min(value) = max(value) as agrees from x group by name, accum"),
    "read_db_stub": (read_db_stub, "with d as (select coalesce(source, 'none') as source, count(*) as n from documents group by 1) select cast(sum(n) over (order by source) as bigint) as last, source as file, source || '_1' as prolog from d"),
}

"""Queries on single reads: encodings, trimming, blocks, masks, printing, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import bases as B
from readloom.sources.tables import CONTIGS_SQL, RC_SQL, READS_SQL, contigs, reads

#: Trim cutoff, bases of a block, rows of one step of a running total, width of printed lines.
CUTOFF, BLOCK_BASES, STEP, WIDTH = 500, 65536, 4096, 60


def encode_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", F.col("rlen").cast("long").alias("rlen"), F.md5("seq").alias("seq_md5"))


def number_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's characters as digits, and the letters of those digits in both cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), B.number_read(F.coalesce("text", F.lit(""))).alias("d"))
    return docs.select("read_id", F.md5("d").alias("digits_md5"), F.md5(B.lower_read(F.col("d"))).alias("lower_md5"), F.md5(B.upper_read(F.col("d"))).alias("upper_md5"))


def change_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", F.md5(B.change_case(F.col("seq"))).alias("changed_md5"))


def arrow_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse widths as letters; read back from a text, characters that aren't letters of a width are 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), F.coalesce("text", F.lit("")).alias("t"), B.to_bases(F.col("text")).alias("seq"))
    return docs.select("read_id", F.md5(B.letter_arrow(B.number_read(F.col("seq")))).alias("letters_md5"), F.md5(B.number_arrow(F.col("t"))).alias("numbers_md5"))


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", F.md5(B.reverse_complement(F.col("seq"))).alias("rc_md5"))


def pack_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2-bit packing of every contig as hex digits."""
    return contigs(spark, sf_dir).select("contig_id", B.pack_bases(F.col("seq")).alias("packed_hex"))


def base_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(x)))).alias(x) for x in "ACGT"]
    sums = reads(spark, sf_dir).agg(F.sum("rlen").alias("n"), *each)
    return sums.select(*[F.round(F.col(x) / F.col("n"), 9).alias(f"freq_{x.lower()}") for x in "ACGT"])


def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).agg(F.count("*").alias("nreads"), F.sum("rlen").cast("long").alias("totlen"), F.max("rlen").cast("long").alias("maxlen"))


def db_sizeof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the reads take in memory: a header of 112, 40 a read and two spare, a path of 4, and the bases with delimiters."""
    stats = db_stats(spark, sf_dir)
    return stats.select((112 + 40 * (F.col("nreads") + 2) + 4 + 1 + F.col("totlen") + F.col("nreads") + 4).cast("long").alias("bytes"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, well (a document's source), best (its quality label is 1), rlen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), F.col("source").alias("well"), F.length(B.to_bases(F.col("text"))).alias("rlen"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("read_id"), (F.col("quality") == 1).alias("best"))
    return docs.join(labels, "read_id", "left").withColumn("best", F.coalesce("best", F.lit(False)))


def trim_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).where(f"best and rlen >= {CUTOFF}").select("read_id", F.col("rlen").cast("long").alias("rlen"))


def trim_ccs_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the reads kept, the first of each well has no CCS flag and the others have it: a min per well, no ordering of a well's rows."""
    kept = _flagged(spark, sf_dir).where(f"best and rlen >= {CUTOFF}")
    first = kept.groupBy(F.col("well").alias("_well")).agg(F.min("read_id").alias("first"))
    return kept.join(first, F.col("well").eqNullSafe(F.col("_well"))).select("read_id", "well", (F.col("read_id") != F.col("first")).cast("int").alias("ccs"))


def running(table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """table with the sum of value over rows of a smaller or equal key (unique, not negative). Steps of STEP keys are summed first, so that the
    only window over everything sees one row a step."""
    stepped = table.withColumn("_step", F.floor(F.col(key) / STEP))
    steps = stepped.groupBy("_step").agg(F.sum(value).alias("_s"))
    before = steps.select("_step", (F.sum("_s").over(Window.orderBy("_step")) - F.col("_s")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_step").orderBy(key))
    return stepped.withColumn("_within", within).join(before, "_step").withColumn(out, F.col("_before") + F.col("_within")).drop("_step", "_within", "_before")


def block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of consecutive reads of about BLOCK_BASES: a read belongs to the block in which it starts."""
    placed = running(reads(spark, sf_dir).select("read_id", "rlen"), "read_id", "rlen", "upto")
    block = F.floor((F.col("upto") - F.col("rlen")) / BLOCK_BASES).cast("long") + 1
    return placed.groupBy(block.alias("block")).agg(F.min("read_id").alias("ufirst"), F.max("read_id").alias("ulast"), F.count("*").alias("nreads"), F.sum("rlen").cast("long").alias("bases"))


def hpc_plan(spark: SparkSession, sf_dir: str, per_job: int = 4) -> DataFrame:
    """The mapping jobs over all blocks: job j takes blocks low up to, not including, hgh."""
    last = block_ranges(spark, sf_dir).agg(F.max("block").alias("last")).withColumn("bits", F.floor((F.col("last") - 1) / per_job) + 1)
    jobs = last.select("last", "bits", F.explode(F.sequence(F.lit(1).cast("long"), F.col("bits"))).alias("job"))
    edge = lambda j: (1 + F.floor(F.col("last") * j / F.col("bits"))).cast("long")
    jobs = jobs.select("job", edge(F.col("job") - 1).alias("low"), edge(F.col("job")).alias("hgh"))
    names = F.array_join(F.transform(F.sequence("low", F.col("hgh") - 1), lambda b: F.concat(F.lit("reads."), b.cast("string"))), " ")
    return jobs.select("job", "low", "hgh", F.concat(F.lit("map ref "), names).alias("command"))


def load_subread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second quarter of every read."""
    beg, end = F.floor(F.col("rlen") / 4).cast("int"), F.floor(F.col("rlen") / 2).cast("int")
    return reads(spark, sf_dir).select("read_id", beg.alias("beg"), end.alias("end"), F.md5(F.substring(F.col("seq"), beg + 1, end - beg)).alias("sub_md5"))


def print_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads wrapped to lines of WIDTH bases, their length with thousands separated, and its digits."""
    lines = F.regexp_replace("seq", f"(.{{1,{WIDTH}}})", "$1\n")
    return reads(spark, sf_dir).select("read_id", F.md5(lines).alias("lines_md5"), F.format_number("rlen", 0).alias("said"), B.number_digits(F.col("rlen")).alias("digits"))


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of path names, here of the pages' urls, and names put together again."""
    url = F.coalesce("url", F.lit(""))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url.alias("u"))
    full = F.concat(B.path_to(F.col("u")), F.lit("/"), B.root(F.col("u")), F.concat(F.lit("."), F.col("page_id").cast("string"), F.lit(".las")))
    return pages.select("page_id", B.path_to(F.col("u")).alias("path"), B.root(F.col("u")).alias("root"), B.root_without(F.col("u"), ".html").alias("stem"), full.alias("full"))


# ---------------------------------------------------------------- masks


def mask_tracks(table: DataFrame) -> DataFrame:
    """read_id, rlen, beg, end of three mask tracks: the first quarter, the second to fifth tenth, the seventh and eighth tenth of each read."""
    of = lambda part: F.floor(F.col("rlen") * part / 10).cast("int")
    spans = F.array(*[F.struct(of(a).alias("beg"), of(b).alias("end")) for a, b in ((0, 2.5), (2, 5), (6, 8))])
    return table.select("read_id", "rlen", F.explode(spans).alias("m")).select("read_id", "rlen", "m.beg", "m.end").where("beg < end")


def merged_masks(tracks: DataFrame) -> DataFrame:
    """read_id, rlen, beg, end of the union of each read's intervals; touching ones merge."""
    before = Window.partitionBy("read_id").orderBy("beg", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = tracks.withColumn("new", (F.col("beg") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(Window.partitionBy("read_id").orderBy("beg", "end")))
    return island.groupBy("read_id", "rlen", "island").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("island")


def unmasked(merged: DataFrame, table: DataFrame) -> DataFrame:
    """read_id, beg, end of the stretches that no interval covers."""
    edges = merged.select("read_id", F.col("end").alias("beg"), F.lead("beg").over(Window.partitionBy("read_id").orderBy("beg")).alias("next"), "rlen")
    gaps = edges.select("read_id", "beg", F.coalesce("next", "rlen").alias("end"))
    first = table.select("read_id", "rlen").join(merged.groupBy("read_id").agg(F.min("beg").alias("b")), "read_id", "left").select("read_id", F.lit(0).alias("beg"), F.coalesce("b", "rlen").alias("end"))
    return gaps.unionByName(first).where("beg < end")


def mask_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_masks(mask_tracks(reads(spark, sf_dir))).select("read_id", "beg", "end")


def mask_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of mask intervals per read, in order."""
    each = F.sort_array(F.collect_list(F.struct("beg", "end")))
    lists = mask_tracks(reads(spark, sf_dir)).groupBy("read_id").agg(each.alias("m"))
    said = F.array_join(F.transform("m", lambda x: F.concat_ws("-", x["beg"].cast("string"), x["end"].cast("string"))), ",")
    return lists.select("read_id", F.size("m").cast("long").alias("n"), said.alias("mask"))


def mask_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = reads(spark, sf_dir)
    return unmasked(merged_masks(mask_tracks(table)), table).select("read_id", "beg", F.col("end").cast("long").alias("end"))


def complement_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complements with their merged masks mirrored."""
    table = reads(spark, sf_dir)
    mirrored = merged_masks(mask_tracks(table)).select("read_id", (F.col("rlen") - F.col("end")).alias("beg"), (F.col("rlen") - F.col("beg")).alias("end"))
    lists = mirrored.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("beg", "end"))).alias("m"))
    said = F.array_join(F.transform("m", lambda x: F.concat_ws("-", x["beg"].cast("string"), x["end"].cast("string"))), ",")
    return table.join(lists, "read_id", "left").select("read_id", F.md5(B.reverse_complement(F.col("seq"))).alias("rc_md5"), F.coalesce(said, F.lit("")).alias("mask"))


_FLAGGED = f"flagged as (select read_id, source as well, coalesce(quality = 1, false) as best, length(seq) as rlen from (select doc_id as read_id, source, {READS_SQL.split('read_id, ')[1].split(' as seq')[0]} as seq from documents) left join labels on labels.doc_id = read_id), kept as (select * from flagged where best and rlen >= {CUTOFF})"
_PLACED = "placed as (select read_id, length(seq) as rlen, sum(length(seq)) over (order by read_id) as upto from reads)"
_BLOCKS = f"blocks as (select cast((upto - rlen) // {BLOCK_BASES} + 1 as bigint) as block, min(read_id) as ufirst, max(read_id) as ulast, count(*) as nreads, cast(sum(rlen) as bigint) as bases from placed group by 1)"
_TRACKS = "tracks as (select read_id, length(seq) as rlen, cast(floor(length(seq) * a / 10) as int) as beg, cast(floor(length(seq) * b / 10) as int) as fin from reads, (values (0, 2.5), (2, 5), (6, 8)) v(a, b)), good as (select * from tracks where beg < fin)"
_MERGED = (
    "marked as (select *, case when beg > coalesce(max(fin) over (partition by read_id order by beg, fin rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as new from good), "
    "islands as (select *, sum(new) over (partition by read_id order by beg, fin rows unbounded preceding) as island from marked), merged as (select read_id, rlen, min(beg) as beg, max(fin) as fin from islands group by read_id, rlen, island)"
)
_DOC = "coalesce(text, '')"

QUERIES = {
    "encode_reads": (encode_reads, f"with {READS_SQL} select read_id, length(seq) as rlen, md5(seq) as seq_md5 from reads"),
    "number_read": (number_reads, f"with d as (select doc_id as read_id, translate(regexp_replace({_DOC}, '[^ACGTacgt]', 'A', 'g'), 'ACGTacgt', '01230123') as d from documents) select read_id, md5(d) as digits_md5, md5(translate(d, '0123', 'acgt')) as lower_md5, md5(translate(d, '0123', 'ACGT')) as upper_md5 from d"),
    "change_case": (change_case, f"with {READS_SQL} select read_id, md5(translate(seq, 'acgtACGT', 'ACGTacgt')) as changed_md5 from reads"),
    "arrow_letters": (arrow_letters, f"with {READS_SQL} select read_id, md5(translate(seq, 'ACGT', '1234')) as letters_md5, md5(translate(regexp_replace({_DOC}, '[^1234]', '4', 'g'), '1234', '0123')) as numbers_md5 from reads join documents on doc_id = read_id"),
    "reverse_complement": (reverse_complement, f"with {READS_SQL} select read_id, md5({RC_SQL}) as rc_md5 from reads"),
    "pack_reads": (pack_reads, f"with {CONTIGS_SQL}, p as (select contig_id, translate(seq, 'ACGT', '0123') || repeat('0', (4 - length(seq) % 4) % 4) as s from contigs) select contig_id, coalesce(list_aggregate(list_transform(range(0, length(s) // 2), lambda i: substring('0123456789ABCDEF', 4 * cast(substring(s, 2 * i + 1, 1) as int) + cast(substring(s, 2 * i + 2, 1) as int) + 1, 1)), 'string_agg', ''), '') as packed_hex from p"),
    "base_freq": (base_freq, f"with {READS_SQL} select " + ", ".join(f"round(sum(length(seq) - length(replace(seq, '{x}', ''))) / sum(length(seq)), 9) as freq_{x.lower()}" for x in "ACGT") + " from reads"),
    "db_stats": (db_stats, f"with {READS_SQL} select count(*) as nreads, cast(sum(length(seq)) as bigint) as totlen, max(length(seq)) as maxlen from reads"),
    "db_sizeof": (db_sizeof, f"with {READS_SQL} select cast(112 + 40 * (count(*) + 2) + 5 + sum(length(seq)) + count(*) + 4 as bigint) as bytes from reads"),
    "trim_reads": (trim_reads, f"with {_FLAGGED} select read_id, rlen from kept"),
    "trim_ccs_flags": (trim_ccs_flags, f"with {_FLAGGED} select read_id, well, case when row_number() over (partition by well order by read_id) > 1 then 1 else 0 end as ccs from kept"),
    "block_ranges": (block_ranges, f"with {READS_SQL}, {_PLACED}, {_BLOCKS} select * from blocks"),
    "hpc_plan": (hpc_plan, f"with {READS_SQL}, {_PLACED}, {_BLOCKS}, l as (select max(block) as last, (max(block) - 1) // 4 + 1 as bits from blocks), j as (select last, bits, unnest(range(1, bits + 1)) as job from l), e as (select job, 1 + last * (job - 1) // bits as low, 1 + last * job // bits as hgh from j) select job, low, hgh, 'map ref ' || list_aggregate(list_transform(range(low, hgh), lambda b: 'reads.' || b), 'string_agg', ' ') as command from e"),
    "load_subread": (load_subread, f"with {READS_SQL} select read_id, cast(length(seq) // 4 as int) as beg, cast(length(seq) // 2 as int) as \"end\", md5(substring(seq, cast(length(seq) // 4 as int) + 1, cast(length(seq) // 2 - length(seq) // 4 as int))) as sub_md5 from reads"),
    "print_read": (print_reads, f"with {READS_SQL} select read_id, md5(regexp_replace(seq, '(.{{1,{WIDTH}}})', '\\1\n', 'g')) as lines_md5, format('{{:,}}', length(seq)) as said, cast(case when length(seq) = 0 then 0 else length(cast(length(seq) as varchar)) end as int) as digits from reads"),
    "path_names": (path_names, "with p as (select page_id, coalesce(url, '') as u, list_extract(string_split(coalesce(url, ''), '/'), -1) as last from pages), q as (select page_id, last, case when contains(u, '/') then regexp_extract(u, '(?s)^(.*)/[^/]*$', 1) else '.' end as path, split_part(last, '.', 1) as root from p) select page_id, path, root, case when length(last) > 5 and ends_with(lower(last), '.html') then left(last, length(last) - 5) else last end as stem, path || '/' || root || '.' || page_id || '.las' as \"full\" from q"),
    "mask_intervals": (mask_intervals, f"with {READS_SQL}, {_TRACKS} select read_id, count(*) as n, string_agg(beg || '-' || fin, ',' order by beg, fin) as mask from good group by read_id"),
    "mask_merge": (mask_merge, f"with {READS_SQL}, {_TRACKS}, {_MERGED} select read_id, beg, fin as \"end\" from merged"),
    "mask_complement": (mask_complement, f"with {READS_SQL}, {_TRACKS}, {_MERGED}, g as (select read_id, fin as beg, coalesce(lead(beg) over (partition by read_id order by beg), rlen) as fin from merged union all select r.read_id, 0, coalesce(min(m.beg), max(length(seq))) from reads r left join merged m using (read_id) group by r.read_id) select read_id, beg, fin as \"end\" from g where beg < fin"),
    "complement_db": (complement_db, f"with {READS_SQL}, {_TRACKS}, {_MERGED}, m as (select read_id, string_agg((rlen - fin) || '-' || (rlen - beg), ',' order by rlen - fin) as mask from merged group by read_id) select read_id, md5({RC_SQL}) as rc_md5, coalesce(mask, '') as mask from reads left join m using (read_id)"),
}

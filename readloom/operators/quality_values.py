"""Quality-value streams, here the characters of documents: histograms, runs, packed tags, lossy values; and metadata of tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.huffman import scheme
from readloom.functions.quality_codec import LINES, Packed, pack_entry, unpack_entry
from readloom.sources import quality_files as source
from readloom.sources.scratch import scratch_path
from readloom.sources.tables import READS_SQL, reads, spread

#: The symbol that counts as the run character.
RUN = " "


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), F.coalesce("text", F.lit("")).alias("qv"))


def _signs(texts: DataFrame) -> DataFrame:
    return texts.select("read_id", F.explode(F.regexp_extract_all("qv", F.lit("(?s)(.)"), 1)).alias("sign"))


def qv_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every symbol, by its code."""
    return _signs(_texts(spark, sf_dir)).groupBy(F.ascii("sign").cast("long").alias("symbol")).agg(F.count("*").alias("n"))


def qv_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the run character by their length."""
    runs = _texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("qv", F.lit("( +)"), 1)).alias("run"))
    return runs.groupBy(F.length("run").cast("long").alias("length")).agg(F.count("*").alias("n"))


def qv_pack_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags where the value isn't the run character, their number, and the tags unpacked again with n elsewhere."""
    packed = F.regexp_replace("qv", RUN, "")
    return _texts(spark, sf_dir).select("read_id", F.length(packed).cast("long").alias("packed"), F.md5(packed).alias("tags_md5"), F.md5(F.regexp_replace("qv", RUN, "n")).alias("unpacked_md5"))


def qv_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram after insertion values lose one bit and merge values two."""
    code = F.ascii("sign")
    found = _signs(_texts(spark, sf_dir)).groupBy(code.cast("long").alias("c")).agg(F.count("*").alias("n"))
    return found.groupBy(F.col("c").bitwiseAND(F.lit(~1)).alias("ins"), F.col("c").bitwiseAND(F.lit(~3)).alias("mrg")).agg(F.sum("n").cast("long").alias("n"))


def track_extra_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a track's blocks (here sources) folded by language: sums add up, exact values must agree."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks = docs.groupBy("lang", "source").agg(F.sum("n_chars").alias("total"), F.count("*").alias("n"))
    return blocks.groupBy("lang").agg(F.sum("total").cast("long").alias("total"), F.sum("n").cast("long").alias("n"), (F.min("n") == F.max("n")).alias("agrees"))


def sorted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose id isn't above its predecessor's within the source: none, if the table is in order."""
    order = Window.partitionBy("source").orderBy("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.lag("doc_id").over(order).alias("before"))
    return docs.groupBy("source").agg(F.count_if(F.col("doc_id") <= F.col("before")).alias("out_of_order"), F.count("*").alias("n"))


# ---------------------------------------------------------------- codec of quality entries


_STREAMS = ["del", "ins", "mrg", "sub"]


def quality_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, header and five lines of equal length: deletion values and tags, insertion, merge and substitution values, all functions of the bases."""
    seq = F.col("seq")
    shift = lambda by: F.translate(seq, "ACGT", by)
    lines = {"del": shift("!!!%"), "tag": F.translate(F.regexp_replace(seq, "[ACG]", "n"), "T", "a"), "ins": shift('"#$%'), "mrg": F.translate(F.reverse(seq), "ACGT", "+++0"), "sub": shift("5556")}
    return spread(reads(spark, sf_dir)).select("read_id", F.format_string("@m/%d/0_%d RQ=0.850", "read_id", "rlen").alias("header"), *[c.alias(k) for k, c in lines.items()])


def read_quiva(lines: DataFrame) -> DataFrame:
    """Entries of a text of six lines each (value, one entry a row, lines parted by a line feed): header, del, tag, ins, mrg, sub; lines of unequal length
    are an error."""
    part = F.split("value", "\n", -1)
    named = [part[i].alias(c) for i, c in enumerate(["header", "del", "tag", "ins", "mrg", "sub"])]
    told = lines.select(*named).withColumn("well", F.regexp_extract("header", r"^@[^/]*/(\d+)/", 1).cast("long"))
    odd = F.exists(F.array("tag", "ins", "mrg", "sub"), lambda x: F.length(x) != F.length("del"))
    return told.withColumn("del", F.when(odd, F.raise_error(F.concat(F.lit("lines of unequal length: "), F.col("header")))).otherwise(F.col("del")))


def quality_schemes(entries: DataFrame, char: str, lossy: bool = False) -> dict[str, dict[int, str]]:
    """Prefix codes of the four streams and of the runs of char among deletion values, from histograms over all entries (255 rows a stream at most), all taken
    in one pass; lossy: of what compressed() keeps of the values."""
    cut = {"ins": 1, "mrg": 2} if lossy else {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros(256, np.int64) for c in [*_STREAMS, "runs"]}
        for batch in batches:
            for c in _STREAMS:
                lines = [x for x in batch.column(c).to_pylist() if x is not None]
                signs = np.frombuffer("\n".join(lines).encode(), np.uint8)
                sums[c] += np.bincount(signs, minlength=256)
                sums[c][10] -= max(0, len(lines) - 1)
                if c == "del" and lines:  # a line's end parts runs as any other sign does
                    others = np.flatnonzero(signs != ord(char))
                    sums["runs"] += np.bincount((np.diff(others, prepend=-1, append=len(signs)) - 1) % 256, minlength=256)  # runs() cuts off 255 and the sign behind them
        rows = [(c, int(s) >> cut.get(c, 0) << cut.get(c, 0), int(n[s])) for c, n in sums.items() for s in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["stream", "s", "n"])

    made: dict[str, dict[int, int]] = {c: {ord(char): 1} for c in _STREAMS} | {"runs": {}}
    for r in entries.select(*_STREAMS).mapInArrow(count, "stream string, s long, n long").groupBy("stream", "s").agg(F.sum("n").alias("n")).collect():
        if not (r["stream"] != "runs" and r["s"] == ord(char)):
            made[r["stream"]][r["s"]] = r["n"]
    made["runs"] |= {255: 1, 0: 1}
    return {c: scheme(n) for c, n in made.items()}


def compressed(entries: DataFrame, codes: dict[str, dict[int, str]], char: str, lossy: bool = False) -> DataFrame:
    """well, n and the streams' codes. Tags go in two bits and only where the deletion value isn't char; lossy: a bit less of insertions, two of merges."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                dele, ins, mrg, sub = (getattr(r, c).encode() for c in ("dele", "ins", "mrg", "sub"))
                if lossy:
                    ins, mrg = [x >> 1 << 1 for x in ins], [x >> 2 << 2 for x in mrg]
                out.append((r.well, *pack_entry([dele, ins, mrg, sub], r.tag.lower(), codes, ord(char))))
            yield pd.DataFrame(out, columns=["well", "n", "pairs", "runs", "del", "tag", "ins", "mrg", "sub"])

    narrow = entries.select("well", F.col("del").alias("dele"), "tag", "ins", "mrg", "sub")
    return narrow.mapInPandas(pack, "well long, n long, pairs long, runs binary, del binary, tag binary, ins binary, mrg binary, sub binary")


def uncompressed(packed: DataFrame, codes: dict[str, dict[int, str]], char: str) -> DataFrame:
    """well and the five lines of compressed() entries; tags are n where there is none."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for well, *streams in batch.itertuples(index=False):
                out.append((well, *unpack_entry(Packed(*streams), codes, ord(char))))
            yield pd.DataFrame(out, columns=["well", "del", "tag", "ins", "mrg", "sub"])

    return packed.mapInPandas(unpack, "well long, del string, tag string, ins string, mrg string, sub string")


def qv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every read's quality lines after they were read from text, compressed and uncompressed; insertions and merges lose bits."""
    text = quality_entries(spark, sf_dir).select(F.concat_ws("\n", "header", "del", "tag", "ins", "mrg", "sub").alias("value"))
    entries = read_quiva(text)
    first = entries.where(F.lower("tag").contains("n")).select(F.substring(F.col("del"), F.instr(F.lower("tag"), "n"), F.lit(1)).alias("c"))
    char = first.agg(F.min("c").alias("c")).first()["c"] or "!"  # the deletion value at a tag that says none
    codes = quality_schemes(entries, char, lossy=True)
    back = uncompressed(compressed(entries, codes, char, lossy=True), codes, char)
    return back.select(F.col("well").alias("read_id"), *[F.md5(c).alias(f"{c}_md5") for c in ("del", "tag", "ins", "mrg", "sub")])


def quality_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every read's quality lines after they went as text through one data source, and packed, a range of wells a file, through another."""
    source.register(spark)
    text, packed = scratch_path(spark), scratch_path(spark)
    quality_entries(spark, sf_dir).select(F.concat_ws("\n", "header", *LINES)).write.text(text)
    found = spark.read.format(source.TEXT).load(text)
    found.repartitionByRange("well").sortWithinPartitions("well").write.format(source.NAME).mode("append").save(packed)
    back = spark.read.format(source.NAME).load(packed)
    return back.select(F.col("well").alias("read_id"), "header", *[F.md5(c).alias(f"{c}_md5") for c in LINES])


_Q = "q as (select doc_id as read_id, coalesce(text, '') as qv from documents)"
_H = "h as (select cast(unicode(s) as bigint) as c, count(*) as n from (select unnest(regexp_extract_all(qv, '(?s).')) as s from q) group by 1)"
QUERIES = {
    "qv_histogram": (qv_histogram, f"with {_Q}, {_H} select c as symbol, n from h"),
    "qv_runs": (qv_runs, f"with {_Q} select cast(length(r) as bigint) as length, count(*) as n from (select unnest(regexp_extract_all(qv, ' +')) as r from q) group by 1"),
    "qv_pack_tags": (qv_pack_tags, f"with {_Q} select read_id, length(replace(qv, ' ', '')) as packed, md5(replace(qv, ' ', '')) as tags_md5, md5(replace(qv, ' ', 'n')) as unpacked_md5 from q"),
    "qv_lossy": (qv_lossy, f"with {_Q}, {_H} select c // 2 * 2 as ins, c // 4 * 4 as mrg, cast(sum(n) as bigint) as n from h group by 1, 2"),
    "qv_roundtrip": (qv_roundtrip, f"with {READS_SQL} select read_id, md5(translate(seq, 'ACGT', '!!!%')) as del_md5, md5(translate(seq, 'ACGT', 'nnna')) as tag_md5, md5(translate(seq, 'ACGT', '\"\"$$')) as ins_md5, md5(translate(reverse(seq), 'ACGT', '(((0')) as mrg_md5, md5(translate(seq, 'ACGT', '5556')) as sub_md5 from reads"),
    "quality_files": (quality_files, f"with {READS_SQL} select read_id, '@m/' || read_id || '/0_' || length(seq) || ' RQ=0.850' as header, md5(translate(seq, 'ACGT', '!!!%')) as del_md5, md5(translate(seq, 'ACGT', 'nnna')) as tag_md5, md5(translate(seq, 'ACGT', '\"#$%')) as ins_md5, md5(translate(reverse(seq), 'ACGT', '+++0')) as mrg_md5, md5(translate(seq, 'ACGT', '5556')) as sub_md5 from reads"),
    "track_extra_reduce": (track_extra_reduce, "with b as (select lang, source, sum(n_chars) as total, count(*) as n from documents group by 1, 2) select lang, cast(sum(total) as bigint) as total, cast(sum(n) as bigint) as n, min(n) = max(n) as agrees from b group by lang"),
    "sorted_check": (sorted_check, "with d as (select source, doc_id, lag(doc_id) over (partition by source order by doc_id) as before from documents) select source, count(*) filter (doc_id <= before) as out_of_order, count(*) as n from d group by source"),
}

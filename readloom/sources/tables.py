"""Reads, contigs and k-mers as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from readloom.functions.bases import reverse_complement, to_bases


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it is read from fewer files; a table of more files is split by its scan, a stream by its trigger."""
    if df.isStreaming:
        return df
    cores = int(df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq, rlen from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), to_bases(F.col("text")).alias("seq"))
    return docs.withColumn("rlen", F.length("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, seq, clen from benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("contig_id"), to_bases(F.col("text")).alias("seq"))
    return items.withColumn("clen", F.length("seq"))


def complemented(table: DataFrame) -> DataFrame:
    return table.withColumn("seq", reverse_complement(F.col("seq")))


def stranded(table: DataFrame, key: str = "read_id") -> DataFrame:
    """table with every third sequence (key divisible by 3) as its reverse complement: reads come from either strand, the driver's texts from one."""
    return table.withColumn("seq", F.when(F.col(key) % 3 == 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))


#: What each base is in a code of two bits a base, and bases whose k-mers are made, and sent on, at once.
_BITS = np.zeros(256, np.uint64)
_BITS[list(b"ACGT")] = range(4)
BATCH = 1 << 17


def codes_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, code) of every k-mer (k up to 31) of a column of base strings: place counts from the row's first base, code has two bits a base, the first
    base highest. A code of 2m bases is put together from two of m, so that all k-mers take about log k steps."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.maximum(np.diff(offsets) - k + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    have, power, code, done = _BITS[data], 1, np.zeros(len(data), np.uint64), 0
    while done < k:  # the bits of k, from the last: code is of the bases from each place on
        if k & power:
            code = have if not done else (have[: len(code) - power] << np.uint64(2 * done)) | code[power:]
            done += power
        if done < k:
            have = (have[:-power] << np.uint64(2 * power)) | have[power:]
            power *= 2
    return row, place, code[(offsets[:-1] - offsets[0])[row] + place].astype(np.int64)


def rows_at_once(column: pa.Array, most: int = BATCH) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a column of base strings in stretches of at most that many bases, or of one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, most + (upto[at - 1] if at else 0), "right")))
        yield at, column.slice(at, end - at)
        at = end


def windows(column: pa.Array, k: int, most: int = BATCH) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, first place, rows) of a column of base strings: stretches of rows of at most `most` bases together; a longer sequence alone, in windows that
    share k - 1 bases, so that each of its k-mers is in one. What is held at once grows neither with the rows of a batch nor with a sequence's length."""
    for first, some in rows_at_once(column, most):
        if len(some) > 1 or (size := pc.binary_length(some)[0].as_py() or 0) <= most:
            yield first, 0, some
            continue
        text = some[0].as_py()
        for at in range(0, size - k + 1, most):
            yield first, at, pa.array([text[at : at + most + k - 1]], column.type)


def codes_in_parts(column: pa.Array, k: int, most: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """codes_of() a column in parts of at most `most` k-mers."""
    for first, at, some in windows(column, k, most):
        row, place, code = codes_of(some, k)
        yield row + first, place + at, code


def kmers(table: DataFrame, key: str, k: int) -> DataFrame:
    """key, rpos (the k-mer's last base), code (the k-mer, two bits a base) of every k-mer; null sequences and ones shorter than k have none."""
    whole = spread(table.select(key, "seq")).where(F.length("seq") >= k)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, code in codes_in_parts(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((place + k - 1).astype(np.int32)), pa.array(code)], [key, "rpos", "code"])

    return whole.mapInArrow(of, StructType([whole.schema[key], StructField("rpos", IntegerType()), StructField("code", LongType())]))


#: K-mers of a side of a join up to which it is broadcast, about 24 MB.
BROADCAST_KMERS = 1_000_000


def as_side(index: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """An index of the k-mers of table as a join's side: their number is counted first, from the lengths alone, as Spark would take the index to be no larger
    than the table. Beyond BROADCAST_KMERS the join shuffles."""
    n = table.agg(F.coalesce(F.sum(F.greatest(F.length("seq") - (k - 1), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(index) if n <= BROADCAST_KMERS else index.hint("merge")


#: The same tables in SQL, as common table expressions.
_BASES = "regexp_replace(translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g')"
READS_SQL = f"reads as (select doc_id as read_id, {_BASES} as seq from documents)"
CONTIGS_SQL = f"contigs as (select item_id as contig_id, {_BASES} as seq from benchmark)"
RC_SQL = "reverse(translate(seq, 'ACGT', 'TGCA'))"
STRANDED_SQL = f"sreads as (select read_id, case when read_id % 3 = 0 then {RC_SQL} else seq end as seq from reads)"


def kmers_sql(name: str, table: str, key: str, k: int, seq: str = "seq") -> str:
    """A common table expression like kmers()."""
    return (
        f"{name} as (select {key}, i + {k - 1} as rpos, substring(s, i + 1, {k}) as code "
        f"from (select {key}, s, unnest(range(0, length(s) - {k - 1})) as i from (select {key}, {seq} as s from {table}) where length(s) >= {k}))"
    )

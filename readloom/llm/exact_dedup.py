"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash of what still shares both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.util import numbered, small_side, written

#: Characters that the second refinement hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shared(counted: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """The keys that at least two rows share, with a mark; broadcast if small. Counts are partial sums before the shuffle."""
    return small_side(written(counted.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(mark))))


def staged(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """docs (doc_id, _norm and any others) with _len, _prefix and _sha. Each step reads more of a text, and only where the step before leaves it among
    others: the prefix is hashed where the length is shared, the whole text where length and prefix are, else they are null (digest_all: all texts are
    hashed, because the hash is asked for)."""
    sized = docs.withColumn("_len", F.length("_norm"))
    prefix = F.xxhash64(F.substring("_norm", 1, PREFIX))
    lengths = _shared(sized.select("_len"), ["_len"], "_l")
    second = sized.join(lengths, "_len", "left").withColumn("_prefix", F.when(F.col("_l"), prefix)).drop("_l")
    both = _shared(second.where("_prefix is not null").select("_len", "_prefix"), ["_len", "_prefix"], "_p")
    third = second.join(both, ["_len", "_prefix"], "left")
    sha = F.unhex(F.sha2("_norm", 256))
    return third.withColumn("_sha", sha if digest_all else F.when(F.col("_p"), sha)).withColumn("_alive", F.coalesce("_p", F.lit(False))).drop("_p")


def refined(docs: DataFrame, digest_all: bool = False, keep: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, groups), both written.

    rows: doc_id, keep (a column of docs), _len, _prefix, _sha (binary), _alive of staged(), and _rid.
    groups: the keys that at least two rows share, with _n rows, _keep (the smallest doc_id, null only if all are) and _tied, the rows that
    have that doc_id. Counts are partial sums before the shuffle, so that a group with a third of all rows is a few rows a task.
    """
    told = staged(docs.select(*dict.fromkeys(["doc_id", keep]), normalised(F.col("text")).alias("_norm")), digest_all).drop("_norm")
    rows = written(told.withColumn("_rid", F.monotonically_increasing_id()))
    keys = ["_len", "_prefix", "_sha"]
    each = rows.where("_alive").groupBy(*keys, "doc_id").agg(F.count("*").alias("_c"), F.min("_rid").alias("_first"))
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_c"), F.col("_first")))
    groups = each.groupBy(*keys).agg(F.sum("_c").alias("_n"), best.alias("_b")).where("_n > 1")
    return rows, written(groups.select(*keys, "_n", F.col("_b.doc_id").alias("_keep"), F.col("_b._c").alias("_tied"), F.col("_b._first").alias("_keep_rid")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays; a null doc_id comes last; of rows that repeat that doc_id too, exactly one stays. A
    null text counts as empty, so null and empty texts are equal. An empty table gives an empty result; further columns are ignored.
    """
    rows, groups = refined(docs, digest_all=True)
    out = rows.join(small_side(groups), ["_len", "_prefix", "_sha"], "left")
    alone = F.col("_n").isNull()
    return out.select(
        F.col("doc_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_rid") == F.col("_keep_rid"))).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Full content is hashed only where length and prefix are shared.

    Rows that repeat both doc_id and text come out once; nulls, repeats and empty tables as in exact_groups(). Only numbers meet in the joins."""
    marked = numbered(docs)
    rows, groups = refined(marked.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_key"), keep="_key")
    beside = rows.where("_alive").join(small_side(groups), ["_len", "_prefix", "_sha"])
    gone = written(beside.where("not (doc_id <=> _keep) or (_tied > 1 and _rid != _keep_rid)").select("_key"))
    return marked.join(small_side(gone), "_key", "left_anti").select("_row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document: see exact_groups(). Its last column asks for the hash of every text."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""

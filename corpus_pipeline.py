"""The corpus pipeline: from raw documents to packed training sequences, in five stages of the llm subpackage's operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.exact_dedup import exact_dedup
from readloom.llm.packing import pack_documents
from readloom.llm.quality import quality_scores, train
from readloom.llm.simhash import without_near_copies
from readloom.llm.substring_dedup import without_repeats
from readloom.llm.util import discard, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.5 or more; null and empty texts are scored like any other."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, model).where("score >= 0.5").drop("score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id; a null text is empty, a null doc_id comes last."""
    return exact_dedup(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the document with the smallest doc_id; texts without words stay."""
    return without_near_copies(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 35-word sequences that occur elsewhere; texts with none, null ones too, stay as they are. n_chars, where there is such a
    column, follows the text."""
    told = without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    told = told.withColumn("text", text)
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        told = told.withColumn("n_chars", chars)
    return told.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with the sequence and place that they are packed into; a null or empty text is a piece with the end id."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]
#: The classifier and the tokenizer can't be said in SQL; tests/llm/test_registered.py holds each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table replaces its predecessor's in the scratch folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""The k-mer filter of blocks and the counts of a run on small tables."""

from pyspark.sql import functions as F

from readloom.operators.blocks import Counted, block_seeds, blocked, observed_candidates, side
from readloom.operators.seeds import BAND, SEED_K


def tables(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_blocks_by_bases(spark):
    table = spark.createDataFrame([(i, "A" * 30) for i in range(10)], "id long, seq string")
    got = {r["id"]: r["block"] for r in blocked(table, "id", 100).collect()}
    assert got == {i: 30 * i // 100 + 1 for i in range(10)}


def test_a_code_goes_only_from_the_block_where_it_is_frequent(spark, monkeypatch):
    monkeypatch.setattr("readloom.operators.blocks.blocked", lambda table, key: table.withColumn("block", F.floor(F.col(key) / 10)))
    table = spark.createDataFrame([(i, "ACGT") for i in (0, 1, 2, 10, 11)] + [(3, "AACC"), (4, None), (5, "")], "id long, seq string")
    got = sorted((r["id"], r["xblock"]) for r in side(table, "id", 4, 3, Counted(), "x").collect())
    assert got == [(3, 0), (10, 1), (11, 1)]
    assert side(table, "id", 4, None, Counted(), "x").count() == 6


def test_counts_are_those_of_the_run(spark, tmp_path):
    text, other = "acgttgcaagtcctagatcc", "ttgacaggtctaaacgcgta"
    sf = tables(spark, tmp_path, [(i, text) for i in range(9)] + [(20, other), (21, None), (22, "")], [(1, text + other), (2, None)])
    per = len(text) - SEED_K + 1
    found, n = observed_candidates(spark, sf, most=None)
    assert (n["a_bases"], n["b_bases"], n["a_kmers"], n["b_kmers"], n["a_kept"]) == (200, 40, 10 * per, 40 - SEED_K + 1, 10 * per)
    assert n["seeds"] == 10 * per == found.agg(F.sum("seeds")).first()[0] and n["candidates"] == found.count() == 10
    found, n = observed_candidates(spark, sf, most=9)  # the nine copies reach the limit in their block, the other text doesn't
    assert (n["a_kmers"], n["a_kept"], n["b_kept"], n["seeds"], n["candidates"]) == (10 * per, per, 40 - SEED_K + 1, per, 1)
    assert {(r["aread"], r["band"]) for r in found.collect()} == {(20, -20 // BAND)}


def test_nothing_in_common_and_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [(1, None)], [(1, "acgt" * 9)])
    found, n = observed_candidates(spark, sf)
    assert found.count() == 0 and n["seeds"] == n["a_kmers"] == n["candidates"] == 0
    assert block_seeds(spark, sf, 2, Counted()).count() == 0


def test_no_kmer_is_shuffled_or_stored(spark, tmp_path):
    sf = tables(spark, tmp_path, [(i, "acgttgcaagtcctagatcc" * 5) for i in range(30)], [(1, "acgttgcaagtcctagatcc")])
    plan = block_seeds(spark, sf, 9, Counted())._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "RepartitionByExpression" not in above and "merge" not in above.lower() and "broadcast" in above.lower()

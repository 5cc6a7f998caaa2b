"""Every registered query with SQL against DuckDB on the smallest tables, and the functions' edge cases."""

import importlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from readloom.functions import bases as B
from readloom.operators.reads import merged_masks, running, unmasked
from readloom.operators.seeds import cap_limit, mapping_seeds
from readloom.plans.registry import QUERIES, SQL
from readloom.sources.tables import kmers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple("" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    frame = importlib.import_module("__spark_entry__").entry(spark)
    assert frame.count() > 0


def test_cap_follows_the_budget(spark):
    products = spark.createDataFrame([(f"c{i}", p) for i, p in enumerate([1, 1, 4, 6, 6, 20_000])], "code string, product long")
    assert [cap_limit(products, b).first()["limit"] for b in (1, 2, 6, 17, 18)] == [1, 4, 6, 6, 10_000]
    assert cap_limit(products).first()["limit"] == 10_000


def test_copies_change_no_candidate(spark, tmp_path):
    """50 copies of a contig give each read's band 50 times, and 20 copies of each read every band of it; only the budget's cap and a filter asked for drop."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("acgt") for _ in range(60)) for _ in range(4)]
    spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(texts) for k in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 * k + i, t) for i, t in enumerate(texts) for k in range(50)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    found = QUERIES["diag_band_candidates"](spark, sf).where("covered = 60").collect()
    assert {(r["aread"], r["bread"]) for r in found} == {(10 * k + i, 100 * n + i) for i in range(4) for k in range(20) for n in range(50)}
    assert mapping_seeds(spark, sf).count() == 4 * 20 * 50 * 49
    assert mapping_seeds(spark, sf, most=50).count() == 0 and mapping_seeds(spark, sf, budget=100_000).count() == 0
    boxes_ = QUERIES["sort_alignments"](spark, sf).select("aread", "bread").distinct().count()
    assert boxes_ == 0  # ids of copies differ by tens, so that copies are odd or even alike


def test_copies_keep_overlaps(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice("acgt") for _ in range(80)) for _ in range(3)]
    spark.createDataFrame([(3 * k + i, t) for i, t in enumerate(texts) for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["aread"], r["bread"]) for r in QUERIES["sort_alignments"](spark, str(tmp_path)).collect()}
    assert found == {(a, b) for a in range(120) for b in range(120) if a % 3 == b % 3 and a % 2 == 1 and b % 2 == 0}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "made, want",
    [
        (lambda: B.to_bases(F.lit("abcd éZ!")), "ACGTC"),
        (lambda: B.to_bases(F.lit(None).cast("string")), ""),
        (lambda: B.reverse_complement(F.lit("AACG")), "CGTT"),
        (lambda: B.kmer_code(F.lit("ACGT")), 27),
        (lambda: B.hamming(F.lit("ACGT"), F.lit("AGGA")), 2),
        (lambda: B.snake(F.lit("ACGT"), F.lit("ACT")), 2),
        (lambda: B.snake(F.lit("AC"), F.lit("AC")), 2),
        (lambda: B.rsnake(F.lit("ACGT"), F.lit("GGT")), 2),
        (lambda: B.number_read(F.lit("aCx2T")), "01003"),
        (lambda: B.special_log(F.lit(1000)), 30),
        (lambda: B.special_log(F.lit(9999)), 39),
        (lambda: B.special_log(F.lit(0)), 0),
        (lambda: B.path_to(F.lit("a/b/c.x")), "a/b"),
        (lambda: B.path_to(F.lit("c.x")), "."),
        (lambda: B.root(F.lit("a/b.c.d")), "b"),
        (lambda: B.root_without(F.lit("a/b.HTML"), ".html"), "b"),
        (lambda: B.pack_bases(F.lit("ACGTC")), "1B40"),
    ],
)
def test_functions(spark, made, want):
    assert value(spark, made()) == want


def test_special_log_equals_its_formula_everywhere(spark):
    got = spark.range(2, 10000).select("id", B.special_log(F.col("id")).alias("x")).collect()
    powers = [10 ** (m / 10) for m in range(41)]
    assert all(r["x"] == max(m for m in range(41) if powers[m] <= r["id"] + 1e-9) for r in got)


def test_kmers_of_short_and_long_sequences(spark):
    long = "ACGGT" * 300
    table = spark.createDataFrame([(1, ""), (2, "ACG"), (3, "ACGT"), (4, long)], "id long, seq string")
    got = {}
    for r in kmers(table, "id", 4).collect():
        got.setdefault(r["id"], {})[r["rpos"]] = r["code"]
    code = lambda kmer: int(kmer.translate(str.maketrans("ACGT", "0123")), 4)
    assert got == {3: {3: code("ACGT")}, 4: {i + 3: code(long[i : i + 4]) for i in range(len(long) - 3)}}
    for k in (1, 3, 12, 20, 31):
        each = {r["rpos"]: r["code"] for r in kmers(table, "id", k).where("id = 4").collect()}
        assert each == {i + k - 1: code(long[i : i + k]) for i in range(len(long) - k + 1)}


def test_masks_merge_and_complement(spark):
    table = spark.createDataFrame([(1, 100), (2, 50)], "read_id long, rlen int")
    tracks = spark.createDataFrame([(1, 100, 0, 10), (1, 100, 10, 20), (1, 100, 30, 40), (1, 100, 35, 100)], "read_id long, rlen int, beg int, end int")
    merged = merged_masks(tracks)
    assert sorted((r["beg"], r["end"]) for r in merged.collect()) == [(0, 20), (30, 100)]
    assert sorted((r["read_id"], r["beg"], r["end"]) for r in unmasked(merged, table).collect()) == [(1, 20, 30), (2, 0, 50)]


def test_running_total_over_many_steps(spark):
    got = running(spark.range(10000).withColumn("v", F.lit(2)), "id", "v", "s").collect()
    assert all(r["s"] == 2 * (r["id"] + 1) for r in got)

"""Candidates and chains are of all seeds: a code of any number of seeds, 10,000 and more too, is left out by none of these queries."""

import random

import duckdb
import pytest

from readloom.plans.registry import QUERIES, SQL
from tests.test_queries import rows


@pytest.fixture(scope="module")
def frequent(spark, tmp_path_factory):
    """101 reads and 100 contigs of one text, of which each code makes 10,100 seeds and more, and a read that shares a part of it."""
    folder, rng = tmp_path_factory.mktemp("frequent"), random.Random(7)
    text = "".join(rng.choice("acgt") for _ in range(60))
    reads = [(n, text) for n in range(101)] + [(101, "ac" * 200 + text[:40]), (102, None)]
    spark.createDataFrame(reads, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, text) for n in range(100)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def oracle(folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.sql(SQL[name]).df()


@pytest.mark.parametrize("name, n", [("diag_band_candidates", 102 * 100), ("best_contig_per_read", 102), ("elim_filter", 102 * 100), ("dominance_orderfree", 102 * 100), ("sql_dominance", 102 * 100)])
def test_no_code_is_left_out(spark, frequent, name, n):
    got = QUERIES[name](spark, frequent).toPandas()
    assert len(got) >= n and rows(got) == rows(oracle(frequent, name))


@pytest.mark.parametrize("name", ["chain_candidates", "sql_chains"])
def test_no_chain_is_left_out(spark, frequent, name):
    got = {(r["aread"], r["bread"]): r["score"] for r in QUERIES[name](spark, frequent).collect()}
    assert got == {(a, b): 60 if a < 101 else 40 for a in range(102) for b in range(100)}

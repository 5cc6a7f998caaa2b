"""The counts of all k-mers without a row for each, on odd rows too."""

import duckdb
import pytest

from readloom.operators import overlaps as O

ROWS = [(n, "acgtgcatgcatttagcagcagt" * (n % 5)) for n in range(30)] + [(-3, "acgtgcatgcatttagcagcagtt"), (-4, "ttagcagcagtttagcagcagttt"), (None, "ggagcagcagtttagcagcagttt"), (31, None)]


@pytest.mark.parametrize("some", [ROWS, ROWS[30:33], [(1, "acgt"), (2, None)]])
def test_counts_are_those_of_sql_and_no_kmer_is_a_row(spark, tmp_path, monkeypatch, some):
    spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    monkeypatch.setattr(O, "kmers", None)
    assert list(map(tuple, O.seed_statistics(spark, str(tmp_path)).collect())) == con.sql(O.QUERIES["seed_statistics"][1]).fetchall()

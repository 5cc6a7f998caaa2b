"""The SQL surface against its DataFrame twins, and its functions on odd rows."""

from readloom.operators.sql_surface import register
from readloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_chains_equal_the_dataframe_query(spark):
    got = sorted(map(tuple, QUERIES["sql_chains"](spark, SF).collect()))
    want = sorted(map(tuple, QUERIES["chain_candidates"](spark, SF).collect()))
    assert got == want and got


def test_functions_on_odd_rows(spark):
    register(spark)
    assert spark.sql("select readloom_to_bases('abcd éZ!') as b, readloom_to_bases(null) as n, readloom_reverse_complement('AACG') as r").first() == ("ACGTC", "", "CGTT")
    assert spark.sql("select readloom_diagonal_band(10, 11) as d").first()["d"] == -1
    spark.sql("select * from values (1, 'ACGTA'), (2, cast(null as string)), (3, ''), (4, 'ACG'), (null, 'AAAA') as t(id, seq)").createOrReplaceTempView("odd")
    got = {(r["id"], r["rpos"], r["code"]) for r in spark.sql("select * from readloom_kmers(table(odd), 4)").collect()}
    assert got == {(1, 3, 0b00011011), (1, 4, 0b01101100), (None, 3, 0)}
    assert spark.sql("select * from readloom_kmers(table(select * from odd where id > 9), 4)").count() == 0
    empty = "select * from readloom_seed_chains(table(select 1L as aread, 1L as bread, 1L as apos, 1L as bpos where false) partition by (aread, bread) order by (apos, bpos))"
    assert spark.sql(empty).count() == 0


def test_expressions_are_inlined(spark):
    register(spark)
    plan = spark.sql("select readloom_reverse_complement(cast(id as string)) as r from range(10)")._jdf.queryExecution().executedPlan().toString()
    assert "translate" in plan and "Python" not in plan

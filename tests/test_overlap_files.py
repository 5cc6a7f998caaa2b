"""The data source of overlap files: whole rows back, ranges left out unread, appends, overwrites, and what isn't committed."""

import json
import os
import random

import pytest

from readloom.sources import overlap_files
from readloom.sources.overlap_files import NAME, SCHEMA, Reader, register, unpacked


def made(rng, n, low=0):
    rows = []
    for k in range(n):
        wide = 60_000 if rng.random() < 0.2 else 255
        rows.append((low + k // 3, rng.randrange(-5, 1 << 40), rng.random() < 0.5, -k, k, k + 100, 2 * k, 2 * k + 90, rng.randrange(99), [(rng.randrange(wide), rng.randrange(wide)) for _ in range(rng.randrange(5))]))
    return rows


def back(frame):
    return sorted((*r[:9], [tuple(t) for t in r["trace"]]) for r in frame.collect())


def test_rows_come_back_and_ranges_are_left_out(spark, tmp_path):
    register(spark)
    rows, path = made(random.Random(1), 300), str(tmp_path / "a")
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartitionByRange(5, "aread").write.format(NAME).mode("append").save(path)
    load = lambda: spark.read.format(NAME).load(path)
    assert back(load()) == sorted(rows)
    assert back(load().where("aread >= 20 and aread < 23")) == sorted(r for r in rows if 20 <= r[0] < 23)
    assert back(load().where("aread = 1000")) == [] and load().select("trace").count() == 300
    files = json.load(open(f"{path}/_overlaps.json"))
    assert len(files) == 5 and sum(f["n"] for f in files) == 300
    reader = Reader(path)
    from pyspark.sql.datasource import EqualTo

    assert len(list(reader.pushFilters([EqualTo(("aread",), 50)]))) == 1 and len(reader.partitions()) == 1
    for name in [f["name"] for f in files if not f["low"] <= 50 <= f["high"]]:  # what is left out isn't opened
        os.remove(f"{path}/{name}")
    assert back(load().where("aread = 50")) == sorted(r for r in rows if r[0] == 50)


def test_appends_and_overwrites(spark, tmp_path):
    register(spark)
    one, two, path = made(random.Random(2), 40), made(random.Random(3), 30, 500), str(tmp_path / "b")
    put = lambda rows, mode: spark.createDataFrame(rows, SCHEMA).write.format(NAME).mode(mode).save(path)
    put(one, "append")
    put(two, "append")
    assert back(spark.read.format(NAME).load(path)) == sorted(one + two)
    put(two, "overwrite")
    assert back(spark.read.format(NAME).load(path)) == sorted(two)
    put([], "overwrite")
    assert back(spark.read.format(NAME).load(path)) == []


def test_failures_leave_nothing(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "c")
    with pytest.raises(Exception, match="columns"):
        spark.range(3).write.format(NAME).mode("append").save(path)
    with pytest.raises(Exception):
        spark.createDataFrame([(1, 2, False, 0, 0, 1, 0, 1, 0, [(70_000, 1)])], SCHEMA).write.format(NAME).mode("append").save(path)
    with pytest.raises(Exception, match="no committed"):
        spark.read.format(NAME).load(path).count()
    assert list(unpacked(b"")) == []


def test_short_files_are_an_error(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "d")
    spark.createDataFrame(made(random.Random(4), 9), SCHEMA).coalesce(1).write.format(NAME).mode("append").save(path)
    (file,) = overlap_files.listed(path)
    with open(f"{path}/{file['name']}", "ab") as out:
        out.write(b"x")
    with pytest.raises(Exception, match="bytes"):
        spark.read.format(NAME).load(path).collect()

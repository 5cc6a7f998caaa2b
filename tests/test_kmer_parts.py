"""K-mers are made in parts: the same k-mers, none twice, in memory that doesn't grow with a batch or a sequence."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.sources import tables


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 17])
def test_parts_are_the_whole(most):
    rng = random.Random(1)
    column = pa.array([None if n == 3 else "".join(rng.choices("ACGT", k=n)) for n in (0, 5, 11, 12, 3, 200, 13, 64, 75, 76, 1, 300)], pa.string()).slice(1)
    parts = list(tables.codes_in_parts(column, 12, most))
    assert most > 1 or max(len(p[0]) for p in parts) == 1
    whole = tables.codes_of(column.fill_null(""), 12)
    assert [np.concatenate(x).tolist() for x in zip(*parts, strict=True)] == [x.tolist() for x in whole]


def test_a_batch_is_not_held_as_kmers():
    column = pa.array(["ACGTTGCA" * 250] * 2000)
    tracemalloc.start()
    n = sum(len(code) for _, _, code in tables.codes_in_parts(column, 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * 1981 and peak < 32e6  # 24 bytes a k-mer would be 95 MB


def test_kmers_of_a_sequence_longer_than_a_part(spark, monkeypatch):
    text = "".join(random.Random(2).choices("ACGT", k=2 * tables.BATCH + 50))
    made = tables.kmers(spark.createDataFrame([(1, text), (2, "ACG"), (3, None)], "id long, seq string"), "id", 20)
    told = made.agg(F.count("*"), F.countDistinct("rpos"), F.min("rpos"), F.max("rpos")).first()
    assert tuple(told) == (len(text) - 19, len(text) - 19, 19, len(text) - 1)

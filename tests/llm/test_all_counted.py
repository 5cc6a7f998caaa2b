"""Near copies: shingles are counted in all texts, whatever their number, in parts and masses of any size."""

import random
from collections import Counter

import numpy as np
import pytest

from readloom.llm import simhash


def shingles(texts, width):
    rows = [t.encode() for t in texts]
    h, cuts = simhash.shingle_sets(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]), width)
    return Counter(h.view(np.int64).tolist())


def texts(n):
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(400)}" for _ in range(12)) for _ in range(9)]
    return ["".join(f"{rng.choice(lines)} x{rng.randrange(30)} " for _ in range(rng.randrange(4))) for _ in range(n)]


def test_no_sample_is_counted(spark, monkeypatch):
    seen, written = [], simhash.written
    monkeypatch.setattr(simhash, "COUNTED", 10, raising=False)  # texts beyond which a part was taken
    monkeypatch.setattr(simhash, "written", lambda df: seen.append(written(df)) or seen[-1])
    made = texts(300)
    simhash.near_copies(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), width=3)
    (counted,) = [x for x in seen if x.columns == ["h", "count"]]
    want = {h: n for h, n in shingles(made, 3).items() if n >= simhash.COMMON}
    assert {r["h"]: r["count"] for r in counted.collect()} == want and max(want.values()) > 20


@pytest.mark.parametrize("parts", [1, 7, 1000])
def test_parts_count_each_shingle_once(spark, parts):
    made = texts(200)
    table = spark.createDataFrame([(t,) for t in [*made, None, ""]], "text string").repartition(5)
    got = [tuple(r) for r in simhash.shingle_counts(table, 3, parts).collect()]
    assert sorted(got) == sorted((h, n) for h, n in shingles(made, 3).items() if n >= simhash.COMMON)


def test_counts_add_up():
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 50, 40).astype(np.uint64), return_counts=True) for _ in range(6)]
    h, counts = simhash.added(parts)
    want = Counter()
    for p in parts:
        want.update(dict(zip(p[0].tolist(), p[1].tolist(), strict=True)))
    assert dict(zip(h.tolist(), counts.tolist(), strict=True)) == want and h.tolist() == sorted(want)

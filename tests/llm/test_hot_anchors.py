"""Anchors that occur very often: their contexts are narrowed and spread, and the result is that of brute force whatever the limit."""

import random

import numpy as np
import pytest
from tests.llm.plain import plain_later_bytes

from readloom.llm.substring_dedup import part_of
from readloom.llm.suffix_dedup import HOT, anchors, narrowed, repeated_anchors, without_repeated_bytes
from readloom.llm.util import _BYTE, BYTE_BASE, rolling

LINE = "Licensed under the terms that the file NOTICE gives in full."


def letters(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def texts(rng, n):
    """Documents with the line in different surroundings, in surroundings that some share, come twice, at either end, and after a text's own copy."""
    shared = [letters(rng, rng.choice((20, 50, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        before, after = (rng.choice((letters(rng, rng.randrange(150)), rng.choice(shared))) for _ in range(2))
        text = before + LINE + after
        out.append(rng.choice((text, text + text, LINE + after, before + LINE, letters(rng, 300), "x" * 250 + text, "")))
    return out


@pytest.mark.parametrize("hot", [2, 30, HOT])
def test_any_limit_gives_the_result_of_brute_force(spark, hot):
    rows = list(enumerate(texts(random.Random(11), 150)))
    rows += [(200 + i, t) for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_later_bytes(rows)
    assert sum(w[1] for w in want.values()) > 1000
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in without_repeated_bytes(docs, hot=hot).collect()}
    assert got == want


def test_how_often_anchors_occur(spark):
    rows = list(enumerate(texts(random.Random(12), 80)))
    found = repeated_anchors(spark.createDataFrame(rows, "_key long, text string").repartition(3), 100, 32, 10).where("_key < 0").collect()
    h = np.concatenate([anchors(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 100, 32)[4] for _, t in rows])
    have, n = np.unique(h & np.uint64(0xFFFFFFFFFF), return_counts=True)
    assert found and {-1 - r["_key"]: max(r["places"]) for r in found} == dict(zip(have[n >= 10].tolist(), n[n >= 10].tolist(), strict=True))


def test_parts_hold_each_window_once_and_equal_windows_meet():
    rng = random.Random(13)
    docs = [t.encode() for t in texts(rng, 60)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    _, at, first, wins, _ = anchors(data, offsets, 100, 32)
    which, begin, count, h = narrowed(rolling(_BYTE[data], BYTE_BASE), at, first, wins, 100, 32)
    whole = [(k, a) for k, (a, n) in enumerate(zip(first, wins, strict=True)) for a in range(a, a + n)]
    parts = [(int(k), a) for k, a, n in zip(which, begin, count, strict=True) for a in range(a, a + n)]
    assert sorted(parts) == whole
    hashes = {}
    for a, n, x in zip(begin, count, h, strict=True):
        for s in range(a, a + n):
            hashes.setdefault(data[s : s + 100].tobytes(), set()).add(int(x))
    assert all(len(x) == 1 for x in hashes.values())


def test_a_common_line_is_spread():
    """3,000 contexts of one line with their own bytes around it: one partition held them all."""
    rng = random.Random(14)
    docs = [(letters(rng, 100) + LINE + letters(rng, 100)).encode() for _ in range(3000)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    _, at, first, wins, h = anchors(data, offsets, 100, 32)
    have, n = np.unique(h, return_counts=True)
    mine = h == have[n.argmax()]
    assert n.max() > 1000 and len(np.unique(part_of(h[mine], 64))) == 1
    load = np.bincount(part_of(narrowed(rolling(_BYTE[data], BYTE_BASE), at[mine], first[mine], wins[mine], 100, 32)[3], 64), minlength=64)
    assert load.max() < 1.5 * np.median(load)

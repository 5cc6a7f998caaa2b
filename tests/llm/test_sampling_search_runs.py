"""Importance resampling, nearest neighbours and periodic runs against plain versions, and on nulls, ties, repeats, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from readloom.llm import importance, runs
from readloom.llm.importance import features, resampled
from readloom.llm.nearest import Lines, chance, lines, nearest, threshold
from readloom.llm.runs import first_smaller, next_smaller, periodic_runs, runs_of, suffix_order
from tests.llm.plain import plain_runs

RNG = random.Random(8)
VOCAB = ["".join(RNG.choice("abcdeéñ0") for _ in range(RNG.randint(1, 7))) for _ in range(40)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


SAME = prose(30)
TEXTS = [None, "", " \t-", "one", SAME, SAME, prose(19), prose(20), prose(500), "Rep-rep " * 90, "x" * 9000 + " y", "é漢🙂 " * 50, prose(25), prose(3000)]
ROWS = [(i, t, "en", 0, 1) for i, t in enumerate(TEXTS)] + [(4, SAME, None, None, None), (None, prose(40), None, None, None), (None, None, None, None, None)]
SCHEMA = "doc_id long, text string, rank string, _row long, n_words int"  # names that operators use themselves


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_features(text):
    w = split(text)
    return [zlib.crc32(" ".join(w[i : i + r]).encode()) % 10_000 for r in (1, 2, 3) for i in range(len(w) - r + 1)]


def plain_resampled(docs, target, share):
    s, t = (Counter(f for x in texts for f in plain_features(x)) for texts in ([r[1] for r in docs], target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n + 10_000) / ((s[b] + 1.0) * (m + 10_000))))
    rows = []
    for k, (i, text, *_) in enumerate(docs):
        f = plain_features(text)
        w = sum(map(gain, f))
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split(text)), k))
    some = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[5]: p for p, r in enumerate(some[: share * len(some) // 100], 1)}
    return Counter((*r[:4], rank.get(r[5])) for r in rows)


@pytest.mark.parametrize("share", [5, 50, 100])
def test_resampling_equals_the_plain_rule(spark, share):
    target = [(1, prose(200)), (2, None), (3, SAME)]
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = resampled(docs, spark.createDataFrame(target, "item_id long, text string"), share)
    assert Counter(map(tuple, got.collect())) == plain_resampled(ROWS, [t for _, t in target], share)


def test_resampling_of_nothing(spark):
    docs, none = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert resampled(none, docs).count() == 0
    assert Counter(map(tuple, resampled(docs, none, 100).collect())) == plain_resampled(ROWS, [], 100)


def test_features_of_long_words_and_odd_borders(monkeypatch):
    texts = ["ab", "cd", "", "A" * 300 + "B é", "-", "0/9:a@z`A[Z{", "x" * 96 + " " + "y" * 97, "é" * 400]
    for together in (1, 7, 96):
        monkeypatch.setattr(importance, "TOGETHER", together)
        data = [t.encode() for t in texts]
        bucket, row, n = features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert n.tolist() == [len(split(t)) for t in texts]
        assert all(sorted(bucket[row == i].tolist()) == sorted(plain_features(t)) for i, t in enumerate(texts))


# ---------------------------------------------------------------- nearest neighbours


def plain_nearest(rows, wanted, every):
    out = Counter()
    good = [(k, i, np.array(v, float) / max(map(abs, v))) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for k, i, v in good:
        if i is not None and i % every == 0:
            others = [((w * v).sum() / math.sqrt((w * w).sum() * (v * v).sum()), j) for n, j, w in good if n != k and len(w) == len(v)]
            for r, (s, j) in enumerate(sorted(others, key=lambda x: (-round(x[0], 12), x[1] is None, x[1] or 0))[:wanted], 1):
                out[(i, r, j, round(s, 9))] += 1
    return out


def told(frame):
    return Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in frame.collect())


def test_nearest_edges(spark):
    """Few enough rows, so that all neighbours are found: nulls, zeros, non-finite, other lengths, ties, copies, repeated and null ids."""
    rng = np.random.default_rng(3)
    v = [rng.normal(size=4).tolist() for _ in range(12)]
    rows = [(i, x) for i, x in enumerate(v)] + [(20, v[0]), (30, v[0]), (31, v[0]), (0, v[0]), (40, None), (50, [0.0] * 4), (60, [1.0, None, 2.0, 3.0]), (70, [float("nan")] * 4), (80, [1e300, 0.0, 0.0, 1.0])]
    rows += [(90, [1.0, 2.0]), (91, [2.0, 1.0]), (None, v[0]), (None, v[5]), (100, [float("inf"), 1.0, 1.0, 1.0]), (110, []), (120, [-x for x in v[0]])] + [(200 + i, v[1]) for i in range(9)]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cid int, score double")
    for wanted in (1, 5, 40):
        assert told(nearest(table, wanted, 10)) == plain_nearest(rows, wanted, 10)
    assert told(nearest(table, 5, 10, block=3, queries=2)) == plain_nearest(rows, 5, 10)
    assert nearest(table.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["spread", "clusters", "cone"])
def test_nearest_recall(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 32))
    if kind == "clusters":
        x = rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] + 0.1 * x
    if kind == "cone":
        x = x + 2.0
    table = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = told(nearest(table, 5, 50, block=512, queries=32))
    want = plain_nearest(list(enumerate(x.tolist())), 5, 50)
    assert sum((got & want).values()) >= 0.95 * sum(want.values())


def test_collisions_decide_what_is_verified(monkeypatch):
    """Far points don't reach the threshold, near ones do, and windows stop to grow when enough is near."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=64)
    near, far = centre + 0.05 * rng.normal(size=(10, 64)), rng.normal(size=(3000, 64))
    seen = []
    from readloom.llm import nearest as module

    plain = module.cosines
    monkeypatch.setattr(module, "cosines", lambda x, y: seen.append(len(x)) or plain(x, y))
    ((i, found, score),) = Lines(np.concatenate((far, near)), lines(64)).nearest(centre[None, :], np.array([0.2]), 5, threshold(64))
    assert set(found.tolist()) <= set(range(3000, 3010)) and len(found) == 5 and sum(seen) <= 10 and (np.diff(score) <= 0).all()
    assert 1 < threshold(64) < 64 and threshold(64, miss=0.2) > threshold(64, miss=0.001) and threshold(1) == 64 and abs(chance(10**6) - 0.7699) < 1e-3


# ---------------------------------------------------------------- runs


def sequence(rng):
    n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randrange(8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("rounds", [0, 8])
@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_the_plain_rule(monkeypatch, seed, rounds):
    monkeypatch.setattr(runs, "ROUNDS", rounds)
    rng = random.Random(seed)
    docs = [sequence(rng) for _ in range(rng.randint(0, 12))]
    ids, rows = np.array([x for d in docs for x in d], np.int64), np.cumsum([0, *map(len, docs)]).astype(np.int64)
    for least in (2, 12):
        got = list(zip(*(x.tolist() for x in runs_of(ids, rows, least)), strict=True))
        assert got == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d, least)]


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_and_smaller_values(seed):
    rng = random.Random(seed)
    docs = [sequence(rng) for _ in range(5)]
    ids, rows = np.array([x for d in docs for x in d], np.int64), np.cumsum([0, *map(len, docs)]).astype(np.int64)
    place, lcp = suffix_order(ids, rows)
    order = sorted((k, d[i:], rows[k] + i) for k, d in enumerate(docs) for i in range(len(d)))
    assert np.argsort(place).tolist() == [x[2] for x in order]
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0 if not k or order[k - 1][0] != order[k][0] else shared(order[k - 1][1], order[k][1]) for k in range(len(order))]
    values, ends = np.array(rng.sample(range(500), len(ids)), np.int64), np.repeat(rows[1:], np.diff(rows))
    want = [next((j for j in range(i + 1, e) if values[j] < values[i]), e) for i, e in enumerate(ends.tolist())]
    assert next_smaller(values, ends).tolist() == want
    if len(ids):
        free = first_smaller(values, np.arange(1, len(ids) + 1), values)
        assert np.minimum(free, ends).tolist() == want


def test_run_rows(spark):
    line = "the same line again "
    texts = [None, "", " \n", "a " * 11, "a " * 12, line * 3, line * 2, "b " + line * 5 + "the same end", "A a " * 9, prose(50) + " " + prose(9) * 3, prose(400)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(4, "a " * 12, 0, ""), (None, "z\x0bz " * 8, 0, "")]
    for planted in (False, True):
        want = Counter()
        for i, t, *_ in rows:
            w, h = re.findall("[^\x20\x09-\x0d]+", t or ""), zlib.crc32(b"" if i is None else str(i).encode())
            w = [w[k] for k in runs.periodic_tail(len(w), h)] if planted else w
            found = plain_runs(w, 12)
            gone = {k for s, n, p in found for k in range(s + p, s + n)}
            best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
            want[(i, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
        docs = spark.createDataFrame(rows, "doc_id long, text string, start int, period string").repartition(2)
        assert Counter(map(tuple, periodic_runs(docs, planted).collect())) == want
    assert periodic_runs(docs.limit(0)).count() == 0
    assert periodic_runs(docs.where("doc_id = 4")).first()["collapsed_sha256"] == sha("a")


def test_runs_of_a_long_text(spark):
    """A text of 200,000 words, half of it one period, and one without any run."""
    rng = random.Random(1)
    odd = [str(rng.randrange(5000)) for _ in range(100_000)]
    text = " ".join(odd + [odd[i % 30_000] for i in range(100_000)])
    got = {r["doc_id"]: r for r in periodic_runs(spark.createDataFrame([(1, text), (2, " ".join(odd))], "doc_id long, text string")).collect()}
    assert got[1]["n_runs"] >= 1 and got[1]["period"] == 30_000 and got[1]["length"] >= 100_000 and got[2]["n_runs"] == 0

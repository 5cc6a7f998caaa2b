"""Stretches of k-mers and runs of seeds: the same seeds and bands as the joins of rows, in a part of their bytes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import stretches as S
from readloom.operators import overlaps as O
from readloom.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most, seeds", [(1 << 17, 1 << 21), (60, 5)])
def test_runs_are_the_seeds_of_all_pairs(monkeypatch, most, seeds):
    monkeypatch.setattr(S, "SEEDS", seeds)
    monkeypatch.setattr(S, "windows", lambda column, k: tables.windows(column, k, most))
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    shared = [word(n) for n in (20, 25, 70, 200)] + ["A" * 40, "ACG" * 20]
    texts = ["".join(x for _ in range(4) for x in (word(rng.randrange(30)), rng.choice(shared))) for _ in range(30)]
    kind = np.array([n % 3 for n in range(30)])
    row, place, by, told = (np.concatenate(c) for c in zip(*S.stretches(pa.array(texts), 20), strict=True))
    got = []
    for m in np.unique(by):
        here = by == m
        for a, b, c, apos, diag, n in S.seed_runs(row[here], place[here], told[here], kind[row[here]], 20, 40):
            got += [(int(x), int(y), int(p) + i, int(p) - int(d) + i) for x, y, p, d, k in zip(a, b, apos, diag, n, strict=True) for i in range(k)]
    of = {}
    for r, t in enumerate(texts):
        for i in range(len(t) - 19):
            of.setdefault(t[i : i + 20], ([], []))[int(kind[r] > 0)].append((r, i + 20))
    want = [(x, y, p, q) for a, b in of.values() if len(a) * len(b) < 40 for x, p in a for y, q in b]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("turns", [1, 3])
def test_living_stretches_make_the_same_runs_in_turns(turns):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    shared = [word(n) for n in (20, 25, 70, 200)] + ["A" * 40]
    texts = ["".join(x for _ in range(3) for x in (word(rng.randrange(60)), rng.choice(shared))) for _ in range(40)]
    kind = np.array([n % 3 for n in range(40)])
    row, place, by, told = (np.concatenate(c) for c in zip(*S.stretches(pa.array(texts), 20), strict=True))
    said = lambda runs: sorted(tuple(map(int, r)) for run in runs for r in zip(*run, strict=True))
    want, got, gone, seeds = [], [], 0, 0
    for m in np.unique(by):
        columns = [c[by == m] for c in (row, place, told, kind[row])]
        want += said(S.seed_runs(*columns, 20, 60))
        alive, n = S.living(columns[2], columns[3], 20, 60)
        gone, seeds, here = gone + int((alive == 0).sum()), seeds + n, alive > 0
        for t in range(turns):
            mine = here & ((columns[3] > 0) | (S.mixed(columns[0]) % turns == t))
            got += said(S.seed_runs(*(c[mine] for c in columns), 20, 60, alive[mine]))  # counts of capped codes have changed, their k-mers stay dead
    assert sorted(got) == sorted(want) and gone > 0 and seeds == sum(r[-1] for r in want)


def test_no_turn_puts_all_runs_on_disk(spark, monkeypatch):
    live, buckets, n = O.live_stretches(spark, SF, 300, True)
    size = lambda *t: O.runs_of(live, buckets, 300, *t).agg(F.sum(F.length("data"))).first()[0]
    assert max(size(t, 6) for t in range(6)) < 0.6 * size()
    seeds, made, runs_of = live.agg(F.sum("seeds")).first()[0], [], O.runs_of
    want = O.strong_bands(spark, SF, 300, True).collect()
    monkeypatch.setattr(O, "TURN_BYTES", 1)
    monkeypatch.setattr(O, "SEED_BYTES", 2.5 * (n // 2) / seeds)
    monkeypatch.setattr(O, "runs_of", lambda *x: made.append(x[3:]) or runs_of(*x))
    assert sorted(map(tuple, O.strong_bands(spark, SF, 300, True).collect())) == sorted(map(tuple, want)) and made == [(0, 3), (1, 3), (2, 3)]


def test_columns_survive_packing():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-(1 << 63), (1 << 63) - 1, 1000), np.arange(1000), np.full(1000, -5)]
    assert all((a == b).all() for a, b in zip(S.unpacked(S.packed(*columns), 3), columns, strict=True))


@pytest.mark.parametrize("strands", [False, True])
def test_bands_of_runs_are_the_bands_of_seeds(spark, strands):
    keys = ["aread", "bread", "comp", "band"]
    want = O.boxes(O.overlap_seeds(spark, SF, 300, strands), *keys)
    got = O.strong_bands(spark, SF, 300, strands).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_runs_are_a_part_of_the_bytes_of_seeds(spark):
    packed = O.packed_runs(spark, SF).agg(F.sum(F.length("data"))).first()[0]
    assert packed < 5 * O.overlap_seeds(spark, SF).count()  # a seed as a row is 40 bytes and more


def test_what_was_shuffled_is_removed(spark, tmp_path):
    from readloom.sources.scratch import CLEANUP, stored

    assert stored(lambda: spark.range(100).repartition(3)).count() == 100 and spark.conf.get(CLEANUP) == "false"


def test_only_what_is_read_again_stays_on_disk(spark, tmp_path, monkeypatch):
    from readloom.sources import scratch

    monkeypatch.setattr(scratch, "scratch_path", lambda _: str(tmp_path / f"{len(made)}-{made.append(0)}"))
    made = []
    bands = O.strong_bands(spark, SF)
    assert len(made) == O.TURNS + 1 and len(list(tmp_path.iterdir())) == 1 and bands.count()  # the stretches are gone
    boxed = O._boxed(spark, SF)
    assert len(made) == 2 * O.TURNS + 4 and len(list(tmp_path.iterdir())) == 3 and boxed.count() == bands.count()
    monkeypatch.setattr(O, "reads", None)
    monkeypatch.setattr(O, "strong_bands", lambda *_: bands)
    assert O.entwine(spark, SF).count()  # reads no sequence


def test_boxes_are_cut_in_turns_and_none_stays(spark, tmp_path, monkeypatch):
    from readloom.sources import scratch

    keys = ["aread", "bread", "band", "diffs", "trace"]
    queries = [lambda: O.overlaps(spark, SF).select(keys), lambda: O.mid_traces(spark, SF)]
    want = [sorted(map(tuple, q().collect())) for q in queries]
    bands = O.strong_bands(spark, SF)
    bases = bands.agg(F.sum(F.col("aepos") - F.col("abpos"))).first()[0]
    bands._bases = -(-bases // 4)  # as if the boxes had four times the bases of all sequences
    monkeypatch.setattr(O, "TURN_BYTES", 1)
    monkeypatch.setattr(O, "strong_bands", lambda *_: bands)
    monkeypatch.setattr(scratch, "scratch_path", lambda _: str(tmp_path / f"{len(made)}-{made.append(0)}"))
    held, stored = [], O.stored
    monkeypatch.setattr(O, "stored", lambda df: (out := stored(df), held.append(sum(len(r.a) for r in out.select("a").collect()) if "a" in out.columns else 0))[0])
    made = []
    for n, q in enumerate(queries, 1):
        assert sorted(map(tuple, q().collect())) == want[n - 1] and len(made) == 8 * n and len(list(tmp_path.iterdir())) == 4 * n
    assert sum(held[:8]) == bases and max(held) < 0.6 * bases

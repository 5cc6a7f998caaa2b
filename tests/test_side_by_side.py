"""Alignments of many bands side by side, of packed runs, once for equal sequences: the rows are those of each band by itself."""

import random

import pytest

from readloom.functions import alignments as A
from readloom.operators import overlaps as O
from tests.test_alignments import bases, noisy
from tests.test_pebbles import SPEC, pair


def _bands(rng):
    pairs, bands = [], []
    for seed in range(12):
        a, b, i, j = pair(seed, share=rng.choice([0.02, 0.12, 0.3]), core=rng.choice([100, 400, 900]))
        pairs.append((a, b))
        bands.append((seed, sorted({(i, j), *((rng.randrange(20, len(a)), rng.randrange(20, len(b))) for _ in range(9)), *((min(len(a), i + d), min(len(b), j + d)) for d in range(0, 300, 30))})))
    a = bases(rng, 800)
    return [*pairs, (a, a), ("A" * 300, "C" * 300)], [*bands, (12, [(20, 20), (400, 400), (800, 800)]), (13, [(150, 150)]), (0, [])]


@pytest.mark.parametrize("spacing, at_once", [(None, 2000), (100, 2000), (7, 3)])
def test_many_bands_are_each_by_itself(monkeypatch, spacing, at_once):
    monkeypatch.setattr(A, "AT_ONCE", at_once)
    pairs, bands = _bands(random.Random(1))
    got = A.walked_together(pairs, bands, SPEC, 20, 60, spacing)
    want = [A.walked_traces(*pairs[p], seeds, SPEC, 20, 60, spacing or len(pairs[p][0]) + 1) for p, seeds in bands]
    assert got == want and sum(map(len, want)) > 12
    asked = [(p, ahead, *seeds[0]) for p, seeds in bands if seeds for ahead in (True, False)]
    far = [A.reach(a[i:], b[j:], SPEC) if ahead else A.reach(a[:i][::-1], b[:j][::-1], SPEC) for p, ahead, i, j in asked for a, b in [pairs[p]]]
    assert A.reached_together(pairs, asked, SPEC) == far


@pytest.mark.parametrize("seed", range(20))
def test_scripts_of_arrays_are_those_of_dictionaries(monkeypatch, seed):
    rng = random.Random(seed)
    core = bases(rng, rng.randrange(400))
    a, b = bases(rng, rng.randrange(60)) + core, noisy(rng, core, 0.2) + bases(rng, rng.randrange(60))
    monkeypatch.setattr(A, "NARROW", 1 << 30)
    want = A.edit_script(a, b, 3, 5)
    for narrow in (1, 5, 16):
        monkeypatch.setattr(A, "NARROW", narrow)
        assert A.edit_script(a, b, 3, 5) == want


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("copied"), random.Random(8)
    core = [bases(rng, 400).lower() for _ in range(3)]
    texts = [noisy(rng, c.upper(), 0.03).lower() for c in core for _ in range(4)]
    rows = [(n, texts[n % 12]) for n in range(60)] + [(61, None), (63, ""), (-1, texts[0]), (-2, texts[0]), (None, texts[0]), (7, texts[1])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("strands", [False, True])
def test_equal_sequences_are_cut_once_and_have_all_their_bands(spark, copied, strands):
    keys = ["aread", "bread", "comp", "band"]
    want = O.boxes(O.overlap_seeds(spark, copied, strands=strands), *keys)
    got = O.strong_bands(spark, copied, strands=strands).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    seeds = O.live_stretches(spark, copied, O.MOST_CAP, strands)[0].agg({"seeds": "sum"}).first()[0]
    assert 5 * seeds < O.overlap_seeds(spark, copied, strands=strands).count()


def test_no_seed_is_a_row(spark, copied, monkeypatch):
    monkeypatch.setattr(O, "overlap_seeds", None)
    boxes = {(r["aread"], r["bread"], r["band"]) for r in O.strong_bands(spark, copied).collect()}
    found = O.local_alignments(spark, copied).collect()
    assert {(r["aread"], r["bread"], r["band"]) for r in found} == boxes
    assert {(r["aread"], r["bread"], r["band"]) for r in O.extensions(spark, copied).collect()} == boxes
    assert O.nonredundant(spark, copied).count() >= len({b[:2] for b in boxes})

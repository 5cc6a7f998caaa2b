"""Alignment helpers, chains, zones, fusion, records and the quality codec against plain versions and on edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions.alignments import align_spec, aligned, edit_script, local_alignment, rendered, trace_points, walked
from readloom.functions.huffman import ESCAPE, MOST_BITS, decode, encode, runs, scheme, unrun
from readloom.operators.catalog import guarded, reduced_extras
from readloom.operators.overlaps import chain_links, fused, read_records, write_records, zones
from readloom.operators.quality_values import read_quiva


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def noisy(rng, text, share):
    out = []
    for c in text:
        r = rng.random() / share
        out.append("" if r < 1 / 3 else c + rng.choice("ACGT") if r < 2 / 3 else rng.choice("ACGT") if r < 1 else c)
    return "".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_scripts_are_best_and_whole(seed):
    rng = random.Random(seed)
    a = bases(rng, rng.randint(0, 60))
    b = noisy(rng, a, 0.3) if seed % 2 else bases(rng, rng.randint(0, 40))
    diffs, gaps = edit_script(a, b)
    x, y = aligned(a, b, gaps)
    assert diffs == distance(a, b) == sum(p != q for p, q in zip(x, y, strict=True))
    assert x.replace("-", "") == a and y.replace("-", "") == b
    assert edit_script(a, b, 100, 200)[1] == [g - 100 if g < 0 else g + 200 for g in gaps]
    trace = trace_points(a, b, 7, 3)
    assert sum(d for d, _ in trace) == diffs and sum(s for _, s in trace) == len(b)
    assert len(trace) == ((3 + len(a) - 1) // 7 - 3 // 7 + 1 if a else 1)
    assert rendered(a, b, gaps, 1000).count("*") == diffs


@pytest.mark.parametrize("seed", range(12))
def test_origins_are_recovered(seed):
    """A stretch of a contig with 12 % errors, between unlike flanks, is found from one exact seed."""
    rng = random.Random(seed)
    spec = align_spec(0.85, 0.5)
    assert spec == (9, 51, 150, 850)
    core = bases(rng, 1200)
    a = bases(rng, 200) + core + bases(rng, 200)
    before = bases(rng, 150) + noisy(rng, core[:600], 0.12)
    b = before + core[600:620] + noisy(rng, core[620:], 0.12) + bases(rng, 150)
    a0, a1, b0, b1 = local_alignment(a, b, 810, len(before) + 10, spec)
    assert abs(a0 - 200) < 60 and abs(a1 - 1400) < 60 and abs(b0 - 150) < 70
    assert edit_script(a[a0:a1], b[b0:b1])[0] <= 0.16 * (a1 - a0)
    assert walked(a, b, [(820, len(before) + 20), (815, len(before) + 15)], spec, 20, 60) == [(a0, a1, b0, b1)]


def test_alignment_of_nothing_in_common():
    assert local_alignment("A" * 300, "C" * 300, 150, 150, align_spec(0.85, 0.5)) == (150, 150, 150, 150)
    assert edit_script("", "") == (0, []) and edit_script("AC", "") == (2, [1, 1])


def test_chains_go_on_with_what_scores_best():
    rows = [(5000, 6000, 5010, 6010, 20), (2000, 4900, 2010, 4900, 100), (0, 1000, 0, 1000, 0), (900, 1900, 90_000, 91_000, 0)]
    rows.sort(key=lambda r: (-r[0], -r[2]))
    links = chain_links(rows)
    assert links[0] == (954, -1) and links[1] == (int(954 + 2900 - 230), 0)
    assert links[3] == (int(links[1][0] + 1000), 1) and links[2][1] == -1
    assert chain_links([]) == [] and chain_links([(0, 100, 0, 100, 60)]) == [(-38, -1)]


def plain_links(rows):
    """The rule said plainly: of all later overlaps that may follow, tried from the nearest on, the first stays unless another is clearly better."""
    out = []
    for c, (a0, a1, b0, b1, diffs) in enumerate(rows):
        own = a1 - a0 - 2.3 * diffs
        score, gap, link = int(own), 0, -1
        for d in range(c)[::-1]:
            p, q = rows[d][0] - a1, rows[d][2] - b1
            if rows[d][2] >= b0 and p > -400 and q > -400 and 1 / 1.4 <= (p + 500) / (q + 500) <= 1.4:
                total = int(out[d][0] + own)
                clearly, nearly = total > score + 50, score - 50 <= total <= score + 50
                nearer = p < gap - 500
                alike = gap - 500 <= p <= gap + 500
                if clearly or (nearly and (nearer or (alike and (total > score or (total == score and p < gap))))):
                    score, gap, link = total, p, d
        out.append((score, link))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_chains_equal_the_plain_rule(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(rng.randint(0, 40)):
        a, b, n = rng.randrange(6000), rng.randrange(6000), rng.randint(60, 900)
        b = a + rng.randint(-300, 300) if seed % 2 else b
        rows.append((a, a + n, b, b + n + rng.randint(-20, 20), rng.randrange(n // 4)))
    rows.sort(key=lambda r: (-r[0], -r[2]))
    assert chain_links(rows) == plain_links(rows)


def test_zones_hold_what_overlaps_their_first_chain():
    got = zones([(1000, 0, 1000, 1), (990, 50, 900, 2), (900, 10, 990, 3), (1000, 0, 1000, 4), (500, 950, 2000, 5), (100, 1880, 2500, 6)])
    assert got == [(1, 0, True), (4, 0, True), (2, 0, False), (5, 1, True)]  # 3 scores too little, 6 lies in zone 1


def test_fusion_splices_and_drops():
    one = {"abpos": 0, "aepos": 350, "bbpos": 0, "bepos": 350, "diffs": 9, "points": {100: (100, 2), 200: (201, 5), 300: (300, 8)}}
    two = {"abpos": 150, "aepos": 600, "bbpos": 150, "bepos": 601, "diffs": 20, "points": {200: (200, 1), 300: (300, 4), 400: (400, 9), 500: (500, 15)}}
    (both,) = fused([one, two])
    assert (both["abpos"], both["aepos"], both["bbpos"], both["bepos"], both["diffs"]) == (0, 600, 0, 601, 8 + 20 - 4)
    assert both["points"] == {100: (100, 2), 200: (201, 5), 300: (300, 8), 400: (400, 13), 500: (500, 19)}
    inside = {"abpos": 120, "aepos": 340, "bbpos": 120, "bepos": 340, "diffs": 6, "points": {300: (300, 5)}}
    assert fused([one, inside]) == [one]
    apart = {**two, "points": {300: (310, 4)}}
    assert len(fused([one, apart])) == 2 and fused([]) == []


def test_records_come_back(spark):
    rows = [(1, 2, 3, 0, 250, 5, 260, 7, [(3, 100), (0, 105), (4, 50)]), (1, 2, 4, 0, 90, 0, 400, 300, [(300, 400)]), (1, 2, 5, 0, 1, 0, 0, 0, [])]
    shape = "aread long, bread long, band long, abpos long, aepos long, bbpos long, bepos long, diffs long, trace array<struct<d:long,b:long>>"
    packed = write_records(spark.createDataFrame(rows, shape))
    assert sorted(r["small"] for r in packed.collect()) == [False, True, True]
    back = sorted((*r[:8], [tuple(t) for t in r["trace"]]) for r in read_records(packed).collect())
    assert back == rows


@pytest.mark.parametrize("seed", range(20))
def test_prefix_codes(seed):
    rng = random.Random(seed)
    counts = {s: int(1.9 ** rng.uniform(0, 40 if seed % 2 else 4)) + 1 for s in rng.sample(range(255), rng.randint(1, 60))}
    codes = scheme(counts)
    assert max(map(len, codes.values())) <= MOST_BITS and (ESCAPE in codes or set(codes) == set(counts))
    words = sorted(codes.values())
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    text = [rng.choice(list(counts)) for _ in range(500)]
    assert decode(encode(text, codes), len(text), codes) == text and decode(b"", 0, codes) == [] == decode(encode([], codes), 0, codes)


def test_runs():
    for text in ([], [1], [2], [1] * 700, [2, 2, 1, 1, 1, 2], [1] * 255 + [2], [1] * 256):
        pairs = runs(text, 1)
        assert unrun(pairs, 1) == text and all(n <= 255 for n, _ in pairs)
    for n in (0, 1, 254, 255, 256, 300, 511, 512, 700):  # what the histogram of runs counts on
        assert [k for k, _ in runs([1] * n, 1)] == [255] * (n // 256) + [n % 256]


def test_guards_fail(spark):
    table = spark.createDataFrame([("ACGTACGT",), ("ACG",)], "seq string")
    assert guarded(table, 3).count() == 2 and len(guarded(table, 3).collect()) == 2
    with pytest.raises(Exception, match="shorter than 4"):
        guarded(table, 4).collect()
    extras = spark.createDataFrame([("n", "int", "sum", 2), ("n", "int", "sum", 3), ("k", "int", "exact", 20), ("k", "int", "exact", 20)], "name string, vtype string, accum string, value long")
    assert {r["name"]: r["value"] for r in reduced_extras(extras).collect()} == {"n": 5, "k": 20}
    with pytest.raises(Exception, match="disagree on k"):
        reduced_extras(extras.unionByName(spark.createDataFrame([("k", "int", "exact", 21)], extras.schema))).collect()
    lines = spark.createDataFrame([("@m/7/0_3\n!!!\nnnn\n###\n+++\n555",), ("@m/8/0_3\n!!!\nnn\n###\n+++\n555",)], "value string")
    assert read_quiva(lines.where("value like '@m/7%'")).first()["well"] == 7
    with pytest.raises(Exception, match="unequal length: @m/8"):
        read_quiva(lines).select(F.max("del")).collect()

"""Traces out of the search's own waves: whole boxes, no fewer differences than a best script has, the same ends as without pebbles."""

import random

import pytest

from readloom.functions.alignments import SHORT, align_spec, local_alignment, pebbled, reach, trace_points, walked, walked_traces, waves
from readloom.operators.overlaps import SPACE, pebbled_alignments
from tests.test_alignments import bases, distance, noisy
from tests.test_queries import SF

SPEC = align_spec(0.85, 0.5)


def pair(seed, share=0.12, core=900, flank=150):
    rng = random.Random(seed)
    middle = bases(rng, core)
    x, y = noisy(rng, middle[: core // 2], share), noisy(rng, middle[core // 2 :], share)
    a, b = bases(rng, flank) + middle + bases(rng, flank), bases(rng, 80) + x + y + bases(rng, flank)
    return a, b, flank + core // 2, 80 + len(x)


def checked(a, b, box, diffs, trace, spacing):
    a0, a1, b0, b1 = box
    marks = [a0, *range(a0 // spacing * spacing + spacing, a1, spacing), a1]
    assert len(trace) == len(marks) - 1 and sum(d for d, _ in trace) == diffs and sum(s for _, s in trace) == b1 - b0
    at = b0
    for (d, step), p, q in zip(trace, marks[:-1], marks[1:], strict=True):
        assert step >= 0 and d >= distance(a[p:q], b[at : at + step])
        at += step


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("spacing", [1, 7, 100])
def test_traces_are_whole_and_no_better_than_the_best(seed, spacing):
    a, b, i, j = pair(seed, core=400)
    box, diffs, trace = pebbled(a, b, i, j, SPEC, spacing)
    assert box == local_alignment(a, b, i, j, SPEC) and box[1] - box[0] > 300
    checked(a, b, box, diffs, trace, spacing)
    best = distance(a[box[0] : box[1]], b[box[2] : box[3]])
    assert best <= diffs <= 1.1 * best + 2
    whole = trace_points(a[box[0] : box[1]], b[box[2] : box[3]], spacing, box[0])
    assert len(whole) == len(trace) and sum(d for d, _ in whole) == best


def test_no_differences_and_origins_on_a_place():
    a = bases(random.Random(1), 600)
    for i in (200, 300, 355):
        assert pebbled(a, a, i, i, SPEC, 100) == ((0, 600, 0, 600), 0, [(0, 100)] * 6)
    assert pebbled(a[50:], a[50:], 300, 300, SPEC, 100)[2] == [(0, 100)] * 5 + [(0, 50)]
    assert waves(a[:100], a[:100], SPEC, 100, 100) == (100, 100, 0, []) and waves("", "", SPEC, 10, 10) == (0, 0, 0, [])
    assert waves(a[:120], a[:120], SPEC, 50, 20) == (120, 120, 0, [(20, 20, 0), (70, 70, 0)])


def test_short_sides_are_sought_again_and_short_both_leave_nothing():
    rng = random.Random(2)
    core = bases(rng, 500)
    a, b = core + bases(rng, 200), core + bases(rng, 200)
    for i in (480, 498):  # little of the core lies ahead
        box, diffs, trace = pebbled(a, b, i, i, SPEC, 100)
        assert box[0] == box[2] == 0 and 470 <= box[1] <= 530 and reach(a[i:], b[i:], SPEC)[0] < SHORT
        checked(a, b, box, diffs, trace, 100)
        back = pebbled(a[::-1], b[::-1], 700 - i, 700 - i, SPEC, 100)
        assert back[0][1] == back[0][3] == 700
        checked(a[::-1], b[::-1], *back, 100)
    assert pebbled("A" * 300, "C" * 300, 150, 150, SPEC, 100) == ((150, 150, 150, 150), 0, [(0, 0)])


def test_walks_have_the_same_boxes():
    a, b, i, j = pair(3)
    seeds = [(i + 8, j + 8), (40, 900), (i + 8 - 200, j + 8 - 198)]
    found = walked_traces(a, b, seeds, SPEC, 14, 50, 100)
    assert found and [x[0] for x in found] == walked(a, b, seeds, SPEC, 14, 50)
    for x in found:
        checked(a, b, *x, 100)


def test_query(spark):
    rows = pebbled_alignments(spark, SF).collect()
    assert rows and any(r["comp"] for r in rows)
    for r in rows:
        trace = [tuple(map(int, t.split(":"))) for t in r["trace"].split(",")]
        assert sum(d for d, _ in trace) == r["diffs"] >= r["best"] and sum(s for _, s in trace) == r["bepos"] - r["bbpos"]
        assert len(trace) == (r["aepos"] - 1) // SPACE - r["abpos"] // SPACE + 1

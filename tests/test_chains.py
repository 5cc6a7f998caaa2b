"""Chaining against a plain quadratic version of its rule, and on simple cases."""

import random

import pytest

from readloom.operators.chains import LOOK_BACK, chain

K = 12


def plain(seeds, least):
    nodes, best, gone = [], {}, set()
    for at, (a, b) in enumerate(seeds):
        diag = a - b
        live = [n for n in nodes if n["a"] >= a - LOOK_BACK and n["at"] not in gone]
        left = [n for n in live if n["d"] > diag and n["b"] >= b - LOOK_BACK]
        right = [n for n in live if n["d"] <= diag and n["b"] <= b]
        choice = None
        if left:
            n = max((n for n in left if n["d"] == min(x["d"] for x in left)), key=lambda n: n["at"])
            choice = (n["s"] + min(K, a - n["a"]), n)
        if right:
            n = max((n for n in right if n["d"] == max(x["d"] for x in right)), key=lambda n: n["at"])
            s = n["s"] + min(K, b - n["b"])
            if choice is None or s >= choice[0]:
                choice = (s, n)
        score, start = (choice[0], choice[1]["start"]) if choice else (K, at)
        if start not in best or score >= best[start][0]:
            best[start] = (score, at)
            if choice and abs(diag - choice[1]["d"]) <= 0.2 * (a - choice[1]["a"]):
                gone.add(choice[1]["at"])
        nodes.append({"a": a, "b": b, "d": diag, "s": score, "start": start, "at": at})
    out = [(s, seeds[o][0] - K, seeds[e][0], seeds[o][1] - K, seeds[e][1]) for o, (s, e) in best.items() if s >= least]
    return sorted(out, key=lambda x: (-x[0], *x[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_chain_equals_the_plain_rule(seed):
    rng = random.Random(seed)
    seeds = sorted({(rng.randint(K, 3000), rng.randint(K, 600)) for _ in range(rng.randint(2, 80))})
    assert chain(seeds, K, 24) == plain(seeds, 24)


def test_a_straight_run_is_one_chain():
    seeds = [(100 + i, 50 + i) for i in range(30)]
    assert chain(seeds, K, 24) == [(K + 29, 88, 129, 38, 79)]


def test_single_seed_and_none():
    assert chain([(20, 20)], K, 24) == [] and chain([], K, 24) == []

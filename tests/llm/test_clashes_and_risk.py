"""Columns whose names clash with an operator's own, repeated ids in a training sample, and the risk's gradient against differences."""

import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from readloom.llm import quality
from readloom.llm.bpe import bpe_decode, bpe_encode
from readloom.llm.packing import pack

BYTE = path("byte_bpe_50k.json")


def test_pack_passes_clashing_columns_through(spark):
    names = ["_before", "_chunk", "_rank", "_n", "_first", "c0", "c7"]
    rows = [(i % 50 + 1, *[f"{n}{i}" for n in names], 9, 9) for i in range(300)]
    items = spark.createDataFrame(rows, "length int, " + ", ".join(f"{n} string" for n in names) + ", sequence_id long, offset long")
    got = pack(items, 64)
    assert got.columns == ["length", *names, "sequence_id", "offset"]
    found = got.collect()
    assert sorted(tuple(r)[:-2] for r in found) == sorted(r[:-2] for r in rows)
    placed = {}
    for r in found:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_pack_of_nothing(spark):
    got = pack(spark.createDataFrame([], "_before string, length int"), 64)
    assert got.columns == ["_before", "length", "sequence_id", "offset"] and got.count() == 0


def test_encode_and_decode_in_place(spark):
    docs = spark.createDataFrame([(1, "a b  c"), (2, ""), (3, None)], "doc_id long, text string")
    ids = bpe_encode(docs, BYTE, ids="text")
    assert ids.columns == ["doc_id", "text"] and ids.where("doc_id = 1").select(F.size("text")).first()[0] > 0
    back = bpe_decode(ids, BYTE, ids="text", text="text")
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "a b  c", 2: "", 3: ""}


def risk(w, x, is_p, prior):
    """Both parts of the risk, by its formula."""
    out = np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
    one, zero = np.log1p(np.exp(-out)), np.log1p(np.exp(out))
    return prior * one[is_p].mean(), zero[~is_p].mean() - prior * zero[is_p].mean()


@pytest.mark.parametrize("prior, below", [(0.3, False), (0.95, True)])
def test_gradients_are_those_of_the_risk(prior, below):
    rng = np.random.default_rng(1)
    x, is_p = rng.normal(size=(40, 5)), np.arange(40) < 15
    x[is_p] += 1.5
    w = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), np.array(0.1)]
    w[2] = w[2] * np.sign((np.tanh(x @ w[0] + w[1])[is_p].mean(0) - np.tanh(x @ w[0] + w[1])[~is_p].mean(0)) * w[2])  # positives score higher
    grads, negative = quality.gradients(w, x, is_p, prior)
    first, second = risk(w, x, is_p, prior)
    assert negative == pytest.approx(second) and (second < 0) == below
    stepped = lambda v: -risk(v, x, is_p, prior)[1] if below else sum(risk(v, x, is_p, prior))
    for i, g in enumerate(grads):
        for at in np.ndindex(w[i].shape):
            sides = []
            for d in (1e-5, -1e-5):
                moved = [v.copy() for v in w]
                moved[i][at] += d
                sides.append(stepped(moved))
            assert np.asarray(g)[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_a_repeated_id_is_one_text_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: seen.append((len(p), len(u), prior)))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    docs = spark.createDataFrame([(i, f"text {k}") for i in ids for k in range(40)] + [(ids[0], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in ids[:3])) for i in ids] * 2, "doc_id long, quality int")
    quality.train(docs, labels)
    assert seen == [(3, 6, 0.5)]

"""The candidate stream: any split of the contigs over files, micro-batches and runs gives what the batch queries give."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readloom.operators.seeds import NEAR, band_candidates
from readloom.sources.tables import contigs, kmers, reads
from readloom.streaming.candidates import SEED_K, CandidateStream, bands_of, read_index

LEAST = 3 * SEED_K


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Twelve contigs, three of them equal, and reads of pieces of them; one read is of no contig, one is null."""
    folder, rng = tmp_path_factory.mktemp("planted"), random.Random(3)
    made = ["".join(rng.choice("acgt") for _ in range(rng.randint(80, 300))) for _ in range(10)]
    made += [made[0], made[0]]
    noise = lambda s: "".join(c if rng.random() > 0.02 else rng.choice("acgt") for c in s)
    texts = [noise("".join(made[rng.randrange(12)][rng.randrange(40) :] for _ in range(rng.randint(1, 5)))) for _ in range(30)] + ["acgt" * 3, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(made)), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def wanted(spark, planted):
    a = kmers(reads(spark, planted), "read_id", SEED_K).select(F.col("read_id").alias("aread"), (F.col("rpos") + 1).alias("apos"), "code")
    b = kmers(contigs(spark, planted), "contig_id", SEED_K).select(F.col("contig_id").alias("bread"), (F.col("rpos") + 1).alias("bpos"), "code")
    seeds = a.join(b, "code").select("aread", "bread", "apos", "bpos", (F.col("apos") - F.col("bpos")).alias("diag"))
    found = band_candidates(seeds).toPandas()
    out = {}
    for read, rows in found.groupby("aread"):
        best = min((-r.covered, r.bread, r.band) for r in rows.itertuples())
        strong = rows[rows["covered"] >= LEAST]
        depth = [sum(1 for r in strong.itertuples() if r.afirst // 100 <= k < (r.alast - 1) // 100 + 1) for k in range(30)]
        out[read] = (best[1], best[2], -best[0], int((rows["covered"] >= NEAR * -best[0]).sum()), len(rows), len(strong), max(depth))
    return out


def result(stream):
    return {r["aread"]: tuple(r)[1:] for r in stream.latest().select("aread", "bread", "band", "covered", "near", "candidates", "significant", "deepest").collect()}


@pytest.mark.parametrize("split, files, broadcast", [([12], 1, True), ([1] * 12, 5, False), ([3, 4, 5], 1, True)])
def test_any_split_gives_the_batch_result(spark, planted, wanted, tmp_path, split, files, broadcast):
    incoming, at = str(tmp_path / "incoming"), 0
    table = contigs(spark, planted).select("contig_id", "seq", "clen")
    stream = CandidateStream(read_index(spark, planted), incoming, str(tmp_path / "stream"), files, broadcast)
    for n in split:
        table.where(F.col("contig_id").between(at, at + n - 1)).coalesce(1).write.mode("append").parquet(incoming)
        at += n
    stream.advance()
    assert result(stream) == wanted and len(wanted) >= 20


def test_goes_on_where_it_ended(spark, planted, wanted, tmp_path):
    incoming, table = str(tmp_path / "incoming"), contigs(spark, planted).select("contig_id", "seq", "clen")
    for lo, hi in ((8, 11), (0, 3), (4, 7)):
        table.where(F.col("contig_id").between(lo, hi)).coalesce(1).write.mode("append").parquet(incoming)
        stream = CandidateStream(read_index(spark, planted), incoming, str(tmp_path / "stream"), broadcast=True)  # as a new session would
        stream.advance()
    assert result(stream) == wanted
    stream.advance()  # nothing new
    assert result(stream) == wanted


def test_bands_of_one_seed_and_of_ties():
    one = bands_of(pd.DataFrame({"bread": [4], "apos": [20], "bpos": [90]}))
    assert one.to_dict("records") == [{"bread": 4, "band": -2, "covered": SEED_K, "afirst": 8, "alast": 20}]
    same = bands_of(pd.DataFrame({"bread": [1, 1, 1], "apos": [30, 30, 33], "bpos": [31, 30, 33]}, dtype=np.int32))
    assert same["covered"].tolist() == [SEED_K, SEED_K + 3] and same["band"].tolist() == [-1, 0]


def test_reads_of_a_group_are_one_state():
    from readloom.operators.seeds import LEAST, NEAR, SPACING
    from readloom.streaming.candidates import ReadState

    class Held:
        value, calls = None, 0

        def get(self):
            Held.calls += 1
            return self.value

        def update(self, value):
            Held.calls += 1
            self.value = value

        def getValueState(self, *_):
            return self

    state, rng, every, got = ReadState(), np.random.default_rng(1), [], {}
    state.init(Held())
    for contigs in ((1, 2, 3), (4, 5), (6,)):
        size = 400
        seeds = pd.DataFrame({"aread": rng.integers(0, 9 + max(contigs), size), "bread": rng.choice(contigs, size), "apos": rng.integers(12, 300, size), "bpos": rng.integers(12, 150, size)})
        every.append(seeds)
        for out in state.handleInputRows((0,), iter([seeds[:150], seeds[150:]]), None):
            got |= {r.aread: r for r in out.itertuples(index=False)}
    assert Held.calls == 6
    for read, some in pd.concat(every).groupby("aread"):
        found = bands_of(some.drop(columns="aread"))
        top = min((-c, b, d) for b, d, c in found[["bread", "band", "covered"]].itertuples(index=False))
        strong = found[found["covered"] >= LEAST * SEED_K]
        depth = np.zeros(10, int)
        for a, z in zip(strong["afirst"], strong["alast"], strict=True):
            depth[a // SPACING : (z - 1) // SPACING + 1] += 1
        r = got[read]
        assert (-r.covered, r.bread, r.band) == top and r.candidates == len(found) and r.significant == len(strong)
        assert r.near == (found["covered"] >= NEAR * -top[0]).sum() and r.deepest == depth.max()

"""Embedding near-duplicates by NN-descent: a neighbour graph, refined through neighbours of neighbours, gives the links above a cosine threshold.

Equal vectors are one point with a multiplicity. Lists start from leaves of random hyperplanes; each round, the members of a point's list (its own
neighbours and a sample of the points that list it) meet each other, and better neighbours are kept. A list that lies wholly above the threshold is
saturated and doubles. Each round adds new hyperplane tables. Threshold edges are verified in double precision, and the links of a sample are audited against
brute force: rounds go on while the recall is short, and where the sample holds few links, until the tables alone would find a pair at the threshold.
Within each component that the edges join, all links are then counted exactly, tile by tile.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.components import components
from readloom.llm.simhash import whole_groups
from readloom.llm.substring_dedup import binary
from readloom.llm.util import discard, partitions, small_side, written

_LOG = logging.getLogger(__name__)
#: Neighbours a list starts with, hyperplane tables a round, points of a leaf that meet at the start, proposals a member gets from one list.
NEIGHBOURS, TABLES, LEAF, PROPOSALS = 10, 4, 128, 4
#: Audited points at first, true links that they should have, comparisons and numbers of the sample that it grows to otherwise, recall to reach.
AUDIT, LINKS, AUDIT_PAIRS, AUDIT_NUMBERS, RECALL = 1000, 300, 2_000_000_000, 4_000_000, 0.99
#: Times a saturated list doubles, rounds after which a short recall is an error (more if the tables need more).
DOUBLINGS, MOST_ROUNDS = 6, 12
#: Points a side of a tile.
TILE = 2048
#: How far the half-precision cosines of the search may be off.
SLACK = 0.01


def _same(*columns: str):
    def same(x: pa.RecordBatch) -> np.ndarray:
        cols = [x.column(c).to_numpy(zero_copy_only=False) for c in columns]
        return np.concatenate(([False], np.all([c[1:] == c[:-1] for c in cols], axis=0)))

    return same


def _groups(batch: pa.RecordBatch, same) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(~same(batch))
    return cuts, np.append(cuts[1:], batch.num_rows)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    data = np.frombuffer(b"".join(x.as_py() for x in column), kind)
    return data.reshape(len(column), -1)


def points(vectors: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows, points): rows vec_id, cid (null for a vector that links with nothing); points d (length), cid, m rows, least vec_id, unit (double),
    half."""
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(column, lambda x: x != 0)
    valid = F.coalesce(F.col(column).isNotNull() & finite, F.lit(False))
    raw = vectors.select("vec_id", F.when(valid, F.col(column).cast("array<double>")).alias("_v"))
    rows = written(raw.select("vec_id", F.when(F.col("_v").isNotNull(), F.xxhash64("_v")).alias("cid"), "_v"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == d))
                x = some.column("_v").flatten().to_numpy().reshape(-1, d)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                cols = [binary([r.tobytes() for r in y]) for y in (x, x.astype(np.float16))]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("d", "cid", "m", "least")), *cols], ["d", "cid", "m", "least", "unit", "half"])

    distinct = rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("_v").alias("_v"))
    told = distinct.select("cid", "m", "least", F.size("_v").alias("d"), "_v").mapInArrow(made, "d int, cid long, m long, least long, unit binary, half binary")
    return rows.select("vec_id", "cid"), written(told)


_EDGE = "a long, b long, sim float"


def _edges(a: list, b: list, sim: list) -> pa.RecordBatch:
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(cat(a, np.int64)), pa.array(cat(b, np.int64)), pa.array(cat(sim, np.float32))], ["a", "b", "sim"])


def tables_for(n_points: int, threshold: float) -> int:
    """Tables in which a pair at the threshold shares a leaf of evenly spread codes with a chance of RECALL."""
    bits = math.log2(max(1, n_points / (LEAF / 2)))
    apart = 1 - (1 - math.acos(min(1, threshold)) / math.pi) ** bits
    return math.ceil(math.log(1 - RECALL) / math.log(apart)) if apart > 0 else 1


def middle(points: DataFrame) -> np.ndarray:
    """The mean of all unit vectors of one length; a task sends one row of sums."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + _matrix(batch.column("unit"), np.float64).sum(axis=0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["i", "s", "n"])

    told = points.select("unit").mapInArrow(of, "i long, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("x")).toArrow()
    out = np.zeros(len(told))
    out[told["i"].to_numpy()] = told["x"].to_numpy()
    return out


def start(points: DataFrame, n_points: int, turn: int, mean: np.ndarray) -> DataFrame:
    """Proposals a, b, sim of TABLES new tables: points close by in the order of a table's code meet in leaves. Codes say on which side of hyperplanes through
    the mean a point lies, so that points with a common direction are spread as well."""
    n = partitions(points.sparkSession)
    bits = max(0, min(24, math.ceil(math.log2(max(1, n_points / (8 * LEAF))))))
    weights = 1 << np.arange(29, -1, -1)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("half"), np.float16).astype(np.float32)
            planes = np.random.default_rng((11, turn)).normal(size=(x.shape[1], TABLES * 30))
            codes = (((x - mean.astype(np.float32)) @ planes > 0).reshape(len(x), TABLES, 30) * weights).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, TABLES, dtype=np.int32)), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("half"), lists], ["cid", "half", "codes"])

    told = points.select("cid", "half").mapInArrow(coded, "cid long, half binary, codes array<long>")
    each = told.select("cid", "half", F.posexplode("codes").alias("t", "code")).withColumn("leaf", F.shiftright("code", 30 - bits))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = _same("t", "leaf")
        for batch in whole_groups(batches, same, LEAF):
            ids, x = batch.column("cid").to_numpy(), _matrix(batch.column("half"), np.float16).astype(np.float32)
            out: tuple[list, list, list] = ([], [], [])
            for s, e in zip(*_groups(batch, same), strict=True):
                for a in range(s, e, LEAF // 2):  # leaves overlap by half
                    b = min(a + LEAF, e)
                    if b - a < 2:
                        break
                    _best(ids[a:b], x[a:b] @ x[a:b].T, np.full(b - a, -2.0), NEIGHBOURS, out)
                    if b == e:
                        break
            yield _edges(*out)

    return each.select("t", "leaf", "code", "cid", "half").repartition(n, "t", "leaf").sortWithinPartitions("t", "leaf", "code").mapInArrow(meet, _EDGE)


def _best(ids: np.ndarray, sims: np.ndarray, worst: np.ndarray, k: int, out: tuple[list, list, list]) -> None:
    """Appends to out each row's k best columns that beat its worst."""
    np.fill_diagonal(sims, -3)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(sims, top, 1)
    r, c = np.nonzero((got > worst[:, None]) & (ids[top] != ids[:, None]))
    out[0].append(ids[r])
    out[1].append(ids[top[r, c]])
    out[2].append(got[r, c])


def kept_lists(proposals: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """a, b, sim, worst: each list's best neighbours. A list holds NEIGHBOURS, or twice as many for each round in which it was saturated; worst is
    the least similarity that a proposal must beat, -2 while the list isn't full."""
    n = partitions(proposals.sparkSession)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = _same("a")
        for batch in whole_groups(batches, same, 50_000):
            a, b, sim = (batch.column(c).to_numpy() for c in ("a", "b", "sim"))
            order = np.lexsort((b, -sim, a))
            a, b, sim = a[order], b[order], sim[order]
            fresh = np.ones(len(a), bool)
            by = np.lexsort((-sim, b, a))
            fresh[by[1:]] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
            a, b, sim = a[fresh], b[fresh], sim[fresh]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            size = NEIGHBOURS
            limit = np.full(len(a), size)
            first = np.searchsorted(a, a)
            count = np.searchsorted(a, a, "right") - first
            for _ in range(rounds):  # doubles while the last kept neighbour is above the threshold
                last = first + np.minimum(limit, count) - 1
                limit = np.where((count >= limit) & (sim[last] >= threshold), 2 * limit, limit)
            last = first + np.minimum(limit, count) - 1
            worst = np.where(count >= limit, sim[last], np.float32(-2))
            keep = place < limit
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, sim, worst.astype(np.float32))], ["a", "b", "sim", "worst"])

    return written(proposals.repartition(n, "a").sortWithinPartitions("a").mapInArrow(trim, _EDGE + ", worst float"))


def descend(lists: DataFrame, points: DataFrame, turn: int) -> DataFrame:
    """Proposals a, b, sim from one round: the members of every list meet."""
    n = partitions(points.sparkSession)
    worst = lists.groupBy("a").agg(F.max("worst").alias("worst"))
    back = Window.partitionBy("b").orderBy(F.xxhash64("a", "b", F.lit(turn)))
    reverse = lists.select("a", "b").withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= NEIGHBOURS).select(F.col("b").alias("u"), F.col("a").alias("v"))
    members = lists.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(reverse).distinct()
    known = points.select("cid", "half").join(worst, F.col("cid") == F.col("a"), "left").select(F.col("cid").alias("v"), "half", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = _same("u")
        for batch in whole_groups(batches, same, 5_000):
            ids, x, least = batch.column("v").to_numpy(), _matrix(batch.column("half"), np.float16).astype(np.float32), batch.column("worst").to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for s, e in zip(*_groups(batch, same), strict=True):
                if e - s > 1:
                    _best(ids[s:e], x[s:e] @ x[s:e].T, least[s:e], PROPOSALS, out)
            yield _edges(*out)

    met = members.join(known, "v").select("u", "v", "half", "worst")
    return met.repartition(n, "u").sortWithinPartitions("u").mapInArrow(meet, _EDGE)


def verified(edges: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """a > b of the edges whose cosine in double precision is at least threshold. Written."""
    pairs = edges.where(F.col("sim") >= threshold - SLACK).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    unit = lambda c, as_: points.select(F.col("cid").alias(c), F.col("unit").alias(as_))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = (_matrix(batch.column("ua"), np.float64) * _matrix(batch.column("ub"), np.float64)).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(sims >= threshold))

    return written(pairs.join(unit("a", "ua"), "a").join(unit("b", "ub"), "b").select("a", "b", "ua", "ub").mapInArrow(check, "a long, b long"))


def true_links(points: DataFrame, size: int, threshold: float) -> DataFrame:
    """a, b: all links of size points (least hashes), by brute force. Written."""
    sample = points.orderBy(F.xxhash64("cid")).limit(size).select("cid", "unit").toArrow().combine_chunks()
    ids, q = sample["cid"].to_numpy(), _matrix(sample["unit"], np.float64)
    rows = max(1, AUDIT_NUMBERS // len(ids))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                other = batch.column("cid").to_numpy()
                i, j = np.nonzero(q @ _matrix(batch.column("unit"), np.float64).T >= threshold)
                keep = ids[i] != other[j]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i][keep]), pa.array(other[j][keep])], ["a", "b"])

    return written(points.select("cid", "unit").mapInArrow(brute, "a long, b long"))


def audit(points: DataFrame, n_points: int, threshold: float) -> tuple[DataFrame, bool]:
    """(a, b: true links of a sample, whether it says enough: it has LINKS links or is the whole table). It grows until then or up to its bounds."""
    d = len(points.select("unit").first()["unit"]) // 8
    most = min(n_points, max(AUDIT, min(AUDIT_PAIRS // n_points, AUDIT_NUMBERS // d)))
    size = min(AUDIT, most)
    while True:
        truth = true_links(points, size, threshold)
        enough = size >= n_points or truth.count() >= LINKS
        if enough or size >= most:
            return truth, enough
        discard(truth)
        size = min(4 * size, most)


def search(points: DataFrame, n_points: int, threshold: float) -> tuple[DataFrame, float]:
    """(components of the verified edges, recall: the share of the audited true links whose ends they join, nan if there
    are none; all links in a component are counted)."""
    truth, enough = audit(points, n_points, threshold)
    mean = middle(points)
    common = min(0.999, float(mean @ mean))
    # a pair at the threshold has this cosine around the mean
    tables = tables_for(n_points, max(0.0, (threshold - common) / (1 - common)))
    lists, turn = None, 0
    while True:
        turn += 1
        before, met = lists, start(points, n_points, turn, mean)
        if before is None:
            before = kept_lists(met, threshold - SLACK, 0)
            met = descend(before, points, turn)
        else:
            met = met.unionByName(descend(before, points, turn))
        lists = kept_lists(before.select("a", "b", "sim").unionByName(met), threshold - SLACK, min(turn, DOUBLINGS))
        discard(before)
        edges = verified(lists, points, threshold)
        roots = written(components(edges, "a", "b"))
        discard(edges)
        end = lambda c: roots.select(F.col("node").alias(c), F.col("component").alias(f"r{c}"))  # noqa: E731, B023
        joined = truth.join(end("a"), "a", "left").join(end("b"), "b", "left").where(F.coalesce("ra", "a") == F.coalesce("rb", "b")).count()
        n = truth.count()
        recall = joined / n if n else math.nan  # nothing was measured; the tables decide
        _LOG.info("round %d: recall %.4f of %d audited links", turn, recall, n)
        if not recall < RECALL and (enough or turn * TABLES >= tables):
            return roots, recall
        if turn >= max(MOST_ROUNDS, 2 * math.ceil(tables / TABLES)):
            raise RuntimeError(f"recall is {recall:.4f} of {n} audited links after {turn} rounds, below {RECALL}")
        discard(roots)


def tiled_links(members: DataFrame, threshold: float) -> DataFrame:
    """cid, links: for members (cid, m, unit, component), the rows of other points of the same component with a cosine of at least threshold.

    A component of g points is dealt into blocks of about TILE; a tile holds two blocks, so no task holds more than two, whatever g is."""
    n = partitions(members.sparkSession)
    sizes = written(members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")))
    dealt = members.join(small_side(sizes), "component").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "m", "unit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = _same("component", "i", "j")
        for batch in whole_groups(batches, same, 2_000):
            ids, m, own, i = (batch.column(c).to_numpy() for c in ("cid", "m", "own", "i"))
            j, x, links = batch.column("j").to_numpy(), _matrix(batch.column("unit"), np.float64), np.zeros(batch.num_rows, np.int64)
            for s, e in zip(*_groups(batch, same), strict=True):
                if i[s] == j[s]:
                    near = x[s:e] @ x[s:e].T >= threshold
                    np.fill_diagonal(near, False)
                    links[s:e] = near @ m[s:e]
                else:
                    a = s + np.flatnonzero(own[s:e] == i[s])
                    b = s + np.flatnonzero(own[s:e] != i[s])
                    near = x[a] @ x[b].T >= threshold
                    links[a], links[b] = near @ m[b], near.T @ m[a]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["cid", "links"])

    counted = dealt.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(count, "cid long, links long")
    return counted.groupBy("cid").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Vectors that are null, zero, or hold a null or non-finite component link with nothing and form a component each. Vectors of different lengths don't
    link; each length is searched by itself. Equal vectors link. Repeated vec_ids are rows of their own; a null vec_id takes part, and component_id is the
    smallest vec_id that isn't null, so that a row with a null id is kept only if its component has no other.
    """
    rows, nodes = points(vectors, column)
    rooted, counted = [], []
    for r in nodes.groupBy("d").count().where("count > 1").orderBy("d").collect():  # a row for each length
        some = nodes.where(F.col("d") == r["d"])
        roots, recall = search(some, r["count"], threshold)
        _LOG.info("vectors of %d: recall %.4f", r["d"], recall)
        named = some.join(small_side(roots), F.col("cid") == F.col("node"), "left").select("cid", "m", "unit", F.coalesce("component", "cid").alias("component"))
        rooted.append(roots)
        counted.append(tiled_links(named.join(roots.select("component").distinct(), "component", "left_semi"), threshold))
    none = nodes.limit(0)
    roots = written(reduce(DataFrame.unionByName, rooted, none.select(F.col("cid").alias("node"), F.col("cid").alias("component"))))
    linked = reduce(DataFrame.unionByName, counted, none.select("cid", F.col("m").alias("links")))
    named = nodes.join(small_side(roots), F.col("cid") == F.col("node"), "left").select("cid", "m", "least", F.coalesce("component", "cid").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = named.join(least, "component").join(linked, "cid", "left").select("cid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.join(small_side(written(result)), "cid", "left")
    alone = F.col("cid").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector: see near_vectors()."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Nearest neighbours by collision-counting hashing: sorted arrays of single projections, windows centred on the query, exact verification.

Every point is projected on PROJECTIONS random lines. All candidates are dealt into blocks, and each query meets each block in a tile. A tile sorts its points
along every line. A query's windows of width WIDTH * R, around its own place on each line, count how many lines a point collides on; points that collide on
enough of them are verified, by the cosine in double precision. Windows grow by virtual rehashing, a greater R on the same arrays, until the wanted number of
verified points lies within R: at that R a true neighbour misses the threshold with a chance of MISS at most, whatever the data. The first bound of R is the
query's best among a bounded sample of all points; the sample bounds the work alone, the search is over all rows.

Rows of one vector are one group. Of its rows the WANTED + 1 least ids are candidates, as no more can be among the nearest of anything, and its queries are
searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.simhash import same_group, whole_groups
from readloom.llm.substring_dedup import binary
from readloom.llm.util import partitions, small_side, written

#: Nearest rows of a query, and which ids are queries.
WANTED, EVERY = 5, 50
#: Lines, width of a window in units of the radius, chance that a point at the radius misses the threshold, radii by which windows grow.
PROJECTIONS, WIDTH, MISS, GROWTH = 64, 2.4, 0.02, (0.35, 0.7, 1.0)
#: Points of a candidate block and queries of a query block, and points of the sample that bounds the first radius.
BLOCK, QUERIES, SAMPLE = 4096, 4096, 4096
_MET = "query long, cid long, score double"


def lines(d: int, m: int = PROJECTIONS) -> np.ndarray:
    """m random directions in d dimensions, orthogonal within each d of them, as long as vectors of d standard normals are on average."""
    rng = np.random.default_rng((5, d))
    some = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-m // d))]
    return np.concatenate(some, axis=1)[:, :m] * np.sqrt(d)


def chance(d: int, width: float = WIDTH) -> float:
    """How likely a point at the radius collides on one line: the share of the sphere in d dimensions whose first number is within width / 2 / sqrt(d)."""
    edge = width / 2 / math.sqrt(d)
    if edge >= 1 or d == 1:
        return float(edge >= 1)
    angle = np.linspace(0, min(math.pi / 2, 12 / math.sqrt(d)), 20_001)  # the rest is nothing
    density = np.cos(angle) ** (d - 2)
    return float(density[angle <= math.asin(edge)].sum() / density.sum())


def threshold(d: int, m: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Collisions on m lines that a point at the radius reaches but for a chance of miss, from the binomial of chance()."""
    p = chance(d, width)
    below, least = 0.0, 0
    while least < m and (below := below + math.comb(m, least) * p**least * (1 - p) ** (m - least)) <= miss:
        least += 1
    return max(1, least)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x and y, in double precision; the same for the same two vectors, wherever they stand."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


class Lines:
    """A block of points, sorted along every line."""

    def __init__(self, points: np.ndarray, a: np.ndarray):
        self.raw = points
        places = np.ascontiguousarray((unit(points) @ a).T)
        self.order = np.argsort(places, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(places, self.order, 1)
        self.a = a

    def nearest(self, query: np.ndarray, bound: np.ndarray, wanted: int, enough: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, points, cosines): what is found within each query's bound, a distance of unit vectors, the best first, wanted ones at most."""
        n, m = len(self.raw), len(self.order)
        flat, base = self.order.ravel(), np.arange(m) * n
        places = unit(query) @ self.a
        edges = np.empty((len(query), m, 2, len(GROWTH)), np.int64)
        for k, share in enumerate(GROWTH):  # all windows of all radii, by one search a line
            half = (WIDTH / 2 * share * bound + 1e-6)[:, None]
            for line in range(m):
                at = places[:, line, None] + np.concatenate((-half, half), 1)
                edges[:, line, 0, k] = np.searchsorted(self.sorted[line], at[:, 0], "left")
                edges[:, line, 1, k] = np.searchsorted(self.sorted[line], at[:, 1], "right")
        for i in range(len(query)):
            count, seen = np.zeros(n, np.int32), np.zeros(n, bool)
            found, score = np.zeros(0, np.int64), np.zeros(0)
            for k, share in enumerate(GROWTH):
                lo, hi = edges[i, :, 0, k], edges[i, :, 1, k]
                if k:  # what the windows gain on either side
                    was = edges[i, :, 0, k - 1], edges[i, :, 1, k - 1]
                    first, last = np.concatenate((base + lo, base + was[1])), np.concatenate((base + was[0], base + hi))
                else:
                    first, last = base + lo, base + hi
                size = last - first
                at = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
                count += np.bincount(flat[at], minlength=n).astype(np.int32)
                fresh = np.flatnonzero((count >= enough) & ~seen)
                if len(fresh):
                    seen[fresh] = True
                    found = np.concatenate((found, fresh))
                    score = np.concatenate((score, cosines(self.raw[fresh], query[i][None, :])))
                if len(score) >= wanted:
                    nearest = np.partition(score, len(score) - wanted)[len(score) - wanted]
                    if distance(nearest) <= share * bound[i]:
                        break
            if len(found):
                by = np.argsort(-score, kind="stable")
                if len(by) > wanted:  # ties with the last wanted one stay
                    by = by[: int(np.searchsorted(-score[by], -score[by[wanted - 1]], "right"))]
                yield i, found[by], score[by]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distance(cosine):
    """Distance of unit vectors of a cosine, and a little more for rounding."""
    return np.sqrt(np.maximum(2 - 2 * np.asarray(cosine), 0)) + 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(len(column), -1)


def vectors_of(table: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows: row, vec_id, cid; points: cid, d, v binary of doubles), both written. cid numbers the different vectors that take part: those that are null, zero
    or hold null or non-finite components don't. v is scaled by its largest component, which no cosine sees, so that no square overflows."""
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(column, lambda x: x != 0)
    raw = table.select("vec_id", F.when(F.coalesce(finite, F.lit(False)), F.transform(column, lambda x: x.cast("double"))).alias("_v")).where("_v is not null")
    raw = written(raw.withColumn("row", F.monotonically_increasing_id()))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array(x, np.float64) for x in batch.column("_v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("d"), binary([(x / np.ldexp(1.0, int(np.frexp(np.abs(x).max())[1]))).tobytes() for x in made])], ["cid", "d", "v"])

    classes = written(raw.groupBy("_v").agg(F.min("row").alias("cid")))
    rows = raw.join(small_side(classes), "_v").select("row", "vec_id", "cid")
    return written(rows), written(classes.select("cid", F.size("_v").alias("d"), "_v").mapInArrow(scaled, "cid long, d int, v binary"))


def first_bounds(points: DataFrame, asked: DataFrame, copies: DataFrame, d: int, wanted: int) -> DataFrame:
    """asked (cid, v) with bound: the distance of the wanted-th nearest of a sample of at most SAMPLE points and their copies, no
    bound with fewer."""
    sample = points.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).join(copies, "cid").select("v", "copies").toArrow().combine_chunks()
    x = unit(_matrix(sample["v"])) if len(sample) else np.zeros((0, d))
    x = np.repeat(x, sample["copies"].to_numpy(), axis=0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                near = np.full(some.num_rows, np.inf)
                if len(x) >= wanted:
                    near = distance(np.partition(unit(_matrix(some.column("v"))) @ x.T, len(x) - wanted, axis=1)[:, len(x) - wanted])
                yield pa.RecordBatch.from_arrays([some.column("cid"), some.column("v"), pa.array(near)], ["cid", "v", "bound"])

    return asked.mapInArrow(of, "cid long, v binary, bound double")


def search(points: DataFrame, asked: DataFrame, copies: DataFrame, d: int, wanted: int, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query, cid, score: for every vector of asked (cid, v) the vectors of points (cid, v) that hold its `wanted` nearest rows, and perhaps a few more. copies:
    cid, copies (candidate rows of the vector). All vectors have d numbers."""
    n = partitions(points.sparkSession)
    asked = written(first_bounds(points, asked, copies, d, wanted))
    i_blocks, j_blocks = (max(1, -(-x.count() // size)) for x, size in ((asked, queries), (points, block)))
    dealt = lambda x, blocks: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    q = asked.select(dealt("cid", i_blocks).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(j_blocks - 1))).alias("j"), "cid", "v", "bound", F.lit(0).alias("copies"))
    c = points.join(copies, "cid").select(F.explode(F.sequence(F.lit(0), F.lit(i_blocks - 1))).alias("i"), dealt("cid", j_blocks).alias("j"), "cid", "v", F.lit(0.0).alias("bound"), F.col("copies").cast("int").alias("copies"))
    a, enough, same = lines(d), threshold(d), same_group("i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, same, 1):
            cuts = np.append(np.flatnonzero(~same(held)), held.num_rows)
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                tile = held.slice(start, end - start)
                is_query = tile.column("copies").to_numpy() == 0
                some, those = tile.filter(pa.array(is_query)), tile.filter(pa.array(~is_query))
                if not some.num_rows or not those.num_rows:
                    continue
                ids, names = those.column("cid").to_numpy(), some.column("cid").to_numpy()
                index = Lines(_matrix(those.column("v")), a)
                out: tuple[list, list, list] = ([], [], [])
                for i, found, score in index.nearest(_matrix(some.column("v")), some.column("bound").to_numpy(), wanted, enough):
                    out[0].append(np.full(len(found), names[i]))
                    out[1].append(ids[found])
                    out[2].append(score)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query", "cid", "score"])

    return q.unionByName(c).repartition(n, "i", "j").sortWithinPartitions("i", "j").mapInArrow(meet, _MET)


def nearest(table: DataFrame, wanted: int = WANTED, every: int = EVERY, column: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the `wanted` rows nearest by cosine to each row of table (vec_id, embedding) whose vec_id is divisible by `every`.

    Every row but the query's own is a candidate; with fewer than `wanted`, all come out. Ties go to the smaller vec_id, a null one last. Vectors that are
    null, zero or hold null or non-finite components take no part, neither do vectors of different lengths meet. Rows that repeat a vec_id are rows of their
    own, queries too. A row with a null vec_id is a candidate, but no query. An empty table gives an empty result; further columns are ignored. Each true
    neighbour is missed with a chance of about MISS; scores are exact.
    """
    rows, points = vectors_of(table, column)
    nth = Window.partitionBy("cid").orderBy(F.asc_nulls_last("vec_id"), "row")
    some = written(rows.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= wanted + 1))
    copies = written(some.groupBy("cid").agg(F.count("*").alias("copies")))
    asked = rows.where(F.col("vec_id") % every == 0)
    wants = written(asked.select("cid").distinct())
    met = []
    for r in points.groupBy("d").count().orderBy("d").collect():  # a row for each length
        own = points.where(F.col("d") == r["d"]).select("cid", "v")
        met.append(search(own, own.join(small_side(wants), "cid"), copies, r["d"], wanted + 1, block, queries))
    if not met:
        return points.select(F.col("cid").alias("query_id"), F.lit(1).alias("rank"), F.col("cid").alias("vec_id"), F.lit(0.0).alias("score"))
    all_met = met[0]
    for other in met[1:]:
        all_met = all_met.unionByName(other)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    each = all_met.join(some.select("cid", "row", "vec_id"), "cid").withColumn("_r", best).where(F.col("_r") <= wanted + 1)
    each = written(each.select("query", "row", "vec_id", "score", "_r"))
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("row").alias("_own"), F.col("cid").alias("query"))
    told = mine.join(small_side(each), "query").where("row != _own")
    lists = F.slice(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))), 1, wanted)  # wanted + 1 rows at most
    out = told.groupBy("_own", "query_id").agg(lists.alias("_l")).select("query_id", F.posexplode("_l").alias("_p", "_e"))
    return out.select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_e.vec_id").alias("vec_id"), F.col("_e.score").alias("score"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 rows nearest to each row whose vec_id is divisible by 50: see nearest()."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

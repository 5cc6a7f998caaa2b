"""Importance resampling towards a target: documents are drawn by how much likelier their word runs are in a target's texts, plus seeded noise.

Features come from a byte automaton on Arrow's text buffers: a lookup table classifies every byte, differences of the classes are the word boundaries, and
the CRCs of all runs are advanced together, one byte of every run a step, through the usual table of 256 words. Feature counts are 10,000 sums; each document
then needs its own text alone. Places are numbered within the partitions of a range-partitioned sort, so that no task sees all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.util import partitions, ranges, steps, written

#: Buckets of features, words of a run at most, seed of the noise, words that a drawn document has at least, hundredths that are drawn.
BUCKETS, RUN, SEED, LEAST_WORDS, SHARE = 10_000, 3, 42, 20, 5
#: Bytes of a word that are advanced for all words at once; what is left of a longer one goes through zlib's CRC.
TOGETHER = 96
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _table() -> np.ndarray:
    """The CRC of each byte, reflected polynomial EDB88320."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> np.uint32(1) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_CRC = _table()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, rows): all words of the rows, lower-cased, a space behind each; where each starts and ends; each row's first word."""
    inside = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))[: len(data)]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows, size = np.searchsorted(starts, offsets), ends - starts
    spaced = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    at = np.cumsum(size + 1) - (size + 1)
    spaced[ranges(at, size)] = _LOWER[data[inside]]
    return spaced, at, at + size, rows


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC states after data[starts:ends], all of them a byte further at each step; those that have ended drop out."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    now = state[order]
    live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")
    for k, n in enumerate(live[:TOGETHER].tolist()):
        x = now[:n]
        now[:n] = _CRC[x.astype(np.uint8) ^ data[at[:n] + k]] ^ (x >> np.uint32(8))
    for i in range(int(live[TOGETHER]) if len(live) > TOGETHER else 0):
        now[i] = zlib.crc32(data[at[i] + TOGETHER : at[i] + left[i]].tobytes(), int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, words): the bucket of every run of 1 to run words and the row that it is in, and each row's number of words."""
    spaced, starts, ends, rows = words_of(data, offsets)
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    found, of, last = [], [], np.arange(len(starts))
    for k in range(run):
        if k:  # the space and the word behind the run, where its row has one
            goes_on = last + 1 < rows[1:][row]
            state, row, last = state[goes_on], row[goes_on], last[goes_on] + 1
        state = advanced(state, spaced, starts[last] if not k else ends[last - 1], ends[last])
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        of.append(row)
    return np.concatenate(found), np.concatenate(of), n


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all whole texts (column text; null: empty). A task sends one row of sums; `buckets` sums come back."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in steps(batch, "text"):
                total += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    told = texts.select("text").mapInArrow(of, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[told["bucket"].to_numpy()] = told["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in doubles."""
    s, t = source.astype(float), target.astype(float)
    n = float(len(s))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of its features' gains; none: 0) of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                bucket, row, n = features(data, offsets, len(gain))
                many, weight = np.bincount(row, minlength=len(n)), np.zeros(len(n), np.int64)
                order = np.argsort(row, kind="stable")
                total = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
                cuts = np.concatenate(([0], np.cumsum(many)))
                weight[:] = total[cuts[1:]] - total[cuts[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n, many, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, n_words long, n_features long, weight long")


def placed(rows: DataFrame, most: int, *order) -> DataFrame:
    """rows with rank: 1, 2, 3... by order for the first `most`, null beyond. A range-partitioned sort is written; a place is the number of rows in the
    ranges before and the place within one's own."""
    n = partitions(rows.sparkSession)
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = written(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    own = F.shiftright("_at", 33)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = kept.groupBy(own.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", before)  # a row for each partition
    rank = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    told = kept.withColumn("_part", own).join(F.broadcast(sizes), "_part").withColumn("rank", rank)
    return told.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("_at", "_part", "_n", "_before")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text), all long; target has a column text.

    Words are runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased; features are runs of 1 to RUN words, repeats counted, in buckets by CRC. A weight
    is the sum of the features' gains; a score adds noise from doc_id and seed alone. Of the N rows with at least least_words words, floor(share * N / 100)
    are drawn, the highest scores first, ties to the smaller doc_id (null last); rank is null for all others. A null text has no words, weight 0. A null
    doc_id counts as an empty text in the noise. Repeated rows take part as often as they occur. An empty target gives every bucket the count 0; empty docs
    give an empty result. Further columns are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    rows = written(weighted(docs, gain).withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()))
    some = F.col("n_words") >= least_words
    most = share * rows.where(some).count() // 100
    drawn = placed(rows.where(some), most, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rows.where(~some).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, with the benchmark's texts as target: see resampled()."""
    return resampled(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_BYTES = "list_transform(range(0, octet_length(encode(f))), lambda i: cast('0x' || substring(hex(encode(f)), cast(2 * i + 1 as bigint), 2) as ubigint))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with tab as (select list(c order by b) as t from (select b, list_reduce(range(0, 8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, cast(b as bigint)) as c from range(256) r(b))),
w as (select 'd' as src, doc_id as id, {_WORDS} as w from documents union all select 'b', item_id, {_WORDS} from benchmark),
r as (select src, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f from w),
c as (select src, id, f, count(*) as n from r group by all),
d as (select distinct f from c),
k as (select f, xor(list_reduce(list_concat([cast(4294967295 as ubigint)], {_BYTES}), lambda a, x: xor(a >> 8, cast(t[cast(xor(a & 255, x) as bigint) + 1] as ubigint))), 4294967295) % {BUCKETS} as bucket from d, tab),
e as (select src, id, bucket, sum(n) as n from c join k using (f) group by all),
s as (select b as bucket, coalesce(sum(n) filter (src = 'd'), 0)::double as s, coalesce(sum(n) filter (src = 'b'), 0)::double as t from range({BUCKETS}) x(b) left join e on e.bucket = b group by b),
g as (select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + {BUCKETS}) / ((s + 1) * (sum(t) over () + {BUCKETS}))))::bigint as gain from s),
v as (select id as doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from e join g using (bucket) where src = 'd' group by id),
a as (select doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::bigint + 0.5) / 4294967296::double)))::bigint as score from (select id as doc_id, w from w where src = 'd') left join v using (doc_id)),
o as (select doc_id, row_number() over (order by score desc, doc_id) as rank from a where words >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when rank <= {SHARE} * (select count(*) from o) // 100 then rank end as rank from a left join o using (doc_id)
"""

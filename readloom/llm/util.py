"""What the operators of this subpackage share: the scratch folder, size-checked joins, word and byte hashing on Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parquet bytes up to which the small side of a join is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Text bytes that one vectorised step takes at once (a longer text is a step of its own).
STEP_BYTES = 2 << 20
#: Rows and bytes of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_BYTES = 1500, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, unless they are shorter already."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names in spark.checkpoint.dir; a temporary one where that is unset, in local mode only."""
    short_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/readloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, and a lost executor costs no more than a task."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table made by written()."""
    path, fs = _path(df.sparkSession, df._scratch)
    return fs.getContentSummary(path).getLength()


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    path, fs = _path(df.sparkSession, df._scratch)
    fs.delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table made by written(), with a broadcast hint if its files are within limit; else it is joined by a shuffle."""
    return F.broadcast(df) if written_bytes(df) <= limit else df


def with_row(docs: DataFrame, *more: Column) -> DataFrame:
    """_row (all columns of docs) beside more, so that no name of docs meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *more)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(docs: DataFrame) -> DataFrame:
    """_key, a number for every row of docs, beside _row with all its columns. Written, so that the numbers hold; what reads _row.text reads no more."""
    return written(with_row(docs, F.monotonically_increasing_id().alias("_key")))


# ---------------------------------------------------------------- hashing on Arrow buffers

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full((2, size), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = base, pow(base, -1, 1 << 64)
        have = _powers[base] = tuple(np.cumprod(steps, axis=1, dtype=np.uint64))  # type: ignore[assignment]
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a zero in front."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], dtype=np.uint64, out=out[1:])
    return out


def window_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[starts:ends] that doesn't depend on the place."""
    return mixed((prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts])


_ONES, _LANE = np.uint64(0xFFFFFFFFFFFFFFFF), 0x9FB21C651E98DF25
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks, and an executor holds several."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def steps(batch: pa.RecordBatch, column: str | int, size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batch of about size text bytes, with the bytes and the rows' offsets."""
    data, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of the rows, and each row's first word (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each data[starts:ends], none of which is empty. Eight bytes at a time are mixed with their place before they are summed, so that
    no regular texts collide as they do under a polynomial; another seed gives an independent hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    lanes = (size + 7) >> 3
    first = np.cumsum(lanes) - lanes
    place = np.arange(int(first[-1] + lanes[-1])) - np.repeat(first, lanes)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    x = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[np.repeat(starts, lanes) + 8 * place]
    last = first + lanes - 1
    x[last] &= _ONES >> ((8 * lanes - size) * 8).astype(np.uint64)
    x += (place + 1).astype(np.uint64) * np.uint64(_LANE * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF)
    total = np.add.reduceat(mixed(x), first)
    return mixed(total + size.astype(np.uint64) * np.uint64(_LANE) + np.uint64(seed))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers starts[i] .. starts[i] + counts[i] - 1, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(before - starts, counts)


# ---------------------------------------------------------------- packed hashes


def pack(x: np.ndarray, width: int) -> bytes:
    """The low width bytes of each uint64."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(x: bytes, width: int) -> np.ndarray:
    got = np.frombuffer(x, np.uint8).reshape(-1, width)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, :width] = got
    return out.reshape(-1).view("<u8").astype(np.uint64)

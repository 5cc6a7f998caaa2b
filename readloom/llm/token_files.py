"""Token ids as binary shards with a minimal perfect hash index: constant-time keyed access over raw id payloads.

A shard is one row of an uncompressed Parquet table (part, seq order the shards, a folder for each part; Parquet is only
the container that Spark commits atomically):
  n_docs, n_ids
  least, most   the first and the last doc_id, null where all are null
  width     bytes of an id: 2 if all ids of the shard are below 65536, else 4
  payload   the ids of its documents in ascending key order, little-endian unsigned
  keys      the documents' ids, int64 in payload order; nulls and repeats: see valid and turns
  valid     one byte per document, 0 where doc_id is null
  turns     uint32, how many earlier documents of the whole set have the same doc_id
  seeds     int32 per bucket of the hash: >= 0 a displacement, < 0 minus the slot minus one
  slots     per slot: uint32 fingerprint, uint32 first id in payload, uint32 number of ids
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.bpe import byte_letters
from readloom.llm.util import mixed, partitions, ranges, scratch_dir, small_side, steps, word_hashes, word_spans, written

#: A shard is closed once it has so many ids or documents; one longer document is a shard of its own.
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 15
#: Documents per bucket of the hash, on average.
BUCKET = 4
#: Known words of a task; beyond, those not met again are forgotten, which changes no result.
KNOWN = 1_000_000
#: Fixed value: the word pattern of the vocabulary's pre-tokenizer; and what it comes to on words of ASCII and Latin letters, in lower case.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_EASY = re.compile("[!-~À-ÖØ-öø-įı-ſ]+").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+").findall
_BYTES = {ord(c): "".join(byte_letters()[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x180))}
SCHEMA = "part int, seq int, n_docs long, n_ids long, least long, most long, width int, payload binary, keys binary, valid binary, turns binary, seeds binary, slots binary"
_SLOT = np.dtype([("print", "<u4"), ("first", "<u4"), ("count", "<u4")])


def key_hashes(keys: np.ndarray, valid: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (doc_id or null, turn)."""
    return mixed(mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + turns.astype(np.uint64) * np.uint64(2) + valid.astype(np.uint64))


def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h ^ mixed(np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (mixed(h + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def build_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds per bucket, slot of each key) of a minimal perfect hash: the largest buckets first look for a displacement that puts all their
    keys on free slots; buckets of one key take what is left."""
    n = len(h)
    buckets = max(1, -(-n // BUCKET))
    of = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    seeds, slot, taken = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    sizes = np.diff(cuts)
    tries = np.arange(16, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        mine = order[cuts[b] : cuts[b + 1]]
        seed = 0
        while True:
            at = np.sort(_slot(h[mine][None, :], (tries + np.uint64(seed))[:, None], n), axis=1)
            good = ~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
            if good.any():
                seeds[b] = seed + int(good.argmax())
                slot[mine] = _slot(h[mine], seeds[b], n)
                taken[slot[mine]] = True
                break
            seed += len(tries)
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(sizes == 1)
    seeds[single] = -free[: len(single)] - 1
    slot[order[cuts[single]]] = free[: len(single)]
    return seeds, slot


def find(h: np.ndarray, seeds: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slot of each key hash, -1 where the stored fingerprint differs."""
    if not len(slots):
        return np.full(len(h), -1)
    seed = seeds[(h % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    at = np.where(seed < 0, -seed - 1, _slot(h, np.maximum(seed, 0), len(slots)))
    return np.where(slots["print"][at] == fingerprints(h), at, -1)


class _Known:
    """Words by two independent hashes (sorted by the first), and their ids, one after another. Beyond KNOWN words, those not met again are forgotten."""

    def __init__(self):
        self.a, self.b, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each word, -1 where it isn't known."""
        if not len(self.a):
            return np.full(len(a), -1)
        at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return np.where((self.a[at] == a) & (self.b[at] == b), at, -1)

    def forget(self) -> None:
        keep = np.flatnonzero(self.again)
        self.a, self.b, self.first, self.count = (x[keep] for x in (self.a, self.b, self.first, self.count))
        self.ids, self.first = self.ids[ranges(self.first, self.count)], np.cumsum(self.count) - self.count
        self.again = np.zeros(len(keep), bool)

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate((self.ids, ids))
        every = [np.concatenate(x) for x in ((self.a, a), (self.b, b), (self.first, first), (self.count, count), (self.again, np.zeros(len(a), bool)))]
        order = np.argsort(every[0], kind="stable")
        self.a, self.b, self.first, self.count, self.again = (x[order] for x in every)


class Words:
    """Encodes texts with the tokenizers library, for a vocabulary that drops white space and lowers case. Each different word goes to the library once
    (again when it has been forgotten): plain ASCII to its model, cut by the vocabulary's rule, and other Latin letters too, anything else, and all words of a file with other rules,
    through the whole library. The texts themselves are put together from known words in whole batches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
        cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORDS} and not cuts[1].get("add_prefix_space")
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        self.known = _Known()

    def lone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without blanks, one after another, and their number."""
        model, seen, odd = self.tokenizer.model.tokenize, {}, []
        out, count = array("I"), array("q")
        for word in words:
            if self.plain and _EASY(word) and not ("<|" in word and any(s in word for s in self.special)):
                low, before = word.lower(), len(out)
                for piece in (low,) if low.isalpha() else _PIECES(low):
                    ids = seen.get(piece)
                    if ids is None:
                        ids = seen[piece] = [t.id for t in model(piece if piece.isascii() else piece.translate(_BYTES))]
                    out.extend(ids)
                count.append(len(out) - before)
            else:
                odd.append(word)
                count.append(-1)
        ids, size = np.array(out, np.uint32), np.array(count, np.int64)
        if odd:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            at = np.flatnonzero(size < 0)
            size[at] = 0
            place = np.repeat((np.cumsum(size) - size)[at], [len(x) for x in found])
            size[at] = [len(x) for x in found]
            ids = np.insert(ids, place, np.array([i for x in found for i in x], np.uint32))
        return ids, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one after another, and the rows' offsets among them."""
        starts, ends, rows = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        a, b = word_hashes(data, starts, ends), word_hashes(data, starts, ends, 2)
        while True:
            each, some, of = np.unique(a, return_index=True, return_inverse=True)
            same = b == b[some][of]
            if same.all():
                break
            a = np.where(same, a, mixed(a + b))  # words that share the first hash alone
        pair = each, b[some]
        known = self.known
        at = known.find(*pair)
        if (at < 0).sum() + len(known.a) > KNOWN:
            known.again[at[at >= 0]] = True
            known.forget()
            at = known.find(*pair)
        known.again[at[at >= 0]] = True
        lost = np.flatnonzero(at < 0)
        if len(lost):
            words = [data[s:e].tobytes().decode() for s, e in zip(starts[some[lost]].tolist(), ends[some[lost]].tolist(), strict=True)]
            known.add(pair[0][lost], pair[1][lost], *self.lone(words))
            at = known.find(*pair)
        per_word = known.count[at][of]
        return known.ids[ranges(known.first[at][of], per_word)], np.concatenate(([0], np.cumsum(per_word)))[rows]


@lru_cache(maxsize=1)
def _library(path: str) -> Words:
    return Words(path)


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order to shards below path, nulls first; repeats of a doc_id in the order of
    their text's hash. Every document ends with end_id; a null or empty text has that one id. An empty table gives no shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = _library(vocabulary), TaskContext.get().partitionId(), 0
        last, turn = None, 0
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        rows: list[tuple[int, int, int]] = []
        held = 0
        for batch in batches:
            for step, data, offsets in steps(batch, "text"):
                found, cuts = words.encode(data, offsets)
                found = found.astype("<u4", copy=False)
                for key, null, a, b in zip(step.column("_key").to_pylist(), step.column("_null").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    turn = turn + 1 if last == (key, null) else 0
                    last = (key, null)
                    ids.append(found[a:b].tobytes() + end)
                    rows.append((key, not null, turn))
                    held += b - a + 1
                    if held >= SHARD_IDS or len(rows) >= SHARD_DOCS:
                        yield shard(part, seq, ids, rows)
                        seq, held, ids, rows = seq + 1, 0, [], []
        if rows:
            yield shard(part, seq, ids, rows)

    n = partitions(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_key"), F.col("doc_id").isNull().alias("_null"), "text")
    ordered = keyed.repartitionByRange(n, F.desc("_null"), "_key").sortWithinPartitions(F.desc("_null"), "_key", F.xxhash64("text"))
    ordered.mapInArrow(build, SCHEMA).write.partitionBy("part").option("compression", "none").parquet(path)


def shard(part: int, seq: int, ids: list[bytes], rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    keys, valid, turns = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (np.int64, np.uint8, np.uint32), strict=True))
    counts = np.array([len(x) // 4 for x in ids], np.int64)
    h = key_hashes(keys, valid, turns)
    seeds, slot = build_hash(h)
    slots = np.zeros(len(h), _SLOT)
    slots["print"][slot], slots["first"][slot], slots["count"][slot] = fingerprints(h), np.cumsum(counts) - counts, counts
    known = keys[valid == 1].tolist()
    payload = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(payload) or payload.max() < 1 << 16 else 4
    heads = [[part], [seq], [len(h)], [int(counts.sum())], known[:1] or [None], known[-1:] or [None], [width]]
    packed = (payload.astype(f"<u{width}").tobytes(), *(x.tobytes() for x in (keys, valid, turns, seeds, slots)))
    columns = [*(pa.array(x, t) for x, t in zip(heads, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32()), strict=True)), *(pa.array([x], pa.binary()) for x in packed)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def _ids(payload: bytes, width: int, first: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Each document's ids of a shard's payload, as little-endian unsigned 32-bit."""
    spans = zip((width * first.astype(np.int64)).tolist(), (width * (first.astype(np.int64) + count)).tolist(), strict=True)
    return [payload[a:b] if width == 4 else np.frombuffer(payload[a:b], "<u2").astype("<u4").tobytes() for a, b in spans]


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, start: the ids before each shard. Sums per part first, so that no task sees all shards."""
    heads = shards.select("part", "seq", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return heads.withColumn("_inner", inner).join(F.broadcast(parts), "part").select("part", "seq", (F.col("_before") + F.col("_inner")).alias("start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian binary) of every stored document, each looked up in its shard's index by its key."""

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                keys, valid, turns = np.frombuffer(row.keys, np.int64), np.frombuffer(row.valid, np.uint8), np.frombuffer(row.turns, np.uint32)
                slots = np.frombuffer(row.slots, _SLOT)
                at = find(key_hashes(keys, valid, turns), np.frombuffer(row.seeds, np.int32), slots)
                if (at < 0).any():
                    raise ValueError(f"shard {row.part}/{row.seq}: a key isn't in its index")
                first, count = slots["first"][at].astype(np.int64), slots["count"][at].astype(np.int64)
                ids = _ids(row.payload, row.width, first, count)
                doc = pd.array(keys.copy(), dtype="Int64")
                doc[valid == 0] = pd.NA
                yield pd.DataFrame({"doc_id": doc, "start": row.start + first, "n_tokens": count, "ids": ids})

    shards = spark.read.schema(SCHEMA).parquet(path)
    starts = written(shard_starts(shards))
    return shards.join(small_side(starts), ["part", "seq"]).mapInPandas(look_up, "doc_id long, start long, n_tokens long, ids binary")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, turn, ids (little-endian binary) of each stored document whose doc_id is in keys (doc_id); absent and null keys give nothing.

    The shards' key ranges, two numbers a shard, lead from a key to its shards; only the files that hold them are read, and in each shard the hash leads
    to the slot, whose fingerprint tells absent keys (one in 2**32 is taken for another). Keys meet ranges by a join on steps, not by all pairs."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    heads = shards.select("part", "seq", "least", "most").where("least is not null")
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    width = heads.agg(F.greatest(F.max(F.col("most") - F.col("least")), F.lit(0)).alias("w")).first()["w"] or 0
    step = lambda c: F.floor(F.col(c) / F.lit(width + 1))  # noqa: E731  a shard lies in two steps at most
    near = heads.withColumn("_step", F.explode(F.array_distinct(F.array(step("least"), step("most")))))
    wanted = asked.withColumn("_step", step("doc_id")).join(near, "_step").where("doc_id between least and most").groupBy("part", "seq").agg(F.collect_set("doc_id").alias("asked"))
    wanted = written(wanted)
    parts = [r["part"] for r in wanted.select("part").distinct().collect()]  # a number for each file at most
    body = shards.where(F.col("part").isin(parts)).select("part", "seq", "width", "payload", "seeds", "slots")

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                seeds, slots = np.frombuffer(row.seeds, np.int32), np.frombuffer(row.slots, _SLOT)
                key, turn = np.asarray(row.asked, np.int64), 0
                while len(key):  # the next repeat of the keys found
                    at = find(key_hashes(key, np.ones(len(key), np.uint8), np.full(len(key), turn, np.uint32)), seeds, slots)
                    key, at = key[at >= 0], at[at >= 0]
                    ids = _ids(row.payload, row.width, slots["first"][at], slots["count"][at])
                    yield pd.DataFrame({"doc_id": key, "turn": turn, "ids": ids})
                    turn += 1

    return body.join(small_side(wanted), ["part", "seq"]).select("width", "payload", "seeds", "slots", "asked").mapInPandas(get, "doc_id long, turn long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids, reads the files back and returns each document's place and checksum."""
    import public_tokenizers

    path = scratch_dir(spark)
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Byte-level BPE encoding and decoding, by a contiguous array of part boundaries and adjacent ranks per word."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.util import give_back, short_batches

#: Fixed value: the word pattern of byte-level BPE vocabularies with this pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries in each of the two generations of a task's store of encoded words; a full store ages, which changes no result.
STORE = 100_000
#: Longest word that is stored, in characters.
KEPT_CHARS = 48
#: No rank.
NONE = np.int32(2**31 - 1)
#: Bytes of the words that are merged in one block.
_WIDTHS = (0, 6, 10, 14, 20, 32, 64, 160)
#: Signs that stand alone as a word behind letters.
_STOPS = tuple(".,;:!?")
#: Texts whose missing words are merged together, in characters.
TOGETHER = 2_000_000
#: A blank before a sign that isn't white space always starts a new word of PATTERN.
_CUT = re.compile(r" (?=\S)")


class Store:
    """A bounded mapping in two generations: what is used again stays."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def add(self, fresh: dict) -> None:
        if len(self.young) + len(fresh) > STORE:
            self.old, self.young = self.young, {}
        self.young.update(fresh)

    def known(self, keys: set[str]) -> dict:
        """What the store has of keys; what is only in the older generation is young again."""
        out = {k: self.young[k] for k in self.young.keys() & keys}
        again = {k: self.old[k] for k in self.old.keys() & keys}
        if again:
            self.add(again)
        return out | again


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    out, extra = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """(token: id, merges by rank, added token: id) of a byte-level BPE file of the tokenizers library whose words are PATTERN's; an error for others."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    before = file.get("pre_tokenizer") or {}
    if file["model"]["type"] != "BPE" or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level BPE whose words follow the usual pattern")
    letters = {c: b for b, c in enumerate(byte_letters())}
    to_bytes = lambda token: bytes(letters[c] for c in token)
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    ids = {to_bytes(token): i for token, i in file["model"]["vocab"].items()}
    return ids, [(to_bytes(a), to_bytes(b)) for a, b in merges], {t["content"]: t["id"] for t in file.get("added_tokens", [])}


class Pieces:
    """Cuts texts at the added tokens of a vocabulary."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __call__(self, text: str) -> Iterator[str | int]:
        """The stretches between added tokens, and the added tokens' ids."""
        at = 0
        if self.splitter is not None and any(s in text for s in self.special):
            for m in self.splitter.finditer(text):
                yield text[at : m.start()]
                yield self.special[m.group()]
                at = m.end()
        yield text[at:] if at else text


class ByteBpe:
    """The ids of a vocabulary file for whole texts, and back."""

    def __init__(self, path: str):
        self.ids, merges, special = read_vocabulary(path)
        self.ranks: dict[bytes, int] = {}
        for rank, (a, b) in enumerate(merges):
            self.ranks.setdefault(a + b, rank)
        self.pieces = Pieces(special)
        self.tokens = {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.words = regex.compile(PATTERN)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ids[a] << 16 | self.ids[b], rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)]
        self.made_by = np.array([p[2] for p in pairs] or [0], np.int32)
        self.pair_keys, order = np.unique(np.array([p[0] for p in pairs], np.uint32), return_index=True)
        self.pair_ranks = order.astype(np.int32)  # the first of equal pairs
        every = np.arange(256)
        self.byte_ranks = self.rank_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, len(every))).reshape(256, 256)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of joining parts a and b (ids), NONE where they don't join."""
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_many(self, words: list[str]) -> list[bytes]:
        """The ids of each word, little-endian unsigned 32-bit. Each row of a block is one word's contiguous arrays of parts and adjacent ranks;
        every round scans all rows for their least rank (leftmost of equals), deletes that boundary by closing the gap, and finds the two ranks
        beside it anew."""
        out: list = [None] * len(words)
        data = [w.encode("utf-8") for w in words]
        sizes = np.array([len(x) for x in data], np.int64)
        for low, width in zip(_WIDTHS, _WIDTHS[1:], strict=False):
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(some), 4096):
                self._merge_block(data, some[at : at + 4096], sizes, width, out)
        for k in np.flatnonzero((sizes > _WIDTHS[-1]) | (sizes == 0)):
            out[k] = np.array(self._scan_long(data[k]), "<u4").tobytes()
        return out

    def _merge_block(self, data: list[bytes], some: np.ndarray, sizes: np.ndarray, width: int, out: list) -> None:
        signs = np.frombuffer(b"".join([data[k].ljust(width, b"\0") for k in some]), np.uint8).reshape(-1, width)
        parts, size, cols = self.byte_ids[signs], sizes[some], np.arange(width)
        ranks = np.full(signs.shape, NONE, np.int32)
        ranks[:, :-1] = np.where(cols[:-1] < size[:, None] - 1, self.byte_ranks[signs[:, :-1], signs[:, 1:]], NONE)
        while len(some):
            i = ranks.argmin(axis=1)
            rows = np.arange(len(some))
            least = ranks[rows, i]
            done = least == NONE
            if done.any():
                ids = parts[done].astype("<u4").tobytes()
                for at, (k, n) in enumerate(zip(some[done].tolist(), size[done].tolist(), strict=True)):
                    at *= 4 * width
                    out[k] = ids[at : at + 4 * n]
                some, parts, ranks, size, i, least = (x[~done] for x in (some, parts, ranks, size, i, least))
                rows = rows[: len(some)]
                if not len(some):
                    break
            close = np.minimum(cols + (cols > i[:, None]), width - 1)
            parts, ranks = np.take_along_axis(parts, close, 1), np.take_along_axis(ranks, close, 1)
            ranks[:, -1] = NONE
            size = size - 1
            new = self.made_by[least]
            parts[rows, i] = new
            right, left = np.minimum(i + 1, width - 1), np.maximum(i - 1, 0)
            ranks[rows, i] = np.where(i < size - 1, self.rank_of(new, parts[rows, right]), NONE)
            ranks[rows, left] = np.where(i > 0, self.rank_of(parts[rows, left], new), ranks[rows, left])

    def _scan_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges for a very long word, by a heap over a linked list, so that the time isn't quadratic."""
        n, none = len(word), len(self.ranks)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2], none)) < none]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or end[mid] != stop:
                continue
            alive[mid], end[i], after[i] = False, stop, after[mid]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get(word[i : end[after[i]]], none)) < none:
                    heapq.heappush(heap, (r, i, stop, end[after[i]]))
            if (p := before[i]) >= 0 and (r := self.ranks.get(word[p:stop], none)) < none:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ids[word[i : end[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return next(iter(self.encode_many([text]))).tolist()

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, uint32."""
        for data in Chunks(self).batches(texts):
            yield np.frombuffer(data, "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Chunks:
    """Encodes texts chunk by chunk, a chunk being what stands between the blanks that start a word; keeps the bytes of each chunk's ids."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.store, self.word_store = Store(), Store()

    def words(self, chunk: str) -> list[str]:
        """The words of a blank and a chunk; the commonest kinds need no pattern."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1:] in _STOPS and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        return self.bpe.words.findall(" " + chunk)

    def batches(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, little-endian unsigned 32-bit; the words that the stores lack are merged many at once. A null text has none."""
        held: list[str | None] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._batch(held)
                held, size = [], 0
        yield from self._batch(held)

    def _batch(self, texts: list[str | None]) -> Iterator[bytes]:
        parsed = [[x if isinstance(x, int) else _CUT.split(x) for x in self.bpe.pieces(text) if x != ""] if text else [] for text in texts]
        chunks: set[str] = set()
        words: set[str] = set()
        heads: dict[str, list[str]] = {}  # chunks with no blank before them
        for parts in parsed:
            for part in parts:
                if not isinstance(part, int):
                    chunks.update(part[1:])
                    if part[0] and part[0] not in heads:
                        words.update(heads.setdefault(part[0], self.bpe.words.findall(part[0])))
        made = self.store.known(chunks)
        lacking = list(chunks.difference(made))
        own = list(map(self.words, lacking))
        words.update(chain.from_iterable(own))
        ids = self.word_store.known(words)
        lost = [w for w in words if w not in ids]
        fresh = dict(zip(lost, self.bpe.merge_many(lost), strict=True))
        self.word_store.add({w: x for w, x in fresh.items() if len(w) <= KEPT_CHARS})
        ids |= fresh
        get = ids.__getitem__
        fresh = dict(zip(lacking, [b"".join(map(get, w)) for w in own], strict=True))
        made.update(fresh)
        self.store.add({c: x for c, x in fresh.items() if len(c) <= KEPT_CHARS and "\n" not in c})
        get = made.__getitem__
        for parts in parsed:
            out: list[bytes] = []
            for part in parts:
                if isinstance(part, int):
                    out.append(part.to_bytes(4, "little"))
                else:
                    if part[0]:
                        out.append(b"".join([ids[w] for w in heads[part[0]]]))
                    out += map(get, part[1:])
            yield b"".join(out)


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path)


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids. A null or empty text has no ids; other columns pass through (a column named as ids is replaced)."""

    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(vocabulary)
        for batch in texts:
            yield pd.Series([ids.astype(np.int32) for ids in bpe.encode_many(batch)])

    return docs.withColumn(ids, F.pandas_udf(encode, "array<int>")(docs[text]))


def bpe_decode(docs: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of its ids; bytes that aren't UTF-8 come out as U+FFFD. Null ids give an empty text."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(vocabulary)
        for batch in batches:
            yield pd.Series([bpe.decode(x).decode("utf-8", "replace") if x is not None else "" for x in batch])

    return docs.withColumn(text, F.pandas_udf(decode, "string")(docs[ids]))


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 of its decimal ids joined by commas, decoded_sha256 of the text that those ids decode to.

    One row per row of docs, repeated and null doc_ids included; a null text counts as empty. Ids and texts stay inside the task, so only
    digests leave Python; a text is encoded whole, word by word.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary)
        decimals = [str(i) for i in range(max(bpe.tokens) + 1)].__getitem__
        chunks = Chunks(bpe)
        for batch in batches:
            rows = []
            for data in chunks.batches(batch["text"]):
                ids = np.frombuffer(data, "<u4").tolist()
                said = ",".join(map(decimals, ids))
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out
        del chunks
        give_back()

    short_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: see bpe_digests()."""
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

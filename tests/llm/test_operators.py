"""The numbered operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from readloom.llm.bpe import bpe_decode, bpe_digests, bpe_encode
from readloom.llm.components import components
from readloom.llm.embedding_dedup import near_vectors
from readloom.llm.exact_dedup import exact_dedup, exact_groups
from readloom.llm.packing import pack_documents, plan
from readloom.llm.quality import features, fit, quality_scores, train
from readloom.llm.simhash import close_lanes, near_links, parities, prefixes, simhash_groups, without_near_copies
from readloom.llm.substring_dedup import without_repeats
from readloom.llm import suffix_dedup
from readloom.llm.suffix_dedup import BlindTrie, anchors, later_windows, multikey_quicksort, sort_suffixes, without_repeated_bytes
from readloom.llm.token_files import build_hash, find, fingerprints, lookup, read_documents, write_shards
from readloom.llm.url_filter import RULES, filter_urls
from readloom.llm.util import mixed, scratch_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdeéñ") for _ in range(RNG.randint(1, 7))) for _ in range(300)]


def words(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


PASSAGE = words(60)
BASE = words(400)
EDITED = " ".join(w if i % 80 else "changed" for i, w in enumerate(BASE.split()))
TEXTS = [
    None, "", " \t\n", "one", BASE, BASE, BASE.replace(" ", "\n ", 9), EDITED, words(30) + " " + PASSAGE + " " + words(40), PASSAGE + "\x0b" + words(80),
    "Rep Rep " * 90, "x" * 9000, words(3000), "tail<|endoftext|> and  more\r\n", "é漢🙂 " * 50, words(35), "a b c d", "A B C D", PASSAGE,
]
ROWS = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(4, BASE, "xx", "repeat", 1), (None, BASE, None, None, None), (None, "null id", None, None, None)]
SCHEMA = "doc_id long, text string, _key string, kept string, n_words long"  # names that operators use themselves


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe_equals_the_library(docs, none):
    library = Tokenizer.from_file(BYTE)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for t in TEXTS + ["null id"]}
    got = Counter(map(tuple, bpe_digests(docs, BYTE).collect()))
    assert got == Counter((r[0], len(ids[r[1]]), sha(",".join(map(str, ids[r[1]]))), sha(library.decode(ids[r[1]], skip_special_tokens=False))) for r in ROWS)
    both = bpe_decode(bpe_encode(docs, BYTE), BYTE)
    assert all(r["ids"] == ids[r["text"]] and r["decoded"] == (r["text"] or "") for r in both.collect())
    assert bpe_digests(none, BYTE).count() == 0


def test_exact_groups(docs, none):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in ROWS]
    groups = {}
    for r, t in zip(ROWS, norm, strict=True):
        groups.setdefault(t, []).append(r[0])
    want = Counter()
    seen = set()
    for r, t in zip(ROWS, norm, strict=True):
        ids = [i for i in groups[t] if i is not None]
        keep = min(ids) if ids else None
        stays = r[0] == keep and t not in seen
        if stays:
            seen.add(t)
        want[(r[0], keep, len(groups[t]), stays, sha(t))] += 1
    assert Counter(map(tuple, exact_groups(docs).collect())) == want
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_groups(none).count() == 0 and exact_dedup(none).count() == 0


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://example.com/de/", "https://b.net/es/1", "x://net/fr/", "x://net/frx", "http://anet/es/", None, "no scheme", "h://com", "h://", "h://x.com/", "a://b://c.net/es/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z"), (None, urls[3], None)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")

    def judged(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest).group()
            path = re.match("[^?#]*", rest[len(host) :]).group()
            host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    want = Counter((r[0], *judged(r[1])) for r in pages.select("page_id", "url").collect())
    assert Counter(map(tuple, filter_urls(pages, rules).collect())) == want
    assert {r["verdict"] for r in filter_urls(pages, rules.limit(0), "block").collect()} == {"block"}
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_substring_dedup(docs, none):
    lists = [split(r[1]) for r in ROWS]
    count = Counter(tuple(w[i : i + 35]) for w in lists for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(ROWS, lists, strict=True):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[(r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert Counter(map(tuple, without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect())) == want
    assert without_repeats(none).count() == 0


def test_suffix_dedup(docs, none):
    order = sorted({(r[0] if r[0] is not None else 1 << 62, r[1] or "") for r in ROWS})
    seen, want = set(), {}
    for i, t in order:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        want[i, t] = (len(data), int(gone.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~gone]))
    got = without_repeated_bytes(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["text"] or ""]
    assert without_repeated_bytes(none).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for n, most in ((0, 2), (1, 2), (500, 2), (3000, 4), (3000, 1000)):
        words, group = rng.integers(0, most, (n, 4)).astype(np.uint64), rng.integers(0, 5, n)
        order, new = multikey_quicksort(words, group)
        rows = [(int(group[k]), *words[k].tolist()) for k in order]
        assert sorted(order.tolist()) == list(range(n)) and rows == sorted(rows)
        assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(n)]


@pytest.mark.parametrize("colliding", [False, True])
def test_windows_are_equal_by_bytes_even_if_all_hashes_collide(monkeypatch, colliding):
    length, seed = 20, 8
    rng = random.Random(4)
    part = ["".join(rng.choice("ab") for _ in range(rng.choice((9, 30, 60)))) for _ in range(8)]
    texts = ["".join(rng.choice(part) for _ in range(5)).encode() for _ in range(40)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    row, at, first, wins, _ = anchors(data, offsets, length, seed)
    blob = np.concatenate([data[a : a + n + length - 1] for a, n in zip(first, wins, strict=True)])
    if colliding:
        monkeypatch.setattr(suffix_dedup, "window_hash", lambda prefix, starts, ends, base: np.zeros(len(starts), np.uint64))
    found = later_windows(blob, at - first, wins, row, row, first - offsets[row], length, seed)
    got = {(int(k), int(a) + i) for k, a, n in zip(*found, strict=True) for i in range(n)}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            if t[a : a + length] in seen:
                want.add((i, a))
            seen.add(t[a : a + length])
    assert want and got == want


def test_suffix_order_and_blind_trie():
    strings = list({bytes(RNG.choice(b"ab") for _ in range(RNG.randint(0, 12))) for _ in range(300)})
    assert [strings[k] for k in BlindTrie(strings).order()] == sorted(strings)
    text = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcabcabdabcabcabcabcabcabcabcabcabcabcabc", np.uint8)
    start = np.arange(len(text))
    size = np.minimum(len(text) - start, 40)
    order, lcp = sort_suffixes(np.zeros(len(start), np.int64), text, start, size, 40)
    found = [text[start[k] : start[k] + size[k]].tobytes() for k in order]
    assert found == sorted(found)
    for a, b, n in zip(found, found[1:], lcp[1:], strict=False):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_simhash_groups(docs, none):
    def fingerprint(text):
        w = split("".join(c.lower() if c.isascii() else c for c in text or ""))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r[1]) for r in ROWS]
    root = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = {k: min((r[0] for r, x in zip(ROWS, root, strict=True) if x == k and r[0] is not None), default=None) for k in root}
    want = Counter((r[0], f"{p:016x}", least[k]) for r, p, k in zip(ROWS, prints, root, strict=True))
    assert Counter(map(tuple, simhash_groups(docs).collect())) == want
    assert simhash_groups(none).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 30])
def test_close_lanes(radius):
    rng = np.random.default_rng(radius)
    width = 2 if radius > 20 else 1
    prints = rng.integers(0, 2**63, (200, width), dtype=np.int64).astype(np.uint64)
    prints[100:] = prints[:100] ^ (np.uint64(1) << rng.integers(0, 6, (100, width)).astype(np.uint64))
    groups = np.sort(rng.integers(0, 3, 200))
    got = {(int(i), int(j)) for a, b in close_lanes(prints, groups, radius, 50) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(200) for j in range(i) if groups[i] == groups[j] and np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius}


def test_near_copies_keep_one_of_each_group(spark, docs, none):
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 7 not in ids and 6 not in ids and 5 not in ids and ids.count(4) == 2  # both rows of document 4, which are one document
    assert {0, 1, 2, 3, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18} <= set(ids)
    assert without_near_copies(none).count() == 0


def near_survivors(texts, similarity=0.8):
    """Brute force: the least index of each component of texts with a similarity of five-word shingle sets of at least similarity."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in range(len(texts))}


def near_edit(rng, base, places):
    w = base.split()
    for i in rng.sample(range(0, len(w), 5), places):
        w[i] = f"e{rng.random()}"
    return " ".join(w)


def survivors(spark, texts):
    return {r["doc_id"] for r in without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id").collect()}


def test_near_copies_of_one_original_are_all_found(spark):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(404))
    texts = [near_edit(rng, base, rng.randint(4, 9)) for _ in range(300)]  # 0.8 to 0.9 like the original, less like each other
    texts.insert(150, base)
    assert survivors(spark, texts) == near_survivors(texts)


def test_large_buckets_in_tiles_lose_no_near_copy(spark):
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(204))
    texts = [near_edit(rng, base, rng.randint(1, 7)) for _ in range(120)]
    texts += [near_edit(rng, texts[rng.randrange(120)], 2) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in without_near_copies(table, bucket=8).select("doc_id").collect()} == near_survivors(texts)


def test_large_buckets_in_tiles_lose_no_link(spark):
    rng = np.random.default_rng(13)
    prints = rng.integers(0, 2**20, 300).astype(np.int64) | (1 << 40)  # alike in four of six blocks, so that some buckets hold all
    links = near_links(spark.createDataFrame([(int(x),) for x in prints], "print long"), bucket=16)
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    distinct = sorted(set(prints.tolist()))
    root = {x: x for x in distinct}
    while True:
        least = {x: min(root[y] for y in distinct if (x ^ y).bit_count() <= 4) for x in distinct}
        if least == root:
            break
        root = least
    assert got == {x: r for x, r in root.items() if x != r} and len(set(root.values())) > 1


def test_near_copies_do_not_depend_on_repeats(spark):
    rng = random.Random(9)
    texts = []
    for k in range(20):  # one shingle fills over half of every text
        other = " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
        texts += ["rep " * 150 + other, "rep " * 170 + near_edit(rng, other, 1)]
    page = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    texts += [page, page + " a b c d e" * 400]
    assert survivors(spark, texts) == near_survivors(texts) == set(range(0, 42, 2))


def test_near_copies_miss_no_pair_at_the_similarity(spark):
    rng = random.Random(10)
    texts = []
    for _ in range(250):
        base = " ".join(f"w{rng.randrange(100_000)}" for _ in range(204))
        texts += [base, near_edit(rng, base, 4)]  # 180 of 220 shingles
    assert survivors(spark, texts) == near_survivors(texts) == set(range(0, 500, 2))


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(12)
    for _ in range(500):
        n = int(rng.integers(5, 60))
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        x, y = np.unique(pool[:n]), np.unique(pool[int(rng.integers(0, n // 5 + 1)) : n])
        common = np.sort(rng.choice(pool, n, replace=False))
        got = [set(prefixes(z, np.array([0, len(z)]), 0.8, common, np.arange(1, n + 1))[0].tolist()) for z in (x, y)]
        assert len(y) < 0.8 * len(x) or got[0] & got[1]


def test_sketches_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 900, rng.integers(0, 700))).astype(np.uint64) for _ in range(60)]
    made = [np.frombuffer(x, np.uint64) for x in parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))]
    for x, a in zip(sets, made, strict=True):
        for y, b in zip(sets, made, strict=True):
            assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(x, y))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_token_files(spark, docs, none):
    library = Tokenizer.from_file(WORD)
    path = scratch_dir(spark)
    write_shards(docs, WORD, 2, path)
    got = read_documents(spark, path).collect()
    assert len(got) == len(ROWS)
    of = {}
    for r in ROWS:
        of.setdefault(r[0], []).append(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and 4 * r["n_tokens"] == len(r["ids"]) and bytes(r["ids"]) in of[r["doc_id"]]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    keys = spark.createDataFrame([(4,), (4,), (7,), (12345,), (-3,), (None,)], "doc_id long")
    found = lookup(spark, path, keys).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == Counter((i, x) for i in (4, 7) for x in of[i])
    assert lookup(spark, path, keys.limit(0)).count() == 0
    path = scratch_dir(spark)
    write_shards(none, WORD, 2, path)
    assert read_documents(spark, path).count() == 0 and lookup(spark, path, keys).count() == 0


def test_a_lookup_reads_the_files_of_its_keys_alone(spark):
    path = scratch_dir(spark)
    write_shards(spark.range(400).selectExpr("id as doc_id", "concat('text ', id) as text"), WORD, 2, path)
    got = lookup(spark, path, spark.createDataFrame([(77,)], "doc_id long"))
    assert [bytes(r["ids"]) for r in got.collect()] == [np.array([*Tokenizer.from_file(WORD).encode("text 77", add_special_tokens=False).ids, 2], "<u4").tobytes()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = \d+", plan) and spark.read.parquet(path).select("part").distinct().count() > 1


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_perfect_hash(n):
    h = mixed(np.arange(n, dtype=np.uint64))
    seeds, slot = build_hash(h)
    assert sorted(slot) == list(range(n))
    slots = np.zeros(n, [("print", "<u4")])
    slots["print"][slot] = fingerprints(h)
    assert (find(h, seeds, slots) == slot).all()
    assert (find(mixed(np.arange(n, 2 * n, dtype=np.uint64)), seeds, slots) == -1).mean() > 0.99


def test_packing(docs, none):
    library = Tokenizer.from_file(BYTE)
    left = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in ROWS)
    got = pack_documents(docs, BYTE).collect()
    want = Counter()
    for (doc, ids), n in left.items():
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += n
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(none, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_and_packs_tightly(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, (1025, 400, 30, 1025, 700, 1025)[seed], 3000)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    made = plan(counts)
    fill, placed = Counter(), Counter()
    for size, _, items, each, first, _ in made.segments:
        placed[size] += items
        for i in range(items):
            fill[first + i // each] += size
    assert dict(placed) == counts and max(fill.values()) <= 1024 and len(fill) == made.bins
    large = np.sort(sizes[sizes * 3 > 1024])[::-1].tolist()
    alone = sum(1 for s in large if s * 2 > 1024)
    assert made.bins <= max(-(-int(sizes.sum()) // 1024), alone) * 1.05 + 2


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    center = rng.normal(size=(3, 16))
    rows = [(i, [float(x) for x in center[i % 3] + 0.05 * rng.normal(size=16)], i) for i in range(90)]
    rows += [(100 + i, [float(x) for x in rng.normal(size=16)], 0) for i in range(50)]
    rows += [(200, rows[100][1], 1), (201, None, 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] * 16, 1), (205, [1.0, 2.0], 1), (206, [x * 2 for x in rows[0][1]], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cid long")
    unit = {}
    for i, v, _ in rows:
        if v and len(v) == 16 and None not in v:
            x = np.float32(v).astype(float)
            if np.isfinite(x).all() and x.any():
                unit[i] = x / np.linalg.norm(x)
    near = {i: {j for j in unit if j != i and unit[i] @ unit[j] >= 0.95} for i in unit}
    root = {i: i for i, _, _ in rows}
    for _ in range(5):
        for i in near:
            for j in near[i]:
                root[i] = root[j] = min(root[i], root[j])
    got = near_vectors(table).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (len(near.get(i, ())), root[i], root[i] == i) for i in root}
    assert near_vectors(table.limit(0)).count() == 0


def test_sparse_near_vectors_are_found(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(40):  # cosines 0.952 to 0.97
        other = x[2 * i + 1] - (x[2 * i + 1] @ x[2 * i]) * x[2 * i]
        c = rng.uniform(0.952, 0.97)
        x[2 * i + 1] = c * x[2 * i] + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float64()))})
    got = near_vectors(spark.createDataFrame(table)).where("n_links > 0").collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (1, i - i % 2) for i in range(80)}


def test_quality(spark, none):
    good = [(i, words(80) + ". " + words(50) + ".") for i in range(0, 300, 2)]
    bad = [(i, (RNG.choice(VOCAB) + " ") * 120 if i % 4 == 1 else " ".join(w.upper() + "!!" for w in words(90).split())) for i in range(1, 300, 2)]
    table = spark.createDataFrame([*good, *bad, (None, None), (301, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (301, None)], "doc_id long, quality int")
    model = train(table, labels)
    scored = {r["doc_id"]: r["score"] for r in quality_scores(table, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((scored[i] >= 0.5) == (i % 2 == 0) for i in held)
    assert right >= 0.95 * len(held) and all(0 <= x <= 1 for x in scored.values())
    assert quality_scores(none, model).count() == 0
    assert train(table.limit(0), labels.limit(0)).score(np.zeros((1, 1))).shape == (1,)


def test_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, (500, 3)), np.concatenate((rng.normal(2, 1, (800, 3)), rng.normal(-2, 1, (200, 3))))
    model = fit(p, u, 0.8)
    assert (model.score(rng.normal(2, 1, (300, 3))) >= 0.5).mean() > 0.95 and (model.score(rng.normal(-2, 1, (300, 3))) < 0.5).mean() > 0.9


def test_features_of_empty_and_odd_texts():
    data = "\n\n a\nB!!".encode()
    x = features(np.frombuffer(data, np.uint8), np.array([0, 0, 1, 2, len(data)]))
    assert x.shape[0] == 4 and np.isfinite(x).all()
    assert features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[0] == 0


def test_regular_words_of_one_polynomial_hash_are_told_apart(spark):
    """Two long words built from a/b and b/a by doubling, which collide under any polynomial modulo 2**64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    same = [f"w{i}" for i in range(34)]
    table = spark.createDataFrame([(1, " ".join([*same[:17], a, *same[17:]])), (2, " ".join([*same[:17], b, *same[17:]]))], "doc_id long, text string")
    assert [r["n_removed"] for r in without_repeats(table).collect()] == [0, 0]


def test_long_texts_over_a_step(spark):
    """Texts longer than what one vectorised step takes, with a passage that repeats across them and a single hot string."""
    rng = random.Random(8)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage = text(60)
    table = spark.createDataFrame([(1, text(350_000) + " " + passage), (2, passage + " " + text(10)), (3, "x" * 3_000_000), (4, passage)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in without_repeats(table).select("doc_id", "n_removed").collect()}
    assert got == {1: 60, 2: 60, 3: 0, 4: 60}
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in without_repeated_bytes(table).select("doc_id", "n_removed", "n_spans").collect()}
    assert got[1] == (0, 0) and got[3] == (3_000_000 - 1, 1) and got[4] == (len(passage), 1) and got[2][0] >= len(passage)


def test_vectors_of_two_lengths_and_odd_ids(spark):
    rng = np.random.default_rng(5)
    wide = [[float(x) for x in rng.normal(size=16)] for _ in range(40)]
    short = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = [(i, v) for i, v in enumerate(wide)] + [(50, short), (51, short), (52, [2 * x for x in short]), (52, short), (None, wide[3])]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = Counter([(i, 1 if i == 3 else 0, i, True) for i in range(40)] + [(50, 3, 50, True), (51, 3, 50, False), (52, 3, 50, False), (52, 3, 50, False), (None, 1, 3, False)])
    assert got == want


def test_a_component_wider_than_a_tile(spark):
    rng = np.random.default_rng(6)
    center = rng.normal(size=12)
    x = center + 0.11 * np.linalg.norm(center) / 12**0.5 * rng.normal(size=(2300, 12))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(table).select("vec_id", "n_links").collect()}
    assert [got[i] for i in range(len(x))] == near.tolist()


def test_near_vectors_with_a_common_direction(spark, monkeypatch, caplog):
    """Background cosine 0.85, sparse pairs above 0.95, and an audit that sees few or none of them."""
    from readloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "AUDIT", 10)
    monkeypatch.setattr(embedding_dedup, "AUDIT_PAIRS", 1)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64)) + 2.4
    x[:60] = x[100:160] + 0.6 * rng.normal(size=(60, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.95), strict=True) if i != j}
    table = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = sum(r["n_links"] for r in near_vectors(table).select("n_links").collect())
    assert len(want) >= 60 and 0.99 * len(want) <= found <= len(want)


def test_keys_of_near_copies_tell_ids_from_texts(spark):
    words_ = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(5, words_), (None, "5:" + words_), (1, words_), (None, "#5:" + words_)]
    kept = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted((i or 0, t) for i, t in rows if i != 5)


@pytest.mark.parametrize("limit", [1 << 31, 64])
def test_groups_lose_no_row(monkeypatch, limit):
    """Groups that span many batches come out whole and once, also where 32-bit offsets don't reach."""
    from readloom.llm import simhash

    monkeypatch.setattr(simhash, "OFFSET_BYTES", limit)
    rng = random.Random(3)
    for _ in range(60):
        q = sorted(rng.randrange(6) for _ in range(rng.randint(0, 60)))
        cuts = sorted(rng.randint(0, len(q)) for _ in range(8))
        made = pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([bytes([k]) * 9 for k in range(len(q))], pa.binary())], ["q", "x"])
        batches = [made.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(q)])]
        least = rng.choice([1, 5, 30])
        out = list(simhash.whole_groups(iter(batches), simhash.same_group("q"), least))
        assert [v for b in out for v in b.column("q").to_pylist()] == q
        assert [v for b in out for v in b.column("x").to_pylist()] == [bytes([k]) * 9 for k in range(len(q))]
        assert all(a.column("q")[-1] != b.column("q")[0] for a, b in zip(out, out[1:])) and all(b.num_rows >= least for b in out[:-1])

"""The registered queries themselves, and the pipeline's stages, on the smallest tables against SQL, the libraries or brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from readloom.llm.queries import QUERIES, SQL  # noqa: E402

from tests.llm.plain import plain_runs  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
LIBRARY = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}
SHAPES = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_bpe_roundtrip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_nn_descent": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op6_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op12_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(file):
    return {i: LIBRARY[file].encode(t, add_special_tokens=False).ids for i, t in DOCS}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, SF).toPandas() for name, query in QUERIES.items()}


def rows(results, name):
    return sorted(tuple(x.item() if hasattr(x, "item") else x for x in r) for r in results[name].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_columns(spark, name):
    assert ", ".join(f"{c} {t}" for c, t in QUERIES[name](spark, SF).dtypes) == SHAPES[name]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(results, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(SQL[name]).df()[list(results[name].columns)]
    whole = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    clean = lambda df: Counter(str(tuple(map(whole, r))) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))
    assert clean(results[name]) == clean(want)


def test_encodings(results):
    library = LIBRARY["byte_bpe_50k.json"]
    want = [(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids_of("byte_bpe_50k.json").items()]
    assert rows(results, "op2_bpe_roundtrip") == sorted(want)
    at, want = 0, []
    for i, x in sorted(ids_of("word_bpe_49k.json").items()):
        want.append((i, at, len(x) + 1, crc([*x, 2])))
        at += len(x) + 1
    assert rows(results, "op6_token_files") == want


def packed_right(got, texts):
    ids = {i: [*LIBRARY["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, bins = {}, {}
    for doc, piece, start, length, check, seq, offset in got:
        assert crc(ids[doc][start : start + length]) == check
        pieces.setdefault(doc, []).append((piece, start, length))
        bins.setdefault(seq, []).append((offset, length))
    assert set(pieces) == set(ids)
    for doc, x in pieces.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(x)):
            assert piece == k and start == at and length <= 1024 and (k == 0 or length == 1024)
            at += length
        assert at == len(ids[doc])
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(bins) <= least * 1.02 + 1


def test_packing(results):
    packed_right(rows(results, "op8_best_fit_packing"), dict(DOCS))


def test_vectors(results):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in table], float)
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T >= 0.95
    root = np.array([r["vec_id"] for r in table])
    for _ in range(len(root)):
        least = np.array([root[n].min() for n in near])
        if (least == root).all():
            break
        root = least
    assert rows(results, "op3_nn_descent") == sorted((r["vec_id"], int(n.sum()) - 1, int(c), bool(r["vec_id"] == c)) for r, n, c in zip(table, near, root, strict=True))


def test_suffixes(results):
    seen, want = set(), []
    for i, t in sorted(DOCS):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        starts = gone & ~np.concatenate(([False], gone))[:-1]
        want.append((i, len(data), int(gone.sum()), int(starts.sum()), sha(np.frombuffer(data, np.uint8)[~gone].tobytes())))
    assert rows(results, "op7_suffix_dedup") == want


def test_simhash(results):
    prints = {}
    for i, t in DOCS:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        each = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in each]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}
    while True:
        least = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if least == root:
            break
        root = least
    assert rows(results, "op9_simhash") == sorted((i, f"{p:016x}", root[i]) for i, p in prints.items())


def test_quality(results):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = rows(results, "op10_quality")
    assert [r[0] for r in got] == sorted(i for i, _ in DOCS)
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= score <= 1 and predicted == (score >= 0.5) for i, held, score, predicted in got)
    held = [(score, label[i]) for i, out, score, _ in got if out and i in label]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_nearest(results):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in table], float)
    ids, x = np.array([r["vec_id"] for r in table]), x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for q, r, v, s in rows(results, "op12_nearest_neighbours"):
        got.setdefault(q, []).append((r, v, s))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        want = np.lexsort((ids, -s.round(12)))[:5]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(s[ids == v][0] - c) < 1e-12 for _, v, c in found)
        hits += len({v for _, v, _ in found} & set(ids[want].tolist()))
    assert hits >= 0.95 * 5 * len(got)


def test_runs(results):
    want = []
    for i, t in sorted(DOCS):
        w, h = re.findall("[^\x20\x09-\x0d]+", t), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w, 12)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(told), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(None if isinstance(x, float) and x != x else int(x) if isinstance(x, float) else x for x in r) for r in rows(results, "op13_periodic_runs")]
    assert got == want and sum(r[1] for r in want) > 20


def test_pipeline(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        texts = {r["doc_id"]: r["text"] or "" for r in got} if "text" in out.columns else None
        if name != "best-fit packing":
            assert out.columns == columns
        if name == "quality classifier":
            scores = QUERIES["op10_quality"](spark, SF)
            assert set(texts) == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
        elif name == "exact dedup":
            first = {}
            for i, t in sorted(kept.items()):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), i)
            assert set(texts) == set(first.values())
        elif name == "simhash near-dedup":
            sets = {}
            for i, t in kept.items():
                words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
                sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
            root = {i: i for i in sets}
            for _ in sets:
                least = {i: min([root[i], *(root[j] for j in sets if len(sets[i] & sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]) for i in sets}
                if least == root:
                    break
                root = least
            assert set(texts) == {i for i in sets if root[i] == i}
        elif name == "substring dedup":
            words = {i: re.findall("[^\x20\x09-\x0d]+", t) for i, t in kept.items()}
            count = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
            for i, w in words.items():
                gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
                assert texts[i] == (" ".join(x for j, x in enumerate(w) if j not in gone) if gone else kept[i])
        else:
            packed_right([tuple(r) for r in got], kept)
            break
        kept = texts
        docs = spark.createDataFrame(got, out.schema)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == Counter(tuple(r)[:5] for r in got)

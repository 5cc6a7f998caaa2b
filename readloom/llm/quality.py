"""Document quality by positive-unlabelled learning: the non-negative unbiased risk of trusted positives and unlabelled web text is minimised."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from readloom.llm.util import mixed, steps, word_hashes, word_spans

#: Bounds of the training sample: trusted positives and unlabelled texts at most, those with the least hash of their doc_id.
MOST_POSITIVE, MOST_UNLABELLED = 12_000, 24_000
#: Rounds over the sample, texts a step, hidden units, step size and weight decay of the fit.
EPOCHS, BATCH, HIDDEN, RATE, DECAY = 60, 1024, 24, 0.005, 1e-4
_SIGNS = [b"!", b"?", b".", b",", b";:", b"|", b"#*$%&", b"@", b"-_=", b"'\"", b"()[]{}<>", b"/\\", b"\n", b"\r\t", b" "]
_CLASSES = [*_SIGNS, bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x30, 0x3A)), bytes(range(0x80, 0x100))]


def _per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive rows' offsets."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[rows[1:]] - total[rows[:-1]]


def _variety(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: distinct values, the count of the most frequent, and the sum of squared counts."""
    n = len(rows) - 1
    doc = np.repeat(np.arange(n), np.diff(rows))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(h)))
    owner = d[new]
    most = np.zeros(n)
    np.maximum.at(most, owner, count)
    return np.bincount(owner, minlength=n), most, np.bincount(owner, count.astype(float) ** 2, n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text, from its whole bytes and words: shares of byte classes, word shapes, repetition and line structure."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, rows = word_spans(data, offsets)
    words = np.diff(rows).astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    out = [np.log1p(size), np.log1p(words)]
    kind = np.zeros(256, np.uint8)
    for k, signs in enumerate(_CLASSES, 1):
        kind[list(signs)] = k
    doc = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(doc * (len(_CLASSES) + 1) + kind[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, len(_CLASSES) + 1) * per_byte[:, None]
    out += list(np.sqrt(shares).T)
    length = (ends - starts).astype(float)
    mean = _per_row(length, rows) * per_word
    out += [mean, np.sqrt(np.maximum(_per_row(length**2, rows) * per_word - mean**2, 0)), _per_row(length > 20, rows) * per_word]
    if len(starts):
        first, last, second = kind[data[starts]], kind[data[ends - 1]], kind[data[np.minimum(starts + 1, ends - 1)]]
    else:
        first = last = second = np.zeros(0, np.uint8)
    upper, lower, digit = (len(_SIGNS) + i for i in (1, 2, 3))
    for mark in (first == upper, (first == upper) & (second == upper), first == lower, first == digit, (last < upper) & (last > 0), last == 3, last == 4, last == 7):
        out.append(_per_row(mark, rows) * per_word)
    h = word_hashes(data, starts, ends)
    same_row = np.ones(len(h), bool)
    same_row[rows[:-1][rows[:-1] < len(h)]] = False
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & same_row[1:]
    out.append(_per_row(again, rows) * per_word)
    pair = h.copy()
    pair[1:] += mixed(h[:-1].copy()) * same_row[1:]
    for x in (h, pair):
        distinct, most, square = _variety(x, rows)
        out += [distinct * per_word, np.log1p(distinct), most * per_word, np.sqrt(square) * per_word]
    lines = np.flatnonzero(data == 0x0A)
    cuts = np.union1d(lines + 1, offsets)
    cuts = cuts[cuts <= len(data)]
    if len(cuts) > 1:
        line_rows = np.searchsorted(cuts[:-1], offsets)
        line_hash = word_hashes(data, cuts[:-1], cuts[1:] - np.isin(cuts[1:] - 1, lines))
        distinct, most, _ = _variety(line_hash, line_rows)
        count = np.diff(line_rows)
        out += [np.log1p(count), distinct / np.maximum(count, 1), most / np.maximum(count, 1), np.log1p(size / np.maximum(count, 1))]
    else:
        out += [np.zeros(n)] * 4
    return np.stack(out, axis=1)


@dataclass
class Model:
    """A network with one hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.tanh(z @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def gradients(w: list[np.ndarray], x: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[list[np.ndarray], float]:
    """(the step's gradients by w, the second part of the risk) on standardised rows x, of which is_p are positives: the risk's gradients where the second part
    isn't below zero, else those that undo it."""
    hidden = np.tanh(x @ w[0] + w[1])
    out = hidden @ w[2] + w[3]
    s = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
    loss0 = np.logaddexp(0, out)
    negative = loss0[~is_p].mean() - prior * loss0[is_p].mean()
    n_p, n_u = is_p.sum(), (~is_p).sum()
    g_neg = np.where(is_p, -prior / n_p, 1 / n_u) * s
    g = np.where(is_p, prior / n_p, 0) * (s - 1) + g_neg if negative >= 0 else -g_neg
    back = np.outer(g, w[2]) * (1 - hidden**2)
    return [x.T @ back, back.sum(0), hidden.T @ g, g.sum()], negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Minimises prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)) by Adam, R the mean logistic loss. Where the
    second part falls below zero, the step goes the other way, so that the network can't gain from calling unlabelled positives negative.
    With no positives or no unlabelled texts every score is the prior."""
    dims = positive.shape[1] if positive.ndim == 2 and positive.size else (unlabelled.shape[1] if unlabelled.size else 1)
    if not len(positive) or not len(unlabelled):
        flat = np.clip(prior, 1e-6, 1 - 1e-6)
        return Model(np.zeros(dims), np.ones(dims), [np.zeros((dims, 1)), np.zeros(1), np.zeros(1), np.array(np.log(flat / (1 - flat)))])
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = [rng.normal(0, dims**-0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    batches = max(1, len(u) // BATCH)
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        of_p, of_u = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(batches):
            x = np.concatenate((p[of_p[k::batches]], u[of_u[k::batches]]))
            is_p = np.arange(len(x)) < len(of_p[k::batches])
            if is_p.all() or not is_p.any():
                continue
            grads, _ = gradients(w, x, is_p, prior)
            grads[0], grads[2] = grads[0] + DECAY * w[0], grads[2] + DECAY * w[2]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def text_features(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns of docs and features array<double> of each whole text; a null text is empty."""
    fields = docs.select(*kept, "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                x = features(data, offsets)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), rows], [*kept, "features"])

    return fields.mapInArrow(of, StructType([*fields.drop("text").schema.fields, StructField("features", ArrayType(DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, positives: int = MOST_POSITIVE, unlabelled: int = MOST_UNLABELLED) -> Model:
    """A model from the rows of docs and labels (doc_id, quality) whose fold isn't 1.

    Trusted positives are texts labelled 1, unlabelled ones any texts, labelled or not; the class prior is estimated as the share
    of labels that are 1, the only use made of labels 0. The sample's size is bounded by the two parameters; it is drawn by the hash of doc_id. Null
    doc_ids and labels are no part of it; of rows that repeat a doc_id, the least text is.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (_fold() != 1)).select("doc_id", "quality")
    share = rows.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    p = rows.where("quality = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(True).alias("_p"))
    u = docs.where(F.col("doc_id").isNotNull() & (_fold() != 1)).select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(True).alias("_u"))
    sample = F.broadcast(p.join(u, "doc_id", "full"))  # bounded by the two parameters
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "_p", "_u").agg(F.min("text").alias("text"))
    found = text_features(texts, "_p", "_u").toPandas()
    x = np.stack(found["features"]) if len(found) else np.zeros((0, 1))
    of_p, of_u = (found[c].eq(True).to_numpy(bool) if len(found) else np.zeros(0, bool) for c in ("_p", "_u"))
    order = np.lexsort(x.T[::-1])  # so that the fit doesn't depend on the order of arrival
    x, of_p, of_u = x[order], of_p[order], of_u[order]
    return fit(x[of_p], x[of_u], 0.5 if share is None else share)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a score (0 to 1, higher is better) of each whole text; a column of that name is replaced. Empty and null texts are scored too,
    by the features of an empty text. The score depends on the text alone."""
    docs = docs.drop("score")
    kept = docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features(data, offsets)))], [*kept, "score"])

    return docs.mapInArrow(of, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document: see train() and quality_scores(). A null doc_id counts as an empty text in the fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (_fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

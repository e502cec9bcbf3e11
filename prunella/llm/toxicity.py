"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 6 bytes of the lower-cased word between blanks), hashed into buckets
that each have an embedding; a passage is the average of its bags; a linear softmax tells its class.  Embeddings and
softmax are trained jointly in numpy on a bounded sample of labelled rows.  Unseen misspellings share n-gram vectors
with the words they come from.

One toxic word in a long text would drown in an average over the whole text.  So a text is scored by the passage (a
window of words) that is most toxic, over all windows of the whole text; training finds those windows itself: at first
all windows of a text carry its label a little, then the most toxic one alone.

Defined cases: a null or empty text is scored as a passage without n-grams; labels that are null are ignored, and of
several labels of one document the highest counts; without labels of both kinds the score is 0.  Columns besides doc_id
and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import LOWER, SPACE, byte_grams, row_sums, slices, small_batches, table, word_bounds
from prunella.llm.quality import labelled_sample, platt

#: Labelled documents that the fit uses at most: those with the lowest hash of their id.
SAMPLE_DOCS = 8000
TOXIC_AT = 0.3
PASSAGE_WORDS = 6
BITS = 16
GRAMS = (3, 4, 5, 6)
DIMENSIONS = 6
#: Only n-grams that speak for class toxic in the sample are embedded: so many at most, in so many documents at least.
MAX_FEATURES = 20_000
MIN_DOCS = 3
MIN_CHI = 15.0
FOCUS = 20.0
DECAY = 1e-6
NONE = len(GRAMS) << BITS


@dataclass
class Model:
    """The embeddings seen through the softmax: what each bucket adds to the logit of class toxic, and a calibration."""

    value: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


def grams(buf: np.ndarray, off: np.ndarray):
    """Yield the buckets of the n-grams at each byte; NONE where one leaves its row or spans two words."""
    buf = LOWER[buf]
    buf = np.where(SPACE[buf], np.uint8(32), buf)
    blank = np.concatenate([[0], np.cumsum(buf == 32)])
    for k, n in enumerate(GRAMS):
        at = byte_grams(buf, off, n, BITS)
        at = np.where(at == 1 << BITS, NONE, at + (k << BITS))
        if len(buf) >= n:
            inner = blank[n - 1 : len(buf)] - blank[1 : len(buf) - n + 2]  # blanks between the first and the last byte
            at[: len(buf) - n + 1][inner > 0] = NONE
        yield at


def passages(buf: np.ndarray, off: np.ndarray, words: int = PASSAGE_WORDS):
    """Byte ranges of passages, half overlapping, and where each row's begin; a row without words has one, empty."""
    starts, ends, first = word_bounds(buf, off)
    n = np.diff(first)
    half = max(1, words // 2)
    count = np.maximum(1, -(-np.maximum(n - half, 0) // half))
    at = np.zeros(len(n) + 1, np.int64)
    at[1:] = np.cumsum(count)
    row = np.repeat(np.arange(len(n)), count)
    k = (np.arange(at[-1]) - at[row]) * half
    lo = np.minimum(first[row] + k, len(starts))
    hi = np.minimum(lo + words, first[row + 1])
    empty = n[row] == 0
    padded = np.concatenate([starts, [len(buf)]])
    a = np.where(empty, off[row], np.maximum(padded[lo] - 1, off[row]))
    b = np.where(empty, off[row], np.minimum(np.concatenate([[0], ends])[hi] + 1, off[row + 1]))
    return a, np.maximum(a, b), at


def logits(buf: np.ndarray, off: np.ndarray, value: np.ndarray, bias: float) -> np.ndarray:
    """The logit of the most toxic passage of each row."""
    a, b, at = passages(buf, off)
    total, count = np.zeros(len(buf) + 1), np.zeros(len(buf) + 1)
    for g in grams(buf, off):
        total[1:] += value[g]
        count[1:] += g != NONE
    total, count = np.cumsum(total), np.cumsum(count)
    mean = (total[b] - total[a]) / np.maximum(count[b] - count[a], 1)
    return np.maximum.reduceat(mean, at[:-1]) + bias if len(mean) else np.zeros(0)


def telling(texts: pa.Array, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The buckets whose presence in a text speaks for class toxic (chi-square with one degree of freedom)."""
    df = np.zeros((2, NONE + 1))
    for r, q, buf, off in slices(texts):
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for g in grams(buf, off):
            pair = np.unique(row.astype(np.int64) * (NONE + 1) + g)
            at, col = np.divmod(pair, NONE + 1)
            at = at[col != NONE] + r
            col = col[col != NONE]
            for c in (0, 1):
                df[c] += np.bincount(col[use[at] & (y[at] == c)], minlength=NONE + 1)
    n = np.array([(use & (y == c)).sum() for c in (0, 1)])
    a, b = df[1], df[0]
    c, d = n[1] - a, n[0] - b
    chi = (a * d - b * c) ** 2 * n.sum() / np.maximum((a + b) * (c + d) * n[0] * n[1], 1)
    found = np.flatnonzero((chi > MIN_CHI) & (a + b >= MIN_DOCS) & (a * n[0] > b * n[1]))
    return np.sort(found[np.argsort(-chi[found], kind="stable")][:MAX_FEATURES])


def _bags(texts: pa.Array, names: np.ndarray):
    """The row and the number of n-grams of each passage, and passage and place in names of each telling n-gram."""
    rows, sizes, bags, cols, n = [], [], [], [], 0
    place = np.full(NONE + 1, -1, np.int32)
    place[names] = np.arange(len(names))
    for r, _, buf, off in slices(texts):
        a, b, at = passages(buf, off)
        half = np.searchsorted(a, np.arange(len(buf)), "right") - 1  # the last passage that begins at or before a byte
        size = np.zeros(len(a), np.int64)
        for g in grams(buf, off):
            there = np.concatenate([[0], np.cumsum(g != NONE)])
            size += there[b] - there[a]
            hit = np.flatnonzero(place[g] >= 0)
            for back in (0, 1):  # passages overlap by half
                bag = half[hit] - back
                ok = (bag >= 0) & (b[np.maximum(bag, 0)] > hit)
                bags.append((bag[ok] + n).astype(np.int32))
                cols.append(place[g[hit[ok]]])
        rows.append(np.repeat(np.arange(len(off) - 1), np.diff(at)) + r)
        sizes.append(size)
        n += len(a)
    return np.concatenate(rows), np.maximum(np.concatenate(sizes), 1), np.concatenate(bags), np.concatenate(cols)


def fit(texts: pa.Array, y: np.ndarray, steps: int = 200, rate: float = 0.05, seed: int = 7) -> Model | None:
    """Joint full-batch Adam over embeddings and softmax; None without rows of both classes."""
    n = len(y)
    hold = np.arange(n) % 5 == 4
    if len(np.unique(y[~hold])) < 2:
        return None
    names = telling(texts, y, ~hold)
    row, size, bag, col = _bags(texts, names)
    val = (1 / size[bag]).astype(np.float32)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (DIMENSIONS, len(names))).astype(np.float32)
    w = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params, moments = [e, w, bias], [(np.zeros_like(x), np.zeros_like(x)) for x in (e, w, bias)]
    weight = np.where(y > 0, 0.5 / max(y[~hold].sum(), 1), 0.5 / max((1 - y)[~hold].sum(), 1)) * ~hold
    edge = np.searchsorted(row, np.arange(n + 1))

    def passage_logits():
        value = (w[1] - w[0]) @ e
        return np.bincount(bag, weights=value[col] * val, minlength=len(row)) + float(bias[1] - bias[0])

    for k in range(1, steps + 1):
        u = w[1] - w[0]
        z = passage_logits()
        # Attention over the passages of a text: even at first, on the most toxic one at last.
        top = np.maximum.reduceat(z, edge[:-1])
        att = np.exp(np.clip((z - top[row]) * min(1.0, 2 * k / steps) * FOCUS, -60, 0))
        att /= np.add.reduceat(att, edge[:-1])[row]
        doc = np.add.reduceat(att * z, edge[:-1])
        err = weight * (1 / (1 + np.exp(-np.clip(doc, -40, 40))) - y)
        gz = (att * err[row]).astype(np.float32)
        g = np.bincount(col, weights=gz[bag] * val, minlength=len(names)).astype(np.float32)
        both = e @ g
        grads = [np.outer(u, g) + DECAY * e, np.stack([-both, both]) + DECAY * w, np.array([-gz.sum(), gz.sum()], np.float32)]
        for x, d, (m, v) in zip(params, grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            v += 0.01 * d * d
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        # An n-gram may speak for class toxic or not at all, so that common neighbours of a toxic word can't hide it.
        u = w[1] - w[0]
        e -= np.outer(u, np.minimum(u @ e, 0) / max(float(u @ u), 1e-9))
    value = np.zeros(NONE + 1, np.float32)
    value[names] = (w[1] - w[0]) @ e
    slope, shift = platt(np.maximum.reduceat(passage_logits(), edge[:-1])[hold], y[hold])
    return Model(value, float(bias[1] - bias[0]), slope, shift)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, where=None) -> Model | None:
    sample = labelled_sample(docs, labels, "toxic", sample_docs, where, F.max)
    texts = sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string())
    return fit(texts, sample.column("label").to_numpy().astype(float))


def score_toxicity(docs: DataFrame, model: Model | None, toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, score (probability of toxic) and predicted (1 from toxic_at on) of each row."""
    small_batches(docs.sparkSession)

    def score(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                p = model.probability(logits(buf, off, model.value, model.bias)) if model else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(p.astype(np.float64)), pa.array((p >= toxic_at).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), where=~held_out())
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

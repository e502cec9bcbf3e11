"""Quality rules: base counts of a text, then a hashed word and character n-gram logistic regression.

The regression sees relative frequencies of hashed words and of hashed 1- to 3-byte grams, is fitted in numpy on a
bounded sample of labelled rows, and its logit is calibrated (Platt scaling) on a fifth of that sample which the fit
did not see.  Scoring runs in Arrow batches against fixed thresholds.

Defined cases: a null text has no words (base_failed); documents without an id are scored like others; labels that are
null are ignored, and of several labels of one document the lowest counts; without labels of both kinds the regression
abstains (score 1, so the base rules decide alone).  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import (
    SPACE, byte_grams, row_of, row_sums, slices, small_batches, span_hashes, table, windows, word_bounds,
)

#: Labelled documents that the fit uses at most: those with the lowest hash of their id.
SAMPLE_DOCS = 4000
#: Fixed thresholds.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5

BITS = 14
GRAMS = (1, 2, 3)
#: Weights: one block for words and one for each gram length; each block ends with an unused bucket.
BLOCK = (1 << BITS) + 1
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


def buckets(buf: np.ndarray, off: np.ndarray):
    """Yield (buckets, first) of each feature block: words, then byte grams."""
    starts, ends, first = word_bounds(buf, off)
    yield (span_hashes(buf, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), first
    for k, n in enumerate(GRAMS):
        yield byte_grams(buf, off, n, BITS) + BLOCK * (k + 1), off


def logits(buf: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(off) - 1, bias)
    for at, first in buckets(buf, off):
        out += row_sums(weights[at], first) / np.maximum(np.diff(first), 1)
    return out


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    starts, ends, first = word_bounds(buf, off)
    n_words = np.diff(first)
    chars = row_sums((~SPACE[buf] & ((buf & 0xC0) != 0x80)).astype(np.int64), off)
    symbols = row_sums(SYMBOL[buf].astype(np.int64), off)
    # Lines: cut at each newline and at row ends; a line counts if a word begins in it.
    newline = np.flatnonzero(buf == 10)
    begins = np.sort(np.concatenate([off[:-1], newline + 1]))
    stops = np.sort(np.concatenate([newline, off[1:]]))
    line_row = np.searchsorted(off, begins, "right") - 1
    # A newline that ends its row starts an empty line at the next row's offset; empty lines hold no word anyway.
    worded = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops, line_row = begins[worded], stops[worded], line_row[worded]
    seen = np.unique(span_hashes(buf, begins, stops) ^ (line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    n_rows = len(off) - 1
    dup_lines = np.bincount(line_row, minlength=n_rows) - np.bincount(line_row[seen], minlength=n_rows)
    repeat = np.zeros(n_rows, np.int64)
    win, at = windows(span_hashes(buf, starts, ends), first, 3)
    if len(win):
        rows = row_of(first)
        key = win ^ (rows[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        ranked = np.sort(key)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if len(twice):
            near = np.searchsorted(twice, key)
            near[near == len(twice)] = 0
            hit = at[twice[near] == key]
            covered = np.zeros(len(starts), np.int64)
            for j in range(3):
                covered[hit + j] = 1
            repeat = row_sums(covered, first)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where=None, of=F.min) -> pa.Table:
    """text and label of the `limit` labelled documents with the lowest hash of their id.

    Ids are chosen first, without texts; so the join's broadcast side and what reaches the driver are bounded.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = ids.where(where) if where is not None else ids
    ids = ids.groupBy("doc_id").agg(of(label).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = texts.toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    return found.take(pa.array(order)).select(["text", "label"])


def _sparse(texts: pa.Array) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """All rows' relative frequencies, as parts of one slice of rows and one feature block each: first row, number of the
    block, entries of each row, and each entry's bucket in the block and its value.

    Six bytes an entry, as a fit keeps them all; what never counts, the unused bucket, is left out.
    """
    parts = []
    for a, _, buf, off in slices(texts):
        for k, (at, first) in enumerate(buckets(buf, off)):
            size = np.diff(first)
            key, count = np.unique(row_of(first) * BLOCK + (at - k * BLOCK), return_counts=True)
            row, col = np.divmod(key, BLOCK)
            used = col < BLOCK - 1
            row, col, value = row[used], col[used], (count[used] / size[row[used]]).astype(np.float32)
            parts.append((a, k, np.bincount(row, minlength=len(size)), col.astype(np.uint16), value))
    return parts


def _products(parts, w: np.ndarray, n: int) -> np.ndarray:
    """The sum of each row's values times the weights of their buckets; part by part, so that temporaries stay small."""
    z = np.zeros(n)
    for a, k, entries, col, val in parts:
        row = np.repeat(np.arange(len(entries)), entries)
        z[a : a + len(entries)] += np.bincount(row, weights=w[k * BLOCK : (k + 1) * BLOCK][col] * val, minlength=len(entries))
    return z


def _gradient(parts, err: np.ndarray, size: int) -> np.ndarray:
    """The sum of each bucket's values times the errors of their rows."""
    g = np.zeros(size)
    for a, k, entries, col, val in parts:
        g[k * BLOCK : (k + 1) * BLOCK] += np.bincount(col, weights=np.repeat(err[a : a + len(entries)], entries) * val, minlength=BLOCK)
    return g


def fit(texts: pa.Array, y: np.ndarray, steps: int = 80, rate: float = 1.0, decay: float = 1e-4) -> Model | None:
    """Full-batch Adam on the first four fifths, Platt scaling on the rest; None without rows of both classes."""
    n = len(y)
    hold = np.arange(n) % 5 == 4
    if len(np.unique(y[~hold])) < 2:
        return None
    parts = _sparse(texts)
    size = BLOCK * (len(GRAMS) + 1)
    w, bias = np.zeros(size), 0.0
    m1, m2, b1, b2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    use = (~hold).astype(float)
    for k in range(1, steps + 1):
        z = _products(parts, w, n) + bias
        err = use * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / use.sum()
        g = _gradient(parts, err, size) + decay * w / n
        gb = err.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**k, 1 - 0.99**k
        w -= rate * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-8)
        bias -= 0.1 * rate * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-8)
    z = _products(parts, w, n) + bias
    slope, shift = platt(z[hold], y[hold])
    return Model(w.astype(np.float32), bias, slope, shift)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a sigmoid over logits, by Newton steps on smoothed targets; (1, 0) without both classes."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        d, h = p - target, p * (1 - p) + 1e-6
        grad = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        step *= min(1, 2 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    sample = labelled_sample(docs, labels, "quality", sample_docs)
    texts = sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string())
    return fit(texts, sample.column("label").to_numpy().astype(float))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def score_quality(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """Base counts, base_failed, kept and the calibrated probability (score) of each row of docs."""
    small_batches(docs.sparkSession)

    def score(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                base = base_counts(buf, off)
                p = model.probability(logits(buf, off, model.weights, model.bias)) if model else np.ones(b - a)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a)]
                    + [pa.array(x.astype(np.int64)) for x in base.values()]
                    + [pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p.astype(np.float64))],
                    ["doc_id", *base, "base_failed", "kept", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def kept_documents(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that base rules and model keep, with all their columns."""
    small_batches(docs.sparkSession)

    def keep(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                base = base_counts(buf, off)
                good = (base["n_words"] >= MIN_WORDS) & (100 * base["n_repeat_words"] <= MAX_REPEAT_PERCENT * base["n_words"])
                if model:
                    good &= model.probability(logits(buf, off, model.weights, model.bias)) >= keep_at
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))

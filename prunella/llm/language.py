"""Language identification: nearest of several TF-IDF centroids per language, by cosine, with rejection by distance.

Features are hashed 1- to 3-byte grams of the letters of a text (A-Z lower-cased, other ASCII as blanks).  The fit takes
a bounded sample of labelled rows: document frequencies, then spherical k-means for each language.  A text gets the
language of the most similar centroid; one that is further away than nearly all training rows of that language is marked
as rejected.

Defined cases: a text that is null or has no letter is `und` with score 0; labels that are null are ignored; without
labelled rows every text is `und`.  Columns besides doc_id, text and (for the fit) lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import byte_grams, row_of, slices, small_batches, table

#: Labelled documents of a language that the fit uses at most: those with the lowest hash of their id.
SAMPLE_DOCS = 600
CENTROIDS = 4
BITS = (8, 11, 12)
SIZE = sum(1 << b for b in BITS)
ROWS = 256
#: A text is rejected below this share of the similarity that all but one in a hundred training rows have.
SLACK = 0.5

_LETTER = np.array([c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray


def counts(buf: np.ndarray, off: np.ndarray):
    """Yield (first row, counts of the rows' grams) over blocks of at most ROWS rows."""
    buf = _LETTER[buf]
    blank = buf == 32
    void = blank.copy()
    void[:-1] &= blank[1:]
    n = len(off) - 1
    for a in range(0, n, ROWS):
        b = min(n, a + ROWS)
        part, edge = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        row = row_of(edge)
        out, base = np.zeros((b - a, SIZE), np.float32), 0
        for k, bits in enumerate(BITS):
            g = byte_grams(part, edge, k + 1, bits)
            use = (g < 1 << bits) & ~(void if k else blank)[off[a] : off[b]]
            c = np.bincount(row[use] * (1 << bits) + g[use], minlength=(b - a) << bits)
            out[:, base : base + (1 << bits)] = c.reshape(b - a, -1)
            base += 1 << bits
        yield a, out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(texts: pa.Array, langs: list[str]) -> Model | None:
    if not langs:
        return None
    tf = np.concatenate([c for _, _, buf, off in slices(texts) for _, c in counts(buf, off)])
    idf = np.log((1 + len(langs)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
    x, langs = vectors(tf, idf), np.asarray(langs)
    centroids, names, limits = [], [], []
    for lang in sorted(set(langs.tolist())):
        own = x[langs == lang]
        c = kmeans(own, CENTROIDS)
        near = (own @ c.T).max(1)
        centroids.append(c)
        names += [lang] * len(c)
        limits += [SLACK * float(np.quantile(near, 0.01))] * len(c)
    return Model(idf, np.concatenate(centroids), names, np.asarray(limits))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the row nearest the mean and then the rows furthest from what is chosen; unit centroids."""
    mean = x.mean(0)
    chosen = [int((x @ mean).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(docs: DataFrame, where=None, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on at most sample_docs rows of each language.  Languages are few; ids are chosen before texts are fetched."""
    small_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null and text is not null and lang is not null")
    rows = rows.where(where) if where is not None else rows
    mark = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    # The k least marks of each language, by a bound that every task applies before anything is shuffled.
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total:
        return None
    share = F.lit(0.0)
    for lang, n in total.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * sample_docs / n))).otherwise(share)
    few = rows.where((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) <= share).select("lang", mark.alias("m"))
    ids = few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("m")), 1, sample_docs).alias("m"))
    ids = ids.select(F.explode("m").alias("m")).select("m.doc_id").distinct()
    found = rows.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").toArrow()
    found = found.take(pa.array(np.argsort(found.column("doc_id").to_numpy(), kind="stable")))
    return fit(found.column("text").combine_chunks(), found.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (cosine) and rejected of each row."""
    small_batches(docs.sparkSession)

    def predict(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                langs, scores, rejected = [], [], []
                letter = lettered(batch.column("text").slice(a, b - a), buf, off)
                for r, tf in counts(buf, off) if model else ():
                    near = vectors(tf, model.idf) @ model.centroids.T
                    best = near.argmax(1)
                    cos = near[np.arange(len(best)), best].astype(np.float64)
                    langs += [model.languages[j] for j in best]
                    scores += np.clip(cos, 0, 1).tolist()
                    rejected += (cos < model.limits[best]).tolist()
                if not model:
                    langs, scores, rejected = ["und"] * (b - a), [0.0] * (b - a), [True] * (b - a)
                for i in np.flatnonzero(~letter):
                    langs[i], scores[i], rejected[i] = "und", 0.0, True
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def lettered(texts: pa.Array, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row has a letter: an ASCII one, or else one that Unicode calls a letter."""
    low = buf | np.uint8(32)
    ascii_ = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (buf < 128))])
    out = ascii_[off[1:]] > ascii_[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, where=~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")

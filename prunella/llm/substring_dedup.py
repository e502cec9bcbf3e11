"""Substring dedup: documents parsed into factors of earlier text, in the manner of relative Lempel-Ziv.

The reference is the text of all documents, cut into blocks where its content says: each window of `width` words has an
anchor, the least of the hashes of its runs of ANCHOR words, and the neighbouring windows with one anchor make a block.
Blocks are indexed by their content.  A document is factored block by block: a block whose content stands in a document
before is copied whole.  At the boundaries of such factors, blocks whose anchor also stands in blocks of other content
are looked up window by window (equal windows have equal anchors, so no other block can hold them).  Windows that follow
one another and come from the same document make one factor; the words of factors are the duplicate spans.  Repeats
within a document are found where it is read.

Blocks and windows are known by two 64-bit hashes, 128 bits, of their words.  What is shuffled is one short row for each
distinct block of a document (about one in six words), then the texts of blocks at boundaries, then the spans.

Defined cases: a null or blank text has no words; a text of fewer words than a window keeps all; identical rows of one
doc_id count as one document and each gets its result; different rows of one doc_id do not remove words of each other; a
null doc_id comes after all others.  Other columns are not read by spans, and kept by deduplicated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import mix, powers, released, row_of, slices, small_batches, span_hashes, table, windows, word_bounds, written
from prunella.llm.lookup import looked_up

WIDTH = 20
#: Words of an anchor: longer ones are rarer by chance, shorter ones make blocks longer.
ANCHOR = 10
#: Bytes of text that are hashed at a time.
SLICE = 4 << 20
LAST = (1 << 63) - 1


def _spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of hashed words; equal runs hash alike wherever they stand."""
    power, inverse = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Hashed:
    """Words, windows and blocks of the rows of a slice of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, width: int):
        self.starts, self.ends, self.first = word_bounds(buf, off)
        self.h = span_hashes(buf, self.starts, self.ends)
        self.width = width
        self.row = row_of(self.first)
        last = max(0, len(self.h) - width + 1)
        ok = self.row[:last] == self.row[width - 1 :] if last else np.zeros(0, bool)
        self.at = np.flatnonzero(ok)  # the first word of each window

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that begin at these words."""
        return _spans(self.h, at, at + self.width), _spans(mix(self.h ^ np.uint64(0xA0761D6478BD642F)), at, at + self.width)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, where its anchor stands (the first of equal ones) and its hash."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = np.zeros(len(self.h), np.uint64)
        own, at = windows(self.h, self.first, size)
        grams[at] = own
        # Least place of 2, 4, 8, ... runs, then of all by two that overlap; ties to the first.
        n, span, best = self.width - size + 1, 1, np.arange(len(grams))
        least = lambda x, y: np.where(grams[x] <= grams[y], x, y)
        while 2 * span <= n:
            best = least(best[: len(best) - span], best[span:])
            span *= 2
        if n > span:
            best = least(best[: len(best) - (n - span)], best[n - span :])
        place = best[self.at]
        return place, grams[place]

    def blocks(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor, content, first word and number of windows of each block; a content once in a row."""
        place, anchor = self.anchors(size)
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.row[self.at[1:]] != self.row[self.at[:-1]])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(place)))
        at = self.at[head]
        content = _spans(self.h, at, at + n + self.width - 1)
        row = self.row[at]
        order = np.lexsort((at, content, anchor[head], row))
        keep = np.ones(len(order), bool)
        r, a, c = row[order], anchor[head][order], content[order]
        keep[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        own = np.sort(order[keep])
        return row[own], anchor[head][own], content[own], at[own], n[own]

    def repeated(self) -> np.ndarray:
        """The first words of the windows that stand earlier in their own row."""
        if not len(self.at):
            return self.at
        one, two = self.keys(self.at)
        order = np.lexsort((self.at, two, one, self.row[self.at]))
        r, x, y = self.row[self.at][order], one[order], two[order]
        same = np.zeros(len(order), bool)
        same[1:] = (r[1:] == r[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        return np.sort(self.at[order[same]])


def _keys() -> list:
    """doc (doc_id, null last) and k, which tells rows of one doc_id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def block_rows(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """(doc, k, a, s, first, n): the distinct blocks of each document: anchor, content, first word, number of windows."""

    def blocks(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text"), SLICE):
                own = Hashed(buf, off, width)
                row, low, content, at, n = own.blocks(anchor)
                pick = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pick), batch.column("k").take(pick), _signed(low), _signed(content),
                     pa.array((at - own.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["doc", "k", "a", "s", "first", "n"],
                )

    return docs.select(*_keys(), "text").mapInArrow(blocks, "doc long, k long, a long, s long, first int, n int")


def _boundary_windows(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc, k, first, w1, w2): the windows of the wanted blocks (doc, k, blocks of first and n)."""

    def cut(batches):
        for batch in batches:
            texts, blocks = batch.column("text"), batch.column("blocks")
            for a, b, buf, off in slices(texts, SLICE):
                own = Hashed(buf, off, width)
                part = blocks.slice(a, b - a)
                row = np.repeat(np.arange(b - a), part.value_lengths().to_numpy())
                flat = part.flatten()
                first, n = flat.field("first").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                before = np.cumsum(n) - n
                step = np.arange(n.sum()) - np.repeat(before, n)
                row, first = np.repeat(row, n), np.repeat(first, n) + step
                one, two = own.keys(own.first[row] + first)
                pick = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pick), batch.column("k").take(pick), pa.array(first.astype(np.int32)), _signed(one), _signed(two)],
                    ["doc", "k", "first", "w1", "w2"],
                )

    rows = docs.select(*_keys(), "text").join(wanted, ["doc", "k"]).select("doc", "k", "text", "blocks")
    return rows.mapInArrow(cut, "doc long, k long, first int, w1 long, w2 long")


def factors(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc, k, runs): of each document with any, runs (first, n, source): n windows from word `first` on that stand in the
    document `source` before it."""
    spark = docs.sparkSession
    small_batches(spark)
    anchor = min(anchor, width)
    blocks = written(block_rows(docs, width, anchor), "blocks")
    # Rows of one doc_id share their blocks: the document counts once.
    index = blocks.groupBy("a", "s").agg(F.min("doc").alias("source"), F.count("*").alias("n_rows"))
    index = written(index, "block-index")
    released(spark)
    # Boundaries: contents that share an anchor with another content.
    several = index.groupBy("a").agg(F.count("*").alias("n_contents")).where("n_contents > 1")
    several = written(several, "shared-anchors")
    boundary = looked_up(index, several, ["a"], "n_contents").withColumn("boundary", F.lit(True))
    both = index.where("n_rows > 1").withColumn("boundary", F.lit(False)).unionByName(boundary)
    both = both.groupBy("a", "s").agg(F.first("source").alias("source"), F.first("n_rows").alias("n_rows"), F.max("boundary").alias("boundary"))
    found = written(looked_up(blocks, written(both, "live-blocks"), ["a", "s"], "n_rows").drop("a", "s"), "found-blocks")
    released(spark, blocks, index, several)
    # A content at a boundary is looked up where it stands first: elsewhere it is copied whole.
    wanted = found.where("boundary and source = doc").groupBy("doc", "k").agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("blocks"))
    rows = written(_boundary_windows(docs, wanted, width), "boundary-windows")
    released(spark)
    seen = rows.groupBy("w1", "w2").agg(F.min("doc").alias("source"), F.max("doc").alias("last"), F.count("*").alias("n_rows"))
    seen = written(seen.where("source < last").drop("last"), "repeated-windows")
    single = looked_up(rows, seen, ["w1", "w2"], "n_rows").where("source < doc")
    runs = found.where("source < doc").select("doc", "k", "first", "n", "source").unionByName(single.select("doc", "k", "first", F.lit(1).alias("n"), "source"))
    out = runs.groupBy("doc", "k").agg(F.array_sort(F.collect_set(F.struct("first", "n", "source"))).alias("runs"))
    out = written(out, "factor-runs")
    released(spark, found, rows, seen)
    return out


def merged_runs(runs: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Factors (first word, words, source) of runs of windows: a run that goes on in the same source is one factor."""
    out: list[list[int]] = []
    for first, n, source in runs:
        if out and out[-1][2] == source and first <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], first + n - out[-1][0])
        else:
            out.append([first, n, source])
    return [(first, n + width - 1, source) for first, n, source in out]


SPAN = "array<struct<first:int,words:int,source:long>>"


def deduplicated(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """docs with n_words, n_removed, spans (first word, words, source doc_id; the own doc_id for repeats within) and kept,
    the words that stay, joined by blanks."""
    found = factors(docs, width, anchor)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys()).join(found, ["doc", "k"], "left")
    rows = rows.select("row", "doc", "runs", F.col("row.text").alias("text"))
    schema = rows.schema["row"].dataType.simpleString()
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("source", pa.int64())]))

    def cut(batches):
        for batch in batches:
            doc, runs = batch.column("doc").to_numpy(), batch.column("runs")
            for a, b, buf, off in slices(batch.column("text"), SLICE):
                own = Hashed(buf, off, width)
                n_words = np.diff(own.first)
                again = own.repeated()
                local = np.searchsorted(again, own.first)
                data, spans, kept, removed = buf.tobytes(), [], [], []
                for i in range(b - a):
                    base = int(own.first[i])
                    given = [(r["first"], r["n"], r["source"]) for r in runs[a + i].as_py() or []]
                    inner = [(int(x) - base, 1, int(doc[a + i])) for x in again[local[i] : local[i + 1]]]
                    parts = merged_runs(given, width) + merged_runs(inner, width)
                    gone = np.zeros(int(n_words[i]) + 1, np.int32)
                    for first, n, _ in parts:
                        gone[first] += 1
                        gone[first + n] -= 1
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + base
                    removed.append(int(n_words[i]) - len(stay))
                    kept.append(b" ".join(data[x:y] for x, y in zip(own.starts[stay].tolist(), own.ends[stay].tolist(), strict=True)))
                    spans.append([{"first": f, "words": n, "source": None if s == LAST else s} for f, n, s in sorted(parts)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, b - a), pa.array(n_words), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["row", "n_words", "n_removed", "spans", "kept"],
                )

    out = rows.mapInArrow(cut, f"row {schema}, n_words long, n_removed long, spans {SPAN}, kept string")
    return out.select("row.*", "n_words", "n_removed", "spans", "kept")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)::BIGINT - 18)) AS i FROM dw WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM dw),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""

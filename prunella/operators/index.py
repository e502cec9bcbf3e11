"""Index construction: postings, vocabulary, document and index statistics as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prunella.functions.text import PROCESSORS, TermFunction, words
from prunella.storage import bounded_batches, deleted, ordered, written

#: Positions between two fragments of a virtual document.
VIRTUAL_GAP = 64
#: Bytes of texts that a batch hands to Python, and words that are inverted at a time; a longer document is one of its own.
BATCH_BYTES = 4 << 20
SLICE_WORDS = 1 << 17


@dataclass
class Index:
    """postings (field, term, doc_id, count, positions), vocab (field, term_id, term, df, cf), doc_stats (field, doc_id,
    size, n_terms), stats (field and one row of totals); payloads (doc_id, typed columns) where documents have any."""

    postings: DataFrame
    vocab: DataFrame
    doc_stats: DataFrame
    stats: DataFrame
    inverted: DataFrame | None = None
    payloads: DataFrame | None = None
    _totals: list | None = None

    def totals(self) -> list:
        """The rows of stats, one a field: read once."""
        if self._totals is None:
            self._totals = self.stats.collect()
        return self._totals

    def stored(self) -> Index:
        """The same index as tables; postings range-partitioned and sorted by term, so that a term's list is pruned to.

        Texts are read once: what they give is stored in the order of documents, and dealt out by ranges of terms from
        there, for which a sample of the terms alone is read.
        """
        postings, doc_stats, rows = self.postings, self.doc_stats, None
        if self.inverted is not None:
            rows = written(self.inverted, "inverted")
            postings, doc_stats = _parts(rows)
        postings = postings.repartitionByRange("field", "term").sortWithinPartitions("field", "term", "doc_id")
        postings, doc_stats = written(postings, "postings"), written(doc_stats, "doc-stats")
        if rows is not None:
            deleted(rows)
        out = index_of(postings, doc_stats, store=True)
        out.payloads = None if self.payloads is None else written(in_document_order(self.payloads), "payloads")
        return out


def tokens(docs: DataFrame, text: str = "text", field: str = "text", processor: str | Callable[[Column], Column] = "downcase") -> DataFrame:
    """(field, doc_id, pos, term); a cancelled term is null, but keeps its position."""
    process = PROCESSORS[processor] if isinstance(processor, str) else processor
    return docs.select(F.lit(field).alias("field"), "doc_id", F.posexplode(words(text)).alias("pos", "word")).select(
        "field", "doc_id", "pos", process(F.col("word")).alias("term")
    )


def invert(toks: DataFrame, positions: bool = True) -> DataFrame:
    kept = toks.where("term is not null").groupBy("field", "term", "doc_id")
    if not positions:
        return kept.agg(F.count("*").cast("int").alias("count"))
    return kept.agg(F.count("*").cast("int").alias("count"), F.sort_array(F.collect_list("pos")).alias("positions"))


def document_stats(toks: DataFrame, docs: DataFrame, field: str = "text") -> DataFrame:
    """size counts positions, cancelled terms too; documents without words have size 0."""
    sizes = toks.groupBy("doc_id").agg((F.max("pos") + 1).alias("size"), F.count_distinct("term").alias("n_terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return docs.select("doc_id").join(sizes, "doc_id", "left").select(
        F.lit(field).alias("field"), "doc_id", zero(F.col("size")).alias("size"), zero(F.col("n_terms")).alias("n_terms")
    )


INVERTED = "field string, term string, doc_id {}, count int, positions array<int>, n_terms int"


def inverted(docs: DataFrame, text: str, field: str, processor) -> DataFrame:
    """What a pass over the texts gives: a row for each (document, term), and one for each document, which has no term,
    but its size as `count`, and n_terms.

    A document's words are brought together where it is read; nothing is shuffled.
    """
    process = PROCESSORS[processor] if isinstance(processor, str) else processor
    of = process.of if isinstance(process, TermFunction) else None
    own = words(text) if of else F.transform(words(text), process)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(own, F.array().cast("array<string>")).alias("w"))

    def one(w, ids):
        size = w.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        coded = w.flatten().dictionary_encode()
        terms, code = coded.dictionary, coded.indices.fill_null(-1).to_numpy()
        if of:
            again = pa.array([of(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
            terms, own_code = again.dictionary, again.indices.fill_null(-1).to_numpy()
            code = own_code[code] if len(own_code) else code
        kept = np.flatnonzero(code >= 0)
        order = kept[np.argsort(row[kept] * max(len(terms), 1) + code[kept], kind="stable")]
        r, c = row[order], code[order]
        head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))) if len(order) else np.zeros(0, np.int64)
        edges = np.append(head, len(order))
        n = len(size)
        at = np.concatenate([r[head], np.arange(n)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([edges, np.full(n, len(order))]).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array([field] * len(at), pa.string()), pa.concat_arrays([terms.take(pa.array(c[head])), pa.nulls(n, pa.string())]), ids.take(pa.array(at)),
             pa.array(np.concatenate([np.diff(edges), size]).astype(np.int32)), lists, pa.array(np.bincount(r[head], minlength=n)[at].astype(np.int32))],
            ["field", "term", "doc_id", "count", "positions", "n_terms"],
        )

    def invert_(batches):
        for batch in batches:
            w, ids = batch.column("w"), batch.column("doc_id")
            end = np.cumsum(w.value_lengths().to_numpy().astype(np.int64))
            a = 0
            while a < len(end):
                b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + SLICE_WORDS, "right")))
                yield one(w.slice(a, b - a), ids.slice(a, b - a))
                a = b

    return rows.mapInArrow(invert_, INVERTED.format(kind))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and document statistics of inverted rows."""
    postings = rows.where("term is not null").select("field", "term", "doc_id", "count", "positions")
    return postings, rows.where("term is null").select("field", "doc_id", F.col("count").alias("size"), "n_terms")


def vocabulary(postings: DataFrame, store: bool = False) -> DataFrame:
    """Terms are numbered in their order within a field; with store, by ranges of terms that are written."""
    terms = postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("count").alias("cf"))
    if store:
        rows = ordered(terms, [F.col("field"), F.col("term")])
        first = rows.groupBy("field").agg(F.min("ord").alias("first"))  # one row per field
        return rows.join(F.broadcast(first), "field").select("field", (F.col("ord") - F.col("first")).alias("term_id"), "term", "df", "cf")
    number = F.row_number().over(Window.partitionBy("field").orderBy("term")) - 1
    return terms.select("field", number.cast("long").alias("term_id"), "term", "df", "cf")


def index_statistics(postings: DataFrame, doc_stats: DataFrame, vocab: DataFrame) -> DataFrame:
    p = vocab.groupBy("field").agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.sum("cf").alias("n_occurrences"))
    p = p.join(postings.groupBy("field").agg(F.max("count").alias("max_count")), "field")
    d = doc_stats.groupBy("field").agg(F.count("*").alias("n_docs"), F.max("size").alias("max_doc_size"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_terms", "n_postings", "n_occurrences", "max_count")}
    return d.join(p, "field", "left").select("field", "n_docs", *zero.values(), "max_doc_size")


def index_of(postings: DataFrame, doc_stats: DataFrame, store: bool = False) -> Index:
    keep = written if store else (lambda df, _: df)
    vocab = keep(vocabulary(postings, store), "vocab")
    return Index(postings, vocab, doc_stats, keep(index_statistics(postings, doc_stats, vocab), "stats"))


def in_document_order(payloads: DataFrame) -> DataFrame:
    """Payloads as they are stored: in the order of documents, whose row groups then have narrow bounds of whatever goes up
    or down with it, such as dates."""
    return payloads.repartitionByRange("doc_id").sortWithinPartitions("doc_id")


def build_index(docs: DataFrame, fields: dict[str, str] | None = None, processor="downcase", payloads: dict[str, str] | None = None) -> Index:
    """An index of the given fields (name: column); each field has its own postings, vocabulary and statistics.

    payloads (name: column) are typed values of a document, which are stored with the index, and asked for by ranges.
    """
    fields = {"text": "text"} if fields is None else fields
    if missing := [c for c in [*fields.values(), *(payloads or {}).values()] if c not in docs.columns]:
        raise ValueError(f"no such columns: {missing}")
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    rows = reduce(DataFrame.unionByName, [inverted(docs, column, field, processor) for field, column in sorted(fields.items())])
    out = index_of(*_parts(rows))
    out.inverted = rows
    if payloads:
        out.payloads = docs.select("doc_id", *(F.col(f"`{c}`").alias(name) for name, c in payloads.items()))
    return out


def remapped(frame: DataFrame, doc_map: DataFrame) -> DataFrame:
    """frame with its doc_id replaced by new_id of doc_map (doc_id, new_id)."""
    return frame.join(doc_map, "doc_id").withColumn("doc_id", F.col("new_id")).drop("new_id")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Parts with dense ids one after another: ids of a part are moved behind those of the parts before."""
    out = sizes = None
    for k, p in enumerate(parts):
        one = p.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("n")).withColumn("part", F.lit(k))
        tagged = p.withColumn("part", F.lit(k))
        sizes, out = (one, tagged) if out is None else (sizes.union(one), out.unionByName(tagged))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return out.join(sizes, "part").withColumn("doc_id", F.col("doc_id") + F.col("offset")).drop("part", "offset")


def virtual_tokens(fragments: DataFrame, gap: int = VIRTUAL_GAP, processor="downcase") -> DataFrame:
    """(field, doc_id, pos, term) of documents made of fragments (target, ord, text).

    A fragment begins behind the kept words of those before it, and a gap for each.
    """
    if gap < 0:
        raise ValueError("a gap must not be negative")
    process = PROCESSORS[processor] if isinstance(processor, str) else processor
    own = fragments.select("target", "ord", words("text").alias("w"))
    kept = F.size(F.filter("w", lambda x: process(x).isNotNull()))
    run = Window.partitionBy("target").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("start", F.coalesce(F.sum(kept + gap).over(run), F.lit(0)))
    rows = own.select("target", "start", F.posexplode("w").alias("p", "word"))
    return rows.select(
        F.lit("virtual").alias("field"), F.col("target").alias("doc_id"), (F.col("start") + F.col("p")).alias("pos"), process(F.col("word")).alias("term")
    )


def unigram_xdoc(postings: DataFrame, model: DataFrame, unknown: float) -> DataFrame:
    """(doc_id, n_terms, xdoc): the sum of the probabilities of a document's distinct terms under model (term, prob)."""
    own = postings.select("doc_id", "term").join(model, "term", "left")
    return own.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum(F.coalesce("prob", F.lit(unknown))).alias("xdoc"))


def corpus_lines(docs: DataFrame) -> DataFrame:
    """Each document's words, as they are, joined by blanks."""
    return docs.select("doc_id", F.array_join(words("text"), " ").alias("line"))

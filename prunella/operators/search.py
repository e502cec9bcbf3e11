"""Batch search: many flat queries in one plan, ranked results, set operations and and-then over query parts.

queries are rows (qid, term), or (qid, field, term[, weight]).  The query side of the joins is a stated query set; its
rows are counted before it is broadcast, else it is joined by a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prunella.functions.scoring import bm25
from prunella.functions.text import words
from prunella.operators.index import Index
from prunella.storage import written

BROADCAST_TERMS = 200_000
#: So many (query, document) pairs are summed up in one partition, about.
PARTITION_SUMS = 1 << 20


def query_terms(log: DataFrame, id_column: str, text: str = "text", terms: int | None = None, field: str = "text") -> DataFrame:
    """(qid, field, term): the distinct words (of the first `terms`) of each line of a query log; empty lines give none."""
    own = words(F.lower(text))
    own = F.slice(own, 1, terms) if terms else own
    return log.select(F.col(id_column).alias("qid"), F.lit(field).alias("field"), F.explode(F.array_distinct(own)).alias("term"))


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast where it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def small_or_none(df: DataFrame) -> DataFrame | None:
    """df as a table marked for broadcast, None where it has too many rows."""
    df = written(df, "small")
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else None


def kept(results: DataFrame) -> DataFrame:
    """Results as a table, computed once; marked for broadcast where they are few, so that what they are joined to stays."""
    return small(written(results, "results"))


def matches(index: Index, queries: DataFrame, global_df: DataFrame | None = None, sizes: bool = False) -> DataFrame:
    """The postings of each query's terms: (qid, field, term, doc_id, count, df); the terms' list lengths come with them,
    the index's or those of global_df (field, term, df), so that scoring needs no second look at the postings.

    With sizes, the documents' sizes come along: postings are dealt out by document, each once however many queries have
    its term, and repeated for the queries where they are, so what is summed by document needs no other shuffle.
    """
    keep = ["qid", "field", "term", *(["weight"] if "weight" in queries.columns else [])]
    df = (index.vocab if global_df is None else global_df).select("field", "term", "df")
    own = queries.select(*keep).distinct()
    if not sizes:
        return index.postings.select("field", "term", "doc_id", "count").join(small(own.join(df, ["field", "term"])), ["field", "term"])
    lists = own.select("field", "term").distinct().join(df, ["field", "term"])
    return dealt_postings(index, lists, own).join(small(own), ["field", "term"])


def dealt_postings(index: Index, lists: DataFrame, queries: DataFrame, *more: Column) -> DataFrame:
    """The postings of lists (field, term, ..), with the documents' sizes and more of their columns; dealt out by document
    in as many partitions as results of the queries (qid) for all documents would need."""
    n_docs = max((r["n_docs"] for r in index.totals()), default=0)
    parts = -(-n_docs * queries.select("qid").distinct().count() // PARTITION_SUMS)
    parts = max(parts, int(index.stats.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    postings = index.postings.select("field", "term", "doc_id", "count", *(["positions"] if more else []))
    rows = postings.join(small(lists), ["field", "term"]).select(*lists.columns, "doc_id", "count", *more)
    return sized(rows.repartition(parts, "doc_id"), index)


def sized(rows: DataFrame, index: Index) -> DataFrame:
    """rows (field, doc_id, ..) with the size of their documents; they stay dealt out by document."""
    fields = [r["field"] for r in index.totals()]
    if len(fields) == 1:
        return rows.join(index.doc_stats.where(F.col("field") == fields[0]).select("doc_id", "size"), "doc_id")
    own = [F.max(F.when(F.col("field") == f, F.col("size"))).alias(f"size_{k}") for k, f in enumerate(fields)]
    sizes = index.doc_stats.groupBy("doc_id").agg(*(own or [F.lit(0).alias("none")]))
    size = F.lit(None).cast("int")
    for k, f in enumerate(fields):
        size = F.when(F.col("field") == f, F.col(f"size_{k}")).otherwise(size)
    return rows.join(sizes, "doc_id").select(*rows.columns, size.alias("size")).where("size is not null")


def needed(queries: DataFrame) -> DataFrame:
    """(qid, need): how many distinct terms a document must have to match all of a query."""
    return queries.select("qid", "field", "term").distinct().groupBy("qid").agg(F.count("*").alias("need"))


def conjunctive(found: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of found whose document has all terms of its query."""
    docs = found.groupBy("qid", "doc_id").agg(F.count_distinct("field", "term").alias("n")).join(needed(queries), "qid").where("n = need")
    return found.join(docs.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")


def scored(
    found: DataFrame,
    index: Index,
    scorer=bm25,
    weights: dict[str, float] | None = None,
    global_stats: DataFrame | None = None,
    global_df: DataFrame | None = None,
    need: DataFrame | None = None,
) -> DataFrame:
    """(qid, doc_id, score): the weighted sum over distinct terms of what their postings add.

    found brings the list lengths along (df), or they are joined to its terms; documents' sizes (size) likewise.  With need (qid, need), documents with
    fewer terms go, by the same aggregate that sums the scores.

    weights by field: the default shares 1 equally, a field that is not named has weight 0.  With global_stats (field,
    n_docs, n_occurrences) and global_df (field, term, df), these stand for the index's own (pruned indexes, shards).
    """
    stats = (global_stats or index.stats).select("field", "n_docs", "n_occurrences")
    fields = [r["field"] for r in index.totals()]
    share = {f: 1 / len(fields) for f in fields} if weights is None else {f: weights.get(f, 0.0) for f in fields}
    weight = F.lit(0.0)
    for f, w in share.items():
        weight = F.when(F.col("field") == f, F.lit(w)).otherwise(weight)
    rows = found
    if global_df is not None or "df" not in found.columns:
        df = (index.vocab if global_df is None else global_df).select("field", "term", "df")
        rows = found.drop("df").join(small(found.select("field", "term").distinct().join(df, ["field", "term"])), ["field", "term"])
    rows = rows.join(F.broadcast(stats), "field")
    if "size" not in rows.columns:
        rows = sized(rows, index)
    one = scorer(F.col("count"), F.col("size"), F.col("df"), F.col("n_docs"), F.col("n_occurrences")) * weight
    one = one * F.col("weight") if "weight" in found.columns else one
    out = rows.groupBy("qid", "doc_id").agg(F.round(F.sum(one), 6).alias("score"), F.count("*").alias("n"))
    if need is not None:
        out = out.join(small(need), "qid").where("n >= need")
    return out.select("qid", "doc_id", "score")


def ranked(results: DataFrame, length: int = 1000, offset: int = 0, key: str | list[str] = "qid") -> DataFrame:
    """The results with rank (from 1) after offset, the best `length`; ties by doc_id."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    rows = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= offset + length)
    return rows.where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset) if offset else rows


def unscored(found: DataFrame, length: int = 1000) -> DataFrame:
    """Matches in the order of documents, with score -1."""
    docs = found.select("qid", "doc_id").distinct().withColumn("score", F.lit(-1.0))
    return ranked(docs, length)


def search(index: Index, queries: DataFrame, length: int = 1000, offset: int = 0, mode: str = "or", scorer=bm25, **stats) -> DataFrame:
    """(qid, doc_id, score, rank) of flat queries, all in one plan."""
    found = matches(index, queries, stats.pop("global_df", None), sizes=True)
    need = needed(queries) if mode == "and" else None
    return ranked(scored(found, index, scorer, need=need, **stats), length, offset)


def tiered(frame: DataFrame, n_docs: int, lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """Documents from round(n_docs * lower) up to, not including, round(n_docs * upper); the bounds reach the scan."""
    if not 0 <= lower < upper <= 1:
        raise ValueError("a tier needs 0 <= lower < upper <= 1")
    half_up = lambda x: int(n_docs * x + 0.5)
    return frame.where((F.col("doc_id") >= half_up(lower)) & (F.col("doc_id") < half_up(upper)))


def within(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """frame for the documents of a keep list."""
    return frame.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def and_then(parts: list[DataFrame], length: int = 1000, offset: int = 0) -> DataFrame:
    """Ranked results (qid, doc_id, score) of parts in turn: what earlier parts returned is left out of later ones.

    A part's scores are scaled so that its best equals the worst before it.
    """
    out = None
    for k, part in enumerate(parts):
        part = part.select("qid", "doc_id", "score")
        if out is not None:
            part = part.join(out.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
            last = out.groupBy("qid").agg(F.min("score").alias("worst"))
            best = F.max("score").over(Window.partitionBy("qid"))
            part = part.withColumn("best", best).join(last, "qid", "left")
            scale = F.when(F.col("worst").isNull() | (F.col("best") == 0), F.lit(1.0)).otherwise(F.col("worst") / F.col("best"))
            part = part.select("qid", "doc_id", (F.col("score") * scale).alias("score"))
        part = part.withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("qid").orderBy("part", F.desc("score"), "doc_id")
    rows = out.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > offset) & (F.col("rank") <= offset + length))
    return rows.select("qid", "doc_id", F.round("score", 6).alias("score"), "part", (F.col("rank") - offset).alias("rank"))


def equalised(scores: list[tuple[DataFrame, float]], sample_docs: int) -> DataFrame:
    """The weighted sum of several scorers' results, each divided by its best among the first sample_docs documents."""
    out = None
    for k, (frame, weight) in enumerate(scores):
        top = frame.groupBy("qid").agg(F.max(F.when(F.col("doc_id") < sample_docs, F.col("score"))).alias("top"))
        one = F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0) * weight
        part = frame.join(top, "qid").select("qid", "doc_id", one.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def matched_terms(results: DataFrame, found: DataFrame, vocab: DataFrame) -> DataFrame:
    """results with `terms`, the sorted numbers of the query's terms that each document has."""
    rows = kept(results).join(found.select("qid", "doc_id", "field", "term"), ["qid", "doc_id"]).join(vocab.select("field", "term", "term_id"), ["field", "term"])
    return rows.groupBy("qid", "doc_id", "rank", "score").agg(F.sort_array(F.collect_set("term_id")).alias("terms"))


def match_counts(found: DataFrame) -> DataFrame:
    """How many documents each query matches; nothing is ranked or returned."""
    return found.groupBy("qid").agg(F.count_distinct("doc_id").alias("n_docs"))


def list_lengths(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, df): the length of each query term's list, 0 for unknown terms."""
    terms = queries.select("qid", "field", "term").distinct().join(index.vocab, ["field", "term"], "left")
    return terms.select("qid", "term", F.coalesce("df", F.lit(0)).alias("df"))


def first_from(index: Index, term: str, doc_id: int, field: str = "text") -> Column | DataFrame:
    """The first document of a term's list at or after doc_id."""
    rows = index.postings.where((F.col("field") == field) & (F.col("term") == term) & (F.col("doc_id") >= doc_id))
    return rows.agg(F.min("doc_id").alias("doc_id"))


def merged(lists: list[DataFrame], length: int = 1000) -> DataFrame:
    """One ranked list per query from several (qid, doc_id, score); of a document in more than one, the best score."""
    rows = reduce(DataFrame.unionByName, (one.select("qid", "doc_id", "score") for one in lists))
    return ranked(rows.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), length)


def long_lists(index: Index, least: int) -> DataFrame:
    """(field, term_id, term, df) of the terms in at least so many documents."""
    return index.vocab.where(F.col("df") >= least).select("field", "term_id", "term", "df")

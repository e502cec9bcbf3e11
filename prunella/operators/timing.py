"""Times: of each query of a stated log, answered on its own, and of reading lists from end to end and at random places."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prunella.functions.scoring import bm25
from prunella.operators.index import Index
from prunella.operators.search import dealt_postings
from prunella.storage import written

TIMES = "qid long, n_results long, ms double"


def timed(index: Index, queries: DataFrame, length: int = 1000, mode: str = "or", answer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, n_results, ms): each query of a log (qid, field, term), one after another, as a user would wait for it.

    The log is a stated set: a query that is run once more for each of its rows makes the rows of the result.  Results are
    counted as they pass, by an observation of the plan that answers, and not brought to the driver.  The lists of the log's
    terms are laid beside the documents' sizes once, before any query is timed; a query reads those of its own terms.
    """
    spark, rows = queries.sparkSession, []
    terms = [(r["qid"], r["field"], r["term"]) for r in queries.select("qid", "field", "term").distinct().collect()]
    laid = _lists_of_log(index, queries) if answer is None else None
    by_query: dict[int, list[tuple]] = {}
    for t in terms:
        by_query.setdefault(t[0], []).append(t)
    for qid, own in sorted(by_query.items()):
        seen = Observation(f"query-{qid}")
        began = time.perf_counter()
        if answer is None:
            found = _answered_alone(laid, [t[1:] for t in own], mode, length)
        else:
            found = answer(spark.createDataFrame(own, "qid long, field string, term string"))
        found.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        rows.append((qid, seen.get["n"], (time.perf_counter() - began) * 1000))
    return spark.createDataFrame(rows, TIMES)


def _lists_of_log(index: Index, queries: DataFrame) -> DataFrame:
    """(field, term, doc_id, one) of the postings of a log's terms, `one` being what each adds to a score.

    The postings are stored with the lists' lengths and the documents' sizes, dealt out by document, in the order of terms
    in each file, so that a query reads its own lists there; it computes `one` itself.
    """
    own = queries.select("qid", "field", "term").distinct()
    lists = own.select("field", "term").distinct().join(index.vocab.select("field", "term", "df"), ["field", "term"])
    laid = written(dealt_postings(index, lists, own).sortWithinPartitions("field", "term"), "log-lists")
    n_docs, n_occurrences = F.lit(None).cast("long"), F.lit(None).cast("long")
    for r in index.totals():
        here = F.col("field") == r["field"]
        n_docs = F.when(here, r["n_docs"]).otherwise(n_docs)
        n_occurrences = F.when(here, r["n_occurrences"]).otherwise(n_occurrences)
    one = bm25(F.col("count"), F.col("size"), F.col("df"), n_docs, n_occurrences) / max(len(index.totals()), 1)
    return laid.select("field", "term", "doc_id", one.alias("one"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _answered_alone(lists: DataFrame, terms: list[tuple[str, str]], mode: str, length: int) -> DataFrame:
    """(doc_id, score) of the best `length` documents of one query, whose terms reach the scan of its lists."""
    by_field: dict[str, list[str]] = {}
    for field, term in terms:
        by_field.setdefault(field, []).append(_quoted(term))
    # As text: a column for each of many terms would take longer to build than the query to run.
    which = " or ".join(f"(field = {_quoted(f)} and term in ({', '.join(own)}))" for f, own in sorted(by_field.items()))
    found = lists.where(which).groupBy("doc_id").agg(F.round(F.sum("one"), 6).alias("score"), F.count("*").alias("n"))
    found = found.where(f"n >= {len(terms)}") if mode == "and" else found
    return found.orderBy(F.desc("score"), "doc_id").limit(length).select("doc_id", "score")


def total_ms(times: DataFrame) -> DataFrame:
    """(n_queries, n_results, ms, ms_per_query) of a log's times."""
    return times.agg(F.count("*").alias("n_queries"), F.sum("n_results").alias("n_results"), F.sum("ms").alias("ms"), F.avg("ms").alias("ms_per_query"))


def time_lines(times: DataFrame) -> DataFrame:
    """(qid, line) for people: what a query found, and how long it took."""
    return times.select("qid", F.format_string("%d results; %.3f ms", "n_results", "ms").alias("line"))


def _ns(action: Callable[[], object], runs: int) -> float:
    """Mean time of an action over runs after one that warms up."""
    action()
    began = time.perf_counter()
    for _ in range(runs):
        action()
    return (time.perf_counter() - began) * 1e9 / runs


def list_access(index: Index, least: int, most_lists: int = 10, places: int = 25, runs: int = 100) -> DataFrame:
    """(term, df, ns_per_posting, ns_per_access) of the longest lists of at least so many postings, each read whole, and at
    evenly spread places: the first posting at or behind a document, which min/max bounds and page indexes lead to."""
    lists = index.vocab.where(F.col("df") >= least).orderBy(F.desc("df"), "field", "term").limit(most_lists).collect()
    top = index.doc_stats.agg(F.max("doc_id")).first()[0]
    rows = []
    for r in lists:
        own = index.postings.where((F.col("field") == r["field"]) & (F.col("term") == r["term"]))
        whole = _ns(lambda own=own: own.agg(F.max("doc_id"), F.sum("count")).collect(), runs)
        wanted = [int(top * k / max(places, 1)) for k in range(places)]
        at = lambda d, own=own: own.where(F.col("doc_id") >= d).agg(F.min("doc_id")).collect()
        jump = _ns(lambda at=at, wanted=wanted: [at(d) for d in wanted], runs) / max(places, 1)
        rows.append((r["term"], r["df"], whole / r["df"], jump))
    return index.vocab.sparkSession.createDataFrame(rows, "term string, df long, ns_per_posting double, ns_per_access double")

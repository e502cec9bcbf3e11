"""Positional operators, and snippets: passes over sorted positions with windows that carry state, no Python on the data.

A query's lists are read in one scan and brought together by document; the passes need no further shuffle, and take time
in proportion to the positions (and their sort).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prunella.functions.text import words


def located(postings: DataFrame, field: str, terms) -> DataFrame:
    """(doc_id, lists): the distinct terms' numbers `t` and positions in the documents that have all of them; one scan."""
    names = list(dict.fromkeys(terms))
    number = reduce(lambda out, kt: F.when(F.col("term") == kt[1], kt[0]).otherwise(out), enumerate(names), F.lit(None).cast("int"))
    own = postings.where((F.col("field") == field) & F.col("term").isin(names))
    lists = own.groupBy("doc_id").agg(F.collect_list(F.struct(number.alias("t"), "positions")).alias("lists"))
    return lists.where(F.size("lists") == len(names))


def events(rows: DataFrame, *keys: str) -> DataFrame:
    """A row (keys, t, pos) for each position; rows of a document stay where they are."""
    rows = rows.select(*keys, F.explode("lists").alias("l")).select(*keys, "l.*")
    return rows.select(*keys, *(c for c in rows.columns if c not in (*keys, "positions")), F.explode("positions").alias("pos"))


def phrase(postings: DataFrame, field: str, terms) -> DataFrame:
    """Documents in which the terms stand one after another."""
    names = list(dict.fromkeys(terms))
    rows = located(postings, field, terms).withColumn("lists", F.array_sort("lists"))
    shifted = lambda at, k: F.transform(F.col("lists")[at]["positions"], lambda x: x - k)
    starts = [shifted(names.index(t), k) for k, t in enumerate(terms)]
    return rows.where(F.size(reduce(F.array_intersect, starts)) > 0).select("doc_id")


def ordered_within(postings: DataFrame, field: str, terms, width: int | None = None) -> DataFrame:
    """Documents in which the terms stand in this order (the last less than `width` positions behind the first).

    One pass over the positions carries, for each term, the latest place where a chain that ends with it begins: a
    later beginning makes a shorter chain.
    """
    terms, names = list(terms), list(dict.fromkeys(terms))
    rows = events(located(postings, field, terms), "doc_id")
    before = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("t") == 0, F.col("pos"))
    for k, term in enumerate(terms[1:], 1):
        rows = rows.withColumn(f"s{k}", F.last(start, ignorenulls=True).over(before))
        start = F.when(F.col("t") == names.index(term), F.col(f"s{k}"))
    fits = start.isNotNull() if width is None else F.col("pos") - start < width
    return rows.where(fits).select("doc_id").distinct()


def intervals(postings: DataFrame, field: str, terms, most: int | None = None, longest: int | None = None) -> DataFrame:
    """(doc_id, intervals): minimal intervals of the terms, at most `most` of at most `longest` positions.

    One pass over the positions carries the last place of each term: an interval ends at a position and begins at the
    least of these places, and is minimal where that place is new.
    """
    n = len(set(terms))
    rows = events(located(postings, field, terms), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("pos")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col("t") == k, F.col("pos")), ignorenulls=True).over(upto) for k in range(n)]
    rows = rows.select("doc_id", "pos", F.array(*last).alias("last"))
    rows = rows.withColumn("left", F.when(~F.exists("last", lambda x: x.isNull()), F.array_min("last")))
    rows = rows.withColumn("before", F.lag("left").over(order))
    new = F.col("left").isNotNull() & (F.col("before").isNull() | (F.col("left") > F.col("before")))
    span = F.when(new, F.struct(F.col("left"), F.col("pos").alias("right")))
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("intervals"))
    if longest is not None:
        out = out.withColumn("intervals", F.filter("intervals", lambda s: s["right"] - s["left"] < longest))
    if most is not None:
        out = out.withColumn("intervals", F.slice("intervals", 1, most))
    return out


def interval_scores(postings: DataFrame, field: str, terms, full: int = 16) -> DataFrame:
    """(doc_id, score): proximity as a sum over minimal intervals: 1 up to `full` positions, full / length beyond."""
    rows = intervals(postings, field, terms)
    length = "s.right - s.left + 1"
    score = F.expr(f"aggregate(intervals, 0.0D, (a, s) -> a + least(1.0D, {float(full)}D / ({length})))")
    return rows.where(F.size("intervals") > 0).select("doc_id", F.round(score, 6).alias("score"))


def near(postings: DataFrame, field: str, terms, width: int) -> DataFrame:
    """Documents with all terms inside some `width` positions."""
    return intervals(postings, field, terms, longest=width).where(F.size("intervals") > 0).select("doc_id")


def snippets(docs: DataFrame, found: DataFrame, before: str = "<b>", after: str = "</b>", context: int = 4) -> DataFrame:
    """(doc_id, snippet): the words of the first interval with `context` words around it, the interval's marked."""
    rows = docs.select("doc_id", words("text").alias("w")).join(found.where(F.size("intervals") > 0), "doc_id")
    rows = rows.withColumn("s", F.col("intervals")[0])
    low = F.greatest(F.col("s.left") - context, F.lit(0))
    part = F.slice("w", low + 1, F.col("s.right") - low + 1 + context)
    marked = F.transform(part, lambda x, i: F.when((i + low >= F.col("s.left")) & (i + low <= F.col("s.right")), F.concat(F.lit(before), x, F.lit(after))).otherwise(x))
    return rows.select("doc_id", F.array_join(marked, " ").alias("snippet"))

"""Sinks: TREC runs, feature files, LibSVM, event logs, and result lines in the modes of an interactive session."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Title and score of the line that stands for a query without results.
# Fixed values.
NO_TITLE = "GX000-00-0000000"


def trec_run(results: DataFrame, titles: DataFrame, tag: str, topics: DataFrame | None = None) -> DataFrame:
    """(topic, rank, line): `topic Q0 title rank score tag`, ranks from 0; topics without results have a dummy line."""
    rows = results.join(titles.select("doc_id", "title"), "doc_id").select(F.col("qid").alias("topic"), F.col("rank") - 1, "title", "score").toDF("topic", "rank", "title", "score")
    if topics is not None:
        rows = topics.select("topic").distinct().join(rows, "topic", "left")
        rows = rows.fillna({"title": NO_TITLE, "score": 0.0}).withColumn("rank", F.coalesce("rank", F.when(F.col("title") == NO_TITLE, 1)))
    line = F.format_string("%d Q0 %s %d %.10f %s", "topic", "title", "rank", "score", F.lit(tag))
    return rows.select("topic", "rank", line.alias("line"))


def write_lines(frame: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """A column as text files whose lines, file after file, are in order."""
    frame.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("overwrite").text(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.csv(path, header=True, mode="overwrite")


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def write_libsvm(vectors: DataFrame, path: str) -> None:
    """(label, features) as LibSVM."""
    vectors.select(F.col("label").cast("double").alias("label"), "features").write.mode("overwrite").format("libsvm").save(path)


def event_log(frame: DataFrame, key: str, cluster: str, column: str) -> DataFrame:
    """(id, cluster, column): what happened for a query in a cluster; arrays become blank-separated."""
    value = F.array_join(F.col(column).cast("array<string>"), " ") if dict(frame.dtypes)[column].startswith("array") else F.col(column)
    return frame.select(F.col(key).alias("id"), F.col(cluster).alias("cluster"), value.alias(column))


MODES = ("time", "short", "long", "snippet", "trec")


def shown(results: DataFrame, mode: str, docs: DataFrame | None = None, snippets: DataFrame | None = None, tag: str = "run") -> DataFrame:
    """(qid, rank, line) for people: ids and scores, with titles, or with snippets, or as a TREC run; `time` gives a line for
    each query, with the number of results and the milliseconds until they were all there."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "time":
        began = time.perf_counter()
        counts = results.groupBy("qid").agg(F.count("*").alias("n")).collect()  # a row for each query
        ms = (time.perf_counter() - began) * 1000
        lines = [(r["qid"], 1, f"{r['n']} results; {ms:.3f} ms") for r in counts]
        return results.sparkSession.createDataFrame(lines, "qid long, rank int, line string")
    if mode == "trec":
        return trec_run(results, docs, tag)
    out = F.format_string("%d\t%.6f", "doc_id", "score")
    if mode in ("long", "snippet") and docs is not None:
        results = results.join(docs.select("doc_id", "title"), "doc_id", "left")
        out = F.concat_ws("\t", out, "title")
    if mode == "snippet" and snippets is not None:
        results = results.join(snippets, "doc_id", "left")
        out = F.concat_ws("\t", out, "snippet")
    return results.select("qid", "rank", out.alias("line"))

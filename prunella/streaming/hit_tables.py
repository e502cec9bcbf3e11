"""Rank hits of a stream of queries, kept as partial tables that are merged after every so many batches.

A batch of queries writes the bins of its own hits to a folder of its number; every `flush` batches, the tables since
the last merge and the merged table before them become the next merged table, in a folder of its number.  What a folder
holds follows from its number and the stream alone, so a batch that is run again after a failure writes the same again,
and no hit is counted twice; a folder counts once its writer has marked it as done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from prunella.operators.hits import binned, merged, raw_hits
from prunella.operators.index import Index
from prunella.operators.search import matches, query_terms, search
from prunella.sources.index_store import stands

DONE = "_SUCCESS"


def _done(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the folders <folder>/n=<number> that are whole, in order."""
    if not stands(spark, folder):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
    numbers = sorted(int(n[2:]) for n in names if n.startswith("n="))
    return [n for n in numbers if stands(spark, f"{folder}/n={n}/{DONE}")]


def _tables(spark: SparkSession, path: str, upto: int | None = None) -> list[DataFrame]:
    """The last merged table at or before a batch, and the partial tables behind it."""
    last = max((n for n in _done(spark, f"{path}/merged") if upto is None or n < upto), default=-1)
    names = [f"{path}/merged/n={last}"] if last >= 0 else []
    names += [f"{path}/partial/n={n}" for n in _done(spark, f"{path}/partial") if n > last and (upto is None or n <= upto)]
    return [spark.read.parquet(n) for n in names]


def hit_stream(queries: DataFrame, index: Index, path: str, checkpoint: str, keys: tuple[str, ...] = ("doc_id",), flush: int = 8, length: int = 1000) -> StreamingQuery:
    """Start counting the hits of a stream (qid, text) by keys and bins of ranks into tables under path."""
    if flush < 1:
        raise ValueError("a flush takes one batch at least")

    def count(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = query_terms(batch, "qid")
        hits = raw_hits(search(index, log, length), matches(index, log), index.vocab)
        binned(hits, list(keys), "dh").write.mode("overwrite").parquet(f"{path}/partial/n={number}")
        if (number + 1) % flush == 0:
            merged(_tables(spark, path, number), list(keys)).write.mode("overwrite").parquet(f"{path}/merged/n={number}")

    return queries.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).start()


def hit_table(spark: SparkSession, path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The hits of all batches so far: the last merged table and what came after it."""
    parts = _tables(spark, path)
    if not parts:
        raise ValueError(f"no batch is done under {path}")
    return merged([reduce(DataFrame.unionByName, parts)], list(keys))

"""A query log as a stream: each micro-batch of queries is answered in one plan against the static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prunella.operators.index import Index
from prunella.operators.search import query_terms, search


def answered(queries: DataFrame, index: Index, path: str, checkpoint: str, length: int = 10, mode: str = "or") -> StreamingQuery:
    """Start answering a stream (qid, text) into Parquet at path.

    A batch that is run again after a failure replaces its own folder, so each query is answered once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        terms = query_terms(batch, "qid")
        search(index, terms, length, mode=mode).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()

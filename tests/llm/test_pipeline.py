"""The five stages, one after another: what each keeps, and the token files against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prunella.llm import mixing, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """sf0.001 with nulls, repeated rows, and columns whose names the stages use themselves."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).select((F.col("doc_id") + 1000).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    again = docs.where("doc_id in (3, 4)")
    none = docs.where("doc_id = 5").withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(2000).cast("long"))
    rows = docs.unionByName(odd).unionByName(again).unionByName(none)
    rows.withColumns({"k": F.lit(7), "n": F.lit("x"), "row": F.col("doc_id"), "shard": F.lit(1.5)}).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_each_stage_keeps_rows_of_its_predecessor(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = corpus_pipeline.written(stage(spark, docs, tables), f"test-{k}")
        rows = docs.collect()
        assert docs.columns == columns and rows
        if before is not None and k < 3:
            assert set(map(str, rows)) <= set(map(str, before)) and len(rows) <= len(before)
        if k == 3:  # each text whole, as often as its source's target asks; at most one a source is cut short
            whole = {(r["doc_id"], r["source"]): r["text"] for r in before}
            assert all(whole[r["doc_id"], r["source"]].startswith(r["text"]) for r in rows)
            cut = [r["source"] for r in rows if whole[r["doc_id"], r["source"]] != r["text"]]
            assert len(cut) == len(set(cut))
            words = {r["source"]: r["quota_words"] for r in mixing.targets(mixing.sized(spark.createDataFrame(before, docs.schema))).collect()}
            taken = dict.fromkeys(words, 0)
            for r in rows:
                taken[r["source"]] += len(r["text"].split())
            assert sum(taken.values()) == pytest.approx(sum(words.values()), abs=0)
        before = rows
    # The token files: texts in ascending order of ids, each whole and with one end id.
    library, start, want = tokens.tokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER)), 0, []
    for r in sorted(before, key=lambda r: (r["doc_id"], r["text"].encode())):
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, tokens.END_ID]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.token_ids(spark, docs, tables).collect())) == sorted(want)


def test_stages_on_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)

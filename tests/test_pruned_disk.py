import os

import pytest
from pyspark.sql import functions as F

from prunella import storage
from prunella.operators import pruning
from prunella.operators.index import build_index
from prunella.storage import scratch_dir, written


def folders(spark) -> set[str]:
    root = scratch_dir(spark).removeprefix("file://") + "/prunella"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


@pytest.mark.parametrize("values", ["cast(id as double)", "round(id % 7 / 3.0, 6)", "1.0D", "if(id % 5 = 0, double('NaN'), id % 100)"])
def test_only_rows_about_the_cut_are_put_in_order(spark, monkeypatch, values):
    rows = spark.range(6000).select((F.col("id") % 600).alias("term_id"), F.floor(F.col("id") / 600).alias("doc_id"), F.expr(f"cast({values} as double)").alias("score"))
    rows, ties, sorted_rows = written(rows, "rows"), [F.col("term_id"), F.col("doc_id")], []
    whole = pruning.posting_order(rows, [F.desc("score"), *ties])
    monkeypatch.setattr(pruning, "ordered", lambda df, order: sorted_rows.append(df.count()) or storage.ordered(df, order))
    for level in (0.0, 0.001, 0.3, 0.97, 1.0):
        own = pruning.best_postings(rows, "score", ties, 6000, level)
        of = pruning.kept_postings(whole, 6000, level).select(rows.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, of.collect()))  # as text, NaN equals NaN
    if values == "cast(id as double)":
        assert max(sorted_rows) <= 100


def test_stored_indexes_leave_no_tables_behind(spark):
    before = folders(spark)
    docs = spark.createDataFrame([(k, "a " * (k % 4) + f"b w{k}") for k in range(40)], "doc_id long, text string")
    index = build_index(docs).stored()
    assert not [f for f in folders(spark) - before if f.startswith("inverted")]
    kept = written(index.postings.where("term != 'b'").select("field", "term", "doc_id"), "kept")
    lazy, stored = pruning.pruned_index(index, kept), pruning.pruned_index(index, kept, store=True)
    for name in ("postings", "vocab", "doc_stats", "stats"):
        assert sorted(getattr(lazy, name).collect()) == sorted(getattr(stored, name).collect())
    before = folders(spark)
    assert stored.doc_stats.count() == 40 and folders(spark) == before

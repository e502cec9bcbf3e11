import struct

import pytest

from prunella.operators import search
from prunella.operators.index import build_index
from prunella.sources import index_store


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "a b b", "x"), (1, "b c", "y"), (2, None, None), (3, "", "x y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_saved_and_opened(spark, docs, tmp_path):
    for field in ("text", "source"):
        index_store.save_index(build_index(docs, {field: field}), f"{tmp_path}/{field}", bloom_bits=10)
    index, weights = index_store.open_indexes(spark, [f"{tmp_path}/text:0.7", f"{tmp_path}/source"])
    assert weights == {"text": 0.7, "source": 0.5}
    both = build_index(docs, {"text": "text", "source": "source"})
    for name in index_store.PARTS:
        same = sorted(getattr(both, name).columns)
        assert sorted(map(str, getattr(index, name).select(same).collect())) == sorted(map(str, getattr(both, name).select(same).collect()))
    with pytest.raises(ValueError):
        index_store.open_indexes(spark, [f"{tmp_path}/text", f"{tmp_path}/text"])
    kept = index_store.open_index(spark, f"{tmp_path}/text{index_store.IN_MEMORY}")
    assert kept.postings.is_cached and kept.postings.count() == 4


def test_specs(spark, tmp_path):
    assert index_store.weighted_name("/a/b:0.5") == ("/a/b", 0.5)
    assert index_store.weighted_name("file:///a/b") == ("file:///a/b", None)
    assert index_store.virtual_gaps(["64", "anchor:3"]) == {None: 64, "anchor": 3}
    with pytest.raises(ValueError):
        index_store.virtual_gaps(["anchor:-1"])
    with pytest.raises(ValueError):
        index_store.save_index(None, str(tmp_path), bloom_bits=-1)


def test_binary_frequencies(spark, tmp_path):
    (tmp_path / "freq").write_bytes(struct.pack(">3q", 7, -1, 1 << 40))
    found = index_store.big_endian_longs(spark, str(tmp_path / "freq"))
    assert [tuple(r) for r in found.orderBy("ord").collect()] == [(0, 7), (1, -1), (2, 1 << 40)]
    with pytest.raises(ValueError):
        index_store.global_totals(spark, str(tmp_path / "freq"))
    (tmp_path / "stat").write_bytes(struct.pack(">2q", 4, 9))
    assert index_store.global_totals(spark, str(tmp_path / "stat")) == (4, 9)


def test_stored_vocabulary_is_the_same(docs):
    index = build_index(docs, {"text": "text", "source": "source"})
    assert sorted(index.vocab.collect()) == sorted(index.stored().vocab.collect())


def test_merged_lists_keep_the_best_score(spark):
    one = spark.createDataFrame([(1, 5, 2.0), (1, 6, 1.0)], "qid long, doc_id long, score double")
    two = spark.createDataFrame([(1, 6, 3.0), (1, 7, 1.0)], "qid long, doc_id long, score double")
    rows = search.merged([one, two], 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(6, 3.0), (5, 2.0)]


def test_intervals_of_a_long_document(spark):
    from prunella.operators.intervals import interval_scores, intervals

    text = "a b " * 4000 + "c " * 40 + "a"
    postings = build_index(spark.createDataFrame([(1, text), (2, "a c c b")], "doc_id long, text string")).postings
    found = {r["doc_id"]: [tuple(s) for s in r["intervals"]] for r in intervals(postings, "text", ("a", "b")).collect()}
    assert found == {1: [(i, i + 1) for i in range(7999)] + [(7999, 8040)], 2: [(0, 3)]}
    scores = {r["doc_id"]: r["score"] for r in interval_scores(postings, "text", ("a", "b")).collect()}
    assert scores == {1: pytest.approx(7999 + 16 / 42, abs=1e-6), 2: 1.0}


def test_folders_of_shards_that_no_query_selects_are_not_read(spark, tmp_path):
    from prunella.operators import shards

    docs = spark.createDataFrame([(i, f"a b{i} " + "c " * (i % 5), f"s{i % 6}") for i in range(60)], "doc_id long, text string, source string")
    index, doc_map = build_index(docs).stored(), shards.shard_map(docs, "source")
    index_store.save_shards(index, doc_map, str(tmp_path / "shards"))
    queries = spark.createDataFrame([(1, "text", "a"), (1, "text", "c"), (2, "text", "c"), (2, "text", "b7")], "qid long, field string, term string")
    selection = spark.createDataFrame([(1, 0, 1), (1, 4, 2), (2, 1, 1), (1, 2, 3)], "qid long, shard_id int, place int")
    want = {mode: sorted(map(tuple, shards.selective_search(index, queries, doc_map, selection.where("place < 3"), mode=mode).collect())) for mode in ("or", "and")}
    postings = spark.read.parquet(str(tmp_path / "shards"))
    for k in (2, 3, 5):  # a task that opened one of these files would fail
        for file in (tmp_path / "shards" / f"shard_id={k}").glob("part-*"):
            file.write_bytes(b"no parquet")
    for mode in ("or", "and"):
        found = shards.search_shards(index, postings, queries, selection, 2, mode=mode)
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want[mode] != []

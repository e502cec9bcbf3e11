"""A micro-corpus with values worked out by hand."""

import re

import pytest

from prunella.operators import evaluate, hits, pruning, renumber, search, shards
from prunella.operators.index import build_index, concatenated, tokens, unigram_xdoc, virtual_tokens
from prunella.operators.intervals import intervals, phrase, snippets
from prunella.functions.text import stop_words
from prunella.plans.planner import Planner
from prunella.plans.query_language import And, Not, Or, QueryError, Range, Term, Within, flat, multiplexed, parse
from prunella.session import SearchSession
from prunella.sources.sinks import trec_run

TEXTS = ["a b a c", "b c d", "a d d d", "e", "b a", "c c e f"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def index(docs):
    return build_index(docs).stored()


def queries(spark, *texts):
    rows = [(k, "text", t) for k, text in enumerate(texts) for t in text.split()]
    return spark.createDataFrame(rows, "qid long, field string, term string")


def scores(rows):
    return {(r["qid"], r["doc_id"]): round(r["score"], 6) for r in rows.collect()}


def run(index, text, **more):
    return [(r["doc_id"], round(r["score"], 6)) for r in Planner(index).run(text, **more).orderBy("rank").collect()]


def test_prefixes_of_so_many_terms(spark):
    docs = spark.createDataFrame([(0, "thou"), (1, "thousand"), (2, "thoughts Though"), (3, "other")], "doc_id long, text string")
    index = build_index(docs).stored()
    own = lambda text, n: sorted(r["doc_id"] for r in Planner(index, prefix_terms=n).run(text).collect())
    assert own("thou*", None) == [0, 1, 2] and own("thou*", 3) == [0, 2] and own("thou*", 1) == [0] and own("zz*", 3) == []


def test_index_built_in_slices(docs, monkeypatch):
    from prunella.operators import index as index_module

    own = lambda: {tuple(map(str, r)) for r in build_index(docs).postings.collect()}
    want = own()
    for words in (1, 5):
        monkeypatch.setattr(index_module, "SLICE_WORDS", words)
        assert own() == want


def test_postings_are_dealt_out_once_for_all_queries(spark, index):
    asked = queries(spark, "a b", "a d", "a")
    plain, dealt = search.matches(index, asked), search.matches(index, asked, sizes=True)
    sizes = {d: len(t.split()) for d, t in enumerate(TEXTS)}
    assert sorted((*r, sizes[r["doc_id"]]) for r in plain.select("qid", "term", "doc_id", "count", "df").collect()) == sorted(
        tuple(r) for r in dealt.select("qid", "term", "doc_id", "count", "df", "size").collect()
    )
    assert scores(search.scored(plain, index)) == scores(search.scored(dealt, index))
    # No shuffle has a row for each query, as one by (qid, doc_id) had.
    plan = search.scored(dealt, index)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(qid#\d+L?, doc_id", plan) and re.search(r"hashpartitioning\(doc_id", plan)


def test_statistics(index):
    s = index.stats.first()
    assert (s["n_docs"], s["n_occurrences"], s["n_postings"], s["n_terms"], s["max_count"], s["max_doc_size"]) == (6, 18, 14, 6, 3, 4)
    assert {r["term"]: r["df"] for r in index.vocab.collect()} == dict(a=3, b=3, c=3, d=2, e=2, f=1)


def test_bm25(spark, index):
    assert scores(search.search(index, queries(spark, "d f"))) == {(0, 5): 1.191009, (0, 2): 0.88168, (0, 1): 0.587787}
    flatter = search.search(index, queries(spark, "d f"), scorer=lambda *c: search.bm25(*c, 1.2, 0.3))
    assert scores(flatter) == {(0, 5): 1.232079, (0, 2): 0.898007, (0, 1): 0.587787}
    floor = scores(search.search(index, queries(spark, "a")))
    assert set(floor) == {(0, 0), (0, 2), (0, 4)} and all(abs(v - 1e-6) < 1e-6 for v in floor.values())


def test_queries_of_the_language(index):
    assert {d for d, _ in run(index, "b c")} == {0, 1}
    assert {d for d, _ in run(index, "a & !b")} == {2}
    assert {d for d, _ in run(index, '"b a"')} == {0, 4}
    assert {d for d, _ in run(index, "(b c) | e")} == {0, 1, 3, 5}
    assert {d for d, _ in run(index, "(a c)~2")} == {0}
    assert {d for d, _ in run(index, "b < c")} == {0, 1}
    assert {d for d, _ in run(index, "!a")} == {1, 3, 5}
    assert run(index, "f, d") == [(5, 1.191009), (2, 1.191009), (1, 0.794006)]
    assert run(index, "d{2}")[0][1] == pytest.approx(2 * 0.88168, abs=2e-6)
    assert run(index, "zzz") == []


def test_true_paths(index):
    """c alone counts for a document that fails (a & b), though it has a term of it."""
    both = dict(run(index, "(a & d) | c"))
    alone = dict(run(index, "c"))
    assert both[1] == alone[1] and both[2] != 0


def test_parser():
    assert parse("a b | !c") == [Or((And((Term("a"), Term("b"))), Not(Term("c"))))]
    assert len(parse("a, b, c")) == 3
    assert multiplexed(Term("q"), ["x", "y"]) == Or((Within("x", Term("q")), Within("y", Term("q"))))
    assert parse("ts:[1 .. 5]") == [Within("ts", Range("1", "5"))]
    assert flat(parse("a | b")[0]) == ("or", ("a", "b")) and flat(parse("a (b | c)")[0]) is None
    for bad in ("", "(a", "a)", "a |", '"'):
        with pytest.raises(QueryError):
            parse(bad)


def test_tiers_keep_lists_and_offsets(spark, index):
    found = search.matches(index, queries(spark, "a b c d e"))
    assert {r["doc_id"] for r in search.tiered(found, 6, 0, 0.5).collect()} == {0, 1, 2}
    keep = spark.createDataFrame([(1,), (5,)], "doc_id long")
    assert {r["doc_id"] for r in search.within(found, keep).collect()} == {1, 5}
    whole = search.search(index, queries(spark, "d f")).orderBy("rank").collect()
    later = search.search(index, queries(spark, "d f"), offset=1).orderBy("rank").collect()
    assert [r["doc_id"] for r in later] == [r["doc_id"] for r in whole][1:]
    with pytest.raises(ValueError):
        search.tiered(found, 6, 0.5, 0.5)


def prune_list(spark):
    rows = [(5, "f"), (2, "d"), (1, "d"), (3, "e"), (1, "b"), (0, "a")]
    return spark.createDataFrame([(k, "text", t, d) for k, (d, t) in enumerate(rows)], "ord long, field string, term string, doc_id long")


def test_pruning(spark, index):
    own = prune_list(spark)
    assert [pruning.kept_postings(own, 14, t).count() for t in (0.1, 0.2, 0.3)] == [3, 4, 6]
    kept = pruning.kept_postings(own, 14, 0.1)
    assert {r["doc_id"]: r["local_id"] for r in pruning.local_ids(kept).collect()} == {5: 0, 2: 1, 1: 2}
    small = pruning.pruned_index(index, kept)
    local = scores(search.search(small, queries(spark, "d f")))
    assert local[(0, 5)] == 0.369676 and local[(0, 1)] < 1e-5 and local[(0, 2)] < 1e-5
    full = scores(search.search(index, queries(spark, "d f")))
    assert scores(search.search(small, queries(spark, "d f"), **pruning.global_statistics(index))) == full


def test_document_pruning(spark):
    order = [(2, 4), (5, 4), (1, 3), (0, 4), (4, 2), (3, 1)]
    docs = spark.createDataFrame([(k, d, s) for k, (d, s) in enumerate(order)], "k long, doc_id long, size long")
    rows = pruning.document_order(docs, [docs["k"]])
    for level, ids in ((0.2, {2}), (0.5, {2, 5})):
        assert {r["doc_id"] for r in pruning.kept_documents(rows, 14, level).collect()} == ids


def test_shards(spark):
    doc_map = spark.createDataFrame([(k, s, k) for k, s in enumerate([1] * 100 + [2] * 300 + [3] * 50 + [4] * 70)], "doc_id long, shard_id int, local_id long")
    sample = spark.createDataFrame([(d,) for a, n in ((0, 10), (100, 15), (400, 10), (450, 7)) for d in range(a, a + n)], "doc_id long")
    hit = spark.createDataFrame([(0, 0, 4.0, 1), (0, 100, 3.0, 2), (0, 1, 2.0, 3), (0, 400, 1.0, 4)], "qid long, doc_id long, score double, rank int")
    assert {r["shard_id"]: r["score"] for r in shards.redde(hit, doc_map, sample).collect()} == {1: 20, 2: 20, 3: 5, 4: 0}
    assert {r["shard_id"]: r["score"] for r in shards.rank_s(hit, doc_map, 2).collect()} == {1: 4.5, 2: 1.5, 3: 0.125}
    near = {r["shard_id"]: round(r["score"], 6) for r in shards.rank_s(hit, doc_map, 50).collect()}
    assert near == {1: 4.0008, 2: 0.06}


def test_all_shards_are_exhaustive_search(spark, docs, index):
    doc_map = shards.shard_map(docs.withColumn("s", docs["doc_id"] % 2), "s")
    log = queries(spark, "a d", "c")
    every = log.select("qid").distinct().crossJoin(doc_map.select("shard_id").distinct())
    assert scores(shards.selective_search(index, log, doc_map, every)) == scores(search.search(index, log))


def test_bins_and_segments(spark):
    ranks = [1, 10, 11, 20, 21, 40, 41, 1280, 1281, 9000]
    rows = spark.createDataFrame([(r,) for r in ranks], "rank int")
    assert [r["b"] for r in rows.select(hits.rank_bin(rows["rank"]).alias("b")).collect()] == [0, 9, 10, 10, 11, 11, 12, 16, 17, 19]
    found = spark.createDataFrame([(0, d) for d in (0, 1, 5, 9)], "qid long, doc_id long")
    assert {r["segment"]: r["n"] for r in shards.segment_counts(found, 10, 4).collect()} == {0: 2, 1: 0, 2: 1, 3: 1}


def test_precision(spark):
    original = spark.createDataFrame([(0, d, k) for k, d in enumerate([1, 2, 3, 4], 1)], "qid long, doc_id long, rank int")
    actual = spark.createDataFrame([(0, d) for d in (2, 4, 9)], "qid long, doc_id long")
    both = spark.createDataFrame([(0,), (1,)], "qid long")
    rows = evaluate.precision_at(original, actual, queries=both)
    assert {r["qid"]: r["precision"] for r in rows.collect()} == {0: 0.5, 1: None}
    assert evaluate.mean_precision(rows).first()["precision"] == 0.5


def test_xdoc(spark, index):
    model = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "term string, prob double")
    assert {r["doc_id"]: r["xdoc"] for r in unigram_xdoc(index.postings, model, 0.125).collect()}[0] == 0.875


def test_positions_and_fragments(spark, docs):
    parts = spark.createDataFrame([(7, 0, "x y"), (7, 1, "z z z")], "target long, ord long, text string")
    rows = virtual_tokens(parts).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == [0, 1, 66, 67, 68]
    kept = tokens(docs, processor=stop_words(["b"])).where("doc_id = 0").orderBy("pos").collect()
    assert [(r["pos"], r["term"]) for r in kept] == [(0, "a"), (1, None), (2, "a"), (3, "c")]


def test_intervals_and_snippets(spark, docs, index):
    found = intervals(index.postings, "text", ("a", "c"))
    assert [tuple(s) for s in found.where("doc_id = 0").first()["intervals"]] == [(2, 3)]
    assert snippets(docs, found.where("doc_id = 0"), context=1).first()["snippet"] == "b <b>a</b> <b>c</b>"
    assert {r["doc_id"] for r in phrase(index.postings, "text", ("d", "d", "d")).collect()} == {2}


def test_renumbering_back_is_the_same(spark, docs, index):
    doc_map = renumber.order_map(docs, ["-doc_id"])
    there = renumber.renumbered(index, doc_map)
    back = renumber.renumbered(there, renumber.inverse(doc_map))
    rows = lambda i: sorted((r["term"], r["doc_id"], r["count"]) for r in i.postings.collect())
    assert rows(back) == rows(index) != rows(there)


def test_concatenation(spark):
    a, b = (spark.createDataFrame([(k, t) for k, t in enumerate(x)], "doc_id long, text string") for x in (["p", "q"], ["r"]))
    assert {r["doc_id"]: r["text"] for r in concatenated([a, b]).collect()} == {0: "p", 1: "q", 2: "r"}


def test_empty_index(spark):
    none = build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert none.postings.count() == 0 and none.vocab.count() == 0


def test_trec_lines(spark):
    results = spark.createDataFrame([(7, 3, 1.5, 1)], "qid long, doc_id long, score double, rank int")
    titles = spark.createDataFrame([(3, "T3")], "doc_id long, title string")
    topics = spark.createDataFrame([(7,), (8,)], "topic long")
    lines = {r["topic"]: r["line"] for r in trec_run(results, titles, "tag", topics).collect()}
    assert lines == {7: "7 Q0 T3 0 1.5000000000 tag", 8: "8 Q0 GX000-00-0000000 1 0.0000000000 tag"}


def test_session(index):
    s = SearchSession(index)
    s.command("$limit 1")
    s.command("$mplex off")
    assert [r["doc_id"] for r in s.search("d | f").collect()] == [5]
    s.command("$score bm25(1.2,0.3):2 count:1")
    s.command("$equalize 6")
    assert s.search("d | f").count() == 1
    s.command("$mode trec")
    with pytest.raises(ValueError):
        s.command("$nothing")
    s.command("$quit")
    assert not s.open

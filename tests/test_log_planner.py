"""A log planned at once against each of its queries planned alone, and against sets worked out in Python."""

import random
import re

import pytest

from prunella.operators.index import build_index
from prunella.operators.intervals import intervals, near, ordered_within, phrase
from prunella.plans import log_planner, query_language as q
from prunella.plans.log_planner import LogPlanner, compiled
from prunella.plans.planner import Planner

WORDS = "abcdefgh"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    return [" ".join(rng.choices(WORDS, weights=range(8, 0, -1), k=rng.randint(0, 25))) for _ in range(60)]


@pytest.fixture(scope="module")
def index(spark, corpus):
    docs = spark.createDataFrame([(i, t, t.split(" ")[0]) for i, t in enumerate(corpus)], "doc_id long, text string, head string")
    return build_index(docs, {"text": "text", "head": "head"}).stored()


def tree(rng, depth=3):
    kind = rng.choice(["term", "term", "prefix", "phrase", "near", "ordered", "and", "or", "not", "field", "weight"] if depth else ["term"])
    word = lambda: rng.choice(WORDS)
    match kind:
        case "term":
            return word()
        case "prefix":
            return rng.choice(["a*", "zz*", "h*"])
        case "phrase":
            return '"' + " ".join(word() for _ in range(rng.randint(1, 3))) + '"'
        case "near":
            return f"({word()} {word()} {word()})~{rng.randint(1, 6)}"
        case "ordered":
            return "(" + " < ".join(word() for _ in range(rng.randint(2, 4))) + ")"
        case "and":
            parts = [tree(rng, depth - 1) for _ in range(rng.randint(2, 3))]
            return "(" + " & ".join(rng.choice(["", "", "!"]) + p for p in parts) + ")"
        case "or":
            return "(" + " | ".join(tree(rng, depth - 1) for _ in range(rng.randint(2, 3))) + ")"
        case "not":
            return "!" + tree(rng, depth - 1)
        case "field":
            return f"head:({tree(rng, 0)} | b)"
        case "weight":
            return f"({tree(rng, depth - 1)}){{2.5}}"


def stands(words, kind, terms, width=0):
    """Whether terms stand so, by trying all places."""
    places = [[i for i, w in enumerate(words) if w == t] for t in terms]
    if kind == "phrase":
        return any(words[i : i + len(terms)] == list(terms) for i in range(len(words)))
    if kind == "near":
        return any(all(any(a <= p < a + width for p in own) for own in places) for a in range(-width, len(words)))
    ends = {-1}
    for own in places:
        ends = {p for p in own if any(p > e for e in ends)}
    return bool(ends)


def matched(node, texts):
    """The documents of a tree, by sets."""
    words = [t.split() for t in texts]
    every = set(range(len(texts)))
    match node:
        case q.Term(t):
            return {i for i in every if t in words[i]}
        case q.Prefix(t):
            return {i for i in every if any(w.startswith(t) for w in words[i])}
        case q.Phrase(terms):
            return {i for i in every if stands(words[i], "phrase", terms)}
        case q.Near(terms, width):
            return {i for i in every if stands(words[i], "near", terms, width)}
        case q.Ordered(terms):
            return {i for i in every if stands(words[i], "ordered", terms)}
        case q.Within("head", part):
            return matched(part, [t.split(" ")[0] for t in texts])
        case q.Weighted(part, _):
            return matched(part, texts)
        case q.Or(parts):
            return set().union(*(matched(p, texts) for p in parts))
        case q.And(parts):
            return every.intersection(*(matched(p, texts) for p in parts))
        case q.Not(part):
            return every - matched(part, texts)
    raise AssertionError(node)


def test_a_log_matches_what_sets_match(spark, index, corpus):
    rng = random.Random(2)
    texts = [tree(rng) for _ in range(150)]
    log = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    found = {}
    for r in LogPlanner(index).run(log, scorer=False).collect():
        found.setdefault(r["qid"], set()).add(r["doc_id"])
    for k, text in enumerate(texts):
        assert found.get(k, set()) == matched(q.parse(text)[0], corpus), text


def test_a_log_scores_as_its_queries_alone(spark, index):
    rng = random.Random(5)
    texts = [tree(rng, 2) for _ in range(9)] + ["a b", "a | b | c", "f", "zzz", "a, b | g", '"a b", (c d)~3, !a', "a & !a", "(a & h) | c"]
    log = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    key = lambda r: (r["doc_id"], round(r["score"], 5), r["part"], r["rank"])
    # Multiplexed over one field, plain queries go by trees as well.
    for fields in (None, ["text"]):
        together = {}
        for r in LogPlanner(index).run(log, 20, fields=fields).collect():
            together.setdefault(r["qid"], []).append(key(r))
        for k, text in enumerate(texts[: None if fields is None else -8]):
            alone = sorted(key(r) for r in Planner(index).run(text, 20, fields=fields).collect())
            assert sorted(together.get(k, [])) == alone, text


def test_postings_are_scanned_once_however_many_queries(spark, index):
    rng = random.Random(9)

    def scans(n, make):
        log = spark.createDataFrame([(k, make()) for k in range(n)], "qid long, text string")
        plan = LogPlanner(index).run(log, 10, scorer=False)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("positions#")

    nested = lambda: f"(({tree(rng, 0)} & !{tree(rng, 0)}) | \"a b\") (c d)~4"
    assert scans(3, nested) == scans(200, nested)


def test_a_log_without_queries_and_with_wrong_ones(spark, index):
    none = spark.createDataFrame([], "qid long, text string")
    assert LogPlanner(index).run(none).collect() == []
    wrong = spark.createDataFrame([(1, "(a")], "qid long, text string")
    with pytest.raises(Exception, match="expected"):
        LogPlanner(index).run(wrong).collect()


def test_positional_operators_against_all_places(spark, index, corpus):
    rng = random.Random(4)
    for _ in range(6):
        terms = tuple(rng.choices(WORDS[:5], k=rng.randint(1, 3)))
        width = rng.randint(1, 6)
        own = lambda kind, w=0: {i for i, t in enumerate(corpus) if stands(t.split(), kind, terms, w)}
        ids = lambda rows: {r["doc_id"] for r in rows.collect()}
        assert ids(phrase(index.postings, "text", terms)) == own("phrase")
        assert ids(ordered_within(index.postings, "text", terms)) == own("ordered")
        assert ids(near(index.postings, "text", terms, width)) == own("near", width)
        found = {r["doc_id"]: [tuple(s) for s in r["intervals"]] for r in intervals(index.postings, "text", terms).collect()}
        for i, text in enumerate(corpus):
            words = text.split()
            holds = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if set(terms) <= set(words[a : b + 1])]
            least = [s for s in holds if not any(t != s and t[0] >= s[0] and t[1] <= s[1] for t in holds)]
            assert found.get(i, []) == least


def test_positions_of_a_long_document_are_passed_once(spark):
    """200,000 words with 66,000 places a term: a product of the lists would not end."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(0, " ".join(rng.choices("abc", k=200_000)))], "doc_id long, text string")
    postings = build_index(docs).postings.persist()
    (row,) = intervals(postings, "text", ("a", "b", "c")).collect()
    assert len(row["intervals"]) > 10_000
    assert ordered_within(postings, "text", ("a", "b", "c"), 3).count() == 1
    postings.unpersist()


def test_what_a_log_matches_is_not_dealt_out_by_query(spark, index):
    """Postings are dealt out by document, each once; only results go by query."""
    log = spark.createDataFrame([(n, f'((a & {w}) | "c {w}") & !(e & f), (b {w})~4 | {w}*') for n, w in enumerate("abdg")], "qid long, text string")
    plan = LogPlanner(index).run(log.selectExpr("qid", "split(text, ',')[0] AS text"), 10)._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(qid#\d+L?, (part#\d+, )?doc_id", plan)


def test_trees_with_more_nodes_than_a_mask_and_with_as_many(spark, index, monkeypatch):
    log = [(n, '(a & !"b c") | (' + " | ".join(f"(a < {w} < {v})" for w in WORDS for v in WORDS[:n]) + ") & !(d & e)") for n in (1, 4, 8)]
    log += [(20, "(a | h*) & !(b | c d), !h | (g & f)"), (21, "a b c")]
    frame = spark.createDataFrame(log, "qid long, text string")
    rows = lambda: sorted(tuple(r) for r in LogPlanner(index).run(frame, 100).collect())
    sizes = {n: max(p["node"] for leaf in compiled(text) for p in leaf["path"]) for n, text in log[:3]}
    assert sizes[1] <= log_planner.MASK_NODES < sizes[8]
    both = rows()
    monkeypatch.setattr(log_planner, "MASK_NODES", 0)
    assert both == rows() and {r[0] for r in both} == {1, 4, 8, 20, 21}

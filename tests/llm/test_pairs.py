"""Near-duplicate operators against brute force over all pairs."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from prunella.llm.components import connected_components
from prunella.llm.jaccard_join import deduplicated, jaccard_groups
from prunella.llm.line_dedup import apart, deduplicated_lines, line_groups, line_rows, simhashes, similar

WORDS = [f"w{k}" for k in range(400)]


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def near_copies(rng, n_bases=8, copies=12, length=60, edits=(0, 0, 1, 1, 2, 3, 6)):
    out = []
    for _ in range(n_bases):
        base = [rng.choice(WORDS) for _ in range(rng.randint(5, length * 3))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice(edits)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            out.append(" ".join(own))
    return out


EDGES = [None, "", " \t\n", "one", "One", "two words", "two  words", "TWO\nwords", "x y z", "é è ê ë", "w1 " * 3000]


@pytest.mark.parametrize(
    ("width", "percent", "more"),
    [(3, 90, {}), (5, 80, {}), (3, 90, {"n_bases": 3, "copies": 150, "length": 200, "edits": range(25)}), (5, 80, {"n_bases": 3, "copies": 150, "length": 200, "edits": range(30)})],
)
def test_groups_are_those_of_all_pairs(spark, width, percent, more):
    """The larger ones have buckets of copies on both sides of the limit."""
    texts = near_copies(random.Random(width), **more) + EDGES
    sets = [shingles(t, width) for t in texts]
    links = [
        (a, b)
        for a in range(len(texts)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    comp = components(len(texts), links)
    least = {c: min(k for k in range(len(texts)) if comp[k] == c) for c in set(comp)}
    docs = spark.createDataFrame([(k, t, 1, "s") for k, t in enumerate(texts)], "doc_id long, text string, key int, sig string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(docs, width, percent).collect()}
    assert got == {k: (len(sets[k]), least[comp[k]]) for k in range(len(texts))}
    kept = deduplicated(docs, width, percent)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least[c] for c in comp))


def test_groups_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_groups(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "x"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_groups(rows).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (None, None)], key=str)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def simhash(words):
    votes = [0] * 64
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_simhashes(spark):
    lines = ["a", "a b", "one two three two", " ".join(WORDS), " ".join(WORDS[:77])]
    got = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    assert {r["key"]: r["sim"] % (1 << 64) for r in simhashes(got).collect()} == {k: simhash(x.split()) for k, x in enumerate(lines)}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    bases = [[rng.choice(WORDS) for _ in range(rng.randint(1, 40))] for _ in range(20)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            own = list(rng.choice(bases))
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            lines.append(rng.choice([" ".join(own), " ".join(own).upper() + "!", ", ".join(own)]))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "!!!\n!!!", "solo"]
    occurrences = [(d, p, re.findall(r"[^\W_]+", line.lower())) for d, t in enumerate(texts) if t is not None for p, line in enumerate(t.split("\n"))]
    occurrences = [o for o in occurrences if o[2]]
    norms = list(dict.fromkeys(" ".join(o[2]) for o in occurrences))
    bags = [Counter(n) for n in norms]
    # A substitution changes the counts of two characters by one, so the counts tell a lower bound.
    most = lambda a, b: 0.2 * max(len(norms[a]), len(norms[b])) + 1e-9
    near = lambda a, b: max((bags[a] - bags[b]).total(), (bags[b] - bags[a]).total()) <= most(a, b)
    pairs = [(a, b) for a in range(len(norms)) for b in range(a) if near(a, b) and levenshtein(norms[a], norms[b]) <= most(a, b)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, line string")
    # Candidates are approximate: of all pairs that are similar, some may be missed; nothing else may be linked.
    keyed = spark.createDataFrame([(n,) for n in norms], "norm string").select("norm", F.xxhash64("norm").alias("key"))
    _, groups = line_groups(line_rows(docs), docs)
    got = {r["norm"]: r["g"] for r in keyed.join(groups, "key", "left").select("norm", F.coalesce("g", "key").alias("g")).collect()}
    found = [(a, b) for a, b in pairs if got[norms[a]] == got[norms[b]]]
    assert len(found) >= 0.9 * len(pairs) > 50
    true = dict(zip(norms, components(len(norms), pairs), strict=True))
    assert all(len({true[n] for n in norms if got[n] == g}) == 1 for g in set(got.values()))
    comp = got
    seen, drop = set(), {}
    for d, p, w in occurrences:
        c = comp[" ".join(w)]
        if c in seen:
            drop.setdefault(d, []).append(p)
        seen.add(c)
    got = {r["doc_id"]: r for r in deduplicated_lines(docs).collect()}
    for d, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        kept = None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in drop.get(d, ()))
        assert (got[d]["n_lines"], got[d]["n_dropped"], got[d]["text"]) == (len(lines), len(drop.get(d, ())), kept)


def test_similarity_of_long_texts_is_decided_like_that_of_short_ones(spark):
    rng = random.Random(8)
    rows = []
    for n in (3, 40, 500):
        a = [rng.choice(WORDS) for _ in range(n)]
        for share in (0.0, 0.05, 0.15, 0.22, 0.3, 0.9):
            b = [rng.choice(WORDS) if rng.random() < share else w for w in a]
            del b[: rng.randint(0, 2)]
            rows.append((" ".join(a), " ".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similar("a", "b").alias("s")).collect()
    assert all(r["s"] == (levenshtein(r["a"], r["b"]) <= int(0.2 * max(len(r["a"]), len(r["b"])) + 1e-9)) for r in got)
    assert len({r["s"] for r in got}) == 2


def test_beginnings_and_ends_tell_unrelated_lines_and_no_similar_ones(spark):
    rng = random.Random(11)
    rows = []
    for n in (12, 40, 110):
        for share in (0.05, 0.12, 0.18, 0.25):
            for cut in (0, n // 12, n // 7):
                a = [rng.choice(WORDS) for _ in range(n)]
                b = [rng.choice(WORDS) if rng.random() < share else w for w in a]
                at = rng.choice([0, n // 2, n - cut])
                del b[at : at + cut]
                rows.append(rng.choice([(" ".join(a), " ".join(b)), (" ".join(b), " ".join(a))]))
    # Letters in random order are far apart wherever they are compared.
    far = [tuple("".join(rng.choice("abcdefghij klmnopqrst") for _ in range(rng.randint(270, 300))) for _ in "ab") for _ in range(30)]
    got = spark.createDataFrame(rows + far, "a string, b string").select("a", "b", similar("a", "b").alias("s"), apart("a", "b").alias("apart")).collect()
    links = [levenshtein(r["a"], r["b"]) <= int(0.2 * max(len(r["a"]), len(r["b"])) + 1e-9) for r in got]
    assert [r["s"] for r in got] == links
    assert 10 <= sum(links) <= len(rows) - 3
    assert not any(r["apart"] for r, link in zip(got, links, strict=True) if link)
    assert sum(r["apart"] for r in got if (r["a"], r["b"]) in far) >= 27


def test_lines_of_nothing_and_of_repeated_rows(spark):
    assert deduplicated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (None, "a b\nd"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in deduplicated_lines(rows).collect()), key=str)
    assert got == sorted([(1, "a b\nc"), (1, "a b\nc"), (None, "d"), (2, None)], key=str)


def test_queries_are_native(spark, tmp_path):
    from prunella.llm.mixing import mixed_documents
    from prunella.llm.pii import pseudonymised

    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for f in (deduplicated_lines, pseudonymised, mixed_documents):
        plan = f(docs)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_sizes_are_bounded_by_counts(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("same text here for all").alias("text"))
    assert {r["component_id"] for r in jaccard_groups(docs).collect()} == {0}


def test_rows_without_an_id_or_with_that_of_another_text(spark):
    base = [f"q{k}" for k in range(200)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    far = " ".join(f"z{k}" for k in range(200))
    rows = [
        (5, near(50)), (None, near(90)), (None, near(90)), (7, near(130)), (7, far), (7, far), (9, far + " more"), (None, "alone here"), (None, "alone here"),
        (11, ""), (11, ""), (None, ""), (None, None), (12, near(10)), (12, "!"), (12, "!"),
    ]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, rk long")
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_groups(docs).collect())
    assert got == Counter([(5, 5), (None, 5), (None, 5), (7, 5), (7, 7), (7, 7), (9, 7), (None, None), (None, None), (11, 11), (11, 11), (None, None), (None, None), (12, 5), (12, 12), (12, 12)])
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, near(50)), (7, far), (None, "alone here"), (11, ""), (None, ""), (None, None), (12, "!")])
    # Without an id in the group, one row stays.
    none = spark.createDataFrame([(None, near(20)), (None, near(60)), (None, near(60))], "doc_id long, text string")
    assert deduplicated(none).count() == 1

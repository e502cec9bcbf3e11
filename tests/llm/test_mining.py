"""Collocations, substring dedup and vector codes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prunella.llm import collocations as col
from prunella.llm.lookup import looked_up
from prunella.llm.substring_dedup import LAST, Hashed, deduplicated, merged_runs
from prunella.llm.vector_codes import LIMIT, codebooks_text, compressed, integer_vectors, label_errors

LOWER = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------- lookups


def test_frequent_keys_and_nulls_find_their_row(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}") for i in range(6000)], "i int, key string")
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("i").alias("least")).where("key is null or key != 'k2'")
    out = looked_up(rows, found, ["key"])
    assert out.columns == ["i", "key", "least"]
    assert out.count() == 5999
    assert {(r["key"], r["least"]) for r in out.where("key is null or key = 'hot'").distinct().collect() if r["i"] < 2} == {(None, 0), ("hot", 1)}


# ---------------------------------------------------------------- collocations


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        own = []
        candidates = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        for p in candidates:
            a = counts[p]
            inside = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * counts[q] >= 80 * a for q in inside):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            own.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def collocation_rows(rng):
    vocabulary = ["the", "of", "New", "york", "City", "é", "l’eau", "a", "b", "c"]
    fixed = ["new york city hall", "of the", "a a a a a a", "per\tse  et"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["", ". ", ", "]).join(rng.choice([*fixed, *(" ".join(rng.choices(vocabulary, k=4)))]) + " " for _ in range(30))) for _ in range(40)]
    rows += [("en", "Copies, of copies. of copies")] * 25
    return [*rows, ("en", None), (None, ""), ("de", " \t ;;\n"), ("de", "einmal"), ("fr", "x " * 3000), ("en", "non\xa0break \x1f")]


@pytest.mark.parametrize("top", [2000, 3])
def test_collocations_are_those_of_a_plain_count(spark, top):
    rows = collocation_rows(random.Random(7))
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string")
    found = col.collocations(docs, top=top, least=5).collect()
    want = brute_collocations(rows, 5, top)
    assert len(want) > 8 and sorted(tuple(r) for r in found) == want


def test_no_phrase_is_lost_when_the_filter_is_full(spark, monkeypatch):
    rows = collocation_rows(random.Random(8))
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "lang string, text string")
    monkeypatch.setattr(col, "_marked", lambda frequent, n: np.full(col.FILTER_BITS // 8, 255, np.uint8))
    assert sorted(tuple(r) for r in col.collocations(docs, least=5).collect()) == brute_collocations(rows, 5, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    big = (1 << 61) + 12345
    counts = spark.createDataFrame([("en", "x", 1, big + 7), ("en", "y", 1, big + 1), ("en", "x y", 2, big)], "lang string, phrase string, words int, f long")
    (row,) = col.cut_scores(counts).collect()
    assert (row["a"], row["l"], row["r"], row["score"]) == (big, big + 7, big + 1, 2_000_000 * big // (2 * big + 8))


def test_collocations_of_an_empty_table(spark):
    assert col.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_buckets_spill_and_count_all(spark, monkeypatch):
    monkeypatch.setattr(col, "BUCKET_MEMORY", "20MB")
    rows = spark.range(400_000).select(F.lit("en").alias("lang"), F.concat(F.lit("some words of a phrase "), F.col("id") % 100_000).alias("phrase"), F.lit(2).cast("long").alias("m"))
    out = col.bucket_counts(rows.coalesce(1), 8).agg(F.count("*").alias("n"), F.sum("f").alias("f")).first()
    assert tuple(out) == (100_000, 800_000)


# ---------------------------------------------------------------- substring dedup


def brute_dedup(rows, width=20):
    """Per row: n_words and the words that stay; rows are (doc_id, text)."""
    least, words = {}, []
    for doc, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words.append(own)
        key = LAST if doc is None else doc
        for i in range(len(own) - width + 1):
            w = tuple(own[i : i + width])
            least[w] = min(least.get(w, LAST), key)
    out = []
    for (doc, _), own in zip(rows, words, strict=True):
        key, gone, seen = LAST if doc is None else doc, set(), set()
        for i in range(len(own) - width + 1):
            w = tuple(own[i : i + width])
            if least[w] < key or w in seen:
                gone |= set(range(i, i + width))
            seen.add(w)
        out.append((doc, len(own), len(gone), " ".join(x for i, x in enumerate(own) if i not in gone)))
    return out


def dedup_rows(rng):
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(50)]
    passages = [rng.choices(vocabulary, k=n) for n in (19, 20, 21, 22, 30, 45, 60, 200)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.4:
                    p[rng.randrange(len(p))] = rng.choice(vocabulary)
                a = rng.randint(0, 12)
                text += p[a : len(p) - rng.randint(0, 3)]
            else:
                text += rng.choices(vocabulary, k=rng.randint(0, 40))
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(text)))
    copy = rows[5][1] + " tail of a copy"
    rows += [(1000 + k, copy) for k in range(30)]  # one group holds many rows
    rows += [(-5, " ".join(passages[-1])), (None, " ".join(passages[-1])), (None, " ".join(passages[-2])), (None, None)]
    rows += [(2000, " ".join(passages[4] * 3)), (2001, "z " * 500), (2002, "z " * 25), (2003, ""), (2004, None), (2005, "one"), (2006, " \n ")]
    rows += [(3000, "again " * 2 + copy), (3000, "again " * 2 + copy), (3000, "other " + copy)]  # rows of one doc_id
    return rows


def test_removed_words_are_those_of_a_plain_search(spark):
    rows = dedup_rows(random.Random(3))
    docs = spark.createDataFrame([(a, b, 1, "k", "runs") for a, b in rows], "doc_id long, text string, n int, k string, runs string").repartition(5)
    out = deduplicated(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "spans", "kept"]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()]
    assert sorted(found, key=key) == sorted(brute_dedup(rows), key=key)


@pytest.mark.parametrize(("width", "anchor"), [(1, 1), (3, 2), (8, 10)])
def test_other_windows(spark, width, anchor):
    rng = random.Random(width)
    rows = [(i, " ".join(rng.choices("abcd" if width < 5 else "ab", k=rng.randint(0, 30)))) for i in range(40)]
    found = deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), width, anchor)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()) == sorted(brute_dedup(rows, width))


def test_spans_name_an_earlier_document_that_has_the_words(spark):
    rows = [(d, t) for d, t in dedup_rows(random.Random(4)) if d is not None and d != 3000]
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    n = 0
    for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for first, size, source in r["spans"]:
            own = words[r["doc_id"]][first : first + size]
            assert size >= 20 and source <= r["doc_id"]
            n += 1
            if source < r["doc_id"]:  # every window of a factor stands in its source
                there = {tuple(words[source][i : i + 20]) for i in range(len(words[source]) - 19)}
                assert all(tuple(own[i : i + 20]) in there for i in range(size - 19))
    assert n > 50


def test_empty_table_and_runs(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert merged_runs([(0, 5, 1), (5, 1, 1), (6, 1, 2), (9, 1, 2)], 20) == [(0, 25, 1), (6, 20, 2), (9, 20, 2)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    words = rng.choices([b"a", b"b", b"c"], k=400)
    text = b" ".join(words)
    own = Hashed(np.frombuffer(text, np.uint8), np.asarray([0, len(text)]), 6)
    place, anchor = own.anchors(3)
    of = defaultdict(set)
    for at, p, a in zip(own.at.tolist(), place.tolist(), anchor.tolist(), strict=True):
        assert at <= p <= at + 3
        of[tuple(words[at : at + 6])].add((a, p - at))
    assert max(map(len, of.values())) == 1


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, l, [math.floor(256 * float(x)) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(p, c[p])[1]].append(c[p])
            for k, own in groups.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for (i, l, _), c in zip(kept, cut, strict=True):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((i, l, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    total = Counter()
    for _, l, _, e in out:
        total[l] += e
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, c, e, total[l]) for i, l, c, e in out], text


def vector_rows(rng, n=150, size=32):
    f32 = lambda x: float(np.float32(x))
    rows = [(i * 2, [f32(rng.gauss(0, 0.2)) for _ in range(size)], rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)]  # one vector holds many rows
    rows += [(1, None, 1), (3, [None, *rows[0][1][1:]], 1), (5, [float("nan"), *rows[0][1][1:]], 2), (7, [float("inf"), *rows[0][1][1:]], None)]
    rows += [(9, [0.0, 1.0], 2), (11, [], 2), (None, rows[8][1], None)]
    return rows


@pytest.mark.parametrize(("n", "rounds"), [(150, 2), (20, 1), (150, 0)])
def test_codes_are_those_of_a_plain_lloyd(spark, n, rounds):
    rows = vector_rows(random.Random(n), n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit(1), "part": F.lit(2), "n": F.lit(3)})
    codes, books = compressed(integer_vectors(df.repartition(3)), rounds=rounds)
    found = [(r["vec_id"], "".join(f"{k:02x}" for k in r["codes"]), r["error"], r["label_error"]) for r in label_errors(codes).collect()]
    want, text = brute_codes([r for r in rows if r[1] is None or len(r[1]) == 32], rounds=rounds)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(want, key=key)
    assert hashlib.sha256(codebooks_text(books).encode()).digest() == hashlib.sha256(text.encode()).digest()


def test_vector_codes_of_an_empty_table_and_of_large_components(spark):
    kind = "vec_id long, embedding array<float>, label int"
    codes, _ = compressed(integer_vectors(spark.createDataFrame([(1, None, 2)], kind)))
    assert label_errors(codes).collect() == []
    with pytest.raises(Exception, match="beyond"):
        integer_vectors(spark.createDataFrame([(1, [float(LIMIT)] * 16, 2)], kind))
    with pytest.raises(ValueError, match="equal parts"):
        compressed(integer_vectors(spark.createDataFrame([(1, [1.0] * 17, 2)], kind)))

"""N-gram Jaccard join with PartEnum signatures, and the groups of its links.

Sets of word shingles are compared by Jaccard similarity of at least `percent` / 100.  Sets fall into size bands.  In a
band, two similar sets differ in at most k elements; so, of n1 parts of the (hashed) feature domain, in one they differ
in at most one element, and of the three sub-parts of that part, in two they agree.  Each set has one signature for
every pair of sub-parts of every part; sets that are similar share one.  A set near the top of its band also signs for
the next band, so that similar sets of neighbouring bands meet.

Nothing enumerates the pairs of a bucket of similar sets.  Equal sets are one class from the start; classes are linked
through hubs (see linking), behind a filter that loses no link: the parities of elements per bit of a sketch differ at
most as often as the sets do.  All candidates are verified on their sets.

Defined cases: texts without words (and nulls) have an empty set, link with nothing and are their own component; fewer
words than a shingle make one shingle of the whole sequence; rows that repeat a doc_id each come back, by their own text; a row with a null
doc_id takes part by its text and gets the least id of its group that is not null, or null.  Columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import (
    LOWER, mix, released, row_of, row_sums, slices, small_batches, span_hashes, table, windows, word_bounds, written,
)
from prunella.llm.linking import light, linked_groups, shared_items, shared_signatures, without_frequent

#: Growth of set sizes from one band to the next.
BAND_GROWTH = 1.4
#: Twice one part in so many is there to spare: that many more signatures agree, so a set may leave out as many.
SPARE_SHARE = 8
#: Low bits of a signature that tell its tag; the next bit tells that it is one of emptiness.
TAG_BITS = 7
#: 64-bit words of a parity sketch, and of the wide one that candidate pairs are looked at with before their sets.
SKETCH_WORDS = 32
WIDE_WORDS = 128


@functools.cache
def bands(limit: int = 1 << 40) -> np.ndarray:
    low = [1]
    while low[-1] < limit:
        low.append(max(low[-1] + 1, int(low[-1] * BAND_GROWTH)))
    return np.asarray(low, np.int64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int):
    """Sorted distinct hashes of the shingles of each row, and where each row's begin."""
    buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, off)
    h = span_hashes(buf, starts, ends)
    win, at = windows(h, first, width)
    rows = row_of(first)[at] if len(at) else np.zeros(0, np.int64)
    n = np.diff(first)
    for short in range(1, width):  # whole sequences of fewer words
        few = np.flatnonzero(n == short)
        if len(few):
            whole = np.zeros(len(few), np.uint64)
            for j in range(short):
                whole = mix(whole * np.uint64(31) + h[first[few] + j] + np.uint64(short))
            win, rows = np.concatenate([win, whole]), np.concatenate([rows, few])
    order = np.lexsort((win, rows))
    win, rows = win[order], rows[order]
    keep = np.ones(len(win), bool)
    keep[1:] = (win[1:] != win[:-1]) | (rows[1:] != rows[:-1])
    win, rows = win[keep], rows[keep]
    return win, np.searchsorted(rows, np.arange(len(off)))


def differences(percent: int) -> np.ndarray:
    """In how many elements similar sets of each tag differ at most: together they have at most 2 * top elements."""
    top = bands()[1:] - 1
    return (2 * top * (100 - percent)) // (100 + percent)


def spare_matches(percent: int) -> list[int]:
    """Of each tag, half the number of parts to spare: so many signatures of emptiness, and so many others, may be left out."""
    return (differences(percent) // (2 * SPARE_SHARE) + 1).tolist()


def signatures(sets: np.ndarray, first: np.ndarray, percent: int):
    """PartEnum signatures of each row's set, and where each row's begin; the low bits of a signature are its tag."""
    n = np.diff(first)
    low, most = bands(), differences(percent)
    spare_of = np.asarray(spare_matches(percent))
    band = np.searchsorted(low, n, "right") - 1
    found, owner = [], []
    for ahead in (0, 1):
        tag = np.minimum(band + ahead, len(most) - 1)
        use = (n > 0) & (most[tag] > 0)  # else only equal sets are similar
        if ahead:
            use &= 100 * n >= percent * low[tag]
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        spare = spare_of[tag[rows]]
        parts = most[tag[rows]] // 2 + 1 + 2 * spare
        base = np.zeros(len(rows) + 1, np.int64)
        base[1:] = np.cumsum(parts)
        size = n[rows]
        at = np.repeat(first[rows], size) + _ramp(size)
        h = sets[at]
        part = ((h >> np.uint64(32)) * np.repeat(parts, size).astype(np.uint64)) >> np.uint64(32)
        sub = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
        cell = (np.repeat(base[:-1], size) + part.astype(np.int64)) * 3 + sub.astype(np.int64)
        total = np.zeros(3 * base[-1], np.uint64)
        np.add.at(total, cell, mix(h ^ np.uint64(0xA24BAED4963EE407)))
        bare = (np.bincount(cell, minlength=3 * base[-1]) == 0).reshape(-1, 3)
        total = total.reshape(-1, 3)
        tags = np.repeat(tag[rows], parts).astype(np.uint64)
        salt = mix(tags * np.uint64(1 << 40) + _ramp(parts).astype(np.uint64))
        sign, of = [], []
        for a, b in ((0, 1), (0, 2), (1, 2)):
            both = mix(mix(total[:, a] + salt) + total[:, b] * np.uint64(3) + np.uint64(10 * a + b))
            empty = (bare[:, a] & bare[:, b]).astype(np.uint64)
            sign.append((both << np.uint64(TAG_BITS + 1)) | (empty << np.uint64(TAG_BITS)) | tags)
            of.append(np.repeat(np.arange(len(rows)), parts))
        sign, of = np.concatenate(sign), np.concatenate(of)
        # Of two similar sets, more than 2 * spare pairs of sub-parts agree.  In an order that all sets share, each may
        # leave out its last ones: first signatures of emptiness, then (see without_frequent) frequent ones.
        bare_at = np.flatnonzero(sign & np.uint64(1 << TAG_BITS))
        bare_at = bare_at[np.lexsort((~sign[bare_at], of[bare_at]))]
        row = of[bare_at]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = np.ones(len(sign), bool)
        keep[bare_at[rank < spare[row]]] = False
        found.append(sign[keep])
        owner.append(rows[of[keep]])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(first)))


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, and so on."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(n) else 0) - np.repeat(end - n, n)


def parities(sets: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """Rows of `words` 64-bit words of parity bits: two sets' rows differ in no more bits than the sets in elements."""
    rows = row_of(first)
    bit = ((sets >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 6 - words.bit_length() + 1)
    cell = rows * (64 * words) + bit.astype(np.int64)
    odd = np.bincount(cell, minlength=(len(first) - 1) * 64 * words) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 64 * words), axis=1).view("<i8")


def sketches(sets: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    packed = parities(sets, first, SKETCH_WORDS)
    return [np.ascontiguousarray(packed[:, j]) for j in range(SKETCH_WORDS)]


def row_key() -> Column:
    """What rows with equal id (or none) and equal text have in common."""
    return F.xxhash64("doc_id", "text")


KEY, CHECK = 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03
SKETCH = [f"s{j}" for j in range(SKETCH_WORDS)]


def set_features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, rk, n_shingles, key (hash of the set), check (another) and sketch words of each row."""

    def features(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                sets, first = shingle_sets(buf, off, width)
                key, check = (_set_hash(sets, first, c) for c in (KEY, CHECK))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("rk").slice(a, b - a), pa.array(np.diff(first)), pa.array(key), pa.array(check)]
                    + [pa.array(x) for x in sketches(sets, first)],
                    ["doc_id", "rk", "n_shingles", "key", "check", *SKETCH],
                )

    words = ", ".join(f"{s} long" for s in SKETCH)
    rows = docs.select("doc_id", "text", row_key().alias("rk"))
    return rows.mapInArrow(features, f"doc_id long, rk long, n_shingles long, key long, check long, {words}")


def signed_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, key) for the signatures of each set; a set signs once in a task, however many copies the task reads."""

    def sign(batches):
        done: set[int] = set()
        for batch in batches:
            for _, _, buf, off in slices(batch.column("text")):
                sets, first = shingle_sets(buf, off, width)
                key = _set_hash(sets, first, KEY)
                new = np.zeros(len(key), bool)
                for i, k in enumerate(key.tolist()):
                    if k not in done:
                        done.add(k)
                        new[i] = True
                new &= np.diff(first) > 0
                size = np.where(new, np.diff(first), 0)
                sets = sets[np.repeat(new, np.diff(first))]
                sig, at = signatures(sets, np.concatenate([[0], np.cumsum(size)]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.repeat(key, np.diff(at)))], ["sig", "key"])

    return docs.select("text").mapInArrow(sign, "sig long, key long")


def _set_hash(sets: np.ndarray, first: np.ndarray, c: int) -> np.ndarray:
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets ^ np.uint64(c)), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, elements, wide) of the classes in wanted (key, rk), recomputed from the text of that row."""
    rows = docs.select(row_key().alias("rk"), "text").join(light(wanted), "rk")

    def elements(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                sets, first = shingle_sets(buf, off, width)
                wide = parities(sets, first, WIDE_WORDS).ravel()
                ends = np.arange(b - a + 1, dtype=np.int32) * WIDE_WORDS
                keys = batch.column("key").slice(a, b - a)
                own = pa.array(_set_hash(sets, first, KEY) == keys.to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(wide)),
                    ],
                    ["key", "elements", "wide"],
                ).filter(own)

    return rows.select("key", "text").mapInArrow(elements, "key long, elements array<long>, wide array<long>").dropDuplicates(["key"])


def _verified(docs: DataFrame, info: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar enough; only sets of classes in pairs are built."""
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    sets = written(_sets_of(docs, written(keys.join(info.select("key", "rk"), "key"), "wanted"), width), "sets")
    # First the wide sketches of both sides, then the sets of what is left: a pair of long texts is large.
    few = light(pairs)
    left = sets.select(F.col("key").alias("u"), F.size("elements").alias("n"), F.col("wide").alias("x")).join(few, "u")
    right = sets.select(F.col("key").alias("v"), F.size("elements").alias("m"), F.col("wide").alias("y")).join(few, "v")
    bits = F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (a, b) -> a + b)")
    may = bits * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    pairs = written(left.join(right, ["u", "v"]).where(may).select("u", "v"), "near-pairs")
    released(pairs.sparkSession)
    few = light(pairs)
    left = sets.select(F.col("key").alias("u"), F.col("elements").alias("a")).join(few, "u")
    right = sets.select(F.col("key").alias("v"), F.col("elements").alias("b")).join(few, "v")
    both = F.size(F.array_intersect("a", "b"))
    similar = 100 * both >= percent * (F.size("a") + F.size("b") - both)
    links = written(left.join(right, ["u", "v"]).where(similar).select("u", "v"), "similar")
    released(links.sparkSession, sets)
    return links


def _compare(percent: int):
    """Of two aliased rows: the bits in which their sketches differ, and whether sizes and sketches allow a link."""

    def compare(left: str, right: str):
        bits = sum(F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in SKETCH)
        n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
        return bits, (bits * (100 + percent) <= (n + m) * (100 - percent)) & (100 * F.least(n, m) >= percent * F.greatest(n, m))

    return compare


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The features of the rows of docs, and key, doc_id (the least) and g (the group) of each class of equal sets."""
    small_batches(docs.sparkSession)
    rows = written(set_features(docs, width), "features")
    info = rows.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.min("rk").alias("rk"), F.first("n_shingles").alias("n"),
        F.min("check").alias("low"), F.max("check").alias("high"), *(F.first(s).alias(s) for s in SKETCH),
    )
    info = written(info, "classes")
    if info.where("low != high").limit(1).count():
        raise ArithmeticError("two different sets share a 64-bit hash; change KEY")
    members = shared_signatures(signed_sets(docs, width, percent))
    spare = F.array(*(F.lit(n) for n in spare_matches(percent)))
    empty = F.col("sig").bitwiseAND(F.lit(1 << TAG_BITS)) != 0
    members = without_frequent(members, F.col("sig").bitwiseAND(F.lit((1 << TAG_BITS) - 1)), spare, empty)
    shared = written(shared_items(members).join(info, "key"), "shared-classes")
    groups = linked_groups(members, shared, ["n", *SKETCH], _compare(percent), lambda pairs: _verified(docs, shared, pairs, width, percent))
    return rows, info.select("key", "doc_id").join(groups, "key", "left").select("key", "doc_id", F.coalesce("g", "key").alias("g"))


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows, whole = _grouped(docs, width, percent)
    # From classes to rows: the least doc_id of a group of classes.
    least = whole.groupBy("g").agg(F.min("doc_id").alias("least"))
    named = whole.join(least, "g").select("key", F.col("least").alias("component_id"))
    # A hot class of copies makes this join uneven; AQE splits its partition.
    linked = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "key").join(named, "key").select("doc_id", "n_shingles", "component_id")
    return linked.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that remain when one row of each group stays: that with the least id, one with a null id last.

    Rows without words stay, but for repeated rows of an id, of which one does.
    """
    rows, whole = _grouped(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    first = rows.where("n_shingles > 0").groupBy("key").agg(F.min(order).alias("f")).join(whole.select("key", "g"), "key")
    first = first.groupBy("g").agg(F.min("f").alias("f")).select("f.rk")
    bare = rows.where("n_shingles = 0 and doc_id is not null").select("rk").distinct()
    again = rows.where("n_shingles > 0 or doc_id is not null").groupBy("rk").agg(F.count("*").alias("n")).where("n > 1")
    kept = written(first.union(bare).join(again, "rk", "left").select("rk", F.col("n").isNotNull().alias("many")), "kept")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("rk"))
    out = keyed.join(light(kept.where("not many").select("rk")), "rk", "left_semi").select("row.*")
    # Only rows that are repeated are shuffled to keep one of each.
    many = keyed.join(light(kept.where("many").select("rk")), "rk", "left_semi").dropDuplicates(["rk"]).select("row.*")
    return out.union(many).union(docs.where(F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
bi AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM bi UNION SELECT r.x, b.y FROM reach r JOIN bi b ON b.x = r.y),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON x = doc_id
"""

"""Benchmark decontamination: Aho-Corasick automata over the normalised windows of all test items.

Texts are normalised by lower-casing A-Z and replacing what is no word by one blank; an automaton runs over that once
per text, and its matches are mapped back to character offsets of the original.  A benchmark of more than ITEM_CHARS
characters is cut into parts with an automaton each; of a text, the hit words of all parts count together, and so do the
items, before it is decided.

Defined cases: a null or empty text has no words and no hits; an item without words matches nothing; repeated item rows
count once per item_id; items with a null id or null text are ignored; an empty benchmark leaves all documents clean.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import small_batches, table, word_bounds, written

WINDOW = 13
#: A document is contaminated when at least one word in this many is hit.
SHARE = 20
#: Characters of test items in one automaton (each character is in up to WINDOW patterns).
ITEM_CHARS = 4_000_000

#: A word of the original text.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Maps A-Z to a-z and every ASCII character that is no letter or digit to a blank; other bytes stay.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_BLANK = np.zeros(256, bool)
_BLANK[32] = True
_AUTOMATA: dict[str, tuple] = {}

SCHEMA = (
    "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>, contaminated boolean"
)


def windows_of(text: str, width: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = text.encode().translate(NORMAL).split(b" ")
    words = [w for w in words if w]
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def automaton(items: list[tuple[int, str]], width: int):
    """The automaton, and for each pattern its number of words and its items; kept per worker."""
    key = hashlib.sha256(repr((width, items)).encode()).hexdigest()
    if key not in _AUTOMATA:
        patterns: dict[tuple, set] = {}
        for item, text in items:
            for w in windows_of(text, width):
                patterns.setdefault(w, set()).add(item)
        auto = ahocorasick.Automaton()
        for w, ids in patterns.items():
            auto.add_word(f" {b' '.join(w).decode('latin-1')} ", (len(w), ids))
        if patterns:
            auto.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = (auto, bool(patterns))
    return _AUTOMATA[key]


def hits(text: str, auto) -> tuple[int, np.ndarray, set, list]:
    """Words of the text, which of them are hit, the items found, and the hit runs as offsets of the original."""
    raw = text.encode()
    norm = raw.translate(NORMAL)
    words = norm.split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    found = list(auto.iter(line)) if words else []
    hit = np.zeros(len(words), bool)
    items: set = set()
    if not found:
        return len(words), hit, items, []
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    for end, (n, ids) in found:
        last = int(np.searchsorted(blanks, end)) - 1
        hit[last - n + 1 : last + 1] = True
        items |= ids
    buf = np.frombuffer(norm, np.uint8)
    starts, ends, _ = word_bounds(buf, np.asarray([0, len(buf)]), _BLANK)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    # Characters before each byte, for offsets of the original text.
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    spans = [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in edge.reshape(-1, 2)]
    return len(words), hit, items, spans


def fetched(benchmark: DataFrame, width: int = WINDOW) -> list[list[tuple[int, str]]]:
    """The usable items, in parts of about ITEM_CHARS characters; an item that is longer is in several, by its windows."""
    usable = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    parts, size = [[]], 0
    for item, text in sorted((r["item_id"], r["text"]) for r in usable.collect()):
        for piece in _cut(text, width):
            if parts[-1] and size + len(piece) > ITEM_CHARS:
                parts.append([])
                size = 0
            parts[-1].append((item, piece))
            size += len(piece)
    return parts


def _cut(text: str, width: int) -> list[str]:
    """The text, or pieces of about ITEM_CHARS characters that have all its windows together."""
    if len(text) <= ITEM_CHARS:
        return [text]
    words = text.encode().translate(NORMAL).split()
    step = max(1, ITEM_CHARS * len(words) // len(text.encode()) - width + 1)
    last = max(1, len(words) - width + 1)
    return [b" ".join(words[i : min(i + step, last) + width - 1]).decode() for i in range(0, last, step)]


def _each(texts: list[str], items: list[tuple[int, str]], width: int, share: int):
    """(words, hit words, items, spans, contaminated) of each text."""
    auto, any_pattern = automaton(items, width)
    for text in texts:
        if any_pattern:
            words, hit, ids, spans = hits(text, auto)
        else:
            words, hit, ids, spans = len(text.encode().translate(NORMAL).split()), np.zeros(0, bool), set(), []
        n = int(hit.sum())
        yield words, n, sorted(ids), [{"start": a, "end": b} for a, b in spans], n > 0 and share * n >= words


def _row() -> list:
    """doc_id and k: what rows with equal id and text have in common."""
    return [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("k")]


def _found(docs: DataFrame, parts: list[list[tuple[int, str]]], width: int, share: int) -> DataFrame:
    """r_id, r_k, n_hit, items, spans and contaminated of the texts that any part of the items hits; a pass for each part.

    A worker has one automaton at a time, and what a pass leaves are the rows with hits, without their texts.
    """
    passes = []
    for items in parts:

        def scan(batches, items=items):
            auto, any_pattern = automaton(items, width)
            for batch in batches:
                rows = []
                for i, text in enumerate(batch.column("text").fill_null("").to_pylist() if any_pattern else []):
                    words, hit, ids, spans = hits(text, auto)
                    if spans:
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
                        rows.append((i, words, sorted(ids), [[*e, *x] for e, x in zip(edge, spans, strict=True)]))
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("k").take(at), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.list_(pa.int32())))],
                    ["doc_id", "k", "n_words", "items", "runs"],
                )

        rows = docs.select(*_row(), "text").mapInArrow(scan, "doc_id long, k string, n_words long, items array<long>, runs array<array<int>>")
        passes.append(written(rows.dropDuplicates(["doc_id", "k"]), "hits"))
    each = functools.reduce(DataFrame.union, passes).groupBy("doc_id", "k").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
    )

    def join_runs(batches):
        for batch in batches:
            counts, spans, bad = [], [], []
            for words, runs in zip(batch.column("n_words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                out = []
                for first, end, start, stop in runs:
                    if out and first <= out[-1][1]:
                        out[-1][1], out[-1][3] = max(out[-1][1], end), max(out[-1][3], stop)
                    else:
                        out.append([first, end, start, stop])
                counts.append(sum(r[1] - r[0] for r in out))
                spans.append([{"start": r[2], "end": r[3]} for r in out])
                bad.append(share * counts[-1] >= words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k"), pa.array(counts, pa.int64()), batch.column("items"),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(bad, pa.bool_())],
                ["r_id", "r_k", "n_hit", "items", "spans", "contaminated"],
            )

    return each.mapInArrow(join_runs, SCHEMA.replace("doc_id long, n_words long", "r_id long, r_k string"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted ids), spans (hit runs in the original text), contaminated."""
    small_batches(docs.sparkSession)
    items, *more = fetched(benchmark, width)
    if more:
        rows = docs.select(*_row(), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
        rows = rows.join(_found(docs, [items, *more], width, share), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("k") == F.col("r_k")), "left")
        none = {"n_hit": "0L", "items": "cast(array() as array<long>)", "spans": "cast(array() as array<struct<start:int,end:int>>)", "contaminated": "false"}
        return rows.select("doc_id", "n_words", *(F.expr(f"coalesce({c}, {x})").alias(c) for c, x in none.items()))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.bool_()]

    def scan(batches):
        for batch in batches:
            rows = list(_each(batch.column("text").fill_null("").to_pylist(), items, width, share))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
                ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    small_batches(docs.sparkSession)
    items, *more = fetched(benchmark, width)
    if more:
        bad = _found(docs, [items, *more], width, share).where("contaminated").select("r_id", "r_k")
        rows = docs.select(F.struct(*docs.columns).alias("row"), *_row())
        rows = rows.join(bad, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("k") == F.col("r_k")), "left_anti")
        return rows.select("row.*")

    def clean(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            yield batch.filter(pa.array([not r[4] for r in _each(texts, items, width, share)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit
       FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

"""Phrase collocation mining: weighted counts of n-grams over distinct pieces, and cut scores of the frequent ones.

Texts are cut into pieces at punctuation; equal pieces of a language become one row with a multiplicity.  N-grams are
counted level by level: those of n words are emitted only where both of their parts of n - 1 words may be frequent.  That
is told by a bitmap of hashes of fixed size (FILTER_BITS), in which every frequent part is marked: parts that fall on a
marked bit by chance are counted too, and dropped by their exact counts, so no phrase is lost and none is miscounted
however full the bitmap is.  A task adds up its own n-grams, the sums go to hash buckets, and duckdb counts each bucket
within a memory limit, spilling beyond it.  The counts of a candidate's parts come to it by a shuffle of requests.

Defined cases: a null text is empty, a null lang is `und`; pieces of blanks only have no words; repeated rows count as
often as they stand; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import string
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prunella.llm.common import mix, released, row_of, slices, small_batches, span_hashes, table, windows, word_bounds, written
from prunella.llm.lookup import looked_up

LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: A candidate goes where a longer one has at least COVER percent of its occurrences.
COVER = 80
#: Bits of the filter between levels; it is broadcast, so its 8 MB hold for every size of input.
FILTER_BITS = 1 << 26
#: Bytes of pieces whose n-grams a task adds up at a time.
BLOCK = 8 << 20
#: Memory of duckdb for one bucket; more goes to its spill folder.
BUCKET_MEMORY = "256MB"
_BLANK = np.arange(256) == 32


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language, words joined by one blank, and how often each stands."""
    text = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    rows = rows.select("lang", F.trim(F.regexp_replace("piece", r"[ \t]+", " ")).alias("piece")).where("piece != ''")
    return written(rows.groupBy("lang", "piece").agg(F.count("*").alias("m")), "pieces")


def _gathered(batches, size: int = BLOCK):
    """The batches, put together to tables of about size bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Grams:
    """The words of rows of pieces, and keys of their n-grams that tell languages apart."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: pa.Array):
        self.buf = buf
        self.starts, self.ends, self.first = word_bounds(buf, off, _BLANK)
        self.h = span_hashes(buf, self.starts, self.ends)
        self.row = row_of(self.first)
        coded = langs.dictionary_encode()
        names = [x.encode() for x in coded.dictionary.to_pylist()]
        edges = np.cumsum([0, *map(len, names)])
        salts = span_hashes(np.frombuffer(b"".join(names), np.uint8), edges[:-1], edges[1:]) if names else np.zeros(0, np.uint64)
        self.salt = salts[coded.indices.to_numpy()]

    def bits(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The filter's bit of each n-gram, and its first word."""
        own, at = windows(self.h, self.first, n)
        return (mix(own ^ self.salt[self.row[at]]) & np.uint64(FILTER_BITS - 1)).astype(np.int64), at

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The texts of the n-grams that begin at these words."""
        a, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        edges = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=edges[1:])
        data = self.buf[np.repeat(a - edges[:-1], size) + np.arange(edges[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(data))


def _marked(frequent: DataFrame, n: int) -> np.ndarray:
    """The filter: a bit for each frequent n-gram; FILTER_BITS / 8 bytes reach the driver at most."""

    def bits(batches):
        for some in _gathered(batches):
            langs, texts = (some.column(c).combine_chunks() for c in ("lang", "phrase"))
            for a, b, buf, off in slices(texts, BLOCK):
                own, _ = Grams(buf, off, langs.slice(a, b - a)).bits(n)
                yield pa.RecordBatch.from_arrays([pa.array(own + 1)], ["bit"])

    rows = frequent.select("lang", "phrase").mapInArrow(bits, "bit long")
    rows = rows.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for k, own in rows.collect():
        out[k - 1] = np.frombuffer(bytes(own), np.uint8)
    return out.ravel()


def _emitted(rows: DataFrame, n: int, marks) -> DataFrame:
    """(lang, phrase, m): the n-grams whose parts of n - 1 words are marked, added up block by block."""

    def grams(batches):
        marked = marks.value if marks else None
        for some in _gathered(batches):
            langs, texts, m = (some.column(c).combine_chunks() for c in ("lang", "piece", "m"))
            for a, b, buf, off in slices(texts, BLOCK):
                own = Grams(buf, off, langs.slice(a, b - a))
                if marked is None:
                    at = np.arange(len(own.h))
                else:
                    bit, part = own.bits(n - 1)
                    on = np.zeros(len(own.h) + 1, bool)
                    on[part] = (marked[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    last = max(0, len(own.h) - n + 1)
                    at = np.flatnonzero(on[:last] & on[1 : last + 1] & (own.row[:last] == own.row[n - 1 : n - 1 + last]))
                pick = pa.array(own.row[at] + a)
                found = pa.table({"lang": langs.take(pick), "phrase": own.phrases(at, n), "m": m.take(pick)})
                found = found.group_by(["lang", "phrase"]).aggregate([("m", "sum")]).rename_columns(["lang", "phrase", "m"])
                yield from found.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int64())])).to_batches(1 << 16)

    return rows.mapInArrow(grams, "lang string, phrase string, m long")


def bucket_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases that stand `least` times or more: each hash bucket is counted out of core by duckdb."""

    def count(batches):
        import duckdb

        with tempfile.TemporaryDirectory() as spill, duckdb.connect(":memory:") as con:
            for k, v in {"threads": "1", "memory_limit": f"'{BUCKET_MEMORY}'", "temp_directory": f"'{spill}'", "preserve_insertion_order": "false"}.items():
                con.execute(f"SET {k} = {v}")
            con.execute("CREATE TABLE part (lang VARCHAR, phrase VARCHAR, m BIGINT)")
            for some in _gathered(batches):
                con.register("arrived", some)
                con.execute("INSERT INTO part SELECT lang, phrase, m FROM arrived")
                con.unregister("arrived")
            found = con.sql(f"SELECT lang, phrase, sum(m)::BIGINT AS f FROM part GROUP BY lang, phrase HAVING sum(m) >= {int(least)}")
            kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
            for batch in found.to_arrow_reader(1 << 16):
                yield from pa.Table.from_batches([batch]).cast(kind).to_batches()

    return rows.repartition("lang", "phrase").mapInArrow(count, "lang string, phrase string, f long")


def frequent_phrases(own: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f): the phrases of up to `longest` words that stand `least` times or more in pieces."""
    spark = own.sparkSession
    small_batches(spark)
    levels, marks = [], None
    for n in range(1, longest + 1):
        if n > 1:
            marks = spark.sparkContext.broadcast(_marked(levels[-1], n - 1))
        found = bucket_counts(_emitted(own, n, marks), least).withColumn("words", F.lit(n))
        levels.append(written(found, f"phrases-{n}"))
        released(spark)
    return reduce(DataFrame.unionByName, levels)


def _joined(first: str, size: str) -> str:
    return f"array_join(slice(w, {first}, {size}), ' ')"


def cut_scores(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words or more, at their lowest-scoring cut."""
    rows = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = f"transform(sequence(1, words - 1), k -> array(struct(k, 0 AS side, {_joined('1', 'k')} AS part), struct(k, 1 AS side, {_joined('k + 1', 'words - k')} AS part)))"
    asks = written(rows.select("lang", "phrase", "words", "a", F.expr(f"inline(flatten({cuts}))")), "requests")
    asked = asks.groupBy("lang", "part").agg(F.count("*").alias("n"))
    parts = counts.select("lang", F.col("phrase").alias("part"), "f").join(asked, ["lang", "part"])
    given = looked_up(asks, written(parts, "parts"), ["lang", "part"])
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("f")))
    each = given.groupBy("lang", "phrase", "words", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    # Decimals: a product of counts may pass 64 bits.
    score = F.expr(f"({scale}BD * a) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    best = each.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): of the phrases that stand inside longer ones, the count of the most frequent longer one."""
    rows = counts.where("words > 2").select("lang", "words", "f", F.split("phrase", " ").alias("w"))
    inner = f"flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), i -> {_joined('i', 's')})))"
    return rows.select("lang", "f", F.explode(F.expr(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, top: int | None = TOP, longest: int = LONGEST, least: int = LEAST, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's collocations, the `top` best of them."""
    own = pieces(docs)
    words = F.expr("length(piece) - length(replace(piece, ' ', '')) + 1")
    totals = own.groupBy("lang").agg(F.sum(F.col("m") * words).alias("n"))
    counts = frequent_phrases(own, longest, least)
    scored = cut_scores(counts).join(covered(counts), ["lang", "phrase"], "left")
    enough = F.col("most").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * cover
    scored = scored.where(F.coalesce(~enough, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS MATERIALIZED (SELECT lang, w, count(*) AS m FROM (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0 GROUP BY ALL),
tot AS (SELECT lang, sum(len(w) * m)::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, ws, array_to_string(w[i:i + ws - 1], ' ') AS phrase, sum(m)::BIGINT AS f
  FROM (SELECT lang, w, m, ws, unnest(range(1, len(w)::BIGINT - ws + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS ws) WHERE len(w) >= ws) GROUP BY ALL HAVING sum(m) >= 30),
c AS (SELECT lang, ws, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE ws > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, ws)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, min({'score': (2000000::HUGEINT * k.a) // (x.f::HUGEINT + y.f), 'k': k.k, 'l': x.f, 'r': y.f}) AS s
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp GROUP BY ALL),
cov AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, z, unnest(range(1, ws - z + 2)) AS i FROM (SELECT *, unnest(range(2, ws)) AS z FROM c WHERE ws > 2)) GROUP BY ALL),
r AS (SELECT s.lang, s.phrase, a, s.s.l AS l, s.s.r AS r, s.s.score::BIGINT AS score FROM s LEFT JOIN cov ON cov.lang = s.lang AND cov.phrase = s.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM r) JOIN tot USING (lang) WHERE rank <= 2000
"""

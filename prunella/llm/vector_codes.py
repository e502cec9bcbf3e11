"""Vector code compression: product codes of integer vectors, by weighted Lloyd over the distinct parts.

Each component becomes floor(scale * x) and each vector is cut into equal parts.  Equal parts at one position become one
row with a weight, however many vectors have them; the rounds of Lloyd's algorithm run over these rows, and codes and
errors are joined back to the vectors.  All sums are of integers, so results do not depend on the order of rows.

Defined cases: rows whose vector is null, or has null or non-finite components, are dropped, and so are vectors of
another length than the commonest (of equally common ones, the longest).  Rows that repeat a vec_id stay; of those, the
codebooks start from the lesser vectors.  A null vec_id comes after all others.  Fewer vectors than entries make smaller
codebooks; an empty table gives no rows.  A scaled component beyond +-LIMIT ends the job with a message, for sums of
squares would pass 64 bits.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import small_batches, table, written
from prunella.llm.lookup import looked_up

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 26


def integer_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, v): the rows that are kept, with integer components; row is a number of the stored row."""
    rows = df.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    rows = rows.select("vec_id", "label", scaled.alias("v"))
    large = F.exists("v", lambda x: F.abs(x) > LIMIT)
    whole = F.when(large, F.raise_error(F.lit(f"a scaled component is beyond +-{LIMIT}"))).otherwise(F.col("v").cast("array<int>"))
    out = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("v")), "vectors")
    sizes = out.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).where("size > 0")
    best = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return out.where(F.size("v") == (best[0]["size"] if best else 0)) if best else out.where(F.lit(False))


def exploded_parts(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """(row, vec_id, label, part, c): each part of each vector."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, width))
    return vectors.select("row", "vec_id", "label", F.posexplode(cut).alias("part", "c"))


def _nearest(part: np.ndarray, c: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part's codebook (ties to the lower one), and its squared distance."""
    code, dist = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        d = np.zeros((len(own), books.shape[1]), np.int64)
        for j in range(c.shape[1]):
            d += (c[own, j, None] - books[p, None, :, j]) ** 2
        code[own] = d.argmin(axis=1)
        dist[own] = d[np.arange(len(own)), code[own]]
    return code, dist


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    c = batch.column("c").flatten().to_numpy().astype(np.int64).reshape(-1, width)
    return batch.column("part").to_numpy(), c


def _moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: of each entry, the floor of the mean of its weighted parts; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches):
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            part, c = _columns(batch, width)
            n = batch.column("n").to_numpy()
            code, _ = _nearest(part, c, books)
            np.add.at(total, part * entries + code, np.concatenate([c * n[:, None], n[:, None]], axis=1))
        used = np.flatnonzero(total[:, -1])
        flat = pa.array(total[used].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * (width + 1)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), lists], ["slot", "s"])

    own = distinct.mapInArrow(sums, "slot long, s array<long>")
    own = own.groupBy("slot").agg(F.array(*(F.sum(F.col("s")[j].cast("decimal(38,0)")) for j in range(width + 1))).alias("s"))
    out = books.copy()
    for slot, s in own.collect():  # at most parts * entries rows
        out[slot // entries, slot % entries] = [int(x) // int(s[-1]) for x in s[:-1]]
    return out


def _coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, c, n, code, dist) of the distinct parts."""
    width = books.shape[2]

    def code(batches):
        for batch in batches:
            own, dist = _nearest(*_columns(batch, width), books)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("c"), batch.column("n"), pa.array(own), pa.array(dist)], ["part", "c", "n", "code", "dist"]
            )

    return distinct.mapInArrow(code, "part int, c array<int>, n long, code long, dist long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row, vec_id, label, codes, error) of integer vectors, and the codebooks (parts, entries, width)."""
    if not 1 <= entries <= 256:
        raise ValueError("codes of two hex digits number up to 256 entries")
    small_batches(vectors.sparkSession)
    first = [r["v"] for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    dimension = len(first[0]) if first else parts
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {parts} equal parts")
    width = dimension // parts
    books = np.asarray(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    rows = exploded_parts(vectors, parts, width)
    if not first:
        return vectors.select("row", "vec_id", "label", F.array().cast("array<long>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    distinct = written(rows.groupBy("part", "c").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds):
        books = _moved(distinct, books)
    found = looked_up(rows, written(_coded(distinct, books), "coded-parts"), ["part", "c"])
    codes = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda s: s["code"])
    out = found.groupBy("row", "vec_id", "label").agg(codes.alias("codes"), F.sum("dist").alias("error"))
    return written(out, "vector-codes"), books


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over the rows of a label; rows without a label are one group."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return looked_up(codes, written(sums, "label-errors"), ["label"])


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(integer_vectors(table(spark, sf_dir, "embeddings")))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    text = F.array_join(F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return label_errors(codes).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    mean = ", ".join(f"(s{j} - ((s{j} % n) + n) % n) // n" for j in range(1, 5))
    sums = ", ".join(f"sum(c[{j}])::BIGINT AS s{j}" for j in range(1, 5))
    return f"""a{k} AS MATERIALIZED (SELECT r, pt.p, any_value(pt.c) AS c, min({{'d': {_DIST}, 'e': e}}) AS f FROM pt JOIN b{k} USING (p) GROUP BY r, pt.p),
m{k} AS (SELECT p, f.e AS e, count(*) AS n, {sums} FROM a{k} GROUP BY p, f.e),
b{k + 1} AS MATERIALIZED (SELECT p, e, CASE WHEN n IS NULL THEN b ELSE [{mean}] END AS b FROM b{k} LEFT JOIN m{k} USING (p, e))"""


_DIST = " + ".join(f"(c[{j}] - b[{j}]) * (c[{j}] - b[{j}])" for j in range(1, 5))
OP13_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS MATERIALIZED (SELECT r, p, v[4 * p + 1:4 * p + 4] AS c FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, c AS b FROM pt WHERE r <= 64),
{_round_sql(0)},
{_round_sql(1)},
a2 AS MATERIALIZED (SELECT r, pt.p, min({{'d': {_DIST}, 'e': e}}) AS f FROM pt JOIN b2 USING (p) GROUP BY r, pt.p),
v AS (SELECT vec_id, label, string_agg(printf('%02x', f.e), '' ORDER BY p) AS code, sum(f.d)::BIGINT AS error FROM a2 JOIN kept USING (r) GROUP BY r, vec_id, label),
cb AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v, cb
"""

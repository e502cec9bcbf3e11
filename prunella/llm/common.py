"""Shared helpers: table access, scratch tables, and vectorised byte kernels for Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prunella.storage import shuffles_dropped

ROOT = str(Path(__file__).resolve().parents[2])
#: Arrow batches handed to Python hold at most this many rows; long texts make bigger ones costly.
ARROW_ROWS = 1000
#: Kernels work on slices of about this many bytes, so that temporaries stay small.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Prepare a session for Arrow work: workers can import this package, and batches hold few rows.

    The number of rows stays as it is where the user chose one.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    # One heap per worker that gives memory back: otherwise each of a worker's threads keeps its own.
    env.setdefault("MALLOC_ARENA_MAX", "1")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir; a temporary one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="prunella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared scratch folder as Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/prunella/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again, and let Spark drop what else finished queries have left.

    Spark does so once the driver has collected the garbage that refers to it, which may take long by itself; the shuffle
    files of what was `written` are gone already.
    """
    jvm = spark.sparkContext._jvm
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


# ---------------------------------------------------------------- byte kernels

_RNG = np.random.default_rng(20240607)
BYTE_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Separators of the contracts' words `[^\x20\x09-\x0D]+`; all are ASCII, so UTF-8 bytes can be tested one by one.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, 2 * len(_POW[0]), SLICE_BYTES)
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[k] = np.multiply.accumulate(steps)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Yield (first row, last row, bytes, offsets) over slices of a string column of about size bytes; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, data[off[a] : off[b]], (off[a : b + 1] - off[a]).astype(np.int64)
        a = b


def word_bounds(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
    """Starts and ends of the words in buf, and the number of the first word of each row (and the total)."""
    inside = ~space[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(buf), bool)
    if len(buf):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans hash alike wherever they stand."""
    power, inverse = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * power[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the number of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(h: np.ndarray, first: np.ndarray, width: int):
    """Hashes of all windows of `width` items inside their rows, and the number of each window's first item."""
    rows = row_of(first)
    last = len(h) - width + 1
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = rows[:last] == rows[width - 1 :]
    out = np.zeros(last, np.uint64)
    for j in range(width):
        out = (out + h[j : j + last]) * np.uint64(0x9FB21C651E98DF25 + 2 * j)
        out ^= out >> np.uint64(29)
    at = np.flatnonzero(ok)
    return mix(out[at]), at


_CODE32 = (BYTE_CODE >> np.uint64(17)).astype(np.uint32)


def byte_grams(buf: np.ndarray, off: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket (of 2**bits) of the n bytes at each position; 2**bits where they leave the row."""
    size = len(buf)
    out = np.full(size, 1 << bits, np.int64)
    if size < n:
        return out
    code = _CODE32[buf]
    g = np.full(size - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        g = (g ^ code[j : size - n + 1 + j]) * np.uint32(0x85EBCA6B + 2 * n)
        g ^= g >> np.uint32(15)
    out[: size - n + 1] = (g * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
    for k in range(1, n):
        ends = off[1:] - k
        out[ends[(ends >= 0) & (ends >= off[:-1])]] = 1 << bits
    return out


def row_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x over rows that begin at first[:-1]."""
    total = np.zeros(len(x) + 1, np.float64 if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=total[1:])
    return total[first[1:]] - total[first[:-1]]

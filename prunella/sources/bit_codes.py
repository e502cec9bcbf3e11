"""Files of gamma- or delta-coded numbers, one bit stream from end to end, decoded by byte ranges.

Where a code begins is known only from the code before it.  So each range first finds, for every bit at which it may be
entered, where it is left again and how many codes lie between (all bits at once, by doubling jumps); these short tables,
one for each range, are followed from the beginning of the file, and then every range decodes from where it is entered.

A number x is coded by x + 1: gamma writes as many zeros as it has binary digits behind the first, and then the digits;
delta writes the number of these digits in gamma, and then the digits behind the first.  Bits go from the highest to the
lowest of a byte, and zeros fill the last byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.storage import bounded_batches

RANGE_BYTES = 1 << 16
#: Bytes behind a range that its last code may need.
TAIL_BYTES = 32
#: A code that begins in a range ends at most so many bits behind it.
ENTRIES = 128
CODES = ("gamma", "delta")
#: Numbers are below 2 ** 62.
MOST_DIGITS = 62


def encoded(values: np.ndarray, code: str = "gamma") -> bytes:
    """The bit stream of whole numbers from 0."""
    x = np.asarray(values, np.int64) + 1
    if len(x) and (x.min() < 1 or x.max() >= 1 << MOST_DIGITS):
        raise ValueError("numbers are from 0 to below 2 ** 62")
    digits = np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1
    digits -= (np.int64(1) << digits) > x  # a double may have been rounded up
    if code == "gamma":
        head, first = digits, digits
    elif code == "delta":
        count = np.frexp((digits + 1).astype(np.float64))[1].astype(np.int64) - 1
        head, first = count, 2 * count
    else:
        raise ValueError(f"a code is one of {CODES}")
    size = first + 1 + digits
    ends = np.cumsum(size)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
        for j in range(int(width.max(initial=0))):
            own = j < width
            bits[at[own] + j] = (value[own] >> (width[own] - 1 - j)) & 1

    start = ends - size
    if code == "delta":
        put(start + head, digits + 1, head + 1)
        put(start + first + 1, x, digits)
    else:
        put(start + head, x, digits + 1)
    return np.packbits(bits).tobytes()


def _field(bits: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers of `width` bits from each place on."""
    out = np.zeros(len(at), np.int64)
    for j in range(int(width.max(initial=0))):
        own = np.flatnonzero(j < width)
        out[own] = out[own] << 1 | bits[at[own] + j]
    return out


def _jumps(bits: np.ndarray, n: int, code: str) -> np.ndarray:
    """Where the code that begins at each of the first n bits ends; -1 where none does before the bits end."""
    ones = np.append(np.flatnonzero(bits), len(bits))
    at = np.arange(n)
    zeros = ones[np.searchsorted(ones, at)] - at
    ok = (zeros <= (MOST_DIGITS if code == "gamma" else 5)) & (at + 2 * zeros + 1 <= len(bits))
    size = 2 * zeros + 1
    if code == "delta":
        own = np.flatnonzero(ok)
        digits = _field(bits, own + zeros[own], zeros[own] + 1) - 1
        size[own] += digits
        ok[own] &= digits <= MOST_DIGITS
    return np.where(ok & (at + size <= len(bits)), at + size, -1)


def _table(bits: np.ndarray, n: int, code: str) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first bits: where a chain of codes from there leaves the range (-1 if the stream ends), and its codes."""
    to = _jumps(bits, n, code)
    count = (to >= 0).astype(np.int64)
    inside = np.flatnonzero((to >= 0) & (to < n))
    while len(inside):
        step = to[inside]
        count[inside] += count[step]
        to[inside] = to[step]
        inside = inside[(to[inside] >= 0) & (to[inside] < n)]
    entries = min(ENTRIES, n)
    return np.where(to[:entries] >= 0, to[:entries] - n, -1), count[:entries]


def _decoded(bits: np.ndarray, n: int, entry: int, code: str) -> np.ndarray:
    """The numbers whose codes begin in the first n bits, from entry on."""
    to = _jumps(bits, n, code)
    at = np.asarray([entry])
    at = at[to[at] >= 0]
    jump = to.copy()
    while True:
        more = jump[at]
        more = more[(more >= 0) & (more < n)]
        more = more[to[more] >= 0]
        at = np.concatenate([at, more])
        if len(more) * 2 < len(at):
            break
        known = (jump >= 0) & (jump < n)
        jump = np.where(known, jump[np.where(known, jump, 0)], -1)
    at.sort()
    ones = np.append(np.flatnonzero(bits), len(bits))
    zeros = ones[np.searchsorted(ones, at)] - at
    head = _field(bits, at + zeros, zeros + 1)
    if code == "gamma":
        return head - 1
    digits = head - 1
    return ((np.int64(1) << digits) | _field(bits, at + 2 * zeros + 1, digits)) - 1


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, k, n, bytes): ranges of n bytes, and what is behind them for their last code."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    rows = files.select("path", "length", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("k"))
    own = F.expr(f"substring(content, cast(k * {size} + 1 as int), {size + TAIL_BYTES})")
    n = F.least(F.lit(size).cast("long"), F.col("length") - F.col("k") * size)
    return rows.select("path", "k", n.alias("n"), own.alias("bytes")).repartition("path", "k")


def coded_longs(spark: SparkSession, path: str, code: str = "gamma", size: int = RANGE_BYTES) -> DataFrame:
    """(path, ord, value): the numbers of each file in their order, from 0.  A file is below 2 GB, as Spark's binary rows are."""
    if code not in CODES:
        raise ValueError(f"a code is one of {CODES}")
    bounded_batches(spark)
    rows = _ranges(spark, path, size)

    def tables(batches):
        for batch in batches:
            leave, count = [], []
            for n, data in zip(batch.column("n").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                a, b = _table(np.unpackbits(np.frombuffer(data, np.uint8)), n * 8, code)
                leave.append(a)
                count.append(b)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("k"), pa.array(leave, kind), pa.array(count, kind)], ["path", "k", "leave", "count"])

    found = rows.mapInArrow(tables, "path string, k long, leave array<long>, count array<long>").orderBy("path", "k").collect()  # 2 kB a range
    entries, file, at, base = [], None, 0, 0
    for r in found:
        if r["path"] != file:
            file, at, base = r["path"], 0, 0
        if at < 0 or at >= len(r["leave"]):  # the stream has ended, perhaps at the end of this range
            continue
        entries.append((file, r["k"], at, base))
        base += r["count"][at]
        at = r["leave"][at]
    starts = spark.createDataFrame(entries, "path string, k long, entry int, base long")

    def decode(batches):
        for batch in batches:
            for file, n, data, entry, base in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "bytes", "entry", "base")), strict=True):
                value = _decoded(np.unpackbits(np.frombuffer(data, np.uint8)), n * 8, entry, code)
                for a in range(0, len(value), 1 << 16):
                    own = value[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(own)), pa.array(base + a + np.arange(len(own))), pa.array(own)], ["path", "ord", "value"])

    return rows.join(starts, ["path", "k"]).select("path", "n", "bytes", "entry", "base").mapInArrow(decode, "path string, ord long, value long")


def global_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, df): the list lengths of a collection, gamma-coded in the order of its terms."""
    return coded_longs(spark, path).select(F.col("ord").alias("term_id"), F.col("value").alias("df"))


def coded_records(spark: SparkSession, path: str, names: list[str], code: str = "gamma") -> DataFrame:
    """(record, names ...): records of so many numbers each, one after another."""
    rows = coded_longs(spark, path, code)
    place = F.col("ord") % len(names)
    columns = [F.max(F.when(place == k, F.col("value"))).alias(name) for k, name in enumerate(names)]
    return rows.groupBy("path", F.floor(F.col("ord") / len(names)).alias("record")).agg(*columns).drop("path")

"""Token-ID output: documents encoded to ids and kept as Parquet list columns.

The files hold one row per document in ascending doc_id order: doc_id and n_tokens (delta-encoded), ids (a list
column, dictionary-encoded while its page dictionary holds, else delta).  Row groups and pages are bounded and carry
page indexes, so that a reader can fetch the counts alone, or the ids of a range of documents, without the rest.

Defined cases: a null text counts as empty and yields the end id alone; rows that repeat a doc_id stay, ordered by
their text; rows with a null doc_id come first; an empty table writes no rows.  Other columns are not written.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prunella.llm.common import scratch_dir, slices, small_batches, span_hashes, table
from prunella.storage import shuffles_dropped

END_ID = 2
#: Distinct chunks whose ids a worker remembers before it starts anew; a power of two.
CACHE_CHUNKS = 1 << 21
#: Bytes of text that are cut and encoded at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of new chunks that the library gets in one string.
JOINED_BYTES = 20_000
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
WRITE = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}

@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# What the byte-level pre-tokenizer takes for white space (Unicode White_Space), in UTF-8.
ASCII_SPACE = b"\t\n\x0b\x0c\r "
OTHER_SPACE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: The pre-tokenizer that chunk_starts knows; texts of others go through the library whole.
KNOWN_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_ASCII_SPACE = np.isin(np.arange(256), list(ASCII_SPACE))
_SPACE_LEADS = np.unique([c[0] for c in OTHER_SPACE])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: ASCII marks but the apostrophe, which may begin a piece with letters.
_MARK = np.isin(np.arange(256), [x for x in range(33, 127) if not chr(x).isalnum() and x != 39])


def chunk_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where to cut the rows of buf into chunks; the byte-level pre-tokenizer cuts at all these places too.

    It keeps a space with the word after it, and other white space to itself; of a run of white space before a word, the
    last character stands alone or goes with the word.  After an ASCII letter, a mark begins a piece.  (Its other cuts
    are inside chunks, and depend on nothing outside.)
    """
    white = _ASCII_SPACE[buf]
    if np.isin(buf, _SPACE_LEADS).any():
        data = buf.tobytes()
        for char in OTHER_SPACE:
            at = data.find(char)
            while at >= 0:
                white[at : at + len(char)] = True
                at = data.find(char, at + len(char))
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    after = np.zeros(len(buf), bool)  # white space before, in the same row
    after[1:] = white[:-1]
    after &= ~cut[:-1]
    cut[:-1] |= white & ~after
    word = np.flatnonzero(~white & after)
    last = word - 1
    for _ in range(2):  # to the first byte of the character
        last -= (buf[last] & 0xC0) == 0x80
    cut[last] = True
    cut[word[buf[last] != 32]] = True
    cut[1:-1] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
    cut[-1] = False
    return np.flatnonzero(cut)


class ChunkIds:
    """The ids of chunks seen before, by two hashes of 64 bits: an open-addressing table of numpy arrays."""

    def __init__(self):
        size = 4 * CACHE_CHUNKS
        self.mask = np.uint64(size - 1)
        self.slot = np.full(size, -1, np.int32)
        self.n = 0
        self.key = np.zeros(CACHE_CHUNKS, np.uint64)
        self.check = np.zeros(CACHE_CHUNKS, np.uint64)
        self.begin = np.zeros(CACHE_CHUNKS + 1, np.int64)
        self.flat = np.zeros(4 * CACHE_CHUNKS, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each chunk, -1 for those unknown."""
        out = np.full(len(key), -1, np.int64)
        open_, at = np.arange(len(key)), key & self.mask
        while len(open_):
            there = self.slot[at]
            same = (there >= 0) & (self.key[there] == key[open_]) & (self.check[there] == check[open_])
            out[open_[same]] = there[same]
            go = (there >= 0) & ~same
            open_, at = open_[go], (at[go] + np.uint64(1)) & self.mask
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers for new, distinct chunks; there must be room for them."""
        number = self.n + np.arange(len(key))
        self.key[number], self.check[number] = key, check
        base, end = self.begin[self.n], self.begin[self.n] + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end), np.uint32)])
        self.flat[base:end] = ids
        self.begin[number + 1] = base + np.cumsum(length)
        self.n += len(key)
        open_, at = number, key & self.mask
        while len(open_):
            free = self.slot[at] < 0
            self.slot[at[free]] = open_[free]
            lost = self.slot[at] != open_
            open_, at = open_[lost], (at[lost] + np.uint64(1)) & self.mask
        return number


class Encoder:
    """Encodes texts with the tokenizers library, chunk by chunk: the library sees a chunk once in a worker.

    Rows that hold one of the vocabulary's added strings, and all rows if the tokenizer's normaliser or pre-tokenizer is
    not the one that chunk_starts knows, go through the library whole.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        made = json.loads(self.tok.to_str())
        pre = made["pre_tokenizer"] or {}
        plain = all(made.get(k) is None for k in ("normalizer", "truncation", "padding"))
        self.joins = not any(b" " in x for x in self.added)
        self.by_chunk = plain and all(pre.get(k) == v for k, v in KNOWN_PRE_TOKENIZER.items())
        # A character of a byte-level vocabulary stands for a byte: the bytes of each id.
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(x) for x in vocab]
        self.known = ChunkIds()

    def rows(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the number of ids in each."""
        data = buf.tobytes() if self.added or not self.by_chunk else b""
        if self.by_chunk and not any(x in data for x in self.added):
            return self._chunked(buf, off)
        found = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if self.by_chunk and not any(x in data[a:b] for x in self.added):
                found.append(self._chunked(buf[a:b], np.asarray([0, b - a]))[0])
            else:
                found.append(np.asarray(self.tok.encode(data[a:b].decode(), add_special_tokens=False).ids, np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.asarray([len(x) for x in found], np.int64)

    def _chunked(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        starts = chunk_starts(buf, off)
        edges = np.append(starts, len(buf))
        # A long text may have more chunks than the table holds: so many are looked up at a time.
        found = [self._run(buf, edges[a : min(a + CACHE_CHUNKS, len(starts)) + 1]) for a in range(0, len(starts), CACHE_CHUNKS)]
        count = np.append(0, np.cumsum(np.concatenate([size for _, size in found])))
        return np.concatenate([ids for ids, _ in found]), np.diff(count[np.searchsorted(starts, off)])

    def _run(self, buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of neighbouring chunks between edges, and the number of ids of each chunk."""
        starts, ends, n = edges[:-1], edges[1:], len(edges) - 1
        coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(buf)]).dictionary_encode()
        code = coded.indices.to_numpy()
        first = np.full(len(coded.dictionary), n, np.int64)
        first[code[::-1]] = np.arange(n)[::-1]
        number = self._numbers(buf, starts[first], ends[first].astype(np.int64))
        size = np.diff(self.known.begin)[number]
        at = np.cumsum(size) - size
        ids = self.known.flat[np.repeat(self.known.begin[number] - at, size) + np.arange(size.sum())]
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids))
        # A chunk of a row follows the other, so the taken lists lie one after another.
        return lists.take(coded.indices).flatten().to_numpy(), size[code]

    def _numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's numbers of distinct chunks; new ones are encoded first."""
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=total[1:])
        own = buf[np.repeat(starts - total[:-1], ends - starts) + np.arange(total[-1])]
        key = span_hashes(own, total[:-1], total[1:])
        check = span_hashes(own ^ np.uint8(0x5A), total[:-1], total[1:])
        number = self.known.find(key, check)
        new = np.flatnonzero(number < 0)
        if not len(new):
            return number
        if self.known.n + len(new) > CACHE_CHUNKS:
            self.known, new = ChunkIds(), np.arange(len(key))  # at most CACHE_CHUNKS come at a time
        ids, length = self._encoded([own[a:b].tobytes() for a, b in zip(total[new].tolist(), total[new + 1].tolist(), strict=True)])
        number[new] = self.known.add(key[new], check[new], ids, length)
        return number

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, one after another, and the number of ids of each.

        Chunks of a space and a word are put together to long strings, which the library cuts between them again; the
        lengths of the ids in bytes tell which belong to which.
        """
        size, leads = np.asarray([len(c) for c in chunks], np.int64), set(_SPACE_LEADS.tolist())
        plain = np.asarray([self.joins and len(c) > 1 and c[0] == 32 and c[1] > 32 and c[1] not in leads for c in chunks], bool)
        length = np.zeros(len(chunks), np.int64)
        own = np.flatnonzero(plain)
        ends = np.cumsum(size[own])
        edges = [*np.searchsorted(ends, np.arange(0, size[own].sum(), JOINED_BYTES)).tolist(), len(own)]
        joined = self._ids([b"".join([chunks[i] for i in own[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        out = np.concatenate([np.zeros(0, np.uint32), *joined])
        length[own] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[out]), ends, "right"), prepend=0)
        own = np.flatnonzero(~plain)
        single = self._ids([chunks[i] for i in own])
        length[own] = [len(x) for x in single]
        # Back to the order of chunks.
        ids = np.zeros(length.sum(), np.uint32)
        mine = np.repeat(plain, length)
        ids[mine], ids[~mine] = out, np.concatenate([np.zeros(0, np.uint32), *single])
        return ids, length

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (the end id included), sorted by doc_id across partitions."""
    small_batches(docs.sparkSession)

    def encode(batches):
        coder = encoder(tokenizer_path)
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text"), BLOCK_BYTES):
                flat, n = coder.rows(buf, off)
                flat = np.insert(flat.view(np.int32), np.cumsum(n), np.int32(end_id))
                edges = np.zeros(len(n) + 1, np.int32)
                edges[1:] = np.cumsum(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n + 1), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))],
                    ["doc_id", "n_tokens", "ids"],
                )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    with shuffles_dropped(docs.sparkSession):
        encode_documents(docs, tokenizer_path, end_id).write.options(**WRITE).parquet(path)


def _in_order(name: str = "file") -> list:
    """Files in the order of their partitions: Spark pads numbers to five digits, so names alone do not tell it."""
    return [F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), F.col(name)]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; start comes from the count columns alone."""
    files = spark.read.parquet(path)
    name, row = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    counts = files.select(name, "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    # One row per file, so that this window stays small.
    before = counts.select("file", (F.sum("file_tokens").over(Window.orderBy(*_in_order())) - F.col("file_tokens")).alias("before"))
    run = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.select(name, row, "n_tokens")
        .withColumn("inner", F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
        .join(before, "file")
        .select("file", "row", (F.col("before") + F.col("inner")).alias("start"))
    )
    return files.select(name, row, "doc_id", "n_tokens", "ids").join(starts, ["file", "row"]).drop("file", "row")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, computed from the files."""
    files = spark.read.parquet(path)
    name, row = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")

    def digest(batches):
        for b in batches:
            ids = b.column("ids")
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("row"), b.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())],
                ["file", "row", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = files.select(name, row, "doc_id", "ids").mapInArrow(digest, "file string, row long, doc_id long, n_tokens long, ids_crc32 long")
    counts = files.select(name, "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = counts.select("file", (F.sum("file_tokens").over(Window.orderBy(*_in_order())) - F.col("file_tokens")).alias("before"))
    run = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("n_tokens").over(run), F.lit(0))
    return (
        rows.withColumn("inner", inner)
        .join(before, "file")
        .select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
    )


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files to the shared scratch folder and return the digests read back from them."""
    spark = docs.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/prunella/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path)
    return token_digests(spark, path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

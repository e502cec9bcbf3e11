"""WARC files: responses as documents, read by byte ranges.

Spark's text reader cuts a file into ranges, finds the first mark "WARC/" of a range, and hands out the bytes between two
marks, through whatever store Spark reads; so the records of a file are read by many tasks (gzipped files by one task
each, as a stream).  A piece between two marks is a record if its Content-Length says that it ends there.  A mark may
also stand inside a payload: where any piece does not end as it says, the places of pieces in their files tell which
marks are heads, and the pieces of a payload are put together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prunella.functions.text import html_text
from prunella.storage import bounded_batches, written

SCHEMA = "title string, uri string, mime string, encoding string, html string"
MARK = "WARC/"
#: A piece: where it is read, its bytes, what its head says that it takes (null without a head), and if it ends there.
PLACE = "path string, block long, at long, n long, need long, whole boolean"


class WarcError(ValueError):
    """Bytes that are no WARC record."""


def _headers(lines: Iterator[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        line = line.rstrip(b"\r\n")
        if not line:
            break
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def head(piece: bytes, strict: bool = True) -> tuple[dict[str, str], int, int] | None:
    """Headers of a record that begins behind its mark, the length of its head and that of head and payload; None if it has
    no head.  strict wants version 1.0, else any version is taken."""
    m = re.match(rb"(\d[\d.]*)\s*?\r?\n(?:[^\r\n]+\r?\n)*\r?\n", piece)
    if not m or strict and m[1] != b"1.0":
        return None
    headers = _headers(iter(m[0].split(b"\n")[1:]))
    if not headers.get("content-length", "").isdigit():
        return None
    return headers, m.end(), m.end() + int(headers["content-length"])


def document(headers: dict[str, str], payload: bytes) -> tuple[str, str, str, str, str]:
    """(title, uri, mime, encoding, html) of a response; the charset is the header's, a crawler's guess, or the page's."""
    top, _, body = payload.partition(b"\r\n\r\n")
    http = _headers(iter(top.split(b"\n")[1:]))
    kind = http.get("content-type", "")
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    meta = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", body[:4096], re.I)
    names = [charset and charset[1], headers.get("bubing-guessed-charset"), meta and meta[1].decode("latin-1"), "iso-8859-1"]
    for encoding in filter(None, names):
        try:
            html = body.decode(encoding, "replace")
            break
        except LookupError:
            continue
    return headers.get("warc-trec-id", ""), headers.get("warc-target-uri", "").strip("<>"), kind.partition(";")[0].strip(), encoding.lower(), html


def response(piece: bytes, strict: bool) -> tuple | None:
    """The document of a whole record, None for records that are no responses."""
    found = head(piece, strict)
    if not found or found[0].get("warc-type", "").lower() != "response":
        return None
    return document(found[0], piece[found[1] : found[2]])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value): the bytes between marks, and their order in a file."""
    rows = spark.read.text(path, lineSep=MARK)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return rows.select(*place, F.col("value").cast("binary").alias("value"))


def _scanned(rows: DataFrame, strict: bool) -> DataFrame:
    """The place of each piece and, of whole records that are responses, the document."""

    def scan(batches):
        for batch in batches:
            n, need, whole, docs = [], [], [], []
            for value in batch.column("value"):
                piece = value.as_buffer().to_pybytes() if hasattr(value, "as_buffer") else value.as_py()
                found = head(piece, strict)
                n.append(len(piece))
                need.append(found[2] if found else None)
                whole.append(bool(found) and found[2] <= len(piece) and not piece[found[2] :].strip())
                docs.append(document(found[0], piece[found[1] : found[2]]) if whole[-1] and found[0].get("warc-type", "").lower() == "response" else None)
            columns = [pa.array([d and d[k] for d in docs], pa.string()) for k in range(5)]
            is_doc = pa.array([d is not None for d in docs], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("path", "block", "at")), pa.array(n, pa.int64()), pa.array(need, pa.int64()), pa.array(whole, pa.bool_()), is_doc, *columns],
                ["path", "block", "at", "n", "need", "whole", "is_doc", "title", "uri", "mime", "encoding", "html"],
            )

    return rows.mapInArrow(scan, f"{PLACE}, is_doc boolean, {SCHEMA}")


def _heads(run: list[dict]) -> list[tuple[int, int, int]]:
    """(block, at, head): of a run of neighbouring pieces, the number of the record that each belongs to."""
    out, k = [], 0
    while k < len(run):
        first = run[k]
        if first["need"] is None:
            raise WarcError(f"no record head behind the mark at {first['start']} of {first['path']}")
        end, number = first["start"] + first["need"], k
        while k < len(run) and (k == number or run[k]["start"] - len(MARK) < end):
            out.append((run[k]["block"], run[k]["at"], number))
            k += 1
        if run[k - 1]["start"] + run[k - 1]["n"] < end:
            raise WarcError(f"the record at {first['start']} of {first['path']} ends early")
    return out


def _mended(rows: DataFrame, places: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Places of the pieces around marks that are no heads, and the documents of the records they make.

    Only places (a few numbers a piece) are brought into order by file; then the bytes of the odd records are read again.
    """
    order = Window.partitionBy("path").orderBy("block", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rank = places.withColumn("start", F.coalesce(F.sum(F.col("n") + len(MARK)).over(before), F.lit(0)))
    # Bytes before a file's first mark are no piece.
    rank = rank.where("start > 0 or n > 0").withColumn("end", F.col("start") + F.coalesce("need", "n"))
    # A mark that begins before a record's end belongs to it.
    new = F.coalesce(F.col("start") - len(MARK) >= F.max("end").over(before), F.lit(True))
    runs = rank.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("long")).over(order))
    one = F.struct("start", "n", "need", "whole", "path", "block", "at")
    grouped = runs.groupBy("path", "run").agg(F.array_sort(F.collect_list(one)).alias("pieces"), F.bool_and("whole").alias("whole"))
    grouped = grouped.where("size(pieces) > 1 or not whole")

    def follow(batches):
        for batch in batches:
            for path, run, own in zip(*(batch.column(c).to_pylist() for c in ("path", "run", "pieces")), strict=True):
                found = _heads(own)
                block, at, number = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"path": [path] * len(found), "block": list(block), "at": list(at), "run": [run] * len(found), "head": list(number)},
                    pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("run", pa.int64()), ("head", pa.int64())]),
                )

    odd = written(grouped.select("path", "run", "pieces").mapInArrow(follow, "path string, block long, at long, run long, head long"), "odd-pieces")
    joined = rows.join(odd, ["path", "block", "at"]).groupBy("path", "run", "head").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))

    def whole(batches):
        for batch in batches:
            found = []
            for parts in batch.column("p").to_pylist():
                piece = MARK.encode().join(x["value"] for x in parts)
                if piece[head(piece, strict)[2] :].strip():
                    raise WarcError(f"no record head behind a record: {piece[-40:]!r}")
                found.append(response(piece, strict))
            found = [d for d in found if d]
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in found], pa.string()) for k in range(5)], ["title", "uri", "mime", "encoding", "html"])

    return odd, joined.select("p").mapInArrow(whole, SCHEMA)


def warc_documents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(title, uri, mime, encoding, html, text) of the responses in WARC files, plain or gzipped; bytes that are no records
    are an error.  strict wants records of version 1.0."""
    bounded_batches(spark)
    rows = pieces(spark, path)
    found = written(_scanned(rows, strict), "warc")
    # A first piece without bytes is what stands before the first mark.
    if found.where("not whole and n > 0").limit(1).count():
        odd, mended = _mended(rows, found.select("path", "block", "at", "n", "need", "whole"), strict)
        found = found.join(odd, ["path", "block", "at"], "left_anti").where("is_doc").select("title", "uri", "mime", "encoding", "html").unionByName(mended)
    else:
        found = found.where("is_doc").select("title", "uri", "mime", "encoding", "html")
    return found.withColumn("text", html_text("html"))

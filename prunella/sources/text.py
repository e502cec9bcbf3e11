"""Text sources: delimited documents, TREC collections, HTML pages, query logs, lists and maps, language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.functions.text import html_text, html_title, one_line
from prunella.storage import ordered


def numbered_lines(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """(line, value): the records of text files with their numbers from 0, in the order of files and records."""
    rows = spark.read.text(path, lineSep=delimiter)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return ordered(rows, [F.col("path"), F.col("block"), F.col("at")]).select(F.col("ord").alias("line"), "value")


def delimited_documents(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """(doc_id, text): one document per record."""
    return numbered_lines(spark, path, delimiter).select(F.col("line").alias("doc_id"), F.col("value").alias("text"))


def trec_documents(spark: SparkSession, path: str, encoding: str = "iso-8859-1") -> DataFrame:
    """(doc_id, title, text): the <DOC> records of TREC files (plain or gzipped), titled by DOCNO; HTML becomes text.

    The reader cuts plain files by byte ranges at the end of a record, so that many tasks read one file; gzipped files
    are read as streams.  A record without an end is taken if it is a file's last.
    """
    rows = spark.read.text(path, lineSep="</DOC>")
    plain = encoding.lower().replace("_", "-") in ("utf-8", "utf8")
    value = F.col("value") if plain else F.decode(F.col("value").cast("binary"), encoding)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    docs = rows.select(*place, F.regexp_extract(value, r"(?s)<DOC>(.*)\z", 1).alias("doc")).where("doc != ''")
    number = F.trim(F.regexp_extract("doc", r"(?s)<DOCNO>(.*?)</DOCNO>", 1)).alias("title")
    docs = docs.select("path", "block", "at", number, F.regexp_replace("doc", r"(?s)<DOC(?:NO|HDR)>.*?</DOC(?:NO|HDR)>", "").alias("html"))
    rows = ordered(docs, [F.col("path"), F.col("block"), F.col("at")])
    return rows.select(F.col("ord").alias("doc_id"), one_line("title").alias("title"), html_text("html").alias("text"))


def html_documents(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html") -> DataFrame:
    """(doc_id, uri, title, text) of a table of HTML pages."""
    return pages.select(F.col(key).alias("doc_id"), F.col(uri).alias("uri"), html_title(html).alias("title"), html_text(html).alias("text"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text): one query per line; empty lines and `$` commands are skipped, line numbers are the ids."""
    rows = numbered_lines(spark, path)
    return rows.where("trim(value) != '' and not startswith(value, '$')").select(F.col("line").alias("qid"), F.trim("value").alias("text"))


def topic_queries(spark: SparkSession, path: str) -> DataFrame:
    """(topic, text) of lines `topic,query`; lines with other than two parts are an error."""
    rows = spark.read.text(path).where("trim(value) != ''").withColumn("p", F.split("value", ","))
    wrong = F.raise_error(F.concat(F.lit("no topic line: "), F.col("value")))
    return rows.select(F.when(F.size("p") != 2, wrong).otherwise(F.col("p")[0].cast("int")).alias("topic"), F.trim(F.col("p")[1]).alias("text"))


def parallel_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line, v0, v1, ...): several files side by side, up to the shortest."""
    out = numbered_lines(spark, paths[0]).withColumnRenamed("value", "v0")
    for k, path in enumerate(paths[1:], 1):
        out = out.join(numbered_lines(spark, path).withColumnRenamed("value", f"v{k}"), "line")
    return out


def prune_list(spark: SparkSession, path: str, postings: bool = True) -> DataFrame:
    """An ordered list of (term_id, doc_id), or of doc_id, best first; lines with fewer than two columns are skipped."""
    rows = numbered_lines(spark, path).withColumn("p", F.split("value", ",")).where(F.size("p") >= 2)
    rows = ordered(rows.select("line", "p"), [F.col("line")])
    keys = [F.col("p")[0].cast("bigint").alias("term_id"), F.col("p")[1].cast("bigint").alias("doc_id")] if postings else [F.col("p")[0].cast("bigint").alias("doc_id")]
    return rows.select("ord", *keys)


def longs(spark: SparkSession, path: str, name: str = "doc_id", first: int | None = None) -> DataFrame:
    """(line, name): one number per line; the first so many where asked."""
    rows = numbered_lines(spark, path).where("trim(value) != ''").select("line", F.col("value").cast("bigint").alias(name))
    return rows.where(F.col("line") < first) if first is not None else rows


def document_map(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, new_id): line i has the new id of document i."""
    return longs(spark, path, "new_id").withColumnRenamed("line", "doc_id")


def cluster_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(shard_id, line, doc_id): one file of document ids per cluster."""
    out = None
    for k, path in enumerate(paths):
        one = longs(spark, path).select(F.lit(k).alias("shard_id"), "line", "doc_id")
        out = one if out is None else out.union(one)
    return out


def arpa_unigrams(spark: SparkSession, path: str, unknown: str = "<UNK>") -> tuple[DataFrame, float]:
    """(term, prob) of the 1-grams of an ARPA file, and the probability of unknown terms."""
    rows = numbered_lines(spark, path)
    marks = {r["value"].strip(): r["line"] for r in rows.where("startswith(trim(value), '\\\\')").collect()}  # section heads
    start = marks["\\1-grams:"]
    end = min((n for n in marks.values() if n > start), default=None)
    own = rows.where((F.col("line") > start) & (F.col("line") < end if end is not None else F.lit(True)))
    own = own.withColumn("p", F.split(F.trim("value"), r"\s+")).where(F.size("p") >= 2)
    model = own.select(F.col("p")[1].alias("term"), F.pow(F.lit(10.0), F.col("p")[0].cast("double")).alias("prob"))
    found = model.where(F.lower("term") == unknown.lower()).select("prob").first()
    return model.where(F.lower("term") != unknown.lower()), found["prob"] if found else 0.0


def feature_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A feature file: with a header and inferred types, or without one and a schema; malformed lines are an error."""
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST", sep=sep)
    return spark.read.csv(path, schema=schema, mode="FAILFAST", sep=sep)


def titled(frame: DataFrame, titles: DataFrame) -> DataFrame:
    """frame with the titles of its documents; as many titles as documents are needed."""
    n, m = frame.select("doc_id").distinct().count(), titles.count()
    if n > m:
        raise ValueError(f"{m} titles for {n} documents")
    return frame.join(titles.select("doc_id", "title"), "doc_id")

"""Renumbering: new document orders, and indexes under them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunella.operators.index import Index, index_of, remapped
from prunella.storage import ordered


def order_map(docs: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, new_id): documents numbered in the order of columns; `-name` sorts down, ties go by doc_id."""
    names = [c.lstrip("-") for c in order]
    keys = [F.desc(c.lstrip("-")) if c.startswith("-") else F.asc(c) for c in order]
    rows = docs.select(*dict.fromkeys([*names, "doc_id"]))
    return ordered(rows, keys if "doc_id" in names else [*keys, F.asc("doc_id")]).select("doc_id", F.col("ord").alias("new_id"))


def title_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, new_id) of documents that two lists (doc_id, title) share by title."""
    return old.select("doc_id", "title").join(new.select(F.col("doc_id").alias("new_id"), "title"), "title").select("doc_id", "new_id")


def inverse(doc_map: DataFrame) -> DataFrame:
    return doc_map.select(F.col("new_id").alias("doc_id"), F.col("doc_id").alias("new_id"))


def renumbered(index: Index, doc_map: DataFrame) -> Index:
    """The index with documents renumbered; terms keep their numbers."""
    return index_of(remapped(index.postings, doc_map), remapped(index.doc_stats, doc_map))

"""Posting and document features, labels, and the tables that models learn from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunella.functions.scoring import bm25
from prunella.functions.text import ratio
from prunella.operators.hits import FEATURE_LIMITS
from prunella.operators.index import Index
from prunella.operators.search import sized

_BINS = [f"b{b}" for b in FEATURE_LIMITS]
_HITS = lambda p: [f"{p}_{b}" for b in _BINS] + [f"{p}_top10", f"{p}_top1k"]
DOC = ["d_size", "d_terms", "d_xdoc", "d_size_per_term", "d_xdoc_per_size", "d_xdoc_per_term"]
TERM = ["p_tfreq", "p_tdfreq", "p_bm25"]
DH = [*_HITS("dh"), "dh_top10_per_size", "dh_top1k_per_size", "dh_top10_per_term", "dh_top1k_per_term"]
PH = [*_HITS("ph"), "ph_top10_per_tfreq", "ph_top1k_per_tfreq", "ph_top10_per_tdfreq", "ph_top1k_per_tdfreq"]
GROUPS = {
    "doc": DOC, "term": TERM, "dh": DH, "ph": PH, "intrinsic": DOC + TERM, "docbased": DOC + DH, "termbased": TERM + PH,
    "all": DOC + TERM + DH + PH,
}


#: Ratios of document features: dividend, divisor, name.
DOC_RATIOS = [("d_size", "d_terms", "d_size_per_term"), ("d_xdoc", "d_size", "d_xdoc_per_size"), ("d_xdoc", "d_terms", "d_xdoc_per_term")]


def posting_features(index: Index, k1: float = 1.2, b: float = 0.5) -> DataFrame:
    """(term_id, doc_id, p_tfreq, p_tdfreq, p_bm25) of every posting: list length, count, single-term score."""
    rows = index.postings.select("field", "term", "doc_id", "count").join(index.vocab.select("field", "term", "term_id", "df"), ["field", "term"])
    # Dealt out by document while they are narrow; what documents add later finds them there.
    rows = sized(rows.drop("term").repartition("doc_id"), index).join(F.broadcast(index.stats), "field")
    score = bm25(F.col("count"), F.col("size"), F.col("df"), F.col("n_docs"), F.col("n_occurrences"), k1, b)
    return rows.select("term_id", "doc_id", F.col("df").alias("p_tfreq"), F.col("count").cast("long").alias("p_tdfreq"), F.round(score, 6).alias("p_bm25"))


def posting_keys(index: Index) -> DataFrame:
    """(term_id, doc_id) of every posting."""
    terms = index.vocab.select("field", "term", "term_id")
    return index.postings.select("field", "term", "doc_id").join(terms, ["field", "term"]).select("term_id", "doc_id")


def document_features(index: Index, xdoc: DataFrame) -> DataFrame:
    """(doc_id, d_size, d_terms, d_xdoc)."""
    rows = index.doc_stats.select("doc_id", F.col("size").alias("d_size"), F.col("n_terms").alias("d_terms"))
    return rows.join(xdoc.select("doc_id", F.col("xdoc").alias("d_xdoc")), "doc_id", "left").fillna(0.0, ["d_xdoc"])


def feature_table(postings: DataFrame, documents: DataFrame, doc_hits: DataFrame, posting_hits: DataFrame) -> DataFrame:
    """All features of every posting: hits that are missing are 0, ratios with a 0 divisor too.

    Postings meet their own hits first, so that they are sorted while they are narrow, and by document in that order.
    """
    rows = postings.join(posting_hits, ["doc_id", "term_id"], "left").join(documents, "doc_id").join(doc_hits, "doc_id", "left")
    rows = rows.fillna(0)
    pairs = [*DOC_RATIOS]
    for top in ("top10", "top1k"):
        pairs += [(f"dh_{top}", "d_size", f"dh_{top}_per_size"), (f"dh_{top}", "d_terms", f"dh_{top}_per_term")]
        pairs += [(f"ph_{top}", "p_tfreq", f"ph_{top}_per_tfreq"), (f"ph_{top}", "p_tdfreq", f"ph_{top}_per_tdfreq")]
    return rows.select("*", *(ratio(a, b).alias(name) for a, b, name in pairs))


def hitless_table(postings: DataFrame, label: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Postings with their label, 0 where there is none, and what documents add, if given: feature_table without hits."""
    rows = postings.join(label, ["doc_id", "term_id"], "left")
    if documents is None:
        return rows.fillna(0)
    rows = rows.join(documents, "doc_id").fillna(0)
    return rows.select("*", *(ratio(a, b).alias(name) for a, b, name in DOC_RATIOS))


def labels(hits: DataFrame, depth: int, name: str = "label") -> DataFrame:
    """(term_id, doc_id, label): in how many results of rank below `depth` a posting took part."""
    return hits.where(F.col("rank") < depth).groupBy("term_id", "doc_id").agg(F.count("*").alias(name))


def labelled(features: DataFrame, label: DataFrame, name: str = "label") -> DataFrame:
    """features with their label, 0 where there is none; keys are compared null-safely."""
    other = label.select(F.col("term_id").alias("t_"), F.col("doc_id").alias("d_"), name)
    same = F.col("term_id").eqNullSafe(F.col("t_")) & F.col("doc_id").eqNullSafe(F.col("d_"))
    return features.join(other, same, "left").drop("t_", "d_").fillna(0, [name])


def joined(frames: list[DataFrame], on: str = "id") -> DataFrame:
    """Several feature frames as one, by their common key."""
    return reduce(lambda a, b: a.join(b, on), frames)


def all_double(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in frame.columns))

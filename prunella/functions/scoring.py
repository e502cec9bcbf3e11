"""Scorers as column expressions, and their registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest inverse document frequency.
EPSILON = 1e-6


def term_weight(n_docs: Column, df: Column, k1: float) -> Column:
    return (k1 + 1) * F.greatest(F.lit(EPSILON), F.log((n_docs - df + 0.5) / (df + 0.5)))


def bm25(count: Column, size: Column, df: Column, n_docs: Column, n_occurrences: Column, k1: float = 1.2, b: float = 0.5) -> Column:
    """What one posting adds to the score of its document."""
    norm = k1 * (1 - b) + k1 * b * n_docs / n_occurrences * size
    return count * term_weight(n_docs, df, k1) / (count + norm)


def tf_idf(count: Column, size: Column, df: Column, n_docs: Column, n_occurrences: Column) -> Column:
    return count / size * F.log(n_docs / df)


def count_scorer(count: Column, size: Column, df: Column, n_docs: Column, n_occurrences: Column) -> Column:
    return count.cast("double")


SCORERS: dict[str, Callable[..., Column]] = {"bm25": bm25, "tfidf": tf_idf, "count": count_scorer}


def parse_scorer(spec: str) -> tuple[Callable[..., Column], float]:
    """`name(arguments):weight`; arguments and weight may be left out, the weight must not be negative."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(([^)]*)\))?\s*(?::\s*([-+.\deE]+))?\s*", spec)
    if not m or m[1].lower() not in SCORERS:
        raise ValueError(f"no scorer: {spec}")
    args, weight = [float(x) for x in (m[2] or "").split(",") if x.strip()], float(m[3] or 1)
    if weight < 0:
        raise ValueError(f"a scorer's weight must not be negative: {spec}")
    scorer = SCORERS[m[1].lower()]
    return (lambda *columns: scorer(*columns, *args)), weight

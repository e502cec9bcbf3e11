"""From a query tree to DataFrames: which documents match, and which postings on true paths count for the score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prunella.operators.index import Index
from prunella.operators.intervals import near, ordered_within, phrase
from prunella.operators.search import and_then, ranked, scored
from prunella.plans import query_language as q


@dataclass
class Found:
    """docs (doc_id) that match, and terms (doc_id, field, term, count, weight) that contribute there."""

    docs: DataFrame
    terms: DataFrame


class Planner:
    def __init__(self, index: Index, payloads: DataFrame | None = None, default_field: str = "text", prefix_terms: int | None = None):
        """payloads: (doc_id, typed columns) for ranges; by default those of the index.

        prefix_terms: a prefix stands for its first so many terms in their order; by default for all of them.
        """
        self.index, self.payloads, self.default = index, index.payloads if payloads is None else payloads, default_field
        self.prefix_terms = prefix_terms

    def plan(self, node, field: str | None = None, weight: float = 1.0) -> Found:
        field = field or self.default
        match node:
            case q.Term(text):
                return self.leaf(field, F.col("term") == text, weight)
            case q.Prefix(text):
                return self.leaf(field, self.prefixed(field, text), weight)
            case q.Phrase(terms):
                return self.positional(phrase(self.index.postings, field, terms), field, terms, weight)
            case q.Near(terms, width):
                return self.positional(near(self.index.postings, field, terms, width), field, terms, weight)
            case q.Ordered(terms):
                return self.positional(ordered_within(self.index.postings, field, terms), field, terms, weight)
            case q.Within(name, part):
                return self.range(name, part) if isinstance(part, q.Range) else self.plan(part, name, weight)
            case q.Weighted(part, w):
                return self.plan(part, field, weight * w)
            case q.Or(parts):
                own = [self.plan(p, field, weight) for p in parts]
                return Found(reduce(DataFrame.union, [f.docs for f in own]).distinct(), reduce(DataFrame.union, [f.terms for f in own]).distinct())
            case q.And(parts):
                own = [self.plan(p, field, weight) for p in parts if not isinstance(p, q.Not)]
                out = [self.plan(p.part, field, weight).docs for p in parts if isinstance(p, q.Not)]
                docs = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), [f.docs for f in own]) if own else self.universe()
                docs = reduce(lambda a, b: a.join(b, "doc_id", "left_anti"), out, docs)
                none = self.leaf(field, F.lit(False), weight).terms
                terms = reduce(DataFrame.union, [f.terms for f in own], none).distinct()
                return Found(docs, terms.join(docs, "doc_id", "left_semi"))
            case q.Not(part):
                docs = self.universe().join(self.plan(part, field, weight).docs, "doc_id", "left_anti")
                return Found(docs, self.leaf(field, F.lit(False), weight).terms)
        raise q.QueryError(f"cannot plan {node}")

    def prefixed(self, field: str, text: str) -> Column:
        """The condition of a prefix; where its terms are limited, up to the last of them, which the vocabulary tells."""
        begins = F.col("term").startswith(text)
        if self.prefix_terms is None:
            return begins
        own = self.index.vocab.where((F.col("field") == field) & begins).select("term").orderBy("term").limit(self.prefix_terms)
        return begins & (F.col("term") <= F.lit(own.agg(F.max("term")).first()[0]))

    def universe(self) -> DataFrame:
        return self.index.doc_stats.select("doc_id").distinct()

    def leaf(self, field: str, terms: Column, weight: float) -> Found:
        """The postings of a condition on terms, which reaches their scan."""
        rows = self.index.postings.where((F.col("field") == field) & terms)
        rows = rows.select("doc_id", "field", "term", "count", F.lit(weight).alias("weight"))
        return Found(rows.select("doc_id").distinct(), rows)

    def positional(self, docs: DataFrame, field: str, terms, weight: float) -> Found:
        own = self.leaf(field, F.col("term").isin(list(dict.fromkeys(terms))), weight).terms
        return Found(docs, own.join(docs, "doc_id", "left_semi"))

    def range(self, column: str, bounds: q.Range) -> Found:
        if self.payloads is None or column not in self.payloads.columns:
            raise q.QueryError(f"no typed field {column}")
        kind = dict(self.payloads.dtypes)[column]
        low, high = (F.lit(x or None).cast(kind) for x in (bounds.low, bounds.high))
        docs = self.payloads.where((low.isNull() | (F.col(column) >= low)) & (high.isNull() | (F.col(column) <= high)))
        return Found(docs.select("doc_id").distinct(), self.leaf(self.default, F.lit(False), 1.0).terms)

    def matches(self, found: Found) -> DataFrame:
        """What contributes, each (document, field, term) once, with its count; documents of score 0 have no row."""
        best = found.terms.groupBy("doc_id", "field", "term").agg(F.max("weight").alias("weight"), F.first("count").alias("count"))
        return best.withColumn("qid", F.lit(0))

    def run(self, text: str, length: int = 1000, offset: int = 0, fields: list[str] | None = None, transform=None, scorer=None, weights=None) -> DataFrame:
        """(doc_id, score, part, rank) of a query; each and-then part is multiplexed over fields and transformed first."""
        parts = []
        for node in q.parse(text):
            node = q.multiplexed(node, fields) if fields else node
            node = q.transformed(node, transform) if transform else node
            found = self.plan(node)
            docs = found.docs.select(F.lit(0).alias("qid"), "doc_id")
            if scorer is False:
                parts.append(docs.withColumn("score", F.lit(-1.0)))
                continue
            scores = scored(self.matches(found), self.index, **({"scorer": scorer} if scorer else {}), weights=weights)
            parts.append(docs.join(scores, ["qid", "doc_id"], "left").fillna(0.0, ["score"]))
        out = and_then(parts, length, offset) if len(parts) > 1 else ranked(parts[0], length, offset).withColumn("part", F.lit(0))
        return out.select("doc_id", "score", "part", "rank")

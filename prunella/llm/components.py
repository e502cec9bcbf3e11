"""Connected components over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunella.llm.common import written

#: Rounds after which the loop fails; each at least halves the depth of the trees.
MAX_ROUNDS = 60


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v; the components stay the same."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(low, "u")
    small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))
    return small.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (u, v): the smallest id that its links reach.

    Alternates large-star and small-star steps until nothing changes; each round is written to the shared scratch
    folder, so lineage stays short.  A step groups by a node and keeps only the minimum, so a node with very many
    links is summed before the shuffle.  Edges with a null end and loops are ignored; an empty table gives an empty one.
    """
    now = written(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        stat = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h")).first()
        if (stat["n"], stat["h"]) == mark or not stat["n"]:
            break
        mark = (stat["n"], stat["h"])
        now = written(_round(now), "edges")
    else:
        raise ArithmeticError(f"components still change after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)

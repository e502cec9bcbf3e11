"""Joins of rows with a table of their keys, when one key may hold a third of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it holds one of so many equal shares of the rows: so many keys can do so at most.
SHARES = 1000


def looked_up(rows: DataFrame, found: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows with the columns of found (unique keys `on`, `n` rows each), nulls equal; rows without a match go.

    Frequent keys are at most SHARES rows of found by their counts, and are broadcast; the others meet by a shuffle, in
    which no key holds more than a share.  Both should be stored tables: each is read twice.
    """
    total = found.agg(F.sum(n)).first()[0] or 0
    keys = {c: f"_{c}" for c in on}
    own = found.withColumnsRenamed(keys)
    same: Column = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(own[k]) for c, k in keys.items()))
    often = own.where(F.col(n) * SHARES >= F.lit(total))
    seldom = own.where(F.col(n) * SHARES < F.lit(total))
    hot = rows.join(F.broadcast(often), same)
    rest = rows.join(F.broadcast(often.select(*keys.values())), same, "left_anti").join(seldom.hint("shuffle_merge"), same)
    return hot.unionByName(rest).drop(*keys.values(), n)

"""Groups of linked items from shared signatures, without the pairs of a bucket.

A table of rows (sig, key) has the signatures of each item; items that may be linked share one.  Linking goes in turns:
in a turn each item is compared with the closest hub, of another group, of its signatures; links that hold contract
groups, and signatures whose items are all in one group are done.  Only items of one signature that are in different groups after the turns are compared with each other, so no
link is lost.  A bucket with very many linked items costs a few comparisons an item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prunella.llm.common import released, written
from prunella.llm.components import connected_components

#: Turns of comparing each item with one hub; they end early when a turn finds few links.
HUB_TURNS = 2
#: A turn that links less than one in so many of the items that could still be linked is the last.
WORTHWHILE = 50
#: Tables of ids with fewer rows than this (16 bytes each) go to all executors; larger ones are joined by a shuffle.
BROADCAST_ROWS = 250_000

#: So many signatures of an item before one are looked at, not to compare a pair again.
LAST_SIGNATURES = 8

Compare = Callable[[str, str], tuple[Column, Column]]


def light(df: DataFrame) -> DataFrame:
    """A table of ids, marked for broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_signatures(signed: DataFrame) -> DataFrame:
    """(sig, key): the distinct items of each signature that different items share.

    In the order of keys, the first item of a signature is told apart from the others; rows stream by, none are held.
    """
    bucket = Window.partitionBy("sig").orderBy("key")
    upto = bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = signed.select("sig", "key", F.lag("key").over(bucket).alias("before"), F.first("key").over(upto).alias("hub"))
    rows = rows.where("key != hub and before != key")
    keys = F.when(F.col("before") == F.col("hub"), F.array("hub", "key")).otherwise(F.array("key"))
    out = written(rows.select("sig", F.explode(keys).alias("key")), "shared")
    del rows
    released(out.sparkSession)
    return out


def without_frequent(members: DataFrame, tag: Column, spare: Column, last: Column) -> DataFrame:
    """members without the signatures that each item may leave out: of each tag, its spare[tag] last ones in an order.

    In the order, those marked `last` come after the others, and frequent ones after rare ones.  No link is lost where
    linked items share more than spare[tag] signatures of some tag: of what they share, the first has at least spare[tag]
    others behind it, for both of them.
    """
    often = members.groupBy("sig").agg(F.count("*").alias("f"))
    rows = members.join(light(written(often, "frequencies")), "sig").withColumn("tag", tag)
    place = F.when(last, F.lit((1 << 62))).otherwise(F.col("f"))
    # Signatures count as unsigned numbers, in the signing task too.
    unsigned = F.col("sig").bitwiseXOR(F.lit(-(1 << 63)))
    rank = F.row_number().over(Window.partitionBy("key", "tag").orderBy(place.desc(), unsigned.desc()))
    rows = written(rows.withColumn("rank", rank).where(F.col("rank") > spare[F.col("tag")]).select("sig", "key"), "rare")
    several = rows.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    return written(rows.join(light(written(several, "several")), "sig", "left_semi"), "members")


def shared_items(members: DataFrame) -> DataFrame:
    return members.select("key").distinct()


def _closest(pairs: DataFrame, info: DataFrame, compare: Compare) -> DataFrame:
    """(u, v): of the pairs of each u that may be linked, the closest."""
    distance, may = compare("l", "r")
    near = pairs.join(info.alias("l"), F.col("u") == F.col("l.key")).join(info.alias("r"), F.col("v") == F.col("r.key")).where(may)
    return written(near.groupBy("u").agg(F.min_by("v", F.struct(distance, "v")).alias("v")), "pairs")


def _hubs(live: DataFrame, turn: int) -> DataFrame:
    """(u, v): each item and the hubs of its signatures that are in another group.

    A signature's hub is now the item with most open signatures (what near copies have in common is near to most of
    them), then the first of its items in an order that is new in each turn.
    """
    degree = live.groupBy("key").agg(F.count("*").alias("degree"))
    rows = live.join(light(written(degree, "degrees")), "key")
    order = F.xxhash64("key", F.lit(turn)) if turn > 1 else -F.col("degree")
    hubs = rows.groupBy("sig").agg(F.min(F.struct(order.alias("o"), F.col("key").alias("hub"), F.col("g").alias("hg"))).alias("f"))
    pairs = rows.join(hubs.select("sig", "f.hub", "f.hg"), "sig").where("g != hg")
    return pairs.select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()


def _regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (key, g) after links between items; only the graph of groups is searched."""
    of = groups.select(F.col("key").alias("u"), F.col("g").alias("gu"))
    to = groups.select(F.col("key").alias("v"), F.col("g").alias("gv"))
    merged = connected_components(links.join(of, "u").join(to, "v").select(F.col("gu").alias("u"), F.col("gv").alias("v")))
    return written(groups.join(merged, groups["g"] == merged["id"], "left").select("key", F.coalesce("component", "g").alias("g")), "groups")


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(sig, key, g) of the signatures whose items are in different groups."""
    rows = written(members.join(light(groups), "key").select("sig", "key", "g"), "grouped")
    differ = rows.groupBy("sig").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low != high").select("sig")
    return written(rows.join(light(written(differ, "open-sigs")), "sig", "left_semi"), "open")


def _links(verified: Callable[[DataFrame], DataFrame], pairs: DataFrame) -> DataFrame:
    out = written(verified(pairs), "links")
    released(out.sparkSession)
    return out


def linked_groups(
    members: DataFrame, info: DataFrame, columns: list[str], compare: Compare, verified: Callable[[DataFrame], DataFrame], turns: int = HUB_TURNS
) -> DataFrame:
    """(key, g): the group of each item of members (sig, key).

    info has the columns of the items that compare(left alias, right alias) needs: it gives a distance and whether a
    link is possible.  verified keeps the linked ones of pairs (u, v).
    """
    items = info.count()
    groups = info.select("key", F.col("key").alias("g"))
    live = _open(members, groups)
    for turn in range(turns):
        links = _links(verified, _closest(_hubs(live, turn), info, compare))
        n = links.count()
        if n:
            groups = _regrouped(groups, links)
            live = _open(members, groups)
        if n * WORTHWHILE <= items:
            break
    # What is left, so that no link is lost: items of one signature that are still in different groups.
    # Items that share a signature among their last ones before this have met there; the first that they share stays.
    before = Window.partitionBy("key").orderBy("sig").rowsBetween(-LAST_SIGNATURES, -1)
    rest = live.withColumn("last", F.collect_list("sig").over(before))
    rest = written(rest.join(info.select("key", *columns), "key"), "rest")
    _, may = compare("l", "r")
    apart = (F.col("l.key") > F.col("r.key")) & (F.col("l.g") != F.col("r.g"))
    new = ~F.arrays_overlap("l.last", "r.last")
    pairs = rest.alias("l").join(rest.alias("r"), (F.col("l.sig") == F.col("r.sig")) & apart & may & new)
    pairs = written(pairs.select(F.col("l.key").alias("u"), F.col("r.key").alias("v")).distinct(), "rest-pairs")
    released(pairs.sparkSession, rest, live, members)
    return _regrouped(groups, _links(verified, pairs))

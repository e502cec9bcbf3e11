"""A whole log of structured queries in one plan.

Every tree of the log becomes rows of a node table, in the tasks that hold the log.  The postings of the log's terms are
scanned and dealt out by document once, each once however many leaves have its term, and repeated for the leaves there.
A tree of up to MASK_NODES nodes is a few bit masks: what a document matches of it is one number, the union of the leaves
that stand, from which all its nodes follow without another aggregate.  Larger trees, and those that exclude and ask for
nothing, go level by level: what they match is dealt out by query and document, and each level is one aggregate over
(query, node, document) that needs no further shuffle.  Only terms on true paths count for the score.  How often the
postings are scanned does not depend on the number of queries: once for the trees of each kind, and once for the queries
that are a plain conjunction or disjunction of terms, which need no trees but a count of terms (`search.search`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attribute
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prunella.functions.scoring import bm25
from prunella.operators.index import Index
from prunella.operators.search import and_then, dealt_postings, matches, needed, ranked, scored, small
from prunella.plans import query_language as q
from prunella.storage import bounded_batches, setting, written

#: A leaf and the nodes above it: `path` has the node, how many of its children must match, and whether it is excluded
#: from its own parent; a leaf with `need` terms matches by `kind`.
LEAVES = (
    "qid long, part int, kind string, field string, terms array<struct<k:int,term:string,prefix:boolean>>, width int, weight double, "
    "negated boolean, path array<struct<node:int,need:int,negated:boolean>>, flat string"
)
#: Kinds of leaves that look at positions.
POSITIONAL = ("phrase", "near", "ordered")
#: A place before all positions.
NEVER = -(1 << 30)
#: Trees of so many nodes have one in each bit of a number.
MASK_NODES = 63
#: Off, hits are collected in the order they are sorted in; hashed, they are sorted anyway after the first few groups.
HASHED_LISTS = "spark.sql.execution.useObjectHashAggregateExec"


@dataclass
class _Compiler:
    """The leaves of one tree, from the top down."""

    default: str
    leaves: list[dict] = attribute(default_factory=list)
    nodes: int = 0

    def leaf(self, kind, field, weight, negated, path, terms=(), width=0) -> None:
        self.nodes += 1
        own = [{"k": k, "term": t, "prefix": p} for k, (t, p) in enumerate(terms)]
        # A leaf is a node of its own too, with one child.
        path = [{"node": self.nodes, "need": 1, "negated": negated}, *path]
        self.leaves.append({"kind": kind, "field": field, "terms": own, "width": width, "weight": weight, "negated": False, "path": path})

    def inner(self, need: int, negated: bool, path: list) -> list:
        self.nodes += 1
        return [{"node": self.nodes, "need": need, "negated": negated}, *path]

    def visit(self, node, field=None, weight=1.0, negated=False, path=()) -> None:
        path, field = list(path), field or self.default
        match node:
            case q.Term(text):
                self.leaf("term", field, weight, negated, path, [(text, False)])
            case q.Prefix(text):
                self.leaf("term", field, weight, negated, path, [(text, True)])
            case q.Phrase(terms):
                self.leaf("phrase", field, weight, negated, path, [(t, False) for t in terms])
            case q.Near(terms, width):
                self.leaf("near", field, weight, negated, path, [(t, False) for t in dict.fromkeys(terms)], width)
            case q.Ordered(terms):
                self.leaf("ordered", field, weight, negated, path, [(t, False) for t in terms])
            case q.Within(name, part) if not isinstance(part, q.Range):
                self.visit(part, name, weight, negated, path)
            case q.Weighted(part, w):
                self.visit(part, field, weight * w, negated, path)
            case q.Or(parts):
                below = self.inner(1, negated, path)
                for p in parts:
                    self.visit(p, field, weight, False, below)
            case q.And(parts):
                own = [p for p in parts if not isinstance(p, q.Not)]
                below = self.inner(max(1, len(own)), negated, path)
                if not own:
                    self.leaf("all", field, weight, False, below)
                for p in own:
                    self.visit(p, field, weight, False, below)
                for p in parts:
                    if isinstance(p, q.Not):
                        self.visit(p.part, field, weight, True, below)
            case q.Not(part):
                self.visit(q.And((node,)), field, weight, negated, path)
            case _:
                raise q.QueryError(f"not in a log's plan: {node}")


def compiled(text: str, default: str = "text", fields: list[str] | None = None, transform: Callable | None = None) -> list[dict]:
    """The leaves of a query, of all its and-then parts; each part is multiplexed over fields and transformed first."""
    out = []
    for part, node in enumerate(q.parse(text)):
        node = q.multiplexed(node, fields) if fields else node
        node = q.transformed(node, transform) if transform else node
        plain = q.flat(node)
        if plain:
            terms = [{"k": k, "term": t, "prefix": False} for k, t in enumerate(dict.fromkeys(plain[1]))]
            out.append({"part": part, "kind": "flat", "field": default, "terms": terms, "width": 0, "weight": 1.0, "negated": False, "path": [], "flat": plain[0]})
            continue
        compiler = _Compiler(default)
        compiler.visit(node)
        out += [{**leaf, "part": part, "flat": None} for leaf in compiler.leaves]
    return out


def leaves(log: DataFrame, **how) -> DataFrame:
    """The leaves of a log (qid, text); a text that is no query is an error."""

    def parse(batches):
        for batch in batches:
            rows = []
            for qid, text in zip(batch.column("qid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [{**leaf, "qid": qid} for leaf in compiled(text or "", **how)]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return log.select(F.col("qid").cast("long").alias("qid"), "text").mapInArrow(parse, LEAVES)


_ARROW = pa.schema(
    [
        ("qid", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("field", pa.string()),
        ("terms", pa.list_(pa.struct([("k", pa.int32()), ("term", pa.string()), ("prefix", pa.bool_())]))),
        ("width", pa.int32()), ("weight", pa.float64()), ("negated", pa.bool_()),
        ("path", pa.list_(pa.struct([("node", pa.int32()), ("need", pa.int32()), ("negated", pa.bool_())]))), ("flat", pa.string()),
    ]
)


def expanded(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """asked (.., field, term, prefix, ..) with the terms of the vocabulary that begin with each prefix; by equal beginnings
    of the lengths that prefixes have, not by comparing all."""
    plain = asked.where("not prefix").drop("prefix")
    wanted = asked.where("prefix").withColumn("size", F.length("term")).withColumnRenamed("term", "beginning").drop("prefix")
    sizes = wanted.select("field", "size").distinct()
    words = vocab.select("field", "term").join(small(sizes), "field").where(F.length("term") >= F.col("size"))
    words = words.withColumn("beginning", F.expr("substring(term, 1, size)"))
    return plain.unionByName(words.join(small(wanted), ["field", "size", "beginning"]).drop("size", "beginning"))


def _stands(kind: Column, lists: Column, n: Column, width: Column) -> Column:
    """Whether the terms (lists of k and positions, in the order of k) stand as the kind of leaf says.

    A phrase meets the shifted lists; order and nearness are one pass over the positions that carries a place per term.
    """
    shifted = F.transform(lists, lambda s: F.transform(s["positions"], lambda p: p - s["k"]))
    phrase = F.size(F.aggregate(F.slice(shifted, 2, n), shifted[0], lambda a, b: F.array_intersect(a, b))) > 0
    # At one place, later terms come first, for a chain goes on behind it only.
    events = F.array_sort(F.flatten(F.transform(lists, lambda s: F.transform(s["positions"], lambda p: F.struct(p.alias("p"), (-s["k"]).alias("k"))))))
    none = F.struct(F.array_repeat(F.lit(NEVER), n).alias("at"), F.lit(False).alias("ok"))

    def put(at: Column, k: Column, value: Column) -> Column:
        return F.transform(at, lambda x, i: F.when(i == k, value).otherwise(x))

    def near(s: Column, e: Column) -> Column:
        at = put(s["at"], -e["k"], e["p"])
        return F.struct(at.alias("at"), (s["ok"] | (e["p"] - F.array_min(at) < width)).alias("ok"))

    def chain(s: Column, e: Column) -> Column:
        start = F.when(e["k"] == 0, e["p"]).otherwise(F.get(s["at"], -e["k"] - 1))
        return F.struct(put(s["at"], -e["k"], start).alias("at"), (s["ok"] | ((-e["k"] == n - 1) & (start > NEVER))).alias("ok"))

    all_near = F.aggregate(events, none, near, lambda s: s["ok"])
    ordered = F.aggregate(events, none, chain, lambda s: s["ok"])
    return F.when(kind == "phrase", phrase).when(kind == "near", all_near).when(kind == "ordered", ordered).otherwise(F.lit(True))


def _bit(node: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), node - 1)


def tree_masks(own: DataFrame) -> DataFrame:
    """(qid, part, root, inner) of trees of leaves: the root's bit, and for each inner node from the bottom up its bit, how
    many of its children must match, and the bits of those children and of the excluded ones."""
    rows = own.select("qid", "part", "path", F.posexplode("path").alias("height", "at"))
    below = F.get("path", F.col("height") - 1)
    bit = F.when(below.isNotNull(), _bit(below["node"])).otherwise(0)
    nodes = rows.groupBy("qid", "part", "at.node").agg(
        F.max("height").alias("height"), F.max("at.need").alias("need"), F.bit_or(F.when(~below["negated"], bit).otherwise(0)).alias("kids"),
        F.bit_or(F.when(below["negated"], bit).otherwise(0)).alias("out"),
    )
    node = F.struct("height", "need", "kids", "out", _bit(F.col("node")).alias("bit"))
    trees = nodes.groupBy("qid", "part").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return trees.select("qid", "part", F.element_at("nodes", -1)["bit"].alias("root"), F.filter("nodes", lambda n: n["height"] > 0).alias("inner"))


class LogPlanner:
    """Plans for logs of structured queries (qid, text) over an index."""

    def __init__(self, index: Index, default_field: str = "text"):
        self.index, self.default = index, default_field

    def roots(self, own: DataFrame, depth: int, positional: bool, complements: bool) -> DataFrame:
        """(qid, part, doc_id, terms): the documents of each tree, and the terms on its true paths."""
        one = own.select("qid", "part", "kind", "width", "weight", "negated", "path", F.size("terms").alias("need"), "field", F.explode("terms").alias("t"))
        asked = expanded(one.select("*", "t.*").drop("t"), self.index.vocab)
        # All leaves stand at one depth: above shorter ones, their last node is repeated, with one child.
        pad = F.array_repeat(F.struct(F.col("path")[0]["node"].alias("node"), F.lit(1).alias("need"), F.lit(False).alias("negated")), depth - F.size("path"))
        asked = asked.withColumn("path", F.concat(pad, "path"))
        postings = self.index.postings.select("field", "term", "doc_id", "count", *(["positions"] if positional else []))
        hits = postings.join(small(asked), ["field", "term"])
        places = F.when(F.col("kind").isin(*POSITIONAL), F.col("positions")) if positional else F.lit(None).cast("array<int>")
        term = F.struct("k", places.alias("positions"), "field", "term", "weight", "count")
        hits = hits.select("qid", "part", "doc_id", "kind", "width", "need", "path", term.alias("hit"))
        hits = hits.repartition("qid", "doc_id")
        leaf = hits.groupBy("qid", "part", F.col("path")[0]["node"].alias("node"), "doc_id").agg(
            F.first("kind").alias("kind"), F.first("width").alias("width"), F.first("need").alias("need"), F.first("path").alias("path"),
            F.array_sort(F.collect_list("hit")).alias("hits"),
        )
        found = leaf.where((F.col("kind") == "term") | (F.size("hits") == F.col("need")))
        if positional:
            found = found.where(_stands(F.col("kind"), F.col("hits"), F.col("need"), F.col("width")))
        terms = F.transform("hits", lambda h: F.struct(h["field"].alias("field"), h["term"].alias("term"), h["weight"].alias("weight"), h["count"].alias("count")))
        rows = found.select("qid", "part", "doc_id", "path", F.lit(False).alias("negated"), terms.alias("terms"))
        if complements:
            everyone = self.index.doc_stats.select("doc_id").distinct()
            # Queries that exclude and ask for nothing: their matches are all other documents, so the rows are those of the result.
            every = own.where("kind = 'all'").select("qid", "part", F.concat(pad, "path").alias("path"))
            none = F.array().cast(rows.schema["terms"].dataType)
            every = everyone.crossJoin(small(every)).select("qid", "part", "doc_id", "path", F.lit(False).alias("negated"), none.alias("terms"))
            rows = rows.unionByName(every.repartition("qid", "doc_id"))
        for _ in range(depth):
            kept = F.flatten(F.collect_list(F.when(~F.col("negated"), F.col("terms"))))
            level = rows.groupBy("qid", "part", F.col("path")[0]["node"].alias("node"), "doc_id").agg(
                F.first("path").alias("path"), F.count_if(~F.col("negated")).alias("n"), F.bool_or("negated").alias("out"), kept.alias("terms")
            )
            level = level.where(~F.col("out") & (F.col("n") >= F.col("path")[0]["need"]))
            rows = level.select("qid", "part", "doc_id", F.expr("slice(path, 2, size(path))").alias("path"), F.col("path")[0]["negated"].alias("negated"), "terms")
        return rows.select("qid", "part", "doc_id", "terms")

    def masked(self, own: DataFrame, positional: bool) -> DataFrame:
        """(qid, part, doc_id, field, term, weight, count, size, df): the terms on the true paths of trees that fit in masks.

        Nothing but the postings is shuffled: all aggregates are by document first.
        """
        above = F.aggregate("path", F.lit(0).cast("long"), lambda m, n: m.bitwiseOR(_bit(n["node"])))
        counts = ~F.exists("path", lambda n: n["negated"])
        one = own.select(
            "qid", "part", "kind", "width", "weight", F.size("terms").alias("need"), _bit(F.col("path")[0]["node"]).alias("leaf"),
            F.when(counts, above).alias("path"), "field", F.explode("terms").alias("t"),
        )
        asked = one.select("*", "t.*").drop("t").withColumnRenamed("term", "key")
        placed = F.col("kind").isin(*POSITIONAL)
        # What the log asks for, words and beginnings, and the terms that each stands for: leaves are not repeated for these.
        keys = asked.groupBy("field", "prefix", "key").agg(F.bool_or(placed).alias("placed"))
        keys = expanded(keys.withColumn("term", F.col("key")).withColumn("begins", F.col("prefix")), self.index.vocab)
        lists = keys.groupBy("field", "term").agg(F.bool_or("placed").alias("placed"), F.collect_list(F.struct(F.col("begins").alias("prefix"), "key")).alias("keys"))
        lists = lists.join(self.index.vocab.select("field", "term", "df"), ["field", "term"])
        places = F.when(F.col("placed"), F.col("positions")) if positional else F.lit(None).cast("array<int>")
        rows = dealt_postings(self.index, lists, own, places.alias("positions"))
        rows = rows.select("doc_id", "field", "size", "positions", F.struct("term", "count", "df").alias("term"), F.inline("keys"))
        rows = rows.groupBy("doc_id", "field", "prefix", "key").agg(F.first("size").alias("size"), F.first("positions").alias("positions"), F.collect_list("term").alias("terms"))
        hits = rows.join(small(asked), ["field", "prefix", "key"])
        places = F.when(placed, F.col("positions"))
        hit = F.struct("k", places.alias("positions"), "field", "weight", "size", "terms")
        leaf = hits.groupBy("qid", "part", "doc_id", "leaf").agg(
            F.first("kind").alias("kind"), F.first("width").alias("width"), F.first("need").alias("need"), F.first("path").alias("path"), F.collect_list(hit).alias("hits")
        )
        found = leaf.where(F.size("hits") == F.col("need"))
        if positional:
            found = found.withColumn("hits", F.when(placed, F.array_sort("hits")).otherwise(F.col("hits")))
            found = found.where(_stands(F.col("kind"), F.col("hits"), F.col("need"), F.col("width")))

        def of(h: Column) -> Column:
            return F.transform(h["terms"], lambda t: F.struct(*(x.alias(c) for c, x in [(c, h[c]) for c in ("field", "weight", "size")] + [(c, t[c]) for c in ("term", "count", "df")])))

        terms = F.flatten(F.transform("hits", of))
        docs = found.groupBy("qid", "part", "doc_id").agg(F.bit_or("leaf").alias("mask"), F.collect_list(F.struct("path", terms.alias("terms"))).alias("leaves"))
        docs = docs.join(small(written(tree_masks(own), "tree-masks")), ["qid", "part"])

        def node(m: Column, n: Column) -> Column:
            ok = (F.bit_count(m.bitwiseAND(n["kids"])) >= n["need"]) & (m.bitwiseAND(n["out"]) == 0)
            return F.when(ok, m.bitwiseOR(n["bit"])).otherwise(m)

        # All nodes above a leaf, the root among them, must be true; a list of one lets the inner lambda have them as a value.
        truth = F.array(F.aggregate("inner", F.col("mask"), node))
        kept = F.flatten(F.transform(truth, lambda m: F.flatten(F.transform(F.filter("leaves", lambda x: x["path"].bitwiseAND(m) == x["path"]), lambda x: x["terms"]))))
        return docs.select("qid", "part", "doc_id", F.explode(kept).alias("t")).select("qid", "part", "doc_id", "t.*")

    def run(
        self, log: DataFrame, length: int = 1000, offset: int = 0, fields: list[str] | None = None, transform=None, scorer=bm25, weights: dict[str, float] | None = None
    ) -> DataFrame:
        """(qid, doc_id, score, part, rank) of all queries of a log; as `Planner.run` for each of them.

        scorer False gives documents in their order, with score -1.  Ranges of typed fields are not planned here.
        """
        bounded_batches(log.sparkSession)
        own = written(leaves(log, default=self.default, fields=fields, transform=transform), "leaves")
        s = own.agg(
            F.max("part").alias("parts"), F.max(F.size("path")).alias("depth"), F.bool_or(F.col("kind").isin(*POSITIONAL)).alias("positional"),
            F.bool_or(F.col("kind") == "all").alias("all"), F.bool_or(F.col("kind") == "flat").alias("flat"),
        ).first()
        found = []
        if s["depth"]:
            trees, tall = own.where("kind != 'flat'"), own.groupBy("qid", "part").agg(F.max(F.array_max("path.node")).alias("n"), F.bool_or(F.col("kind") == "all").alias("all"))
            tall = written(tall.where((F.col("n") > MASK_NODES) | F.col("all")), "tall-trees")
            some = tall.count()
            if some:
                rows = self.roots(trees.join(small(tall), ["qid", "part"], "left_semi"), s["depth"], s["positional"], s["all"])
                found.append(self.scores(rows, scorer, weights))
            rest = trees.join(small(tall), ["qid", "part"], "left_anti") if some else trees
            if not some or rest.limit(1).count():
                found.append(self.mask_scores(self.masked(rest, s["positional"]), scorer, weights))
        if s["flat"]:
            found.append(self.flat(own.where("kind = 'flat'"), scorer, weights))
        if not found:
            return log.sparkSession.createDataFrame([], "qid long, doc_id long, score double, part int, rank int")
        rows = reduce(DataFrame.unionByName, found)
        if not s["parts"]:
            out = ranked(rows, length, offset).withColumn("part", F.lit(0))
        else:
            with setting(log.sparkSession, HASHED_LISTS, "false"):
                rows = written(rows, "log-results")
            out = and_then([rows.where(F.col("part") == k) for k in range(s["parts"] + 1)], length, offset)
        return out.select("qid", "doc_id", "score", "part", "rank")

    def scores(self, trees: DataFrame, scorer, weights) -> DataFrame:
        """(qid, part, doc_id, score): each (field, term) on a true path counts once, by its greatest weight."""
        if scorer is False:
            return trees.select("qid", "part", "doc_id", F.lit(-1.0).alias("score"))
        rows = trees.select("qid", "part", "doc_id", F.explode_outer("terms").alias("t")).select("qid", "part", "doc_id", "t.*")
        rows = rows.groupBy("qid", "part", "doc_id", "field", "term").agg(F.max("weight").alias("weight"), F.first("count").alias("count"))
        rows = written(rows, "tree-terms")
        key = F.struct("qid", "part").alias("qid")
        scores = scored(rows.where("field is not null").select(key, "doc_id", "field", "term", "weight", "count"), self.index, scorer, weights)
        plain = scores.select("qid.qid", "qid.part", "doc_id", "score")
        bare = rows.where("field is null").select("qid", "part", "doc_id", F.lit(0.0).alias("score"))
        return plain.unionByName(bare)

    def mask_scores(self, rows: DataFrame, scorer, weights) -> DataFrame:
        """As scores, of rows of terms that bring along the lengths of lists and documents."""
        if scorer is False:
            return rows.select("qid", "part", "doc_id").distinct().withColumn("score", F.lit(-1.0))
        rows = rows.groupBy("qid", "part", "doc_id", "field", "term").agg(F.max("weight").alias("weight"), *(F.first(c).alias(c) for c in ("count", "size", "df")))
        key = F.struct("qid", "part").alias("qid")
        scores = scored(rows.select(key, "doc_id", "field", "term", "weight", "count", "size", "df"), self.index, scorer, weights)
        return scores.select("qid.qid", "qid.part", "doc_id", "score")

    def flat(self, own: DataFrame, scorer, weights) -> DataFrame:
        """(qid, part, doc_id, score) of plain conjunctions and disjunctions: by a count of terms."""
        key = F.struct("qid", "part").alias("qid")
        queries = own.select(key, "flat", "field", F.explode("terms.term").alias("term"))
        need = needed(queries).join(own.select(key, "flat").distinct(), "qid").select("qid", F.when(F.col("flat") == "and", F.col("need")).otherwise(1).alias("need"))
        found = matches(self.index, queries, sizes=True)
        if scorer is False:
            docs = found.groupBy("qid", "doc_id").agg(F.count("*").alias("n")).join(small(need), "qid").where("n >= need")
            return docs.select("qid.qid", "qid.part", "doc_id", F.lit(-1.0).alias("score"))
        return scored(found, self.index, scorer, weights, need=need).select("qid.qid", "qid.part", "doc_id", "score")

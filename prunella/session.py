"""An interactive search session: settings by `$` commands, queries, and results in a chosen mode."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunella.functions.scoring import parse_scorer
from prunella.operators.index import Index
from prunella.operators.search import equalised, ranked
from prunella.plans.planner import Planner
from prunella.sources.sinks import MODES, shown, write_lines

#: Query transformers by name: a function of a node of the query tree.
TRANSFORMERS: dict[str, Callable] = {}


class SearchSession:
    """Settings: mode, limit, select (intervals), score, expand, mplex, divert, weight, equalize."""

    def __init__(self, index: Index, docs: DataFrame | None = None, payloads: DataFrame | None = None):
        self.index, self.docs, self.planner = index, docs, Planner(index, payloads)
        self.fields = [r["field"] for r in index.stats.select("field").orderBy("field").collect()]
        self.mode, self.limit, self.multiplex, self.path = "short", 1000, True, None
        self.intervals, self.longest, self.sample = 4, 40, 0
        self.scorers: list = [parse_scorer("bm25")]
        self.transform, self.weights, self.open = None, None, True

    def command(self, line: str) -> None:
        """One `$` command; an unknown one, or one with wrong arguments, is a ValueError."""
        name, _, rest = line.strip().lstrip("$").partition(" ")
        rest = rest.strip()
        match name:
            case "mode":
                if rest.lower() not in MODES:
                    raise ValueError(f"mode is one of {MODES}")
                self.mode = rest.lower()
            case "limit":
                self.limit = int(rest)
            case "select":
                self.intervals, self.longest = (None, None) if rest in ("all", "") else tuple(int(x) for x in rest.split()[:2])
            case "score":
                self.scorers = [parse_scorer(s) for s in rest.split()]
            case "expand":
                self.transform = TRANSFORMERS[rest] if rest else None
            case "mplex":
                self.multiplex = rest.lower() in ("on", "true", "1")
            case "divert":
                self.path = rest or None
            case "weight":
                pairs = re.findall(r"(\w+):([\d.]+)", rest)
                self.weights = {k: float(v) for k, v in pairs} or None
            case "equalize":
                self.sample = int(rest)
            case "quit":
                self.open = False
            case _:
                raise ValueError(f"no command: {line}")

    def search(self, text: str, offset: int = 0) -> DataFrame:
        """(qid, doc_id, score, part, rank)."""
        if self.sample and len(self.scorers) < 2:
            raise ValueError("equalisation needs several scorers")
        fields = self.fields if self.multiplex else None
        run = lambda scorer, n: self.planner.run(text, n, 0, fields, self.transform, scorer, self.weights)
        if not self.scorers:
            out = run(False, self.limit + offset)
        elif len(self.scorers) == 1:
            out = self.planner.run(text, self.limit, offset, fields, self.transform, self.scorers[0][0], self.weights)
        else:
            everything = self.index.doc_stats.select("doc_id").distinct().count()
            own = [(run(s, everything).select(F.lit(0).alias("qid"), "doc_id", "score"), w) for s, w in self.scorers]
            out = ranked(equalised(own, self.sample or everything), self.limit, offset).withColumn("part", F.lit(0))
        return out.select(F.lit(0).alias("qid"), "doc_id", "score", "part", "rank")

    def run(self, line: str) -> DataFrame | None:
        """A command or a query; results are shown in the mode of the session, or diverted to files."""
        if line.startswith("$"):
            self.command(line)
            return None
        out = shown(self.search(line), self.mode, self.docs)
        if self.path:
            write_lines(out, self.path, ["qid", "rank"])
        return out

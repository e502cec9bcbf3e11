"""The query language: text to a tree, and rewrites of trees.

    a b, a & b      both            a | b     either        !a, -a   not
    "a b"           phrase          a*        all terms that begin with a
    (a b)~5         all within 5 positions    a < b     in this order
    field:(...)     in a field      a{2.5}    weight        [lo .. hi]   range of a typed field (field:[lo .. hi])
    p, q            and-then: results of p, then those of q that p does not have
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

Node = "Term | Prefix | Phrase | And | Or | Not | Near | Ordered | Within | Weighted | Range"


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Prefix:
    text: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Near:
    terms: tuple[str, ...]
    width: int


@dataclass(frozen=True)
class Ordered:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Within:
    field: str
    part: object


@dataclass(frozen=True)
class Weighted:
    part: object
    weight: float


@dataclass(frozen=True)
class Range:
    low: str
    high: str


_TOKEN = re.compile(r'\s*(?:(?P<str>"[^"]*")|(?P<range>\[[^\]]*\])|(?P<weight>\{[^}]*\})|(?P<near>~\s*\d+)|(?P<word>[\w]+\*?)|(?P<op>[&|!\-(),:<]))', re.UNICODE)


class QueryError(ValueError):
    """A text that is no query."""


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"at {at}: {text[at:at + 20]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or wanted and token != wanted:
            raise QueryError(f"expected {wanted or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def either(self):
        parts = [self.both()]
        while self.peek() == "|":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.chain()]
        while self.peek() and self.peek() not in "|),":
            if self.peek() == "&":
                self.take()
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def chain(self):
        parts = [self.single()]
        while self.peek() == "<":
            self.take()
            parts.append(self.single())
        if len(parts) == 1:
            return parts[0]
        if not all(isinstance(p, Term) for p in parts):
            raise QueryError("only terms can be put in order")
        return Ordered(tuple(p.text for p in parts))

    def single(self):
        token = self.take()
        if token in "!-":
            return Not(self.single())
        if token == "(":
            node = self.either()
            self.take(")")
        elif token[0] == '"':
            node = Phrase(tuple(re.findall(r"[^\W_]+", token.lower())))
        elif token[0] == "[":
            low, dots, high = token[1:-1].partition("..")
            if not dots:
                raise QueryError(f"no range: {token}")
            node = Range(low.strip(), high.strip())
        elif token[0].isalnum() or token[0] == "_":
            if self.peek() == ":":
                self.take()
                node = Within(token, self.single())
            else:
                node = Prefix(token[:-1].lower()) if token[-1] == "*" else Term(token.lower())
        else:
            raise QueryError(f"unexpected {token}")
        while self.peek()[:1] in ("~", "{") and self.peek():
            mark = self.take()
            if mark[0] == "{":
                node = Weighted(node, float(mark[1:-1]))
            else:
                terms = node.parts if isinstance(node, And) else (node,)
                if not all(isinstance(t, Term) for t in terms):
                    raise QueryError("proximity needs plain terms")
                node = Near(tuple(t.text for t in terms), int(mark[1:]))
        return node


def parse(text: str) -> list:
    """The and-then parts of a query."""
    parser = _Parser(_tokens(text))
    if not parser.tokens:
        raise QueryError("an empty query")
    parts = [parser.either()]
    while parser.peek() == ",":
        parser.take()
        parts.append(parser.either())
    if parser.peek():
        raise QueryError(f"unexpected {parser.peek()}")
    return parts


def multiplexed(node, fields: list[str]):
    """The query in every field: f0:(q) | f1:(q) | ..."""
    return Or(tuple(Within(f, node) for f in fields)) if len(fields) > 1 else Within(fields[0], node)


def transformed(node, change: Callable):
    """The tree with change applied to every node, children first."""
    if isinstance(node, (And, Or)):
        node = replace(node, parts=tuple(transformed(p, change) for p in node.parts))
    elif isinstance(node, (Not, Within, Weighted)):
        node = replace(node, part=transformed(node.part, change))
    return change(node)


def flat(node) -> tuple[str, tuple[str, ...]] | None:
    """("and" | "or", terms) of a query that is one plain conjunction or disjunction of terms."""
    if isinstance(node, Term):
        return "or", (node.text,)
    if isinstance(node, (And, Or)) and all(isinstance(p, Term) for p in node.parts):
        return ("and" if isinstance(node, And) else "or"), tuple(p.text for p in node.parts)
    return None

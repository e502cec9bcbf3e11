"""Text expressions: words, term processors, plain text of HTML, ratios and bins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prunella.functions.stemmer import porter2

WORD = r"[\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """The words of a text, in order; what is between them takes no position."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


#: Term processors: a term to its replacement, or to null to cancel it (its position stays).
PROCESSORS: dict[str, Callable[[Column], Column]] = {"none": lambda t: t, "downcase": F.lower}


def stop_words(terms: list[str], then: str = "downcase") -> Callable[[Column], Column]:
    """A processor that cancels the given terms."""
    base = PROCESSORS[then]
    return lambda t: F.when(~base(t).isin(terms), base(t))


def s_stemmer(term: Column) -> Column:
    """Plural stripping for English: ies to y, es to e, s to nothing, with the usual exceptions; all in one expression."""
    t = F.lower(term)
    return (
        F.when(t.rlike("[^ea]ies$"), F.regexp_replace(t, "ies$", "y"))
        .when(t.rlike("[^aeo]es$"), F.regexp_replace(t, "es$", "e"))
        .when(t.rlike("[^us]s$"), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


PROCESSORS["english"] = s_stemmer


class TermFunction:
    """A term processor in Python, which must not depend on anything but the term.

    Building an index calls it once for each distinct term of a batch; as a column expression it is an Arrow UDF.
    """

    def __init__(self, of: Callable[[str], str | None]):
        self.of = of

    def __call__(self, term: Column) -> Column:
        of = self.of

        @F.pandas_udf("string")
        def each(terms: pd.Series) -> pd.Series:
            known = {t: of(t) for t in terms.dropna().unique()}
            return terms.map(known)

        return each(term)


PROCESSORS["porter2"] = TermFunction(porter2)


def one_line(title: str | Column) -> Column:
    return F.regexp_replace(title, r"[\r\n]", " ")


def html_text(html: str | Column) -> Column:
    """The text of an HTML page: scripts, styles, comments and tags go, basic entities are resolved, blanks collapse."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: str | Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))


def ratio(a: str, b: str) -> Column:
    """a / b, 0 where b is 0 or either side is missing."""
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def random_int(low: int, high: int, seed: int) -> Column:
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")

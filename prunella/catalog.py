"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it.

`documents` is the collection (source: shard, lang: second field), the `benchmark` items are the query
log, `labels.quality` are judgements, `conversations` are fragments of virtual documents, `pages` are HTML.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.functions.scoring import bm25, tf_idf
from prunella.functions.text import PROCESSORS, html_text, stop_words, words
from prunella.operators import evaluate, features, hits, learning, pruning, renumber, search, shards, timing
from prunella.operators.boosting import Booster
from prunella.operators.index import (
    Index, build_index, concatenated, corpus_lines, document_stats, remapped, tokens, unigram_xdoc, virtual_tokens,
)
from prunella.operators.intervals import interval_scores, intervals, near, ordered_within, phrase, snippets
from prunella.plans.log_planner import LogPlanner
from prunella.plans.planner import Planner
from prunella.plans.query_language import Range
from prunella.sources import index_store
from prunella.sources.sinks import trec_run
from prunella.storage import ALL_KEYS, deleted, scratch_dir, setting, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_INDEXES: dict[tuple[str, str, str], Index] = {}

#: Terms of the fixed queries: frequent words of the collection's languages.
OR_TERMS = ("the", "and", "der", "que")
STOP = ("the", "of", "and", "de", "la", "der", "die", "el", "le")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def index_for(spark: SparkSession, sf_dir: str, fields: str = "text") -> Index:
    """The stored index of a collection, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, fields)
    if key not in _INDEXES:
        columns = {"text": "text"} if fields == "text" else {"text": "text", "source": "source"}
        _INDEXES[key] = build_index(docs_of(spark, sf_dir), columns).stored()
    return _INDEXES[key]


def log_for(spark: SparkSession, sf_dir: str, terms: int | None = None) -> DataFrame:
    return search.query_terms(table(spark, sf_dir, "benchmark"), "item_id", terms=terms)


# ------------------------------------------------------------------ SQL building blocks

W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
TOK = f"tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, {W} AS w FROM documents))"
POST = "post AS (SELECT doc_id, term, count(*) AS c FROM tok GROUP BY ALL)"
SIZES = f"sizes AS (SELECT doc_id, len({W}) AS size FROM documents)"
VOC = "voc AS (SELECT term, count(*) AS df, sum(c)::BIGINT AS cf, row_number() OVER (ORDER BY term) - 1 AS term_id FROM post GROUP BY term)"
TOT = "tot AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(c) FROM post) AS occ)"
BASE = f"WITH {TOK}, {POST}, {SIZES}, {VOC}, {TOT}"


def q_sql() -> str:
    return f"q AS (SELECT DISTINCT item_id AS qid, unnest({W}) AS term FROM benchmark)"


def w_sql(k1: float = 1.2, b: float = 0.5, size: str = "size", c: str = "c", df: str = "df", n: str = "n", occ: str = "occ") -> str:
    return f"({c} * ({k1} + 1) * greatest(1e-6, ln(({n} - {df} + 0.5) / ({df} + 0.5))) / ({c} + {k1} * (1 - {b}) + {k1} * {b} * {n} / {occ} * {size}))"


def scores_sql(k1: float = 1.2, b: float = 0.5) -> str:
    return f"""m AS (SELECT qid, q.term, doc_id, c FROM q JOIN post USING (term)),
sc AS (SELECT qid, doc_id, round(sum({w_sql(k1, b)}), 6) AS score, count(*) AS nt
       FROM m JOIN voc USING (term) JOIN sizes USING (doc_id), tot GROUP BY qid, doc_id)"""


def rank_sql(source: str, k: int) -> str:
    return f"SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


OR_SQL = f"{BASE}, {q_sql()}, {scores_sql()}"
TOP = f"{OR_SQL}, top AS ({rank_sql('sc', 1000)})"
HITS = f"{TOP}, hit AS (SELECT qid, doc_id, term_id, rank - 1 AS rank FROM top JOIN m USING (qid, doc_id) JOIN voc USING (term))"
SHARD = "sm AS (SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS shard_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS local_id FROM documents)"
SAMPLE = "csi AS (SELECT doc_id FROM documents WHERE ('0x' || substr(md5('csi' || doc_id::VARCHAR), 1, 2))::INT < 64)"


def result(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


# ------------------------------------------------------------------ index


@query(f"WITH {TOK} SELECT doc_id, pos::BIGINT AS pos, term FROM tok")
def tokenize_positions(spark, d):
    return tokens(docs_of(spark, d)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


@query(f"WITH {TOK}, {POST} SELECT doc_id, term, c AS n FROM post")
def postings_counts(spark, d):
    return index_for(spark, d).postings.select("doc_id", "term", F.col("count").cast("bigint").alias("n"))


@query(f"WITH {TOK} SELECT doc_id, term, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY ALL")
def postings_positions(spark, d):
    return index_for(spark, d).postings.select("doc_id", "term", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(f"WITH {TOK}, {POST}, {VOC} SELECT term_id, term, df, cf FROM voc")
def vocab_df_cf(spark, d):
    return index_for(spark, d).vocab.select("term_id", "term", "df", "cf")


@query(f"WITH {TOK}, {SIZES} SELECT s.doc_id, size::BIGINT AS size, count(DISTINCT term) AS n_terms FROM sizes s LEFT JOIN tok USING (doc_id) GROUP BY ALL")
def doc_sizes(spark, d):
    return index_for(spark, d).doc_stats.select("doc_id", F.col("size").cast("bigint").alias("size"), F.col("n_terms").cast("bigint").alias("n_terms"))


@query(f"""{BASE} SELECT (SELECT n FROM tot) AS n_docs, (SELECT count(*) FROM voc) AS n_terms, (SELECT count(*) FROM post) AS n_postings,
(SELECT occ::BIGINT FROM tot) AS n_occurrences, (SELECT max(c) FROM post) AS max_count, (SELECT max(size)::BIGINT FROM sizes) AS max_doc_size""")  # fmt: skip
def index_stats(spark, d):
    s = index_for(spark, d).stats
    return s.select(*(F.col(c).cast("bigint").alias(c) for c in ("n_docs", "n_terms", "n_postings", "n_occurrences", "max_count", "max_doc_size")))


_STOPS = ", ".join(f"'{t}'" for t in STOP)


@query(f"""WITH {TOK} SELECT doc_id, max(pos)::BIGINT + 1 AS size, count(*) FILTER (term NOT IN ({_STOPS})) AS n_occurrences,
coalesce(min(pos) FILTER (term NOT IN ({_STOPS})), -1)::BIGINT AS first_pos FROM tok GROUP BY doc_id""")  # fmt: skip
def stopword_position_gaps(spark, d):
    toks = tokens(docs_of(spark, d), processor=stop_words(list(STOP)))
    first = F.coalesce(F.min(F.when(F.col("term").isNotNull(), F.col("pos"))), F.lit(-1)).cast("bigint")
    return toks.groupBy("doc_id").agg((F.max("pos") + 1).cast("bigint").alias("size"), F.count("term").alias("n_occurrences"), first.alias("first_pos"))


@query(f"""WITH {TOK} SELECT stem, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(term, '[^ea]ies$') THEN regexp_replace(term, 'ies$', 'y')
WHEN regexp_matches(term, '[^aeo]es$') THEN regexp_replace(term, 'es$', 'e') WHEN regexp_matches(term, '[^us]s$') THEN regexp_replace(term, 's$', '') ELSE term END AS stem
FROM tok) GROUP BY stem""")  # fmt: skip
def stemmed_terms(spark, d):
    toks = tokens(docs_of(spark, d), processor=PROCESSORS["english"])
    return toks.groupBy(F.col("term").alias("stem")).agg(F.count("*").alias("n"))


#: Words and their stems, of the stemmer's published samples.
STEMS = {
    "consigned": "consign", "consistency": "consist", "consolations": "consol", "conspiracies": "conspiraci", "knackeries": "knackeri", "knives": "knive",
    "generated": "generat", "hopping": "hop", "hoping": "hope", "dying": "die", "news": "news", "happily": "happili", "relational": "relat", "the": "the",
}
_STEMS = ", ".join(f"('{a}', '{b}')" for a, b in STEMS.items())


@query(f"""WITH {TOK}, {POST}, s(term, stem) AS (VALUES {_STEMS}), i AS (SELECT doc_id, unnest([{', '.join(repr(w) for w in STEMS)}]) AS term FROM documents),
u AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, term FROM tok UNION ALL SELECT doc_id, term FROM i) GROUP BY ALL)
SELECT stem, count(DISTINCT doc_id) AS df, sum(c)::BIGINT AS cf FROM u JOIN s USING (term) GROUP BY stem""")  # fmt: skip
def porter2_index(spark, d):
    """An index of stems: each text with sample words behind it, of which the lists of their stems are looked up."""
    docs = docs_of(spark, d).select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.lit(" ".join(STEMS))).alias("text"))
    index = build_index(docs, processor="porter2")
    words_of = {stem: sorted(w for w in STEMS if STEMS[w] == stem) for stem in STEMS.values()}
    # Other words of the collection may share a stem: only those of the samples are asked for, by where they stand.
    plain = build_index(docs).postings.select("doc_id", "term", F.explode("positions").alias("pos"))
    own = index.postings.where(F.col("term").isin(list(words_of))).select("doc_id", F.col("term").alias("stem"), F.explode("positions").alias("pos"))
    rows = own.join(plain, ["doc_id", "pos"]).where(F.col("term").isin(list(STEMS)))
    return rows.groupBy("stem").agg(F.count_distinct("doc_id").alias("df"), F.count("*").alias("cf"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents) SELECT doc_id, array_to_string(w, ' ') AS line FROM w")
def corpus_text(spark, d):
    return corpus_lines(docs_of(spark, d))


@query(f"""{BASE} SELECT doc_id, count(*) AS n_terms, round(sum(CASE WHEN cf >= 5 THEN cf / occ ELSE 1 / occ END), 6) AS xdoc
FROM post JOIN voc USING (term), tot GROUP BY doc_id""")  # fmt: skip
def xdoc_unigram(spark, d):
    index = index_for(spark, d)
    occ = index.stats.first()["n_occurrences"]
    model = index.vocab.where("cf >= 5").select("term", (F.col("cf") / F.lit(float(occ))).alias("prob"))
    return unigram_xdoc(index.postings, model, 1.0 / occ).select("doc_id", "n_terms", F.round("xdoc", 6).alias("xdoc"))


@query(f"""WITH w AS (SELECT conv_id, turn, {W} AS w FROM conversations),
o AS (SELECT *, coalesce(sum(len(w) + 64) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
t AS (SELECT conv_id AS doc_id, start + unnest(range(0, len(w))) AS pos, unnest(w) AS term FROM o)
SELECT doc_id, term, count(*) AS n, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM t GROUP BY ALL""")  # fmt: skip
def virtual_docs_gap(spark, d):
    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("target"), F.col("turn").alias("ord"), "text")
    toks = virtual_tokens(parts)
    pos = F.col("pos").cast("bigint")
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"))


@query(f"WITH {TOK}, {POST}, m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS new_id FROM documents) SELECT new_id AS doc_id, term, c AS n FROM post JOIN m USING (doc_id)")
def remapped_postings(spark, d):
    doc_map = renumber.order_map(docs_of(spark, d), ["-doc_id"])
    return remapped(index_for(spark, d).postings, doc_map).select("doc_id", "term", F.col("count").cast("bigint").alias("n"))


@query(f"""WITH a AS (SELECT doc_id, {W} AS w FROM documents), b AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1),
u AS (SELECT doc_id, w FROM a UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM a), {W} FROM b)
SELECT doc_id, len(w)::BIGINT AS size FROM u""")  # fmt: skip
def concatenated_sizes(spark, d):
    talk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    second = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(talk.alias("text"))
    both = concatenated([docs_of(spark, d).select("doc_id", "text"), second])
    return document_stats(tokens(both), both).select("doc_id", F.col("size").cast("bigint").alias("size"))


# ------------------------------------------------------------------ search


@query(f"{OR_SQL} {rank_sql('sc', 10)}")
def bm25_or_top10(spark, d):
    return result(search.search(index_for(spark, d), log_for(spark, d), 10))


@query(f"{OR_SQL}, need AS (SELECT qid, count(*) AS need FROM q GROUP BY qid), both_ AS (SELECT sc.* FROM sc JOIN need USING (qid) WHERE nt = need) {rank_sql('both_', 10)}")
def bm25_and_top10(spark, d):
    return result(search.search(index_for(spark, d), log_for(spark, d), 10, mode="and"))


@query(f"{BASE}, {q_sql()}, {scores_sql(1.2, 0.3)} {rank_sql('sc', 10)}")
def bm25_params_12_03(spark, d):
    return result(search.search(index_for(spark, d), log_for(spark, d), 10, scorer=lambda *c: bm25(*c, 1.2, 0.3)))


@query(f"{OR_SQL} SELECT qid, doc_id, score, rank - 5 AS rank FROM ({rank_sql('sc', 15)}) WHERE rank > 5")
def bm25_offset(spark, d):
    return result(search.search(index_for(spark, d), log_for(spark, d), 10, offset=5))


_TWO = f"""WITH t0 AS (SELECT 'text' AS field, doc_id, unnest({W}) AS term FROM documents
  UNION ALL SELECT 'source', doc_id, unnest(regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}]+')) FROM documents),
post AS (SELECT field, doc_id, term, count(*) AS c FROM t0 GROUP BY ALL),
voc AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
tot AS (SELECT field, (SELECT count(*) FROM documents) AS n, sum(c) AS occ FROM post GROUP BY field),
sizes AS (SELECT field, doc_id, sum(c) AS size FROM post GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS qid, unnest({W}) AS term FROM benchmark UNION SELECT item_id, 'src1' FROM benchmark),
sc AS (SELECT qid, doc_id, round(sum({w_sql()} * CASE field WHEN 'text' THEN 0.7 ELSE 0.3 END), 6) AS score
       FROM q JOIN post USING (term) JOIN voc USING (field, term) JOIN tot USING (field) JOIN sizes USING (field, doc_id) GROUP BY qid, doc_id)"""


@query(f"{_TWO} {rank_sql('sc', 10)}")
def bm25_two_fields_weighted(spark, d):
    index, log = index_for(spark, d, "both"), log_for(spark, d)
    extra = log.select("qid").distinct().withColumns({"field": F.lit("text"), "term": F.lit("src1")})
    terms = log.select("qid", "field", "term").union(extra.select("qid", "field", "term"))
    fields = terms.select("qid", F.explode(F.array(F.lit("text"), F.lit("source"))).alias("field"), "term").distinct()
    return result(search.search(index, fields, 10, weights={"text": 0.7, "source": 0.3}))


@query(f"{OR_SQL} SELECT qid, doc_id, -1.0::DOUBLE AS score, rank FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS rank FROM sc) WHERE rank <= 10")
def unscored_match(spark, d):
    return result(search.unscored(search.matches(index_for(spark, d), log_for(spark, d)), 10))


@query(f"{OR_SQL} SELECT qid, count(*) AS n_docs FROM sc GROUP BY qid")
def match_counts(spark, d):
    return search.match_counts(search.matches(index_for(spark, d), log_for(spark, d), sizes=True))


@query(f"{BASE}, {q_sql()} SELECT qid, q.term, coalesce(df, 0) AS df FROM q LEFT JOIN voc USING (term)")
def list_lengths_per_query(spark, d):
    return search.list_lengths(index_for(spark, d), log_for(spark, d))


@query(f"{OR_SQL}, top AS ({rank_sql('sc', 10)}) SELECT qid, doc_id, rank, string_agg(term_id::VARCHAR, ' ' ORDER BY term_id) AS terms FROM top JOIN m USING (qid, doc_id) JOIN voc USING (term) GROUP BY ALL")
def matched_term_numbers(spark, d):
    index, log = index_for(spark, d), log_for(spark, d)
    rows = search.matched_terms(search.search(index, log, 10), search.matches(index, log), index.vocab)
    return rows.select("qid", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.array_join(F.col("terms").cast("array<string>"), " ").alias("terms"))


@query(f"{OR_SQL} SELECT qid, least(count(*), 10) AS n_results, true AS timed FROM sc GROUP BY qid")
def query_times(spark, d):
    """The event log of the query log, one query after another; times differ from run to run, so here it is only that there are any."""
    times = timing.timed(index_for(spark, d), log_for(spark, d), 10)
    return times.where("n_results > 0").select("qid", "n_results", (F.col("ms") > 0).alias("timed"))


@query(f"{BASE} SELECT term, min(doc_id) AS doc_id FROM post WHERE term IN ('the', 'der') AND doc_id >= 100 GROUP BY term")
def skip_to(spark, d):
    index = index_for(spark, d)
    own = [search.first_from(index, t, 100).select(F.lit(t).alias("term"), "doc_id") for t in ("the", "der")]
    return own[0].union(own[1]).where("doc_id is not null")


def _planned(spark, d, text: str, length: int = 20, prefix_terms: int | None = None, **more) -> DataFrame:
    rows = Planner(index_for(spark, d), prefix_terms=prefix_terms).run(text, length, **more)
    return rows.select("doc_id", "score", "part", F.col("rank").cast("bigint").alias("rank"))


_HAS = "EXISTS (SELECT 1 FROM post p WHERE p.doc_id = d.doc_id AND p.term = '{}')"


def _has(term: str) -> str:
    return _HAS.format(term)


def _tree_sql(where: str, terms: str, k: int = 20) -> str:
    """Documents that `where` takes, scored on the (doc_id, term) rows of `terms`."""
    return f"""{BASE}, hit AS (SELECT d.doc_id FROM documents d WHERE {where}), contrib AS ({terms}),
sc AS (SELECT h.doc_id, coalesce(round(sum({w_sql()}), 6), 0.0) AS score FROM hit h LEFT JOIN (SELECT DISTINCT doc_id, term FROM contrib) USING (doc_id)
       LEFT JOIN post USING (doc_id, term) LEFT JOIN voc USING (term) LEFT JOIN sizes USING (doc_id), tot GROUP BY h.doc_id)
SELECT doc_id, score, 0 AS part, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {k}"""


def _terms_in(*terms: str) -> str:
    return f"SELECT doc_id, term FROM post WHERE term IN ({', '.join(repr(t) for t in terms)})"


@query(_tree_sql(f"{_has('the')} AND NOT {_has('this')}", _terms_in("the")))
def boolean_not(spark, d):
    return _planned(spark, d, "the & !this")


@query(_tree_sql(f"({_has('with')} AND {_has('from')}) OR {_has('was')}", f"""SELECT doc_id, term FROM post d WHERE term = 'was'
UNION ALL SELECT doc_id, term FROM post d WHERE term IN ('with', 'from') AND {_has('with')} AND {_has('from')}"""))  # fmt: skip
def boolean_nested(spark, d):
    return _planned(spark, d, "(with & from) | was")


@query(_tree_sql("EXISTS (SELECT 1 FROM post p WHERE p.doc_id = d.doc_id AND p.term IN (SELECT term FROM voc WHERE starts_with(term, 'thou') ORDER BY term LIMIT 2048))",
                 "SELECT doc_id, term FROM post WHERE term IN (SELECT term FROM voc WHERE starts_with(term, 'thou') ORDER BY term LIMIT 2048)"))
def prefix_expand(spark, d):
    return _planned(spark, d, "thou*", prefix_terms=2048)


@query(f"""{_TWO.split('q AS (')[0]} hit AS (SELECT DISTINCT doc_id FROM post WHERE term IN ('with', 'src1')),
sc AS (SELECT doc_id, round(sum({w_sql()} * 0.5), 6) AS score FROM post JOIN voc USING (field, term) JOIN tot USING (field) JOIN sizes USING (field, doc_id)
       WHERE term IN ('with', 'src1') GROUP BY doc_id)
SELECT doc_id, score, 0 AS part, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20""")  # fmt: skip
def multiplex_fields(spark, d):
    rows = Planner(index_for(spark, d, "both")).run("with | src1", 20, fields=["source", "text"])
    return rows.select("doc_id", "score", "part", F.col("rank").cast("bigint").alias("rank"))


@query(f"""{BASE}, s1 AS (SELECT doc_id, round(sum({w_sql()}), 6) AS score FROM post JOIN voc USING (term) JOIN sizes USING (doc_id), tot WHERE term = 'den' GROUP BY doc_id),
s2 AS (SELECT doc_id, round(sum({w_sql()}), 6) AS score FROM post JOIN voc USING (term) JOIN sizes USING (doc_id), tot WHERE term = 'with' AND doc_id NOT IN (SELECT doc_id FROM s1) GROUP BY doc_id),
u AS (SELECT doc_id, score, 0 AS part FROM s1 UNION ALL
      SELECT doc_id, round(score * CASE WHEN (SELECT max(score) FROM s2) = 0 THEN 1 ELSE (SELECT min(score) FROM s1) / (SELECT max(score) FROM s2) END, 6), 1 FROM s2)
SELECT doc_id, score, part, rank FROM (SELECT *, row_number() OVER (ORDER BY part, score DESC, doc_id) AS rank FROM u) WHERE rank <= 400""")  # fmt: skip
def andthen_rescaled(spark, d):
    return _planned(spark, d, "den, with", 400)


#: A structured query of the words t0 .. t9 of a text of the log (from its first word on, again and again if it has fewer).
LOG_SHAPE = '((%s & %s) | "%s %s") & !%s, (%s %s)~8 | (%s < %s) | %s*'


@query(f"""{BASE}, q AS (SELECT item_id AS qid, {W} AS w FROM benchmark), s AS MATERIALIZED (SELECT qid, k, w[1 + k % len(w)] AS term FROM q, (SELECT unnest(range(10)) AS k) WHERE len(w) > 0),
tk AS MATERIALIZED (SELECT qid, k, doc_id, pos FROM s JOIN tok USING (term)),
both_ AS (SELECT qid, doc_id FROM (SELECT DISTINCT qid, k, doc_id FROM tk WHERE k IN (0, 1)) GROUP BY ALL HAVING count(*) = 2),
ph AS (SELECT DISTINCT x.qid, x.doc_id FROM tk x JOIN tk y ON y.qid = x.qid AND y.doc_id = x.doc_id AND y.pos = x.pos + 1 WHERE x.k = 2 AND y.k = 3),
nr AS (SELECT DISTINCT x.qid, x.doc_id FROM tk x JOIN tk y ON y.qid = x.qid AND y.doc_id = x.doc_id AND abs(y.pos - x.pos) < 8 WHERE x.k = 5 AND y.k = 6),
od AS (SELECT x.qid, x.doc_id FROM (SELECT qid, doc_id, min(pos) AS p FROM tk WHERE k = 7 GROUP BY ALL) x JOIN (SELECT qid, doc_id, max(pos) AS p FROM tk WHERE k = 8 GROUP BY ALL) y
       ON y.qid = x.qid AND y.doc_id = x.doc_id AND y.p > x.p),
c0 AS (SELECT * FROM (SELECT qid, doc_id, term FROM both_ JOIN s USING (qid) WHERE k IN (0, 1) UNION SELECT qid, doc_id, term FROM ph JOIN s USING (qid) WHERE k IN (2, 3))
       ANTI JOIN (SELECT qid, doc_id FROM tk WHERE k = 4) USING (qid, doc_id)),
c1 AS (SELECT qid, doc_id, term FROM nr JOIN s USING (qid) WHERE k IN (5, 6) UNION SELECT qid, doc_id, term FROM od JOIN s USING (qid) WHERE k IN (7, 8)
       UNION SELECT s.qid, post.doc_id, post.term FROM s JOIN voc ON starts_with(voc.term, s.term) JOIN post ON post.term = voc.term WHERE k = 9),
s0 AS (SELECT qid, doc_id, round(sum({w_sql()}), 6) AS score FROM c0 JOIN post USING (doc_id, term) JOIN voc USING (term) JOIN sizes USING (doc_id), tot GROUP BY qid, doc_id),
s1 AS (SELECT * FROM (SELECT qid, doc_id, round(sum({w_sql()}), 6) AS score FROM c1 JOIN post USING (doc_id, term) JOIN voc USING (term) JOIN sizes USING (doc_id), tot GROUP BY qid, doc_id)
       ANTI JOIN s0 USING (qid, doc_id)),
u AS (SELECT qid, doc_id, score, 0 AS part FROM s0 UNION ALL SELECT qid, doc_id, score * CASE WHEN worst IS NULL OR best = 0 THEN 1 ELSE worst / best END, 1
      FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM s1) LEFT JOIN (SELECT qid, min(score) AS worst FROM s0 GROUP BY qid) USING (qid))
SELECT qid, doc_id, round(score, 6) AS score, part, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, score DESC, doc_id) AS rank FROM u) WHERE rank <= 50""")  # fmt: skip
def structured_log(spark, d):
    """The whole log as nested queries of two and-then parts, planned together."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), words(F.lower("text")).alias("w")).where("size(w) > 0")
    shape = F.format_string(LOG_SHAPE, *(F.expr(f"w[{k} % size(w)]") for k in range(10)))
    rows = LogPlanner(index_for(spark, d)).run(items.select("qid", shape.alias("text")), 50)
    return rows.select("qid", "doc_id", "score", "part", F.col("rank").cast("bigint").alias("rank"))


def _phrase_sql(*terms: str) -> str:
    joins = " ".join(f"JOIN tok t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{t}'" for k, t in enumerate(terms) if k)
    return f"WITH {TOK} SELECT DISTINCT t0.doc_id FROM tok t0 {joins} WHERE t0.term = '{terms[0]}'"


@query(_phrase_sql("of", "the"))
def phrase_match(spark, d):
    return phrase(index_for(spark, d).postings, "text", ("of", "the"))


@query(f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos > a.pos AND b.pos - a.pos < 6 WHERE a.term = 'with' AND b.term = 'the'")
def ordered_pair_within_n(spark, d):
    return ordered_within(index_for(spark, d).postings, "text", ("with", "the"), 6)


@query(f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND abs(b.pos - a.pos) < 5 WHERE a.term = 'with' AND b.term = 'from'")
def proximity_match(spark, d):
    return near(index_for(spark, d).postings, "text", ("with", "from"), 5)


@query(f"""WITH {TOK}, a AS (SELECT doc_id, pos FROM tok WHERE term = 'with'), b AS (SELECT doc_id, pos FROM tok WHERE term = 'from'),
p AS (SELECT a.doc_id, least(a.pos, b.pos) AS l, greatest(a.pos, b.pos) AS r FROM a JOIN b ON a.doc_id = b.doc_id),
mn AS (SELECT DISTINCT doc_id, l, r FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.doc_id = x.doc_id AND y.l >= x.l AND y.r <= x.r AND (y.l > x.l OR y.r < x.r)))
SELECT doc_id, string_agg(l || '-' || r, ' ' ORDER BY l) AS spans FROM mn GROUP BY doc_id""")  # fmt: skip
def proximity_minimal_intervals(spark, d):
    rows = intervals(index_for(spark, d).postings, "text", ("with", "from"))
    return rows.select("doc_id", F.array_join(F.transform("intervals", lambda s: F.concat_ws("-", s["left"], s["right"])), " ").alias("spans"))


@query(SQL["proximity_minimal_intervals"].rpartition("SELECT doc_id")[0] + "SELECT doc_id, round(sum(least(1.0, 16.0 / (r - l + 1)::DOUBLE)), 6) AS score FROM mn GROUP BY doc_id")
def proximity_scores(spark, d):
    return interval_scores(index_for(spark, d).postings, "text", ("with", "from"))


@query(SQL["proximity_minimal_intervals"].rpartition("SELECT doc_id")[0] + f""", f AS (SELECT doc_id, min(l) AS l, min_by(r, l) AS r FROM mn WHERE r - l < 40 GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(range(greatest(l - 4, 0), least(r + 5, len(w))), lambda i: CASE WHEN i BETWEEN l AND r THEN '<b>' || w[i + 1] || '</b>' ELSE w[i + 1] END), ' ') AS snippet
FROM w JOIN f USING (doc_id)""")
def snippet_marks(spark, d):
    found = intervals(index_for(spark, d).postings, "text", ("with", "from"), most=4, longest=40)
    return snippets(docs_of(spark, d), found)


@query(f"{BASE}, {q_sql()}, {scores_sql()}, t AS (SELECT * FROM sc WHERE doc_id >= round((SELECT n FROM tot) * 0.2) AND doc_id < round((SELECT n FROM tot) * 0.6)) {rank_sql('t', 10)}")
def tier_filter(spark, d):
    index, log = index_for(spark, d), log_for(spark, d)
    n = index.stats.first()["n_docs"]
    found = search.tiered(search.matches(index, log, sizes=True), n, 0.2, 0.6)
    return result(search.ranked(search.scored(found, index), 10))


@query(f"{OR_SQL}, t AS (SELECT * FROM sc WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) {rank_sql('t', 10)}")
def doclist_semi(spark, d):
    index, log = index_for(spark, d), log_for(spark, d)
    keep = table(spark, d, "labels").where("quality = 1")
    return result(search.ranked(search.scored(search.within(search.matches(index, log, sizes=True), keep), index), 10))


@query(f"""{OR_SQL}, tf AS (SELECT qid, doc_id, round(sum(c / size * ln(n / df)), 6) AS score FROM m JOIN voc USING (term) JOIN sizes USING (doc_id), tot GROUP BY qid, doc_id),
e AS (SELECT qid, doc_id, sum(s) AS s FROM (
  SELECT qid, doc_id, score / CASE WHEN top > 0 THEN top ELSE 1 END * 2 AS s FROM sc JOIN (SELECT qid, max(score) FILTER (doc_id < 500) AS top FROM sc GROUP BY qid) USING (qid)
  UNION ALL SELECT qid, doc_id, score / CASE WHEN top > 0 THEN top ELSE 1 END FROM tf JOIN (SELECT qid, max(score) FILTER (doc_id < 500) AS top FROM tf GROUP BY qid) USING (qid)) GROUP BY qid, doc_id),
r AS (SELECT qid, doc_id, round(s, 6) AS score FROM e) {rank_sql('r', 10)}""")  # fmt: skip
def aggregate_equalised(spark, d):
    index, log = index_for(spark, d), log_for(spark, d)
    found = search.matches(index, log, sizes=True)
    both = [(search.scored(found, index), 2.0), (search.scored(found, index, tf_idf), 1.0)]
    return result(search.ranked(search.equalised(both, 500), 10))


@query("SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'")
def payload_range(spark, d):
    payloads = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "ts")
    docs = Planner(index_for(spark, d), payloads).range("ts", Range("2024-01-05", "2024-01-10")).docs
    return docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


# ------------------------------------------------------------------ pruning

LEVELS = (0.01, 0.05, 0.1, 0.3)
_PF = f"pf AS (SELECT term_id, post.term, doc_id, df, c, round({w_sql()}, 6) AS bm25 FROM post JOIN voc USING (term) JOIN sizes USING (doc_id), tot)"
_PL = f"{BASE}, {_PF}, pl AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, term_id, doc_id) - 1 AS ord FROM pf)"
_KEPT = f"{_PL}, kp AS (SELECT term, doc_id FROM pl WHERE ord <= ceil((SELECT count(*) FROM post) * 0.3))"


def posting_list(spark, d) -> DataFrame:
    rows = features.posting_features(index_for(spark, d)).select("term_id", "doc_id", "p_bm25")
    return pruning.posting_order(rows, [F.desc("p_bm25"), F.col("term_id"), F.col("doc_id")])


@query(f"""{_PL} SELECT l AS level, count(*) AS n_postings, count(DISTINCT term_id) AS n_terms, count(DISTINCT doc_id) AS n_docs
FROM pl, (SELECT unnest([1, 5, 10, 30]) AS l) WHERE ord <= ceil((SELECT count(*) FROM post) * l / 100) GROUP BY l""")  # fmt: skip
def prune_postings_levels(spark, d):
    rows, n = posting_list(spark, d), index_for(spark, d).postings.count()
    thresholds = {round(t * 100): -(-round(n * t * 10**9) // 10**9) + 1 for t in LEVELS}
    found = pruning.level_counts(rows, thresholds, F.col("ord"), ("term_id", "doc_id"))
    return found.select("level", F.col("n").alias("n_postings"), F.col("n_term_id").alias("n_terms"), F.col("n_doc_id").alias("n_docs"))


@query(f"""{BASE}, o AS (SELECT doc_id, size, sum(size) OVER (ORDER BY size DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM sizes)
SELECT l AS level, count(*) AS n_docs, sum(size)::BIGINT AS mass FROM o, (SELECT unnest([1, 5, 10, 30]) AS l)
WHERE cum - size < ceil((SELECT sum(size) FROM sizes) * l / 100) GROUP BY l""")  # fmt: skip
def prune_docs_levels(spark, d):
    stats = index_for(spark, d).doc_stats.select("doc_id", F.col("size").cast("bigint").alias("size"))
    rows = pruning.document_order(stats, [F.desc("size"), F.col("doc_id")])
    total = stats.agg(F.sum("size").alias("n")).first()["n"]
    thresholds = {round(t * 100): -(-round(total * t * 10**9) // 10**9) for t in LEVELS}
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(n).alias("below")) for k, n in thresholds.items()))
    kept = rows.select("size", F.explode(F.filter(levels, lambda x: F.col("cum") - F.col("size") < x["below"])["level"]).alias("level"))
    return kept.groupBy("level").agg(F.count("*").alias("n_docs"), F.sum("size").alias("mass"))


def pruned(spark, d, level: float = 0.3) -> Index:
    key = (spark.sparkContext.applicationId, d, f"pruned{level}")
    if key not in _INDEXES:
        index = index_for(spark, d)
        rows = written(features.posting_features(index).select("term_id", "doc_id", "p_bm25"), "posting-scores")
        kept = pruning.best_postings(rows, "p_bm25", [F.col("term_id"), F.col("doc_id")], rows.count(), level)
        kept = written(kept.join(index.vocab.select("field", "term", "term_id"), "term_id").select("field", "term", "doc_id"), "kept-postings")
        deleted(rows)
        _INDEXES[key] = pruning.pruned_index(index, kept, store=True)
        deleted(kept)
    return _INDEXES[key]


@query(f"""{_KEPT} SELECT (SELECT count(DISTINCT doc_id) FROM kp) AS n_docs, (SELECT count(DISTINCT term) FROM kp) AS n_terms, (SELECT count(*) FROM kp) AS n_postings,
(SELECT sum(c)::BIGINT FROM kp JOIN post USING (term, doc_id)) AS n_occurrences""")  # fmt: skip
def pruned_index_stats(spark, d):
    return pruned(spark, d).stats.select(*(F.col(c).cast("bigint").alias(c) for c in ("n_docs", "n_terms", "n_postings", "n_occurrences")))


@query(f"""{_KEPT}, lp AS (SELECT post.* FROM post JOIN kp USING (term, doc_id)), lv AS (SELECT term, count(*) AS df FROM lp GROUP BY term),
lt AS (SELECT count(DISTINCT doc_id) AS n, sum(c) AS occ FROM lp), {q_sql()},
sc AS (SELECT qid, doc_id, round(sum({w_sql()}), 6) AS score FROM q JOIN lp USING (term) JOIN lv USING (term) JOIN sizes USING (doc_id), lt GROUP BY qid, doc_id) {rank_sql('sc', 10)}""")  # fmt: skip
def bm25_pruned_local(spark, d):
    return result(search.search(pruned(spark, d), log_for(spark, d), 10))


_GLOBAL = f"""{_KEPT}, lp AS (SELECT post.* FROM post JOIN kp USING (term, doc_id)), {q_sql()},
sc AS (SELECT qid, doc_id, round(sum({w_sql()}), 6) AS score FROM q JOIN lp USING (term) JOIN voc USING (term) JOIN sizes USING (doc_id), tot GROUP BY qid, doc_id)"""


@query(f"{_GLOBAL} {rank_sql('sc', 10)}")
def bm25_pruned_global(spark, d):
    return result(search.search(pruned(spark, d), log_for(spark, d), 10, **pruning.global_statistics(index_for(spark, d))))


@query(f"""{_GLOBAL}, other AS ({rank_sql('sc', 100)}), full_ AS (SELECT qid, doc_id, round(sum({w_sql()}), 6) AS score FROM q JOIN post USING (term) JOIN voc USING (term) JOIN sizes USING (doc_id), tot GROUP BY qid, doc_id),
base AS ({rank_sql('full_', 100)})
SELECT k AS depth, round(avg(share), 6) AS overlap FROM (SELECT k, b.qid, count(o.doc_id) / count(*) AS share FROM (SELECT unnest([10, 100]) AS k) JOIN base b ON b.rank <= k
LEFT JOIN other o ON o.qid = b.qid AND o.doc_id = b.doc_id AND o.rank <= k GROUP BY k, b.qid) GROUP BY k""")  # fmt: skip
def overlap_at_k(spark, d):
    index, log = index_for(spark, d), log_for(spark, d)
    base = search.search(index, log, 100)
    other = search.search(pruned(spark, d), log, 100, **pruning.global_statistics(index))
    return pruning.overlap(base, other, (10, 100))


@query(f"""{_KEPT}, {q_sql()}, {scores_sql()}, top AS ({rank_sql('sc', 10)})
SELECT qid, count(DISTINCT kp.doc_id) AS docs_kept, count(kp.doc_id) AS postings_kept FROM top JOIN m USING (qid, doc_id) LEFT JOIN kp ON kp.doc_id = m.doc_id AND kp.term = m.term GROUP BY qid""")  # fmt: skip
def overlap_docs_postings(spark, d):
    index, log = index_for(spark, d), log_for(spark, d)
    return pruning.surviving(search.search(index, log, 10), search.matches(index, log), pruned(spark, d))


# ------------------------------------------------------------------ shards


def shard_map_of(spark, d) -> DataFrame:
    key = (spark.sparkContext.applicationId, d, "shards")
    if key not in _INDEXES:
        _INDEXES[key] = written(shards.shard_map(docs_of(spark, d), "source"), "shards")
    return _INDEXES[key]


@query(f"WITH {SHARD} SELECT doc_id, shard_id::BIGINT AS shard_id, local_id FROM sm")
def shard_map(spark, d):
    return shard_map_of(spark, d).select("doc_id", F.col("shard_id").cast("bigint").alias("shard_id"), "local_id")


@query(f"{BASE}, {SHARD} SELECT shard_id::BIGINT AS shard_id, term, count(*) AS df, any_value(df) AS global_df FROM post JOIN sm USING (doc_id) JOIN voc USING (term) GROUP BY shard_id, term")
def shard_global_df(spark, d):
    rows = shards.shard_statistics(index_for(spark, d), shard_map_of(spark, d))
    return rows.select(F.col("shard_id").cast("bigint").alias("shard_id"), "term", "df", "global_df")


@query(f"WITH {SAMPLE} SELECT doc_id FROM csi")
def csi_sample(spark, d):
    return shards.hash_sample(docs_of(spark, d), 64).select("doc_id")


_CSI = f"""{BASE}, {SHARD}, {SAMPLE}, cp AS (SELECT * FROM post WHERE doc_id IN (SELECT doc_id FROM csi)), cv AS (SELECT term, count(*) AS df FROM cp GROUP BY term),
ct AS (SELECT (SELECT count(*) FROM csi) AS n, sum(c) AS occ FROM cp), {q_sql()},
cs AS (SELECT qid, doc_id, round(sum({w_sql()}), 6) AS score FROM q JOIN cp USING (term) JOIN cv USING (term) JOIN sizes USING (doc_id), ct GROUP BY qid, doc_id),
ctop AS ({rank_sql('cs', shards.SAMPLE_DEPTH)}),
cnt AS (SELECT shard_id, count(*) AS size, count(csi.doc_id) AS sampled FROM sm LEFT JOIN csi USING (doc_id) GROUP BY shard_id HAVING count(csi.doc_id) > 0),
hc AS (SELECT qid, shard_id, count(*) AS hits FROM ctop JOIN sm USING (doc_id) GROUP BY ALL),
rd AS (SELECT x.qid, cnt.shard_id, coalesce(hits, 0) * size / sampled AS score FROM (SELECT DISTINCT qid FROM ctop) x CROSS JOIN cnt LEFT JOIN hc ON hc.qid = x.qid AND hc.shard_id = cnt.shard_id),
rp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, shard_id) AS place FROM rd)"""


def sample_hits(spark, d) -> tuple[DataFrame, DataFrame]:
    sample = shards.hash_sample(docs_of(spark, d), 64)
    key = (spark.sparkContext.applicationId, d, "sample-index")
    if key not in _INDEXES:
        _INDEXES[key] = shards.subset_index(index_for(spark, d), sample, store=True)
    return written(search.search(_INDEXES[key], log_for(spark, d), shards.SAMPLE_DEPTH), "sample-hits"), sample


@query(f"{_CSI} SELECT qid, shard_id::BIGINT AS shard_id, round(score, 6) AS score, place FROM rp WHERE place <= 10")
def redde_shards(spark, d):
    top, sample = sample_hits(spark, d)
    rows = shards.redde(top, shard_map_of(spark, d), sample, 10)
    return rows.select("qid", F.col("shard_id").cast("bigint").alias("shard_id"), F.round("score", 6).alias("score"), F.col("place").cast("bigint").alias("place"))


@query(f"""{_CSI} SELECT qid, shard_id::BIGINT AS shard_id, round(sum(score * pow(50.0, -(rank - 1))), 6) AS score FROM ctop JOIN sm USING (doc_id)
GROUP BY qid, shard_id HAVING sum(score * pow(50.0, -(rank - 1))) > 1e-4""")  # fmt: skip
def ranks_shards(spark, d):
    top, _ = sample_hits(spark, d)
    rows = shards.rank_s(top, shard_map_of(spark, d))
    return rows.select("qid", F.col("shard_id").cast("bigint").alias("shard_id"), F.round("score", 6).alias("score"))


_SEL = f"""{_CSI}, ss AS (SELECT qid, doc_id, round(sum({w_sql()}), 6) AS score FROM q JOIN post USING (term) JOIN sm USING (doc_id)
JOIN (SELECT qid, shard_id FROM rp WHERE place <= 3) USING (qid, shard_id) JOIN voc USING (term) JOIN sizes USING (doc_id), tot GROUP BY qid, doc_id)"""


def shard_folders(spark, d) -> DataFrame:
    """The postings by shard, stored once in a session."""
    key = (spark.sparkContext.applicationId, d, "shard-folders")
    if key not in _INDEXES:
        path = f"{scratch_dir(spark)}/prunella/shards-{uuid.uuid4().hex}"
        index_store.save_shards(index_for(spark, d), shard_map_of(spark, d), path, positions=False)
        _INDEXES[key] = spark.read.parquet(path)
    return _INDEXES[key]


def selected(spark, d, length: int) -> DataFrame:
    top, sample = sample_hits(spark, d)
    places = written(shards.redde(top, shard_map_of(spark, d), sample, 10), "selection")
    return shards.search_shards(index_for(spark, d), shard_folders(spark, d), log_for(spark, d), places, 3, length)


@query(f"{_SEL} {rank_sql('ss', 10)}")
def selective_search(spark, d):
    return result(selected(spark, d, 10))


@query(f"""{_SEL}, act AS ({rank_sql('ss', 20)}), fu AS (SELECT qid, doc_id, round(sum({w_sql()}), 6) AS score FROM q JOIN post USING (term) JOIN voc USING (term) JOIN sizes USING (doc_id), tot GROUP BY qid, doc_id),
org AS ({rank_sql('fu', 20)})
SELECT org.qid, round(count(act.doc_id) / count(*), 6) AS "precision" FROM org LEFT JOIN act ON act.qid = org.qid AND act.doc_id = org.doc_id GROUP BY org.qid""")  # fmt: skip
def shard_precision_at_k(spark, d):
    full = search.search(index_for(spark, d), log_for(spark, d), 20)
    return evaluate.precision_at(full, selected(spark, d, 20))


@query(f"""{TOP}, b AS (SELECT DISTINCT qid, unnest(range(0, 10)) AS segment FROM top), c AS (SELECT qid, floor(doc_id * 10 / (SELECT n FROM tot))::BIGINT AS segment, count(*) AS n FROM top GROUP BY ALL)
SELECT qid, segment, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (qid, segment)""")  # fmt: skip
def segment_counts(spark, d):
    index = index_for(spark, d)
    return shards.segment_counts(search.search(index, log_for(spark, d)), index.stats.first()["n_docs"], 10)


@query(f"{OR_SQL}, {SHARD}, top AS ({rank_sql('sc', 10)}) SELECT qid, shard_id::BIGINT AS shard_id, string_agg(doc_id::VARCHAR, ' ' ORDER BY rank) AS results_global FROM top JOIN sm USING (doc_id) GROUP BY ALL")
def results_to_global_ids(spark, d):
    own = search.search(index_for(spark, d), log_for(spark, d), 10).join(shard_map_of(spark, d), "doc_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "local_id"))), lambda s: s["local_id"].cast("string")), " ")
    local = own.groupBy("qid", "shard_id").agg(joined.alias("results"))
    rows = shards.global_ids_of_strings(written(local, "local"), shard_map_of(spark, d))
    return rows.select("qid", F.col("shard_id").cast("bigint").alias("shard_id"), "results_global")


# ------------------------------------------------------------------ hits and features


def hits_of(spark, d) -> DataFrame:
    key = (spark.sparkContext.applicationId, d, "hits")
    if key not in _INDEXES:
        index, log = index_for(spark, d), log_for(spark, d)
        _INDEXES[key] = written(hits.raw_hits(search.search(index, log), search.matches(index, log), index.vocab), "hits")
    return _INDEXES[key]


@query(f"{HITS} SELECT qid, doc_id, term_id, rank FROM hit")
def raw_hits(spark, d):
    return hits_of(spark, d).select("qid", "doc_id", "term_id", F.col("rank").cast("bigint").alias("rank"))


def _bins_sql(prefix: str, keys: str) -> str:
    low = (0, *hits.FEATURE_LIMITS[:-1])
    bins = ", ".join(f"count(*) FILTER (rank + 1 > {a} AND rank + 1 <= {b}) AS {prefix}_b{b}" for a, b in zip(low, hits.FEATURE_LIMITS, strict=True))
    tops = f"count(*) FILTER (rank < 10) AS {prefix}_top10, count(*) FILTER (rank < 1280) AS {prefix}_top1k"
    return f"SELECT {keys}, {bins}, {tops} FROM hit GROUP BY {keys}"


def _whole(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in frame.dtypes))


@query(f"{HITS} {_bins_sql('dh', 'doc_id')}")
def doc_hit_bins(spark, d):
    return _whole(hits.binned(hits_of(spark, d), ["doc_id"], "dh"))


@query(f"{HITS} {_bins_sql('ph', 'doc_id, term_id')}")
def posting_hit_bins(spark, d):
    return _whole(hits.binned(hits_of(spark, d), ["doc_id", "term_id"], "ph"))


@query(f"{HITS} SELECT doc_id, term_id, rank, count(*) AS hits FROM hit GROUP BY ALL")
def counted_hits(spark, d):
    return _whole(hits.counted(hits_of(spark, d)))


@query(f"{HITS} {_bins_sql('dh', 'doc_id')}")
def merge_partial_hits(spark, d):
    rows = hits_of(spark, d)
    parts = [hits.binned(rows.where(F.col("qid") % 2 == k), ["doc_id"], "dh") for k in (0, 1)]
    return _whole(hits.merged(parts, ["doc_id"]))


@query(f"{HITS} SELECT doc_id, round(count(*) / size, 6) AS hits_per_word FROM hit JOIN sizes USING (doc_id) WHERE size > 0 GROUP BY doc_id, size")
def hits_by_size(spark, d):
    return hits.hits_by_size(hits.binned(hits_of(spark, d), ["doc_id"], "dh"), index_for(spark, d).doc_stats)


@query(f"{BASE}, {_PF} SELECT term_id, doc_id, df AS p_tfreq, c AS p_tdfreq, bm25 AS p_bm25 FROM pf")
def posting_features(spark, d):
    return features.posting_features(index_for(spark, d))


_FT = f"""{HITS}, {_PF}, dh AS ({_bins_sql('dh', 'doc_id')}), ph AS ({_bins_sql('ph', 'doc_id, term_id')}),
xd AS (SELECT doc_id, count(*) AS terms, sum(CASE WHEN cf >= 5 THEN cf / occ ELSE 1 / occ END) AS x FROM post JOIN voc USING (term), tot GROUP BY doc_id)"""


def _documents_of(index: Index) -> DataFrame:
    occ = index.stats.first()["n_occurrences"]
    model = index.vocab.where("cf >= 5").select("term", (F.col("cf") / F.lit(float(occ))).alias("prob"))
    return features.document_features(index, unigram_xdoc(index.postings, model, 1.0 / occ))


def features_of(spark, d, depth: int | None = None) -> DataFrame:
    """All features of every posting; with a depth, their labels too, which come with the posting's hits."""
    index, rows = index_for(spark, d), hits_of(spark, d)
    documents = _documents_of(index)
    own = hits.binned(rows, ["doc_id", "term_id"], "ph")
    if depth:  # a posting with a label has hits
        own = own.join(features.labels(rows, depth), ["doc_id", "term_id"], "left")
    return features.feature_table(features.posting_features(index), documents, hits.binned(rows, ["doc_id"], "dh"), own)


@query(f"""{_FT} SELECT term_id, doc_id, df AS p_tfreq, c AS p_tdfreq, bm25 AS p_bm25, size::BIGINT AS d_size, terms AS d_terms, round(x, 6) AS d_xdoc, round(size / terms, 6) AS d_size_per_term,
round(x / size, 6) AS d_xdoc_per_size, coalesce(dh_top10, 0) AS dh_top10, coalesce(ph_top1k, 0) AS ph_top1k, round(coalesce(dh_top10, 0) / size, 6) AS dh_top10_per_size, round(coalesce(ph_top1k, 0) / df, 6) AS ph_top1k_per_tfreq
FROM pf JOIN sizes USING (doc_id) JOIN xd USING (doc_id) LEFT JOIN dh USING (doc_id) LEFT JOIN ph USING (doc_id, term_id)""")  # fmt: skip
def feature_table(spark, d):
    rows = features_of(spark, d)
    whole = ["p_tfreq", "p_tdfreq", "d_size", "d_terms", "dh_top10", "ph_top1k"]
    real = ["p_bm25", "d_xdoc", "d_size_per_term", "d_xdoc_per_size", "dh_top10_per_size", "ph_top1k_per_tfreq"]
    return rows.select("term_id", "doc_id", *(F.col(c).cast("bigint").alias(c) for c in whole), *(F.round(c, 6).alias(c) for c in real))


def _label_sql(depth: int) -> str:
    return f"{HITS}, {_PF} SELECT pf.term_id, pf.doc_id, count(hit.rank) AS label FROM pf LEFT JOIN hit ON hit.term_id = pf.term_id AND hit.doc_id = pf.doc_id AND hit.rank < {depth} GROUP BY ALL"


@query(_label_sql(10))
def labels_top10(spark, d):
    rows = features.posting_keys(index_for(spark, d))
    return features.labelled(rows, features.labels(hits_of(spark, d), 10))


@query(_label_sql(1000))
def labels_top1k(spark, d):
    rows = features.posting_keys(index_for(spark, d))
    return features.labelled(rows, features.labels(hits_of(spark, d), 1000))


@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem")
def features_cast_double(spark, d):
    return features.all_double(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))


@query("SELECT o_orderkey AS id, o_totalprice AS price, n AS lines, q AS quantity FROM orders JOIN (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def feature_join_on_id(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    return features.joined([orders, lines.agg(F.count("*").alias("lines")), lines.agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))])


# ------------------------------------------------------------------ orders, runs, evaluation, sources


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS new_id FROM documents")
def cluster_ordering(spark, d):
    return renumber.order_map(docs_of(spark, d), ["source"])


@query(f"WITH {TOK}, {POST}, m AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS new_id FROM documents) SELECT term, min(new_id) AS first_doc, max(new_id) AS last_doc, count(*) AS df FROM post JOIN m USING (doc_id) GROUP BY term")
def renumber_docs(spark, d):
    doc_map = renumber.order_map(docs_of(spark, d), ["source"])
    postings = remapped(index_for(spark, d).postings, doc_map)
    return postings.groupBy("term").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("df"))


@query(f"""{OR_SQL}, top AS ({rank_sql('sc', 10)}) SELECT qid AS topic, rank - 1 AS rank, format('{{}} Q0 doc{{}} {{}} {{:.10f}} run', qid, doc_id, rank - 1, score) AS line FROM top""")
def trec_run_lines(spark, d):
    titles = docs_of(spark, d).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("title"))
    rows = trec_run(search.search(index_for(spark, d), log_for(spark, d), 10), titles, "run")
    return rows.select("topic", F.col("rank").cast("bigint").alias("rank"), "line")


@query(f"""{TOP}, j AS (SELECT qid, doc_id, rank, coalesce(quality, 0) AS gain FROM top LEFT JOIN labels USING (doc_id)),
p AS (SELECT *, CASE WHEN gain > 0 THEN sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) / rank END AS prec FROM j),
r AS (SELECT count(*) AS n_rel FROM labels WHERE quality > 0), i AS (SELECT sum(1 / log2(k + 1)) AS ideal FROM (SELECT unnest(range(1, 11)) AS k))
SELECT qid, round(count(*) FILTER (gain > 0 AND rank <= 10) / 10, 6) AS p_at_k, round(count(*) FILTER (gain > 0) / n_rel, 6) AS recall, round(coalesce(sum(prec), 0) / n_rel, 6) AS ap,
round(coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= 10), 0) / ideal, 6) AS ndcg_at_k FROM p, r, i GROUP BY qid, n_rel, ideal""")  # fmt: skip
def relevance_metrics(spark, d):
    results = search.search(index_for(spark, d), log_for(spark, d))
    good = table(spark, d, "labels").select("doc_id", F.col("quality").alias("gain")).where("gain > 0")
    judged = results.select("qid").distinct().crossJoin(good)  # the same judgements for every query
    return evaluate.relevance(results, judged, 10)


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b)
SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM c""")
def html_text_extract(spark, d):
    return table(spark, d, "pages").select("page_id", html_text("html").alias("text"))


# ------------------------------------------------------------------ learning (not expressible in SQL)


def training_rows(spark, d, group: str = "all") -> DataFrame:
    """(term_id, doc_id, a group of features, label) of every posting; features outside the group are not made."""
    key = (spark.sparkContext.applicationId, d, f"training-{group}")
    if key not in _INDEXES:
        # Postings are dealt out by document, and stay there for the join with their hits, by document and term.
        with setting(spark, ALL_KEYS, "false"):
            _INDEXES[key] = written(features_of(spark, d, 10) if group not in ("term", "intrinsic") else _narrow_rows(spark, d, group == "intrinsic"), "training")
    return _INDEXES[key].select("term_id", "doc_id", *features.GROUPS[group], "label")


def _narrow_rows(spark, d, documents: bool) -> DataFrame:
    """Features of postings, and of documents if asked for, with labels of the first ten results: no bins of hits are made."""
    index, log = index_for(spark, d), log_for(spark, d)
    found = hits.raw_hits(search.search(index, log, 10), search.matches(index, log), index.vocab)
    return features.hitless_table(features.posting_features(index), features.labels(found, 10), _documents_of(index) if documents else None)


@query()
def rf_train_eval(spark, d):
    train, test = learning.split(training_rows(spark, d, "intrinsic"))
    model = learning.trained(train, learning.random_forest(5, 20, 5), features.GROUPS["intrinsic"])
    return spark.createDataFrame([("rf", learning.evaluated(model.transform(test)))], "model string, rmse double")


@query()
def gbt_train_predict(spark, d):
    train, test = learning.split(training_rows(spark, d, "term"))
    model = learning.trained(train, learning.slow_boosted_trees(3), features.GROUPS["term"])
    return model.transform(test).select("term_id", "doc_id", "label", "prediction")


@query()
def cv_rmse(spark, d):
    rows = training_rows(spark, d, "term").select(*features.GROUPS["term"], "label")
    found = learning.cross_validated(rows, learning.random_forest(3, 20, 3), {"maxDepth": [2, 3]}, folds=2)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(found.avgMetrics)], "setting int, rmse double")


@query()
def boosting_history(spark, d):
    """Errors after each round of L1-regularised boosting, of the rows a fold's model learns from and of those it leaves out."""
    booster = Booster(training_rows(spark, d, "intrinsic"), features.GROUPS["intrinsic"], folds=3)
    booster.fit(rounds=10)
    return booster.history()


@query()
def predict_prune_loop(spark, d):
    """Train on hits, predict for every posting, prune by prediction, and see how much of the best results survives."""
    index, log, rows = index_for(spark, d), log_for(spark, d), training_rows(spark, d)
    model = learning.trained(rows, learning.boosted_trees(3, 0.1, 3), features.GROUPS["termbased"])
    scored = model.transform(rows).select("term_id", "doc_id", "prediction").join(index.vocab.select("field", "term", "term_id"), "term_id")
    order = pruning.posting_order(scored, [F.desc("prediction"), F.col("term_id"), F.col("doc_id")])
    small = pruning.pruned_index(index, pruning.kept_postings(order, index.postings.count(), 0.3).select("field", "term", "doc_id"))
    stats = pruning.global_statistics(index)
    return pruning.overlap(search.search(index, log, 100), search.search(small, log, 100, **stats), (10, 100))

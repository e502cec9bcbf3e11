"""Mixing sources to target weights: exact block quotas, split over output shards by a hypergeometric tree.

A source is a stream of words: its documents in keyed order (by md5 of seed and id), one after another.  Its target may
ask for several passes over the stream.  The words a source gives are cut into blocks of BLOCK_WORDS; their number is
its quota.  A binary tree over the output shards halves the blocks of all sources: how many of each source go left is a
multivariate hypergeometric draw, so every shard gets exact, whole numbers.  A source's blocks are put in a keyed
permutation, of which each shard draws its own disjoint range; a shard's blocks are shuffled by a keyed hash.  The mix is
written that way: a row is the part of a document that lies in one block; each file has rows of one shard, in the order
of its shuffle, and files follow one another in that order.

All of it is DataFrame work.  Sums per source are built from sums per (source, range of the key), so no task holds a
source.  Draws are keyed hashes: reruns agree.

Defined cases: a null text has no words and is never taken; a null source is a source, the last; rows that repeat a
doc_id count and are taken one by one; an empty table gives an empty mix.  Columns besides doc_id, text and source play
no part; `sharded_documents` and `mixed_documents` return them as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prunella.llm.common import released, table, written

SEED = "prunella-mix"
#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own size.
MAX_PASSES = 3
BLOCK_WORDS = 1024
#: 2 ** SHARD_LEVELS output shards.
SHARD_LEVELS = 4
#: Documents in one range of a source's key.
RANGE_DOCS = 500
#: Hypergeometric draws over at most so many blocks are made one by one; beyond, by inversion outwards from the mode.
EXACT_DRAWS = 4096
#: Blocks in one file of a shard, about.
FILE_BLOCKS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the space before it; the last one also has the space after it.
UNIT = rf"[\x20\x09-\x0D]*{WORD}(?:[\x20\x09-\x0D]+\z)?"
#: Coprime to every number of blocks below it.
STRIDE = 2147483647


def mark_of() -> Column:
    """A row's keyed order: by md5 of the seed, its id and its text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mark, and dup (the number among rows of one mark) of each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), mark_of().alias("mark"))
    return rows.withColumn("dup", F.row_number().over(Window.partitionBy("mark").orderBy("source")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """sno, source, source_size, n_docs, target, quota_words per source.

    The shares of weight fill up like water: in order of size per weight, a source is at its cap while its cap is below
    what the level of the rest would give it.  The windows run over one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    src = src.withColumn("sno", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    src = src.withColumn("weight", F.element_at(cycle, (F.col("sno") - 1) % len(weights) + 1))
    src = src.withColumn("cap", F.col("source_size") * max_passes)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sno")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    src = (
        src.withColumn("rank", F.row_number().over(order))
        .withColumn("left", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("share", F.sum("weight").over(after))
    )
    free = F.col("cap") * F.col("share") > F.col("left") * F.col("weight")
    src = src.withColumn("level", F.min(F.when(free, F.struct("rank", "left", "share"))).over(all_))
    fill = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.share").cast("double")
    target = F.when(F.col("level").isNull() | (F.col("rank") < F.col("level.rank")), F.col("cap").cast("double")).otherwise(fill)
    return src.select(
        "sno", "source", "source_size", "n_docs", target.alias("target"),
        F.floor(target + 0.5).cast("long").alias("quota_words"),
    )


def shard_quotas(sources: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """sno and cuts: of each source's permuted blocks, the number that shards 0, 1, ... take together."""
    one = sources.select(F.struct("sno", F.ceil(F.col("quota_words") / BLOCK_WORDS).alias("k")).alias("q"))
    node = one.agg(F.array_sort(F.collect_list("q")).alias("q"))  # one entry per source
    node = node.select(F.lit(0).cast("long").alias("node"), F.expr("transform(q, x -> x.sno)").alias("sno"), F.expr("transform(q, x -> x.k)").alias("k"))
    uniform = "(shiftrightunsigned(xxhash64('{s}', node, size(acc.out), {i}), 11) + 0.5D) / 9007199254740992D"
    urn = f"""aggregate(sequence(1L, m), 0L, (h, i) -> h + IF({uniform.format(s=SEED, i="i")} * (acc.total - i + 1) < o - h, 1L, 0L))"""
    # Weights relative to that of the mode, over all that a double can tell from 0; their sum makes them exact.
    span = "sequence(0L, cast(ceil(10 * sqrt(m * (o / acc.total) * (1 - o / acc.total))) + 30 as bigint))"
    mode = "greatest(m + o - acc.total, 0L, least(m, cast(floor((m + 1D) * (o + 1D) / (acc.total + 2D)) as bigint)))"
    up = "s.up * ((o - b - j) * (m - b - j) / ((b + j + 1D) * (acc.total - o - m + b + j + 1D)))"
    down = "s.down * ((b - j) * (acc.total - o - m + b - j) / ((o - b + j + 1D) * (m - b + j + 1D)))"
    # The mode itself comes up in both directions: once too often.
    mass = f"""aggregate({span}, named_struct('up', 1D, 'down', 1D, 'sum', -1D),
        (s, j) -> named_struct('up', {up}, 'down', {down}, 'sum', s.sum + s.up + s.down), s -> s.sum)"""
    found = "CASE WHEN s.hit IS NOT NULL THEN s.hit WHEN s.rest < s.up THEN b + j WHEN s.rest < s.up + s.down THEN b - j END"
    walk = f"""aggregate({span}, named_struct('up', 1D, 'down', 1D, 'rest', 1 + {uniform.format(s=SEED, i="-1L")} * {mass}, 'hit', cast(null as double)),
        (s, j) -> named_struct('up', {up}, 'down', {down}, 'rest', s.rest - s.up - s.down, 'hit', {found}), s -> cast(coalesce(s.hit, b) as bigint))"""
    inverse = f"transform(array(cast({mode} as double)), b -> {walk})[0]"
    # m draws from a urn of acc.total blocks of which o count; the law is the same with both exchanged.
    draw = f"CASE WHEN m = 0 THEN 0L WHEN m <= {EXACT_DRAWS} THEN {urn} ELSE {inverse} END"
    step = f"""aggregate(k, named_struct('n', half, 'total', all, 'out', cast(array() as array<bigint>)), (acc, x) ->
        transform(transform(array(named_struct('m', least(x, acc.n), 'o', greatest(x, acc.n))), z -> {draw}),
        d -> named_struct('n', acc.n - d, 'total', acc.total - x, 'out', concat(acc.out, array(d))))[0]).out"""
    step = _bind(step)
    for _ in range(levels):
        node = node.withColumn("all", F.expr("aggregate(k, 0L, (a, x) -> a + x)")).withColumn("half", F.expr("all - all div 2"))
        node = node.withColumn("left", F.expr(step))
        right = F.expr("zip_with(k, left, (a, b) -> a - b)")
        pair = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("k")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("k")))
        node = node.select("sno", F.explode(pair).alias("p")).select(F.col("p.node").alias("node"), "sno", F.col("p.k").alias("k"))
    rows = node.select(F.explode(F.arrays_zip("sno", "k")).alias("p"), "node").select("p.sno", "p.k", "node")
    run = Window.partitionBy("sno").orderBy("node")
    rows = rows.withColumn("cut", F.sum("k").over(run))
    return rows.groupBy("sno").agg(F.expr("transform(array_sort(collect_list(struct(node, cut))), x -> x.cut)").alias("cuts"))


def _bind(sql: str) -> str:
    """Inside the draw, m and o are fields of the lambda variable z."""
    head, tail = sql.split("z ->", 1)
    body, rest = tail.split("d ->", 1)
    body = re.sub(r"(?<![\w.])(m|o)(?!\w)", r"z.\1", body)
    return f"{head}z ->{body}d ->{rest}"


def stream(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its source's numbers and `start`, the words of its source before it in keyed order."""
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    ranges = F.ceil(F.col("n_docs") / RANGE_DOCS)
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)))
    sums = rows.groupBy("sno", "range").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("sno").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sno", "range", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("base"))
    inner = Window.partitionBy("sno", "range").orderBy("mark", "dup").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(sums, ["sno", "range"]).withColumn("start", F.col("base") + F.col("inner")).drop("range", "base", "inner")


def passes(rows: DataFrame) -> DataFrame:
    """A row for each pass in which a row's words are taken: pass, and words (all, or the first so many in the last pass)."""
    rounds = F.expr(f"filter(sequence(0, {MAX_PASSES}), p -> p * source_size + start < quota_words)")
    taken = rows.where("size > 0").withColumn("pass", F.explode(rounds))
    left = F.col("quota_words") - F.col("pass") * F.col("source_size") - F.col("start")
    return taken.withColumn("words", F.least("size", left))


def pieces(taken: DataFrame, cuts: DataFrame, whole: bool = False) -> DataFrame:
    """The parts of each pass that fall into one block, with the block's shard and its place in the shard's shuffle.

    With whole, a document goes with the block that it begins in and is not cut at the block's end.
    """
    at = F.col("pass") * F.col("source_size") + F.col("start")
    one = taken.withColumn("at", at)
    if whole:
        one = one.withColumns({"block": F.expr(f"at div {BLOCK_WORDS}"), "first_word": F.lit(0).cast("long"), "n_words": F.col("words")})
    else:
        one = one.withColumn("block", F.explode(F.expr(f"sequence(at div {BLOCK_WORDS}, (at + words - 1) div {BLOCK_WORDS})")))
        low = F.greatest(F.col("block") * BLOCK_WORDS, "at")
        high = F.least((F.col("block") + 1) * BLOCK_WORDS, F.col("at") + F.col("words"))
        one = one.withColumn("first_word", low - F.col("at")).withColumn("n_words", high - low)
    one = one.join(cuts, "sno")
    quota = F.element_at("cuts", -1)
    shift = F.pmod(F.xxhash64(F.lit(SEED), "sno"), quota)
    place = F.pmod(F.col("block").cast("decimal(20,0)") * STRIDE + shift, quota.cast("decimal(20,0)")).cast("long")
    one = one.withColumn("place", place).withColumn("shard", F.expr("size(filter(cuts, c -> c <= place))"))
    return one.withColumn("turn", F.xxhash64(F.lit(SEED), "shard", "sno", "block")).drop("cuts")


def mixture(docs: DataFrame) -> DataFrame:
    """The mix: shard, turn (order in the shard), sno, block, doc_id, source, pass, first_word, n_words; see mixed_documents."""
    sizes = written(sized(docs), "sizes")
    sources = written(targets(sizes), "sources")
    return pieces(passes(stream(sizes, sources)), shard_quotas(sources))


def dealt(docs: DataFrame, drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """The pieces in drawn (see pieces) with the columns of docs under `row`, text and n_chars following the part that is
    in the piece; partitions go up with shard and turn, and so do the rows of each.

    A document's pieces are cut in one go where its text is, and only the parts are shuffled to their shards.  Hashes
    spread turns evenly, so the partition of a block is told by its turn, without a sample.
    """
    own = ("shard", "turn", "sno", "block", "pass", "start", "first_word", "n_words")
    takes = drawn.groupBy("mark", "dup").agg(F.first("size").alias("size"), F.collect_list(F.struct(*own)).alias("takes"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), mark_of().alias("m"), "source")
    rows = rows.withColumn("d", F.row_number().over(Window.partitionBy("m").orderBy("source"))).drop("source")
    # Not an equality, so that the rows stay as dealt out for the window: texts move once.
    same = (F.col("d") <= F.col("dup")) & (F.col("d") >= F.col("dup"))
    both = rows.join(takes, (F.col("m") == F.col("mark")) & same)
    units = f"IF(exists(takes, t -> t.n_words < size), regexp_extract_all(row.text, r'{UNIT}', 0), array())"
    part = "array_join(slice(u, cast(t.first_word + 1 as int), cast(t.n_words as int)), '')"
    cut = f"transform(array({units}), u -> transform(takes, t -> named_struct('take', t, 'part', IF(t.n_words < size, {part}, row.text))))[0]"
    rest = [c for c in docs.columns if c != "text"]
    one = both.select(F.struct(*(F.col(f"row.`{c}`") for c in rest)).alias("rest"), "size", F.explode(F.expr(cut)).alias("p"))
    out = {c: F.col(f"rest.`{c}`") for c in rest} | {"text": F.col("p.part")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("p.take.n_words") < F.col("size"), F.length("p.part").cast("long")).otherwise(F.col("rest.n_chars"))
    row = F.struct(*(out[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    # Written before they are dealt out, so that the shuffles of the texts are never on disk at the same time.
    one = written(one.select("p.take.*", row.alias("row")), "parts", compression="zstd")
    released(docs.sparkSession)
    blocks = sources.agg(F.sum(F.ceil(F.col("quota_words") / BLOCK_WORDS))).first()[0] or 0
    files = max(1, -(-int(blocks) // (FILE_BLOCKS << SHARD_LEVELS)))
    slot = F.least(F.floor((F.col("turn") / F.lit(2.0**64) + 0.5) * files), F.lit(files - 1))
    one = one.repartitionById(files << SHARD_LEVELS, (F.col("shard") * files + slot).cast("int"))
    return one.sortWithinPartitions("shard", "turn", "sno", "block", "pass", "start")


def sharded_documents(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The mix as rows of docs: a row for each part of a document that is in one block, shard by shard, each in the order
    of its shuffle.

    The parts of a document, put together, are its text.  With whole, a document is a row for each pass that takes it,
    with all its words (in the last pass, a source's last one may be cut short): what reads the mix without its order
    still has whole texts.  Other columns stay; n_chars, where there is one, follows a part.
    """
    sizes = written(sized(docs), "sizes")
    sources = written(targets(sizes), "sources")
    return dealt(docs, pieces(passes(stream(sizes, sources)), shard_quotas(sources), whole), sources).select("row.*")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The words of the mix as rows of docs, neither dealt to shards nor shuffled: each document once per pass; in the
    last pass a source's last one may be cut short.

    Other columns stay; n_chars, where there is one, follows the text that was cut.
    """
    sizes = written(sized(docs), "sizes")
    sources = written(targets(sizes), "sources")
    takes = passes(stream(sizes, sources)).select(F.struct("mark", "dup", "words", "size").alias("take"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), mark_of().alias("m"), "source")
    rows = rows.withColumn("d", F.row_number().over(Window.partitionBy("m").orderBy("source"))).drop("source")
    # Not an equality, so that the rows stay as dealt out for the window: texts move once.
    same = (F.col("d") <= F.col("take.dup")) & (F.col("d") >= F.col("take.dup"))
    both = rows.join(takes, (F.col("m") == F.col("take.mark")) & same)
    units = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.col("take.words") < F.col("take.size")
    text = F.when(cut, F.array_join(F.slice(units, F.lit(1), F.col("take.words").cast("int")), "")).otherwise(F.col("row.text"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return both.select(*(v.cast(docs.schema[c].dataType).alias(c) for c, v in out.items()))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = written(sized(docs), "sizes")
    sources = written(targets(sizes), "sources")
    rows = written(stream(sizes, sources), "stream")
    mix = dealt(docs.select("doc_id", "text", "source"), pieces(passes(rows), shard_quotas(sources)), sources)
    mix = written(mix.select("shard", "turn", "sno", "block", "pass", "start", "row.doc_id", "row.text"), "mix", compression="zstd")
    released(spark)
    drawn = mix.groupBy(F.col("sno").alias("d_sno"), F.col("start").alias("d_start")).agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("taken"))
    hit = (F.col("sno") == F.col("d_sno")) & (F.col("start") == F.col("d_start")) & (F.col("size") > 0)
    return rows.join(drawn, hit, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('prunella-mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS mark FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sno FROM d GROUP BY source),
s1 AS (SELECT *, (sno - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, sno) AS rank,
              total - coalesce(sum(cap) OVER (ORDER BY cap / weight, sno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
              (sum(weight) OVER (ORDER BY cap / weight, sno ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS share FROM s1),
lev AS (SELECT rank AS edge, rest, share FROM s2 WHERE cap * share > rest * weight ORDER BY rank LIMIT 1),
s3 AS (SELECT s2.source, source_size, CASE WHEN edge IS NULL OR rank < edge THEN cap::DOUBLE
              ELSE (lev.rest * weight)::DOUBLE / lev.share::DOUBLE END AS target FROM s2 LEFT JOIN lev ON true),
r AS (SELECT d.doc_id, d.size, source_size, target, floor(target + 0.5)::BIGINT AS quota,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY mark ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
      FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - start)) END)::BIGINT AS taken
FROM r
"""

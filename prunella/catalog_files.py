"""Registered queries for what is written to files and read back: sources, sinks, saved indexes, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunella.catalog import BASE, OR_SQL, SHARD, SQL, docs_of, index_for, log_for, query, rank_sql, result, shard_map_of
from prunella.operators import search, shards
from prunella.operators.index import build_index
from prunella.plans.planner import Planner
from prunella.sources import bit_codes, index_store, sinks
from prunella.sources import text as sources
from prunella.sources.warc import warc_documents
from prunella.storage import scratch_dir, table, written

ONE_LINE = r"regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')"


def _path(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/prunella/{name}-{uuid.uuid4().hex}"


def _lined(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\r\n]+", " ")


def _saved(spark, d) -> str:
    path = _path(spark, "saved-index")
    index_store.save_index(index_for(spark, d), path, bloom_bits=10)
    return path


@query(f"{OR_SQL} {rank_sql('sc', 10)}")
def index_reopened(spark, d):
    index, weights = index_store.open_indexes(spark, [f"{_saved(spark, d)}:1.0"])
    return result(search.search(index, log_for(spark, d), 10, weights=weights))


@query(f"{BASE} SELECT term_id, term, df FROM voc WHERE df >= 100")
def long_lists(spark, d):
    index = index_store.open_index(spark, _saved(spark, d) + index_store.IN_MEMORY)
    return search.long_lists(index, 100).select("term_id", "term", "df")


@query(f"{OR_SQL} {rank_sql('sc', 10)}")
def merged_lists(spark, d):
    found = search.search(index_for(spark, d), log_for(spark, d), 10)
    rest = search.search(index_for(spark, d), log_for(spark, d), 10, offset=10)
    return result(search.merged([found, rest], 10))


@query(f"""{BASE}, {SHARD} SELECT shard_id::BIGINT AS shard_id, term, count(*) AS n, sum(local_id)::BIGINT AS local_ids
FROM post JOIN sm USING (doc_id) WHERE shard_id = 1 GROUP BY ALL""")
def shard_postings(spark, d):
    path = _path(spark, "shards")
    index_store.save_shards(index_for(spark, d), shard_map_of(spark, d), path)
    own = index_store.open_shard(spark, path, 1).groupBy("shard_id", "term").agg(F.count("*").alias("n"), F.sum("local_id").alias("local_ids"))
    return own.withColumn("shard_id", F.col("shard_id").cast("bigint"))


@query(f"""{OR_SQL}, {SHARD}, ls AS (SELECT qid, shard_id, count(*) AS n_lists, sum(n)::BIGINT AS n_postings, max(n) AS longest
FROM (SELECT qid, shard_id, q.term, count(*) AS n FROM q JOIN post USING (term) JOIN sm USING (doc_id) GROUP BY ALL) GROUP BY ALL),
rk AS (SELECT qid, shard_id, doc_id, row_number() OVER (PARTITION BY qid, shard_id ORDER BY score DESC, doc_id) AS rank FROM sc JOIN sm USING (doc_id)),
best AS (SELECT qid, shard_id, string_agg(doc_id::VARCHAR, ' ' ORDER BY rank) AS results FROM rk WHERE rank <= 10 GROUP BY ALL)
SELECT qid, shard_id::BIGINT AS shard_id, n_lists, n_postings, longest, results FROM ls JOIN best USING (qid, shard_id)""")
def cluster_features(spark, d):
    rows = shards.cluster_features(index_for(spark, d), log_for(spark, d), shard_map_of(spark, d))
    return rows.withColumn("shard_id", F.col("shard_id").cast("bigint"))


@query("""SELECT event_id AS doc_id, -1.0::DOUBLE AS score, row_number() OVER (ORDER BY event_id) AS rank FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10' AND value >= 10 AND value <= 50""")
def payload_reopened(spark, d):
    """Ranges of typed values that are stored with an index, asked of the index opened again."""
    events = table(spark, d, "events").withColumnRenamed("event_id", "doc_id")
    path = _path(spark, "payload-index")
    index_store.save_index(build_index(events, {"text": "event_type"}, payloads={"ts": "ts", "value": "value"}), path)
    rows = Planner(index_store.open_index(spark, path)).run("click & ts:[2024-01-05 .. 2024-01-10] & value:[10 .. 50]", 1_000_000_000, scorer=False)
    return rows.select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


# ------------------------------------------------------------------ sources and sinks


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, {ONE_LINE} AS text FROM documents")
def delimited_read_back(spark, d):
    path = _path(spark, "delimited")
    sinks.write_lines(docs_of(spark, d).select("doc_id", _lined().alias("line")), path, ["doc_id"])
    return sources.delimited_documents(spark, path)


def _pages(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.regexp_replace("html", r"[\r\n]+", " ").alias("html"))


_PAGES = SQL["html_text_extract"].replace("SELECT page_id, trim(", "SELECT page_id::VARCHAR AS title, trim(")


@query(_PAGES)
def trec_read_back(spark, d):
    path = _path(spark, "trec")
    record = F.format_string("<DOC><DOCNO> %d </DOCNO>%s</DOC>", "page_id", "html")
    sinks.write_lines(_pages(spark, d).select("page_id", record.alias("line")), path, ["page_id"])
    return sources.trec_documents(spark, path, encoding="utf-8").select("title", "text")


@query(_PAGES.replace("AS text FROM c", "AS text, url AS uri FROM c JOIN pages USING (page_id)"))
def warc_read_back(spark, d):
    path = _path(spark, "warc")
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "html")
    head = F.format_string(
        "WARC/1.0\r\nWARC-Type: response\r\nWARC-Trec-Id: %d\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n", "page_id", "url", F.octet_length(body)
    )
    sinks.write_lines(_pages(spark, d).select("page_id", F.concat(head, body, F.lit("\r\n\r\n")).alias("line")), path, ["page_id"])
    return warc_documents(spark, f"{path}/part-*").select("title", "text", "uri")


@query(f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS qid, trim({ONE_LINE}) AS text FROM benchmark WHERE trim({ONE_LINE}) != ''")
def query_log_read_back(spark, d):
    path = _path(spark, "log")
    items = table(spark, d, "benchmark").select("item_id", _lined().alias("line")).where("trim(line) != ''")
    sinks.write_lines(items, path, ["item_id"])
    return sources.query_log(spark, path)


@query(f"SELECT item_id::INT AS topic, trim(replace({ONE_LINE}, ',', ' ')) AS text FROM benchmark")
def topics_read_back(spark, d):
    path = _path(spark, "topics")
    line = F.concat_ws(",", "item_id", F.replace(_lined(), F.lit(","), F.lit(" ")))
    sinks.write_lines(table(spark, d, "benchmark").select("item_id", line.alias("line")), path, ["item_id"])
    return sources.topic_queries(spark, path)


@query(f"{BASE} SELECT row_number() OVER (ORDER BY c DESC, term_id, doc_id) - 1 AS ord, term_id, doc_id FROM post JOIN voc USING (term)")
def prune_list_read_back(spark, d):
    path, index = _path(spark, "prune-list"), index_for(spark, d)
    rows = index.postings.join(index.vocab.select("field", "term", "term_id"), ["field", "term"]).withColumn("less", -F.col("count"))
    rows = rows.withColumn("line", F.concat_ws(",", "term_id", "doc_id", "count"))
    sinks.write_lines(rows, path, ["less", "term_id", "doc_id"])
    return sources.prune_list(spark, path)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, n_chars AS new_id FROM documents")
def document_map_read_back(spark, d):
    path = _path(spark, "map")
    sinks.write_lines(docs_of(spark, d).select("doc_id", F.col("n_chars").cast("string").alias("line")), path, ["doc_id"])
    return sources.document_map(spark, path)


@query(f"{BASE} SELECT term_id, df FROM voc")
def bit_codes_read_back(spark, d):
    """The list lengths of all terms as gamma codes in files of ranges of terms, decoded by byte ranges."""
    rows = index_for(spark, d).vocab.select("term_id", "df").repartitionByRange("term_id").sortWithinPartitions("term_id")

    def code(batches):
        import pyarrow as pa

        held = pa.Table.from_batches(list(batches), pa.schema([("term_id", pa.int64()), ("df", pa.int64())]))
        if held.num_rows:
            ids = held.column("term_id").to_pylist()
            yield pa.RecordBatch.from_pydict({"first": [ids[0]], "n": [len(ids)], "bits": [bit_codes.encoded(held.column("df").to_numpy())]})

    path = _path(spark, "codes")
    coded = written(rows.mapInArrow(code, "first long, n long, bits binary"), "codes")
    # A file for each range, named by its first term: what another program would have written.
    for r in coded.select("first", "bits").toLocalIterator():
        stream = index_store.created(spark, f"{path}/{r['first']:020d}")
        stream.write(bytearray(r["bits"]))
        stream.close()
    first = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    return bit_codes.coded_longs(spark, path).select((first + F.col("ord")).alias("term_id"), F.col("value").alias("df"))


@query("SELECT doc_id, n_chars, source FROM documents")
def feature_csv_read_back(spark, d):
    path = _path(spark, "features")
    sinks.write_csv(docs_of(spark, d).select("doc_id", "n_chars", "source"), path)
    return sources.feature_csv(spark, path).select(F.col("doc_id").cast("bigint"), F.col("n_chars").cast("bigint"), "source")

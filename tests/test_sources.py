import gzip
import random

import pytest

from prunella.functions.text import html_text
from prunella.operators import features, learning
from prunella.sources import sinks
from prunella.sources import text as sources
from prunella.sources.warc import WarcError, warc_documents


def _record(kind: str, uri: str, payload: bytes, extra: str = "") -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\n{extra}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


@pytest.fixture
def warc(tmp_path):
    page = "<html><title>x</title><body>café</body></html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + page.encode()
    data = _record("warcinfo", "-", b"info") + _record("response", "http://a/", http, "WARC-TREC-ID: T-1\r\n")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    return tmp_path


def test_warc(spark, warc):
    rows = warc_documents(spark, f"{warc}/*.warc*").collect()
    assert len(rows) == 2 and all(r["title"] == "T-1" and r["uri"] == "http://a/" and r["encoding"] == "utf-8" and "café" in r["text"] for r in rows)


@pytest.fixture
def ranges(spark):
    """Files are cut into ranges of 2 kB."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _page(k: int, body: bytes) -> bytes:
    return _record("response", f"http://{k}/", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + body, f"WARC-TREC-ID: T-{k}\r\n")


def test_warc_records_across_ranges(spark, tmp_path, ranges):
    from prunella.sources.warc import pieces

    rng = random.Random(1)
    bodies = [bytes(rng.choices(b"abc \xe9\xff\r\n<>&W", k=rng.choice([0, 10, 700, 5000]))) for _ in range(60)]
    (tmp_path / "a.warc").write_bytes(b"".join(_page(k, b) for k, b in enumerate(bodies)))
    assert pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    found = {r["title"]: r["html"] for r in warc_documents(spark, str(tmp_path)).collect()}
    assert found == {f"T-{k}": b.decode("latin-1") for k, b in enumerate(bodies)}


def test_marks_inside_payloads(spark, tmp_path, ranges):
    inner = _page(99, b"a record in a page")
    long_claim = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9000000\r\n\r\n"
    bodies = [b"plain", b"see WARC/1.0 and WARC/ here", inner, b"x" * 3000 + inner + b"WARC/", b"WARC/" * 800, long_claim, b"end" * 1000]
    for name in ("a.warc", "b.warc"):
        (tmp_path / name).write_bytes(b"".join(_page(f"{name}{k}", b) for k, b in enumerate(bodies)))
    found = {r["title"]: r["html"] for r in warc_documents(spark, str(tmp_path)).collect()}
    assert found == {f"T-{name}{k}": b.decode("latin-1") for name in ("a.warc", "b.warc") for k, b in enumerate(bodies)}


@pytest.mark.parametrize("data", [b"no record", _page(1, b"x")[:-8], b"WARC/0.18\r\nContent-Length: 0\r\n\r\n", _page(1, b"x") + b"junk", b"WARC/1.0\r\nno: length\r\n\r\n"])
def test_bytes_that_are_no_records(spark, tmp_path, data):
    (tmp_path / "a.warc").write_bytes(data)
    with pytest.raises(Exception, match="record|head"):
        warc_documents(spark, str(tmp_path)).collect()


def test_other_versions_and_empty_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(_page(1, b"x").replace(b"WARC/1.0", b"WARC/0.18").replace(b"\r\n\r\n", b"\r\n\r\n"))
    (tmp_path / "b.warc").write_bytes(b"")
    assert [r["title"] for r in warc_documents(spark, str(tmp_path), strict=False).collect()] == ["T-1"]


def test_trec_records_across_ranges(spark, tmp_path, ranges):
    texts = [f"{k} " + "caf\xe9 " * (k % 7 * 90) for k in range(80)]
    data = "".join(f"<DOC>\n<DOCNO> A-{k} </DOCNO>\n<html>{t}</html></DOC>\n" for k, t in enumerate(texts)).encode("latin-1")
    (tmp_path / "t.txt").write_bytes(data)
    (tmp_path / "u.txt.gz").write_bytes(gzip.compress(data))
    assert spark.read.text(str(tmp_path / "t.txt"), lineSep="</DOC>").rdd.getNumPartitions() > 20
    rows = sources.trec_documents(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], r["text"]) for r in rows] == [(i, f"A-{i % 80}", texts[i % 80].strip()) for i in range(160)]


def test_trec(spark, tmp_path):
    (tmp_path / "t.txt").write_text("<DOC>\n<DOCNO> A-1 </DOCNO>\n<DOCHDR>h</DOCHDR><html>one &amp; two</html></DOC>\n<DOC><DOCNO>A-2</DOCNO>three</DOC>\n")
    assert [(r["doc_id"], r["title"], r["text"]) for r in sources.trec_documents(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "A-1", "one & two"), (1, "A-2", "three")]


def test_lists(spark, tmp_path):
    (tmp_path / "q").write_text("first query\n\n$mode trec\nsecond\n")
    assert [(r["qid"], r["text"]) for r in sources.query_log(spark, str(tmp_path / "q")).orderBy("qid").collect()] == [(0, "first query"), (3, "second")]
    (tmp_path / "p").write_text("3,7,0.5\nbad\n1,2\n")
    assert [(r["ord"], r["term_id"], r["doc_id"]) for r in sources.prune_list(spark, str(tmp_path / "p")).orderBy("ord").collect()] == [(0, 3, 7), (1, 1, 2)]
    (tmp_path / "m").write_text("2\n0\n1\n")
    assert {r["doc_id"]: r["new_id"] for r in sources.document_map(spark, str(tmp_path / "m")).collect()} == {0: 2, 1: 0, 2: 1}
    (tmp_path / "t").write_text("701,oil wells\n702, pipes\n")
    assert [tuple(r) for r in sources.topic_queries(spark, str(tmp_path / "t")).orderBy("topic").collect()] == [(701, "oil wells"), (702, "pipes")]
    both = sources.parallel_lines(spark, [str(tmp_path / "m"), str(tmp_path / "t")])
    assert both.count() == 2


def test_arpa(spark, tmp_path):
    (tmp_path / "lm").write_text("\\data\\\nngram 1=3\n\n\\1-grams:\n-1.0\t<UNK>\n-0.5\ta\t0\n-2\tb\n\n\\2-grams:\n-1 a b\n\\end\\\n")
    model, unknown = sources.arpa_unigrams(spark, str(tmp_path / "lm"))
    assert unknown == pytest.approx(0.1) and {r["term"]: round(r["prob"], 4) for r in model.collect()} == {"a": 0.3162, "b": 0.01}


def test_feature_files(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.5), (2, 3.5)], "id long, x double")
    sinks.write_csv(frame, str(tmp_path / "f"))
    assert sorted(map(tuple, sources.feature_csv(spark, str(tmp_path / "f")).collect())) == [(1, 2.5), (2, 3.5)]
    log = sinks.event_log(spark.createDataFrame([(1, 0, [5, 6])], "q long, c int, results array<long>"), "q", "c", "results")
    assert tuple(log.first()) == (1, 0, "5 6")


def test_html(spark):
    row = spark.createDataFrame([("<style>p{}</style><p>a&nbsp;&lt;b&gt;<!-- no --></p><script>x()</script> c",)], "html string")
    assert row.select(html_text("html").alias("t")).first()["t"] == "a <b> c"


def test_learning(spark, tmp_path):
    rows = [(float(i), float(i % 3), float(2 * i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "x double, y double, label double")
    model = learning.trained(frame, learning.random_forest(3, 8, 4))
    out = model.transform(frame)
    assert learning.evaluated(out) < 20 and learning.feature_names(out) == ["x", "y"]
    sinks.write_libsvm(out, str(tmp_path / "svm"))
    assert spark.read.format("libsvm").load(str(tmp_path / "svm")).count() == 60
    with pytest.raises(ValueError):
        learning.assembler(out)


def test_labels_are_zero_where_missing(spark):
    own = spark.createDataFrame([(1, 1), (1, 2)], "term_id long, doc_id long")
    hit = spark.createDataFrame([(1, 1, 0), (1, 1, 3), (1, 2, 50)], "term_id long, doc_id long, rank int")
    assert {r["doc_id"]: r["label"] for r in features.labelled(own, features.labels(hit, 10)).collect()} == {1: 2, 2: 0}


def test_streamed_queries(spark, tmp_path):
    from prunella.operators.index import build_index
    from prunella.streaming.query_log import answered

    index = build_index(spark.createDataFrame([(0, "a b"), (1, "b c"), (2, "d"), (3, "e")], "doc_id long, text string")).stored()
    spark.createDataFrame([(1, "a"), (2, "b c")], "qid long, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, text string").json(str(tmp_path / "in"))
    run = answered(stream, index, str(tmp_path / "out"), str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    assert {(r["qid"], r["doc_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0), (2, 0), (2, 1)}


def test_hits_of_a_stream_are_counted_once_though_batches_fail(spark, tmp_path, monkeypatch):
    from prunella.operators import hits, search
    from prunella.operators.index import build_index
    from prunella.streaming import hit_tables

    rng = random.Random(3)
    docs = [(k, " ".join(rng.choices("abcdefg", k=12))) for k in range(30)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string")).stored()
    log = [(k, " ".join(rng.choices("abcdefg", k=2))) for k in range(20)]
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(f'{{"qid": {q}, "text": "{t}"}}' for q, t in log[4 * k : 4 * k + 4]))
    where = [str(tmp_path / name) for name in ("tables", "check")]
    stream = lambda: spark.readStream.schema("qid long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    real, calls = hit_tables.merged, []

    def dies(parts, keys):  # the first merge dies after its batch's own table is written
        calls.append(len(parts))
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(parts, keys)

    monkeypatch.setattr(hit_tables, "merged", dies)
    run = hit_tables.hit_stream(stream(), index, *where, flush=2)
    with pytest.raises(Exception, match="lost"):
        run.processAllAvailable()
    run.stop()
    run = hit_tables.hit_stream(stream(), index, *where, flush=2)
    run.processAllAvailable()
    run.stop()
    assert hit_tables._done(spark, where[0] + "/merged") == [1, 3] and calls == [2, 2, 3]
    found = hit_tables.hit_table(spark, where[0])
    terms = search.query_terms(spark.createDataFrame(log, "qid long, text string"), "qid")
    want = hits.binned(hits.raw_hits(search.search(index, terms), search.matches(index, terms), index.vocab), ["doc_id"], "dh")
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect())) != []


def test_ranges_of_stored_payloads_reach_the_scan(spark, tmp_path):
    from prunella.operators.index import build_index
    from prunella.plans.planner import Planner
    from prunella.plans.query_language import Range
    from prunella.sources.index_store import open_index, save_index

    docs = spark.createDataFrame([(k, f"a {k % 3}", k * 0.5, f"d{k:03}") for k in range(200)], "doc_id long, text string, price double, day string")
    save_index(build_index(docs, payloads={"cost": "price", "day": "day"}), str(tmp_path / "i"))
    planner = Planner(open_index(spark, str(tmp_path / "i")))
    plan = planner.range("cost", Range("10", "12")).docs
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cost,10.0)" in text and "LessThanOrEqual(cost,12.0)" in text
    assert sorted(r["doc_id"] for r in planner.run("0 & cost:[10 .. 12] & day:[d021 .. ]", scorer=False).collect()) == [21, 24]
    with pytest.raises(ValueError, match="no such columns"):
        build_index(docs, payloads={"x": "nothing"})

from prunella.operators.index import build_index
from prunella.operators.timing import list_access, time_lines, timed, total_ms
from prunella.session import SearchSession


def test_times(spark):
    docs = spark.createDataFrame([(k, "a " * (k % 4) + "b") for k in range(40)], "doc_id long, text string")
    index = build_index(docs).stored()
    queries = spark.createDataFrame([(1, "text", "a"), (2, "text", "b"), (2, "text", "a"), (3, "text", "zz")], "qid long, field string, term string")
    times = timed(index, queries, 35)
    assert {r["qid"]: r["n_results"] for r in times.collect()} == {1: 30, 2: 35, 3: 0} and times.where("ms <= 0").count() == 0
    total = total_ms(times).first()
    assert (total["n_queries"], total["n_results"]) == (3, 65) and abs(total["ms"] - 3 * total["ms_per_query"]) < 1e-6
    assert time_lines(times).where("qid = 1").first()["line"].startswith("30 results; ")
    lists = {r["term"]: r for r in list_access(index, 30, places=2, runs=1).collect()}
    assert {t: r["df"] for t, r in lists.items()} == {"a": 30, "b": 40} and all(r["ns_per_posting"] > 0 and r["ns_per_access"] > 0 for r in lists.values())
    session = SearchSession(index, docs)
    session.run("$mode time")
    (line,) = session.run("a").collect()
    assert line["line"].startswith("30 results; ") and line["line"].endswith(" ms")


def test_a_query_of_a_log_takes_few_jobs(spark):
    docs = spark.createDataFrame([(k, "a " * (k % 4) + "b") for k in range(40)], "doc_id long, text string")
    index = build_index(docs).stored()
    rows = [(q, "text", t) for q in range(6) for t in ("a", "b", "zz")]
    queries = spark.createDataFrame(rows, "qid long, field string, term string")
    tracker = spark.sparkContext.statusTracker()
    seen = len(tracker.getJobIdsForGroup(None))
    times = timed(index, queries, 5, mode="and")
    assert {r["n_results"] for r in times.collect()} == {0}
    both = timed(index, queries.where("term != 'zz'"), 35, mode="and")
    assert {r["n_results"] for r in both.collect()} == {30}
    assert len(tracker.getJobIdsForGroup(None)) - seen <= 9 * 12


def test_the_lists_of_a_log_are_read_once(spark):
    docs = spark.createDataFrame([(k, "it's a " * (k % 4) + "b\\c") for k in range(40)], "doc_id long, text string")
    index = build_index(docs).stored()
    queries = spark.createDataFrame([(q, "text", t) for q in range(8) for t in ("a", "b", "it's", "back\\slash", "none")], "qid long, field string, term string")
    tracker = spark.sparkContext.statusTracker()

    def jobs(log):
        seen = len(tracker.getJobIdsForGroup(None))
        assert {r["n_results"] for r in timed(index, log, 50).collect()} == {40}
        return len(tracker.getJobIdsForGroup(None)) - seen

    few, many = jobs(queries.where("qid < 2")), jobs(queries)
    assert many - few <= 3 * 6

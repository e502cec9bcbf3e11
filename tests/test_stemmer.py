"""Samples of the published vocabulary, and an index of stems."""

import random

from pyspark.sql import functions as F

from prunella.functions.stemmer import porter2
from prunella.functions.text import PROCESSORS
from prunella.operators.index import build_index, document_stats, invert, tokens

SAMPLES = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consolation consol consolatory consolatori console consol consolidate consolid consolingly consol conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir constable constabl constancy constanc knackeries knackeri knavish knavish kneeling kneel knees knee knightly knight
knitted knit knives knive knocker knocker knopp knopp generate generat general general generic generic generous generous hopping hop hoping hope happy happi cry cri
by by say say ties tie cries cri gas gas this this gaps gap kiwis kiwi dying die news news proceed proceed inning inning skies sky singly singl""".split()


def test_published_samples():
    assert {a: porter2(a) for a in SAMPLES[::2]} == dict(zip(SAMPLES[::2], SAMPLES[1::2], strict=True))
    assert [porter2(x) for x in ("", "a", "it", "Été", "x9s", "CRIES", "dog's", "'tis")] == ["", "a", "it", "été", "x9s", "cri", "dog", "tis"]


def plain_index(docs, processor):
    """By a row for each token, all of them shuffled."""
    toks = tokens(docs, processor=processor)
    return invert(toks), document_stats(toks, docs)


def test_an_index_in_one_pass_is_that_of_all_tokens(spark):
    rng = random.Random(1)
    words = SAMPLES + ["The", "the", "é", "42", "of"]
    rows = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(60)] + [(90, None), (91, ""), (92, " .,"), (93, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for processor in ("none", "downcase", "english", "porter2", lambda t: F.when(t != "the", F.lower(t))):
        index = build_index(docs, processor=processor).stored()
        postings, sizes = plain_index(docs, processor)
        columns = ["field", "term", "doc_id", "count", "positions"]
        assert sorted(map(tuple, index.postings.select(columns).collect())) == sorted(map(tuple, postings.select(columns).collect()))
        assert sorted(map(tuple, index.doc_stats.collect())) == sorted(map(tuple, sizes.collect()))
        s = index.stats.first()
        n = postings.agg(F.count_distinct("term"), F.count("*"), F.sum("count"), F.max("count")).first()
        assert (s["n_docs"], s["n_terms"], s["n_postings"], s["n_occurrences"], s["max_count"], s["max_doc_size"]) == (64, *n, 5000)
    assert PROCESSORS["porter2"].of("ponies") == "poni"


def test_texts_are_not_shuffled_to_be_inverted(spark):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    plan = build_index(docs).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan

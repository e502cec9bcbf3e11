"""The tables that models learn from: where their rows go and what they cost."""

from pyspark.sql import functions as F

from prunella import catalog
from prunella.operators import features, learning
from prunella.storage import ALL_KEYS, setting

SF = "/root/testdata/sf0.001"


def test_a_split_does_not_depend_on_partitions(spark):
    rows = spark.range(4000).select((F.col("id") % 50).alias("term_id"), F.col("id").alias("doc_id"), (F.col("id") * 0.5).alias("x"))
    parts = [[{tuple(r) for r in p.collect()} for p in learning.split(rows.repartition(n, "x"))] for n in (2, 7)]
    assert parts[0] == parts[1]
    train, test = parts[0]
    assert not train & test and len(train | test) == 4000 and 2850 < len(train) < 3150
    bare = learning.split(rows.select("x"), (1, 1))
    assert bare[0].count() + bare[1].count() == 4000


def test_training_rows_are_shuffled_while_they_are_narrow(spark):
    with setting(spark, ALL_KEYS, "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = catalog.features_of(spark, SF, 10)._jdf.queryExecution().executedPlan().toString()
    # Sizes meet postings by document alone, and labels come with hits, not by a join of the whole rows.
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert not any("field#" in x and "doc_id#" in x for x in lines)
    assert not any("coalesce(term_id" in x for x in lines)


def test_labels_that_come_with_hits_are_those_of_labelled(spark):
    rows = features.labelled(catalog.features_of(spark, SF), features.labels(catalog.hits_of(spark, SF), 10))
    want = sorted(map(tuple, rows.select("doc_id", "term_id", "label", "ph_top1k").collect()))
    assert sorted(map(tuple, catalog.training_rows(spark, SF).select("doc_id", "term_id", "label", "ph_top1k").collect())) == want
    assert sum(r[2] for r in want) > 0

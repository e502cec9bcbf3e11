from prunella import catalog
from prunella.operators import features

SF = "/root/testdata/sf0.001"


def test_rows_of_features_without_hits_are_those_of_the_whole_table(spark):
    whole = catalog.training_rows(spark, SF)
    for group in ("term", "intrinsic"):
        own = catalog.training_rows(spark, SF, group)
        columns = ["term_id", "doc_id", *features.GROUPS[group], "label"]
        assert own.columns == columns
        round_ = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
        assert sorted(map(round_, own.collect())) == sorted(map(round_, whole.select(columns).collect()))

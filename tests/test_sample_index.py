import os

from prunella import catalog
from prunella.storage import scratch_dir

SF = "/root/testdata/sf0.001"


def folders(spark) -> set[str]:
    root = scratch_dir(spark).removeprefix("file://") + "/prunella"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_sample_index_is_built_once(spark):
    catalog.sample_hits(spark, SF)
    before = folders(spark)
    catalog.sample_hits(spark, SF)
    assert {f.rsplit("-", 1)[0] for f in folders(spark) - before} == {"sample-hits"}
    shards = catalog.shard_folders(spark, SF)
    assert "positions" not in shards.columns and shards.count() == catalog.index_for(spark, SF).postings.count()

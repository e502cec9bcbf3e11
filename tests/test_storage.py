"""Scratch tables: what writing one leaves behind."""

import os
import time

from pyspark.sql import functions as F

from prunella.llm import common
from prunella.storage import SHUFFLES_GO, written


def shuffle_files(spark) -> int:
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(n.startswith("shuffle_") for r in root for _, _, names in os.walk(r.getPath()) for n in names)


def test_writing_a_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO)
    for write in (written, common.written):
        rows = spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).count()
        out = write(rows.join(rows.select("k").distinct(), "k"), "few")
        for _ in range(50):  # Spark deletes them a moment after the query
            if shuffle_files(spark) <= before:
                break
            time.sleep(0.1)
        assert shuffle_files(spark) <= before
        assert out.count() == 100 and spark.conf.get(SHUFFLES_GO) == setting
        before = shuffle_files(spark)

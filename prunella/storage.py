"""Tables, scratch space that executors share, and total orders without single-task windows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])
#: Whether Spark deletes a query's shuffle files when the query ends, not when the driver has collected the garbage that
#: refers to them.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether a join by several keys shuffles rows again that are dealt out by one of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="prunella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession, size: int = 32 << 20) -> None:
    """Arrow batches for Python hold about so many bytes at most, however long their rows; a lower bound stays.

    Workers that start after this can import this package.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > size:
        spark.conf.set(key, str(size))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind: for writes, whose shuffles nothing reads again."""
    with setting(spark, SHUFFLES_GO, "true"):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Queries that are planned inside have a setting of the session changed."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared scratch folder: computed once, lineage cut."""
    path = f"{scratch_dir(df.sparkSession)}/prunella/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.scratch_path = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Delete tables that were `written` and that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ordered(df: DataFrame, order: list[Column], mass: str | None = None) -> DataFrame:
    """df with `ord` (0-based place in the total order) and, for a mass column, `cum` (its sum up to and with the row).

    Range partitions are sorted and written; a row's place is its place in its file plus the rows of the files before.
    No task sees more than a partition, however long the list is.
    """
    out = written(df.repartitionByRange(*order).sortWithinPartitions(*order), "ordered")
    rows = out.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    total = F.sum(mass) if mass else F.lit(None).cast("long")
    files = rows.groupBy("file").agg(F.count("*").alias("n"), total.alias("m"))
    # Spark pads the partition's number in a name to five digits: beyond, the names' order is not that of the partitions.
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"))
    rows = rows.join(files, "file").withColumn("ord", F.col("n0") + F.col("row"))
    if mass:
        inner = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("cum", F.col("m0") + F.sum(mass).over(inner))
    return rows.drop("file", "row", "n0", "m0")

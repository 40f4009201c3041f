"""Reading the tables of a folder, the folder for checkpoints, and the package on the workers."""

from __future__ import annotations

import math
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: A table is dealt out to the cores only where a split of it holds more bytes than the first number and the whole fewer than the second.
WORTH_SPREADING, SPREAD_AT_MOST = 1 << 20, 1 << 30


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder.  A small one that comes in fewer splits than there are cores, as a single file does, is dealt out to them; large ones never are."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if (splits := df.rdd.getNumPartitions()) < cores:
        size = _bytes(spark, f"{folder}/{name}.parquet")
        if size > WORTH_SPREADING * splits and size < SPREAD_AT_MOST:
            return df.repartition(cores)
    return df


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """The package's code for the workers of a session, once: they need not have it installed."""
    sc, here = spark.sparkContext, Path(__file__).parent
    if sc.applicationId in _SHIPPED or not here.is_dir():
        return
    _SHIPPED.add(sc.applicationId)
    out = Path(tempfile.mkdtemp(prefix="lexloom-code-"), "lexloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path("lexloom") / f.relative_to(here))
    sc.addPyFile(str(out))


def ready(spark: SparkSession) -> SparkSession:
    """``spark`` with a folder for checkpoints: the cluster's, or on a single machine (tests) one of our own."""
    ship(spark)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see, as the session names it; a local session may do without a name."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
    return tempfile.mkdtemp(prefix="lexloom-")


def rank_all(df: DataFrame, *order: Column, name: str = "rk", by: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """``df`` with the place of each row in ``order`` (a total one), by group: ``first``, ``first`` + 1, ...

    The rows are range-partitioned by group and order and counted by partition and group; a row's place is its place in its
    partition and the rows before that partition.  So a group of a third of all rows is ranked by as many tasks as its rows need.
    """
    ready(df.sparkSession)
    keys = [F.col(b) for b in by]
    placed = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    own = Window.partitionBy("__part", *by).orderBy(*order)
    ranked = placed.withColumn("__place", F.row_number().over(own)).checkpoint()  # the sampled bounds must hold for both readings
    counts = ranked.groupBy("__part", *by).agg(F.count("*").alias("__n"))  # a row per partition and group
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = ranked.join(before.drop("__n"), ["__part", *by])
    return joined.withColumn(name, (F.col("__place") + F.col("__before") + (first - 1)).cast("int")).drop("__part", "__place", "__before")


def spread(df: DataFrame, rows_each: int = 500_000, most: int = 50_000, rows: int | None = None) -> int:
    """How many partitions a shuffle of ``df`` should have: the session's number, or more (up to ``most``) where a partition would hold more rows than ``rows_each``.

    ``rows`` are those that are shuffled, by default a row for a row.  The count of a table without filters is read from its files' footers.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, math.ceil((df.count() if rows is None else rows) / rows_each)))

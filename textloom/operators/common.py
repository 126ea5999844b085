"""Size checks and ranks that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"

#: Rows up to which a side may be broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where a counted bound proves the side small; a shuffle join otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hint_if_small(df: DataFrame, rows: int = BROADCAST_ROWS):
    """The same decision as a function, for sides that can't have more rows than df."""
    return F.broadcast if df.limit(rows + 1).count() <= rows else lambda x: x


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; the group limit is applied before the shuffle, too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(name) <= k)


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top(df, by, order, 1, "__first").drop("__first")


def global_offsets(df: DataFrame, key: str, size: str, block: int = 1024) -> DataFrame:
    """df with `before`: the sum of `size` over all rows with a smaller integer key.

    Two levels: sums of blocks of keys are accumulated, then rows within a block; the single task of the first level
    sees one row per block.
    """
    parts = df.withColumn("__block", F.floor(F.col(key) / block))
    sums = parts.groupBy("__block").agg(F.sum(size).alias("__sum"))
    level = sums.withColumn("__top", F.floor(F.col("__block") / block))
    tops = level.groupBy("__top").agg(F.sum("__sum").alias("__t"))
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__a", F.coalesce(F.sum("__t").over(run(Window.orderBy("__top"))), F.lit(0)))
    level = level.withColumn("__b", F.coalesce(F.sum("__sum").over(run(Window.partitionBy("__top").orderBy("__block"))), F.lit(0)))
    start = level.join(tops, "__top").select("__block", (F.col("__a") + F.col("__b")).alias("__start"))
    inner = F.coalesce(F.sum(size).over(run(Window.partitionBy("__block").orderBy(key))), F.lit(0))
    return parts.withColumn("__in", inner).join(start, "__block").withColumn("before", F.col("__start") + F.col("__in")).drop("__block", "__in", "__start")


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with its row number (from 0) in the order of some columns, without a task that sees all rows.

    Rows are dealt by ranges and sorted; the numbers of rows of the ranges alone are accumulated.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)))
    parts = materialise(parts, "numbered")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # a row per range
    return parts.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with `chunk`: rows in order, `size` of them in each."""
    return numbered(df, order, "__n").withColumn("chunk", F.floor(F.col("__n") / size)).drop("__n")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session that names none gets a folder of this machine."""
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set(CHECKPOINT, found)
    return found.rstrip("/")


#: Paths of intermediate tables that this process has written, in order.
_MADE: list[str] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many intermediate tables there are: what forget takes to delete those of later steps alone."""
    return len(_MADE)


def forget(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the intermediate tables written after `since`; results that still read from them must be written before."""
    for path in _MADE[since:until]:
        remove(spark, path)
    del _MADE[since:until]


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

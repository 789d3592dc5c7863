"""Tables in the folder that all executors share, and ranks without gaps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlake.session import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder; lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the tables written inside go as soon as each is written, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that is not read any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def with_rank(df: DataFrame, group: list[str], rank: str = "rank") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in no special order.

    The frame is written once with the number of its partition. Rows are counted per group and
    partition, so a group of any size is numbered by many tasks; only counts are summed up per group.
    """
    parts = written(df.withColumn("_part", F.spark_partition_id()), "ranks")
    by = [*group, "_part"]
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*by).count().select(*by, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    numbered = parts.withColumn("_place", place)
    return numbered.join(starts, by).withColumn(rank, F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")

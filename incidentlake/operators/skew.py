"""Joins whose keys may hold a large share of the rows, and running numbers without one big task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlake.session import materialized

SALTS = 32
SHARE = 200  # a hot value holds at least one row in so many, so there are no more hot values than that
SENT_BYTES = 8 << 20  # a side of a join that is sent to every task
LEAST = 10_000  # a value with fewer rows is no burden to a task


def hot_values(counts: DataFrame, column: str) -> list:
    """Values of ``column`` that hold a large share of all rows; ``counts`` has each value once, with ``n``."""
    total = counts.agg(F.sum("n")).scalar()
    found = counts.where((F.col("n") >= LEAST) & (SHARE * F.col("n") >= total)).select(column).collect()
    return [r[0] for r in found]  # at most SHARE


def spread_join(big: DataFrame, small: DataFrame, on: str, part: str, hot: list) -> DataFrame:
    """``big`` joined to ``small``; rows with a hot key are spread by a hash of ``part`` and meet copies of the small side."""
    if not hot:
        return big.join(small, on)
    is_hot = F.col(on).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(part), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return big.withColumn("_salt", salt).join(small.withColumn("_salt", F.explode(copies)), [on, "_salt"]).drop("_salt")


def fits(df: DataFrame) -> bool:
    """Whether a checkpointed frame may be sent to every task, by the characters in it.

    Spark's estimate for a checkpoint is that of the plan it came from: it multiplies the sizes of joins and knows
    nothing of exploded lists, so it takes the larger side of a join for the smaller one.
    """
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.to_json(F.struct("*")))).alias("chars")).first()
    return 40 * size.rows + 2 * (size.chars or 0) <= SENT_BYTES


def sized(df: DataFrame) -> DataFrame:
    """A checkpointed small side of a join: sent to every task if it fits, else merged, never the other side sent."""
    return F.broadcast(df) if fits(df) else df.hint("merge")


def numbered(df: DataFrame, order: str, number: str) -> DataFrame:
    """Rows numbered from 1 in the order of a column, by ranges: only one count per range is summed up.

    Equal values are numbered in no special order; give distinct ones for numbers that don't change.
    """
    ranges = materialized(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranges.withColumn("_place", place).join(starts, "_part").withColumn(number, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")

"""Exact medians of many columns and groups, with no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlake.session import materialized


def medians(df: DataFrame, columns, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., feature, median) of the known values of each column; a column without any has no row.

    Rows fold to counts per group, column and value. Those are cut into ranges of values, so a group with
    many values spans many ranges; totals of the ranges (one row each) give every range the number of values
    before it, and the two middle places are picked out where they lie.
    """
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "feature", "value")
    counts = values.where("value is not null").groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranges = materialized(counts.repartitionByRange(*by, "feature", "value").withColumn("_part", F.spark_partition_id()))
    group = [*by, "feature"]
    parts = ranges.groupBy(*group, "_part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *group, "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"), F.sum("n").over(Window.partitionBy(*group)).alias("_all")
    )
    inside = Window.partitionBy(*group, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("_within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*group, "_part")]
    first = F.col("_start") + F.col("_within")
    middle = [F.expr("(_all - 1) div 2"), F.expr("_all div 2")]
    held = sum(((first <= m) & (m < first + F.col("n"))).cast("int") for m in middle)  # 1 or 2 where a middle place lies
    picked = placed.alias("r").join(parts.alias("p"), same).withColumn("_held", held).where("_held > 0")
    return picked.groupBy(*[F.col(f"r.{c}").alias(c) for c in group]).agg((F.sum(F.col("value") * F.col("_held")) / 2).alias("median"))


def overall_medians(df: DataFrame, columns) -> dict[str, float | None]:
    """The medians of all rows, as numbers; None for a column without values."""
    found = {r.feature: r.median for r in medians(df, columns).collect()}  # one row per column
    return {c: found.get(c) for c in columns}

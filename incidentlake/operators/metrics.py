"""Binary classification metrics over a scored table (columns y, proba).

Scored rows are read once: they fold to the counts of both labels per distinct score, and every metric
works on those counts. Each function takes scored rows or such a folded table. Rows without a score don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.session import materialized


def thresholds() -> list[float]:
    step = (V.THRESHOLD_START + V.THRESHOLD_STEP) - V.THRESHOLD_START
    return [V.THRESHOLD_START + i * step for i in range(V.THRESHOLD_COUNT)]


def _ratio(a: Column, b: Column) -> Column:
    """Quotient with 0 for a zero denominator."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def folded(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts ``pos`` and ``neg`` of both labels per distinct score; a table that has them is kept as it is."""
    if {"pos", "neg"} <= set(scored.columns):
        return scored
    return scored.where("proba is not null").groupBy(*by, "proba").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )


def ranged(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The folded table in ranges of scores (``part`` numbers them), checkpointed: what several metrics read.

    The number of ranges follows the number of distinct scores, since the partitions of the exchange do.
    """
    points = folded(scored, by).repartitionByRange(*by, "proba")
    return materialized(points.withColumn("part", F.spark_partition_id()))


def confusion(scored: DataFrame, threshold: float | Column, by: tuple[str, ...] = ()) -> DataFrame:
    positive = F.col("proba") >= threshold
    counted = {"tp": ("pos", positive), "fp": ("neg", positive), "fn": ("pos", ~positive), "tn": ("neg", ~positive)}
    return folded(scored, by).groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).alias(name) for name, (c, side) in counted.items()]
    )


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}
    )


def threshold_sweep(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """F1 at every threshold. Each score is only asked how many thresholds it reaches.

    That folds the table to at most 27 pairs of counts per group; the thresholds are spread over
    those counts, never over the rows.
    """
    grid = thresholds()
    reached = sum(((F.col("proba") >= t).cast("int") for t in grid), F.lit(0))
    if not {"pos", "neg"} <= set(scored.columns):  # rows: straight to the counts, whose keys are fewer than the scores
        counts = scored.where("proba is not null").groupBy(*by, reached.alias("reached")).agg(
            F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
        )
    else:
        counts = scored.groupBy(*by, reached.alias("reached")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spread = counts.select(*by, "pos", "neg", "reached", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold"))
    hit = F.col("i") < F.col("reached")
    per = spread.groupBy(*by, "i", "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    )
    return rates(per)


def best_threshold(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first threshold with the highest F1."""
    rank = F.struct(F.col("f1"), -F.col("i"))
    return threshold_sweep(scored, by).groupBy(*by).agg(
        F.max_by("threshold", rank).alias("threshold"), F.max("f1").alias("f1")
    )


def auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, exact with ties.

    Ranks run inside each range of scores and start from the totals of the ranges below; the window
    over totals has one row per range.
    """
    points = scored if "part" in scored.columns else ranged(scored, by)
    below = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = points.groupBy(*by, "part").agg(F.sum("neg").alias("neg")).select(
        *by, "part", F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy(*by, "part").orderBy("proba").rowsBetween(Window.unboundedPreceding, -1)
    ranked = points.withColumn("_before", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(starts, [*by, "part"])
    # pairs won by the positives, ties counted half; doubled to stay whole
    won = F.col("pos") * (2 * (F.col("start") + F.col("_before")) + F.col("neg"))
    return ranked.groupBy(*by).agg(
        _ratio(F.sum(won.cast("decimal(38,0)")).cast("double"), 2.0 * F.sum("pos") * F.sum("neg")).alias("auc")
    )


def binary_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    points = ranged(scored)
    return rates(confusion(points, threshold)).withColumn("auc", auc(points).scalar())


def fold_metrics(scored: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Per fold the best threshold, and f1, precision, recall and auc at it, from one table of counts."""
    points = ranged(scored, by)
    best = best_threshold(points, by).select(*by, "threshold")
    judged = confusion(points.join(best, list(by)), F.col("threshold"), (*by, "threshold"))
    return rates(judged).select(*by, "f1", "threshold", "precision", "recall").join(auc(points, by), list(by))


SUMMED = ("f1", "precision", "recall", "auc")


def cv_summary(folds: DataFrame, labels: DataFrame, feature_count: int) -> DataFrame:
    """Mean and deviation of the folds' metrics, with rows, prevalence of the target and number of features.

    ``labels`` has one column ``y`` per row that was trained on. The deviation is the sample's, null for one fold.
    """
    means = [f(c).alias(f"{name}_{c}") for c in SUMMED for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    rows = labels.agg(F.count(F.lit(1)).alias("train_rows"), F.avg("y").alias("prevalence"))
    target = rows.select(F.struct("*")).scalar()
    return folds.agg(F.count(F.lit(1)).alias("folds"), *means).select(
        "*", target.getField("train_rows").alias("train_rows"), target.getField("prevalence").alias("prevalence"),
        F.lit(feature_count).alias("feature_count"),
    )

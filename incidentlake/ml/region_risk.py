"""Temporal risk classifier on the region-hour features."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions.numbers import round2
from incidentlake.ml import boosting
from incidentlake.operators import metrics as M
from incidentlake.operators import regionhour as R
from incidentlake.session import concurrently, dealt, materialized

# known only after the hour has passed; left out unless asked for
CURRENT_HOUR = ("incidents_count", "unique_enterprises", "unique_threats", "threat_danger_score")


def feature_columns(df: DataFrame, include_current: bool = False) -> tuple[list[str], list[str]]:
    """(all features, categorical ones): the listed features that the table has."""
    dropped = () if include_current else CURRENT_HOUR
    features = [c for c in (*V.NUMERIC_FEATURES, *V.CATEGORICAL_FEATURES) if c in df.columns and c not in dropped]
    return features, [c for c in V.CATEGORICAL_FEATURES if c in features]


def _encoder(features: list[str], categorical: list[str]) -> Pipeline:
    indexed = [f"{c}_index" for c in categorical]
    numeric = [c for c in features if c not in categorical]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"),
            VectorAssembler(inputCols=numeric + indexed, outputCol="features"),
        ]
    )


def with_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("proba", vector_to_array("probability")[1])


TASK_ROWS = 20_000


@dataclass
class RiskModel:
    model: PipelineModel
    features: list[str]
    categorical: list[str]
    threshold: float
    cv: list[dict]  # per fold: f1, threshold, precision, recall, auc, trees kept, rounds fitted
    judged: DataFrame | None = None  # (fold, y, proba) of all validated rows


def _weighted(rows: DataFrame) -> DataFrame:
    """Balanced class weights: the classes' shares are two counts, so they are literals."""
    counts = {r.attack_present: r.n for r in rows.groupBy("attack_present").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("attack_present") == label, F.lit(total / (2 * n))).otherwise(weight)
    return rows.withColumn("weight", weight)


def _bins(df: DataFrame, categorical: list[str]) -> int:
    sizes = df.agg(*[F.countDistinct(c).alias(c) for c in categorical]).first() if categorical else []
    return max(32, *(n + 1 for n in sizes)) if sizes else 32


@dataclass
class _Table:
    """Encoded rows that all fits share: one checkpoint, whatever the number of folds and settings."""

    encoder: PipelineModel
    rows: DataFrame
    features: list[str]
    categorical: list[str]
    bins: int

    @classmethod
    def of(cls, prepared: DataFrame, include_current: bool) -> _Table:
        features, categorical = feature_columns(prepared, include_current)
        encoder = _encoder(features, categorical).fit(prepared)
        rows = encoder.transform(prepared).select("features", "attack_present", "position", "fold_starts", "val_fold")
        rows = dealt(rows, prepared.count(), "position", TASK_ROWS)  # every depth of every tree is a job: no tiny tasks, no large ones
        return cls(encoder, materialized(rows), features, categorical, _bins(prepared, categorical))

    def fit(self, fold: int, params: dict, seed: int, patience: int) -> tuple[PipelineModel, DataFrame, dict]:
        """(model, its judged rows, trees and rounds) of one fold."""
        before = self.rows.where(F.col("position") < F.element_at("fold_starts", fold))
        held = self.rows.where(F.col("val_fold") == fold)
        boosted = boosting.fit(_weighted(before), held.withColumn("weight", F.lit(1.0)), params, seed, self.bins, patience)
        judged = with_probability(boosted.model.transform(held)).select(
            F.lit(fold).alias("fold"), F.col("attack_present").alias("y"), "proba"
        )
        return PipelineModel([*self.encoder.stages, boosted.model]), judged, {"trees": boosted.trees, "rounds": len(boosted.losses)}


def prepare(features_df: DataFrame, order: str = "time", max_rows_per_region: int | None = None) -> DataFrame:
    """Feature rows with their folds, checkpointed once for the many passes of training."""
    df = features_df if max_rows_per_region is None else R.tail_per_region(features_df, max_rows_per_region)
    return materialized(R.cv_folds(df, order=order))


def _metrics(judged: list[DataFrame], by: str) -> tuple[DataFrame, dict]:
    """All judged rows as one checkpoint, and their metrics by ``by`` from one pass over it."""
    table = materialized(reduce(DataFrame.unionByName, judged))
    return table, {r[by]: r.asDict() for r in M.fold_metrics(table, (by,)).collect()}


def train(
    prepared: DataFrame, params: dict | None = None, include_current: bool = False, folds=range(1, V.FOLDS + 1),
    patience: int = V.PATIENCE,
) -> RiskModel:
    """Three expanding folds, fitted side by side; the model and threshold of the fold with the best F1 are kept."""
    table = _Table.of(prepared, include_current)
    folds = list(folds)
    fits = concurrently(
        prepared.sparkSession, [partial(table.fit, fold, params or V.BOOSTING, V.SEED + fold, patience) for fold in folds]
    )
    judged, metrics = _metrics([f[1] for f in fits], "fold")
    cv = [{**metrics[fold], **kept} for fold, (_, _, kept) in zip(folds, fits)]
    best = max(range(len(cv)), key=lambda i: (cv[i]["f1"], -i))
    return RiskModel(fits[best][0], table.features, table.categorical, cv[best]["threshold"], cv, judged)


def grid_search(
    prepared: DataFrame, grid=V.GRID, fold: int = V.FOLDS, include_current: bool = False, patience: int = V.PATIENCE
) -> list[dict]:
    """Every parameter set fitted on one fold, side by side on one table; best F1 first."""
    table = _Table.of(prepared, include_current)
    fits = concurrently(prepared.sparkSession, [partial(table.fit, fold, params, V.SEED, patience) for params in grid])
    _, metrics = _metrics([f[1].withColumn("setting", F.lit(i)) for i, f in enumerate(fits)], "setting")
    rows = [{**params, "fold": fold, **metrics[i], **fits[i][2]} for i, params in enumerate(grid)]
    return sorted(rows, key=lambda r: -r["f1"])


def save(model: RiskModel, spark: SparkSession, path: str) -> None:
    """Pipeline model and a metadata document side by side."""
    model.model.write().overwrite().save(f"{path}/model")
    meta = {"feature_cols": model.features, "cat_feature_names": model.categorical, "threshold": model.threshold}
    spark.range(1).select(F.lit(json.dumps(meta, ensure_ascii=False)).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> RiskModel:
    meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
    return RiskModel(
        PipelineModel.load(f"{path}/model"), meta["feature_cols"], meta["cat_feature_names"], meta["threshold"], []
    )


def score_rows(model: RiskModel, rows: DataFrame) -> DataFrame:
    """Probability and decision of feature rows; features the rows lack count as 0."""
    missing = {c: F.lit(0) for c in model.features if c not in rows.columns}
    scored = with_probability(model.model.transform(rows.withColumns(missing) if missing else rows))
    return scored.withColumn("decision", (F.col("proba") >= model.threshold).cast("int"))


def score_region_hours(model: RiskModel, grid: DataFrame, targets: DataFrame) -> DataFrame:
    """The 24 hours of every (region, date) target."""
    return score_rows(model, R.forecast_rows(grid, targets)).select("region", "time_hour", "hour", "proba", "decision")


def predict_requests(model: RiskModel, requests: DataFrame, grid: DataFrame, fallback: DataFrame, as_of: date) -> DataFrame:
    """Temporal result per request: probability of its region and hour, method and target by history.

    ``fallback`` holds (request_id, method, target). Only regions are scored, then joined to requests.
    """
    resolved = R.resolve_region(requests, grid)
    targets = grid.select("region").distinct().withColumn("date", F.lit(as_of))
    scored = score_region_hours(model, grid, targets).select(
        F.col("region").alias("resolved_region"), "hour", "proba"
    )
    confidence = round2(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("proba"))))
    notes = F.array(
        F.format_string("Region-hour model: probability of a successful incident in the hour (region=%s, hour=%d).",
                        "resolved_region", "hour"),
        F.format_string(V.TEMPORAL_NOTES[0], "ml_confidence"),
        F.format_string(V.TEMPORAL_NOTES[1], "asset_type"),
    )
    return (
        resolved.join(scored, ["resolved_region", "hour"])
        .join(fallback.select("request_id", F.col("method").alias("ml_method"), F.col("target").alias("ml_target")), "request_id")
        .withColumn("ml_confidence", confidence)
        .withColumn("ml_rationale", notes)
        .select("request_id", "ml_method", "ml_target", "ml_confidence", "ml_rationale")
    )

"""Risk score, rationale, predictions and request building, as expressions over request rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions import timecols as T
from incidentlake.functions.numbers import round2
from incidentlake.operators.intensity import attack_intensity
from incidentlake.session import materialized


def heuristic_method(asset: str | Column) -> Column:
    key = F.col(asset) if isinstance(asset, str) else asset
    return T.lookup(key, V.METHOD_BY_ASSET, F.lit(V.DEFAULT_METHOD))


def score(requests: DataFrame, weights: dict | None = None, criticality: dict | None = None) -> DataFrame:
    """Risk score and confidence of requests that carry ``attack_intensity``."""
    w = weights or V.SCORING_WEIGHTS
    asset = T.lookup(F.col("asset_type"), criticality or V.ASSET_CRITICALITY, F.lit(None).cast("double"))
    raw = (
        F.lit(float(w["vulnerability_count_weight"])) * F.col("known_vulnerabilities_count")
        + F.lit(float(w["attack_intensity_weight"])) * F.col("attack_intensity")
        + F.lit(float(w["asset_criticality_weight"])) * F.col("asset_criticality")
    )
    confidence = F.least(
        round2(F.lit(float(w["confidence_base"])) + F.col("risk_score") * F.lit(float(w["confidence_multiplier"]))),
        F.lit(V.CONFIDENCE_CAP),
    )
    return (
        requests.withColumn("asset_criticality", asset)
        .withColumn("risk_score", raw / F.lit(float(w["risk_score_normalizer"])))
        .withColumn("risk_score", F.least(round2(F.least(F.col("risk_score"), F.lit(1.0))), F.lit(V.RISK_CAP)))
        .withColumn("confidence", confidence)
    )


def rationale() -> Column:
    return F.array_compact(
        F.array(
            F.format_string(V.RATIONALE_VULNERABILITIES, "known_vulnerabilities_count"),
            F.format_string(V.RATIONALE_INTENSITY, "industry", "attack_intensity"),
            F.format_string(V.RATIONALE_CRITICALITY, "asset_type", "asset_criticality"),
            F.when(F.col("has_external_access"), V.RATIONALE_EXTERNAL),
            F.when(F.col("privileged_accounts_count") >= V.MANY_PRIVILEGED_ACCOUNTS, V.RATIONALE_PRIVILEGED),
        )
    )


def scored_requests(requests: DataFrame, incidents: DataFrame) -> DataFrame:
    return score(attack_intensity(requests, incidents))


def recommendation_lists(recommendations: DataFrame) -> DataFrame:
    """Method -> ordered list of recommendations (a handful of config rows per method)."""
    entry = F.struct("pos", "code", "title", "description", "priority")
    return recommendations.groupBy("method").agg(F.sort_array(F.collect_list(entry)).alias("recommendations"))


def with_recommendations(df: DataFrame, recommendations: DataFrame, method: str) -> DataFrame:
    """Attach the ordered recommendations of a method column; unknown methods get an empty list."""
    lists = recommendation_lists(recommendations).withColumnRenamed("method", "_method")
    empty = F.array().cast(lists.schema["recommendations"].dataType)
    return (
        df.join(lists, F.col(method) == F.col("_method"), "left")
        .withColumn("recommendations", F.coalesce("recommendations", empty))
        .drop("_method")
    )


def predict(
    requests: DataFrame,
    incidents: DataFrame,
    recommendations: DataFrame,
    as_of: datetime,
    ml: DataFrame | None = None,
) -> DataFrame:
    """Full prediction row per request.

    ``ml`` may carry (request_id, ml_method, ml_target, ml_confidence, ml_rationale) for
    requests with ``prefer_ml``; it replaces method, target and confidence only.
    """
    df = (
        scored_requests(requests, incidents)
        .withColumn("predicted_attack_method", heuristic_method("asset_type"))
        .withColumn("predicted_target_object", F.col("asset_type"))
        .withColumn("rationale", rationale())
    )
    asked = F.coalesce(F.col("prefer_ml"), F.lit(False))
    if ml is None:
        df = df.withColumn(
            "rationale", F.when(asked, F.array_append("rationale", F.lit(V.RATIONALE_ML_OFF))).otherwise(F.col("rationale"))
        )
    else:
        df = df.join(ml, "request_id", "left")
        used = asked & F.col("ml_method").isNotNull()
        df = df.withColumns(
            {
                "predicted_attack_method": F.when(used, F.col("ml_method")).otherwise(F.col("predicted_attack_method")),
                "predicted_target_object": F.when(used, F.col("ml_target")).otherwise(F.col("predicted_target_object")),
                "confidence": F.when(used, F.col("ml_confidence")).otherwise(F.col("confidence")),
                "rationale": F.when(
                    used, F.concat("rationale", F.array(F.lit(V.RATIONALE_ML_ON)), F.col("ml_rationale"))
                )
                .when(asked, F.array_append("rationale", F.lit(V.RATIONALE_ML_OFF)))
                .otherwise(F.col("rationale")),
            }
        ).drop("ml_method", "ml_target", "ml_confidence", "ml_rationale")
    df = df.withColumn("predicted_attack_time_window", T.time_window(F.col("hour")))
    df = df.withColumn("generated_at", F.lit(as_of).cast("timestamp_ntz"))
    return with_recommendations(df, recommendations, "predicted_attack_method")


SLICES = {
    "time": ("generated_at", "predicted_attack_time_window", "confidence", "rationale"),
    "target": ("generated_at", "predicted_target_object", "confidence", "rationale"),
    "method": ("generated_at", "predicted_attack_method", "confidence", "rationale"),
    "recommendations": (
        "generated_at", "predicted_attack_method", "predicted_target_object", "recommendations", "confidence",
    ),
}


def prediction_slice(predictions: DataFrame, name: str) -> DataFrame:
    return predictions.select("request_id", *SLICES[name])


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def alert_band(risk: str = "risk_score") -> dict[str, Column]:
    """Whole percent of the risk score, its alert type and progress status."""
    percent = half_up(F.col(risk) * 100).cast("int")
    return {
        "risk_percent": percent,
        "alert": F.when(percent > V.ALERT_ERROR_PERCENT, "error").otherwise("warning"),
        "progress": F.when(percent > V.ALERT_EXCEPTION_PERCENT, "exception").otherwise("active"),
    }


def requests_from_settings(settings: DataFrame, as_of: datetime) -> DataFrame:
    """One request per organization from its saved settings; the clock is a parameter."""
    hosts = F.greatest(F.col("host_count"), F.lit(1))
    tech = F.col("technologies")
    asset = F.coalesce(
        *[F.when(F.array_contains(tech, name), F.lit(asset)) for name, asset in V.ASSET_BY_TECHNOLOGY],
        F.lit(V.DEFAULT_TARGET),
    )
    now = F.lit(as_of).cast("timestamp_ntz")
    return settings.select(
        F.col("organization_id"),
        T.lookup(F.col("region"), V.REGION_ALIASES, F.lit(V.REQUEST_DEFAULTS["region"])).alias("region"),
        T.lookup(F.col("industry"), V.INDUSTRY_ALIASES, F.lit(V.REQUEST_DEFAULTS["industry"])).alias("industry"),
        T.season(F.month(now)).alias("season"),
        T.iso_weekday(now).alias("day_of_week"),
        F.hour(now).alias("hour"),
        asset.alias("asset_type"),
        F.arrays_overlap(tech, F.array(*map(F.lit, V.EXTERNAL_TECHNOLOGIES))).alias("has_external_access"),
        F.greatest(F.lit(1), half_up(hosts / V.HOSTS_PER_ACCOUNT)).cast("int").alias("privileged_accounts_count"),
        F.greatest(F.lit(1), half_up(hosts / V.HOSTS_PER_VULNERABILITY) + F.size(tech) * 2)
        .cast("int")
        .alias("known_vulnerabilities_count"),
    )


def fill_request_defaults(requests: DataFrame, as_of: datetime) -> DataFrame:
    """Fill missing request fields; blanks count as missing for the text fields."""
    now = F.lit(as_of).cast("timestamp_ntz")
    defaults: dict[str, Column] = {name: F.lit(value) for name, value in V.REQUEST_DEFAULTS.items()}
    defaults |= {"season": T.season(F.month(now)), "day_of_week": T.iso_weekday(now), "hour": F.hour(now)}
    texts = {f.name for f in requests.schema.fields if f.dataType.simpleString() == "string"}
    return requests.withColumns(
        {
            name: F.coalesce(F.nullif(name, F.lit("")) if name in texts else F.col(name), default)
            for name, default in defaults.items()
            if name in requests.columns
        }
    )


def _favourites(folded: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """(key, method, target) under ``names``: the most frequent of each key; ties go to the value met first."""
    counts = (
        folded.unpivot([key, "n", "first_id"], ["attack_method", "target_object"], "what", "value")
        .groupBy(key, "what", "value")
        .agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    )

    def best(what: str, name: str) -> Column:
        rank = F.when(F.col("what") == what, F.struct(F.col("n"), -F.col("first_id")))
        return F.max_by("value", rank).alias(name)

    return counts.groupBy(F.col(key).alias(names[0])).agg(best("attack_method", names[1]), best("target_object", names[2]))


def method_target_fallback(requests: DataFrame, grain: DataFrame) -> DataFrame:
    """Most frequent method and target of the organization, else of the region, else by asset.

    ``grain`` is the statistics grain keyed by organization, which also has the region. It is folded to
    (organization, region, method, target) counts once; both levels come from these.
    """
    keys = ("organization_code", "region", "attack_method", "target_object")
    folded = materialized(grain.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id")))
    org = _favourites(folded, "organization_code", ("org_key", "org_method", "org_target"))
    region = _favourites(folded, "region", ("region_key", "region_method", "region_target"))
    return (
        requests.join(org, F.col("organization_id") == F.col("org_key"), "left")
        .join(region, F.col("region") == F.col("region_key"), "left")
        .withColumn("method", F.coalesce("org_method", "region_method", heuristic_method("asset_type")))
        .withColumn("target", F.coalesce("org_target", "region_target", "asset_type"))
        .drop("org_key", "org_method", "org_target", "region_key", "region_method", "region_target")
    )

"""Text classifiers and the per-incident risk level, generated from token tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V


def normalized_text(*parts: str | Column) -> Column:
    """Lower-case join of the parts, without nulls, blanks and the literal ``nan``."""
    kept = [F.nullif(F.nullif(p if isinstance(p, Column) else F.col(p), F.lit("")), F.lit("nan")) for p in parts]
    return F.lower(F.concat_ws(" ", *kept))


def first_hit(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first rule one of whose tokens is a substring of the text."""
    hits = []
    for label, tokens in rules:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | F.contains(text, F.lit(token))
        hits.append(F.when(hit, F.lit(label)))
    return F.coalesce(*hits, F.lit(default))


def attack_method(name="name", description="description", impact="object_of_impact") -> Column:
    return first_hit(normalized_text(name, description, impact), V.METHOD_TOKENS, V.DEFAULT_METHOD)


def target_object(name="name", description="description", impact="object_of_impact") -> Column:
    return first_hit(normalized_text(impact, name, description), V.TARGET_TOKENS, V.DEFAULT_TARGET)


def risk_level(success: Column, large: Column, method: Column) -> Column:
    """Two points for success, one for a large site, one for a severe method."""
    points = success * 2 + large.cast("int") + method.isin(*V.SEVERE_METHODS).cast("int")
    return (
        F.when(points >= 4, "critical").when(points >= 3, "high").when(points >= 2, "medium").otherwise("low")
    )


def is_large(host_count: str | Column = "host_count") -> Column:
    return F.coalesce(F.col(host_count) if isinstance(host_count, str) else host_count, F.lit(0)) >= V.LARGE_HOST_COUNT


def classify_registry(registry: DataFrame) -> DataFrame:
    """Method and target per threat, so text is scanned once per threat and not per incident."""
    return registry.withColumns({"attack_method": attack_method(), "target_object": target_object()})


def with_classes(incidents: DataFrame, registry: DataFrame) -> DataFrame:
    """Add attack_method and target_object by threat code; unmatched codes get the defaults.

    No broadcast hint: Spark broadcasts the registry while it is under its size threshold
    and shuffles with skew handling beyond it.
    """
    classes = classify_registry(registry).select("threat_code", "attack_method", "target_object")
    return incidents.join(classes, "threat_code", "left").withColumns(
        {
            "attack_method": F.coalesce("attack_method", F.lit(V.DEFAULT_METHOD)),
            "target_object": F.coalesce("target_object", F.lit(V.DEFAULT_TARGET)),
        }
    )

"""Validation splits and referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V


def with_errors(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``errors``, the messages of the checks that did not hold; a null check does not hold."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in checks.items()]
    return df.withColumn("errors", F.array_compact(F.array(*failed)))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of a checked frame."""
    bad = F.size("errors") > 0
    return checked.where(~bad).drop("errors"), checked.where(bad)


def check_requests(requests: DataFrame) -> DataFrame:
    return with_errors(
        requests,
        {
            "organization_id": F.col("organization_id").isNotNull(),
            "region": F.col("region").isNotNull(),
            "industry": F.col("industry").isNotNull(),
            "season": F.col("season").isin(*V.SEASONS),
            "day_of_week": F.col("day_of_week").between(1, 7),
            "hour": F.col("hour").between(0, 23),
            "asset_type": F.col("asset_type").isin(*V.TARGETS),
            "privileged_accounts_count": F.col("privileged_accounts_count") >= 0,
            "known_vulnerabilities_count": F.col("known_vulnerabilities_count") >= 0,
        },
    )


def check_vulnerabilities(vulnerabilities: DataFrame) -> DataFrame:
    return with_errors(
        vulnerabilities,
        {
            "asset_type": F.col("asset_type").isin(*V.TARGETS),
            "severity": F.col("severity").isin(*V.SEVERITIES),
            **{
                name: F.col(name).isNotNull()
                for name in ("asset_id", "asset_name", "vulnerability_code", "title", "description")
            },
        },
    )


def require_rows(batch: DataFrame, message: str = "At least one vulnerability is required") -> DataFrame:
    """Reject an empty batch."""
    if batch.isEmpty():
        raise ValueError(message)
    return batch


def check_settings(settings: DataFrame) -> DataFrame:
    return with_errors(
        settings,
        {
            "region": F.length("region").between(1, 64),
            "industry": F.length("industry").between(1, 64),
            "host_count": F.col("host_count") >= 1,
        },
    )


def _violations(df: DataFrame, kind: str, key: str, checks: dict[str, Column]) -> DataFrame:
    return with_errors(df, checks).select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.explode("errors").alias("violation")
    )


def _subset(column: str, allowed) -> Column:
    return F.size(F.array_except(column, F.array(*map(F.lit, allowed)))) == 0


def rule_violations(rules: DataFrame) -> DataFrame:
    return _violations(
        rules, "rule", "rule_ord",
        {
            "tokens must not be empty": F.size("tokens") > 0,
            "match_score out of range": F.col("match_score").between(0, 1),
            "unknown recommendation method": F.col("recommendation_method").isin(*V.METHODS),
        },
    )


def catalog_violations(catalog: DataFrame) -> DataFrame:
    return _violations(
        catalog, "threat", "threat_id",
        {
            "unknown severity": F.col("severity").isin(*V.SEVERITIES),
            "unknown target": _subset("likely_targets", V.TARGETS),
            "unknown method": _subset("common_methods", V.METHODS),
        },
    )


def recommendation_violations(recommendations: DataFrame) -> DataFrame:
    return _violations(
        recommendations, "recommendation", "code",
        {
            "unknown method": F.col("method").isin(*V.METHODS),
            "priority out of range": F.col("priority").between(1, 5),
        },
    )


def scoring_violations(scoring: DataFrame) -> DataFrame:
    """Checks over the one-row scoring configuration."""
    positive = (
        "vulnerability_count_weight", "attack_intensity_weight", "asset_criticality_weight", "risk_score_normalizer",
    )
    shares = ("confidence_base", "confidence_multiplier")
    critical = F.col("asset_criticality_by_target")
    return _violations(
        scoring.withColumn("id", F.lit("scoring")), "scoring", "id",
        {
            **{f"{c} must be positive": F.col(c) > 0 for c in positive},
            **{f"{c} out of range": F.col(c).between(0, 1) for c in shares},
            "unknown target": F.size(F.array_except(F.map_keys(critical), F.array(*map(F.lit, V.TARGETS)))) == 0,
            "asset criticality values must be non-negative": F.forall(F.map_values(critical), lambda x: x >= 0),
        },
    )


def rule_orphans(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules whose threat is not in the catalog."""
    return rules.join(catalog, "threat_id", "left_anti").select("rule_ord", "threat_id")


def require_threats(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    missing = [r.threat_id for r in rule_orphans(rules, catalog).limit(5).collect()]
    if missing:
        raise KeyError(f"threats not in the catalog: {missing}")
    return rules


def orphan_threat_placeholders(incidents: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows for threat codes that only the incidents know."""
    missing = incidents.select("threat_code").distinct().join(registry, "threat_code", "left_anti")
    text = F.lit(None).cast("string")
    time = F.lit(None).cast("timestamp_ntz")
    return missing.select(
        "threat_code",
        F.concat(F.lit("Threat "), F.col("threat_code").cast("string")).alias("name"),
        F.lit(V.PLACEHOLDER_DESCRIPTION).alias("description"),
        text.alias("source_characteristics"),
        text.alias("object_of_impact"),
        *[F.lit(0).alias(c) for c in ("confidentiality_breach", "integrity_breach", "availability_breach")],
        time.alias("date_added"),
        time.alias("last_modified"),
        text.alias("status"),
        text.alias("notes"),
    )


def orphan_orgs(incidents: DataFrame, organizations: DataFrame) -> DataFrame:
    """Organizations (name, code) that only the incidents know."""
    codes = incidents.select(F.col("organization_code").alias("code")).where("code is not null").distinct()
    return codes.join(organizations, "code", "left_anti").select(
        F.concat(F.lit("Organization "), "code").alias("name"), "code"
    )


def backfill_org_id(incidents: DataFrame, organizations: DataFrame) -> DataFrame:
    ids = organizations.select(F.col("code").alias("organization_code"), F.col("id").alias("organization_id"))
    return incidents.join(ids, "organization_code", "left")


def organization_by_code(organizations: DataFrame, code: str | None) -> DataFrame:
    """Organization of a trimmed code; blank gives nothing."""
    wanted = (code or "").strip()
    return organizations.where((F.col("code") == wanted) & F.lit(wanted != ""))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table with a warning on empty ones."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("warning", F.when(F.col("n") == 0, F.concat("table_name", F.lit(" is empty"))))

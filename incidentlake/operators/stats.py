"""Filtered incident statistics over whole tables."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions import classify as C
from incidentlake.functions import timecols as T

DIMENSIONS = (
    "risk_level", "season", "time_of_day", "hour", "region", "target_object", "month", "attack_method",
)


@dataclass(frozen=True)
class IncidentFilters:
    """Optional predicates; ``None`` leaves a column alone."""

    organization_code: str | None = None
    season: str | None = None
    region: str | None = None
    industry: str | None = None
    success: int | None = None
    time_of_day: str | None = None
    threat_code: int | None = None
    date_from: date | None = None
    date_to: date | None = None

    def predicate(self) -> Column:
        kept = F.lit(True)
        for field in fields(self):
            value = getattr(self, field.name)
            if value is None or field.name in ("date_from", "date_to"):
                continue
            kept = kept & (F.col(field.name) == F.lit(value))
        if self.date_from is not None:
            kept = kept & (F.col("incident_date") >= _midnight(self.date_from))
        if self.date_to is not None:
            kept = kept & (F.col("incident_date") < _midnight(self.date_to) + F.expr("interval 1 day"))
        return kept


def _midnight(day: date) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def filter_incidents(incidents: DataFrame, filters: IncidentFilters | None = None) -> DataFrame:
    return incidents if filters is None else incidents.where(filters.predicate())


def enriched(incidents: DataFrame, registry: DataFrame) -> DataFrame:
    """Every incident with its registry texts, method, target and risk level."""
    names = C.classify_registry(registry).select(
        "threat_code", "name", "description", "object_of_impact", "attack_method", "target_object"
    )
    df = incidents.join(names, "threat_code", "left").withColumns(
        {
            "attack_method": F.coalesce("attack_method", F.lit(V.DEFAULT_METHOD)),
            "target_object": F.coalesce("target_object", F.lit(V.DEFAULT_TARGET)),
        }
    )
    return df.withColumn("risk_level", C.risk_level(F.col("success"), C.is_large(), F.col("attack_method")))


def grain(
    incidents: DataFrame,
    registry: DataFrame,
    filters: IncidentFilters | None = None,
    attack_method: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Counts at the finest grain the statistics need.

    One partial aggregation over the incidents; its groups are bounded by region x month x
    hour x threat x 4 (x the ``by`` keys), and the registry is joined only to those groups.
    A hot organization or region is folded before the shuffle.
    """
    keys = {
        "month": T.year_month(F.col("incident_date")),
        "large": C.is_large(),
    }
    counts = (
        filter_incidents(incidents, filters)
        .groupBy(
            *by, "region", "season", "time_of_day", "hour", "threat_code", "success",
            *[expr.alias(name) for name, expr in keys.items()],
        )
        .agg(F.count(F.lit(1)).alias("n"), F.min("incident_id").alias("first_id"))
    )
    df = C.with_classes(counts, registry)
    if attack_method is not None:
        df = df.where(F.col("attack_method") == attack_method)
    return df.withColumn(
        "risk_level", C.risk_level(F.col("success"), F.col("large"), F.col("attack_method"))
    )


def by_dimension(grain_df: DataFrame, dimensions=DIMENSIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """Long counts (dimension, key, n); null keys (undated incidents) are left out."""
    narrow = grain_df.select(*by, "n", *[F.col(d).cast("string").alias(d) for d in dimensions])
    return (
        narrow.unpivot([*by, "n"], list(dimensions), "dimension", "key")
        .where(F.col("key").isNotNull())
        .groupBy(*by, "dimension", "key")
        .agg(F.sum("n").alias("n"))
    )


def by_one(grain_df: DataFrame, dimension: str) -> DataFrame:
    return (
        grain_df.where(F.col(dimension).isNotNull()).groupBy(dimension).agg(F.sum("n").alias("n"))
    )


def top_of(grain_df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent value per group; ties go to the value met first in id order."""
    counts = grain_df.groupBy(*by, column).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    best = F.max_by(column, F.struct(F.col("n"), -F.col("first_id"))).alias(f"top_{column}")
    return counts.groupBy(*by).agg(best)


def _firsts(grain_df: DataFrame, dimensions) -> DataFrame:
    """Long counts with the smallest incident id of every value, the tie-break of the top values."""
    narrow = grain_df.select("n", "first_id", *[F.col(d).cast("string").alias(d) for d in dimensions])
    return (
        narrow.unpivot(["n", "first_id"], list(dimensions), "dimension", "key")
        .where(F.col("key").isNotNull())
        .groupBy("dimension", "key")
        .agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    )


def _headline() -> list[Column]:
    """Total and both top values over long counts, with defaults when there are none."""

    def best(what: str, default: str) -> Column:
        hit = F.col("dimension") == what
        rank = F.when(hit, F.struct(F.col("n"), -F.col("first_id")))
        return F.coalesce(F.max_by(F.when(hit, F.col("key")), rank), F.lit(default))

    total = F.sum(F.when(F.col("dimension") == "attack_method", F.col("n")))
    return [
        F.coalesce(total, F.lit(0)).cast("bigint").alias("total_incidents"),
        best("attack_method", V.DEFAULT_METHOD).alias("top_attack_method"),
        best("target_object", V.DEFAULT_TARGET).alias("top_target_object"),
    ]


def top_method_target(grain_df: DataFrame) -> DataFrame:
    """One row with the total and both top values; defaults on an empty input."""
    return _firsts(grain_df, ("attack_method", "target_object")).agg(*_headline())


def top_regions(grain_df: DataFrame, n: int = 15) -> DataFrame:
    return by_one(grain_df, "region").orderBy(F.desc("n"), "region").limit(n)


def top_targets(grain_df: DataFrame, n: int = 5) -> DataFrame:
    return by_one(grain_df, "target_object").orderBy(F.desc("n"), "target_object").limit(n)


def document(grain_df: DataFrame) -> DataFrame:
    """The whole statistics answer as one row of scalars and maps.

    The maps hold one entry per dimension value, so their size does not follow the data;
    the region map keeps the top fifteen, as a report.
    """
    entry = F.struct("key", "n")

    def as_map(dimension: str, size: int | None = None) -> Column:
        rows = F.collect_list(F.when(F.col("dimension") == dimension, entry))
        if size is None:
            rows = F.sort_array(rows)
        else:
            ranked = F.sort_array(F.transform(rows, lambda r: F.struct((-r.n).alias("rank"), r.key, r.n)))
            rows = F.transform(F.slice(ranked, 1, size), lambda r: F.struct(r.key, r.n))
        return F.map_from_entries(rows)

    maps = [
        as_map(d, 15 if d == "region" else None).alias(
            "risk_distribution" if d == "risk_level" else f"incidents_by_{d}"
        )
        for d in DIMENSIONS
    ]
    return _firsts(grain_df, DIMENSIONS).agg(*_headline(), *maps)


def document_rows(answer: DataFrame) -> DataFrame:
    """The entries of the maps of ``document`` as rows (section, key, n)."""
    names = ["risk_distribution" if d == "risk_level" else f"incidents_by_{d}" for d in DIMENSIONS]

    def entries(name: str) -> Column:
        return F.transform(F.map_entries(name), lambda e: F.struct(F.lit(name).alias("section"), e.key.alias("key"), e.value.alias("n")))

    return answer.select(F.inline(F.concat(*[entries(c) for c in names])))


# ---- report metrics on the long counts -----------------------------------------------


def _sum_if(condition: Column, value: Column | None = None) -> Column:
    return F.sum(F.when(condition, F.col("n") if value is None else value).otherwise(F.lit(0)))


def risk_index(grain_df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted share of the risk levels. Weights enter as whole hundredths, so sums stay exact."""
    hundredths = {level: round(weight * 100) for level, weight in V.RISK_INDEX_WEIGHTS.items()}
    weight = T.lookup(F.col("risk_level"), hundredths, F.lit(0))
    counts = grain_df.groupBy(*by, "risk_level").agg(F.sum("n").alias("n"))
    index = F.least(F.lit(1.0), F.sum(weight * F.col("n")) / F.greatest(F.sum("n") * 100, F.lit(1)))
    return (
        counts.groupBy(*by)
        .agg(F.round(F.coalesce(index, F.lit(0.0)), 6).alias("risk_index"))
        .withColumn("elevated", (F.col("risk_index") > V.RISK_INDEX_ELEVATED).cast("int"))
    )


def kpi_elevated(grain_df: DataFrame) -> DataFrame:
    return grain_df.agg(
        F.coalesce(_sum_if(F.col("risk_level").isin("high", "critical")), F.lit(0)).alias("elevated")
    )


def kpi_peak_hour(grain_df: DataFrame) -> DataFrame:
    return by_one(grain_df, "hour").agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak"))


def dense_series(grain_df: DataFrame, column: str, labels: dict) -> DataFrame:
    """Counts in a fixed key order with zeros for absent keys.

    The keys become the columns of one global aggregate, so nothing is joined.
    """
    sums = grain_df.agg(
        *[F.coalesce(_sum_if(F.col(column) == key), F.lit(0)).alias(f"v{i}") for i, key in enumerate(labels)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.col(f"v{i}").alias("value"))
            for i, label in enumerate(labels.values())
        ]
    )
    return sums.select(F.inline(rows))


def hourly_series(grain_df: DataFrame) -> DataFrame:
    return dense_series(grain_df, "hour", {h: f"{h}:00" for h in range(24)})


def season_series(grain_df: DataFrame) -> DataFrame:
    return dense_series(grain_df, "season", V.SEASON_LABELS)


def time_of_day_series(grain_df: DataFrame) -> DataFrame:
    return dense_series(grain_df, "time_of_day", V.TIME_OF_DAY_LABELS)


def _labelled(grain_df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """Counts of a dimension under display labels; one placeholder row when there is nothing."""
    rows = by_one(grain_df, column).select(T.lookup(F.col(column), labels, F.col(column)).alias("label"), F.col("n").alias("value"))
    empty = grain_df.agg(F.count(F.lit(1)).alias("rows")).where("rows = 0").select(
        F.lit(V.EMPTY_LABEL).alias("label"), F.lit(1).cast("bigint").alias("value")
    )
    return rows.unionByName(empty)


def target_labels(grain_df: DataFrame) -> DataFrame:
    return _labelled(grain_df, "target_object", V.TARGET_LABELS)


def method_labels(grain_df: DataFrame) -> DataFrame:
    return _labelled(grain_df, "attack_method", V.METHOD_LABELS)


def heatmap_rows(grain_df: DataFrame) -> DataFrame:
    return by_one(grain_df, "hour").select(
        F.lit(V.HEATMAP_DAY).alias("day"),
        F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")).alias("hour"),
        F.col("n").alias("value"),
    )


def risk_distribution_rows(grain_df: DataFrame) -> DataFrame:
    return by_one(grain_df, "risk_level").select(
        F.upper("risk_level").alias("category"), F.col("n").alias("count")
    )


def facets(incidents: DataFrame) -> DataFrame:
    """Distinct non-empty regions and industries per organization, one row per value."""
    return (
        incidents.groupBy("organization_code", "region", "industry")
        .agg(F.count(F.lit(1)).alias("n"))
        .unpivot(["organization_code"], ["region", "industry"], "facet", "value")
        .where(F.col("value") != "")
        .distinct()
    )


def key_frequency(df: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """Count and share of every key value. Only the counted keys are ranked against the total."""
    counts = df.groupBy(key).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def data_summary(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg("success"), 6).alias("success_share"),
        F.min("regional_time").alias("first_time"),
        F.max("regional_time").alias("last_time"),
    )


def lookback(incidents: DataFrame, days: int = V.LOOKBACK_DAYS) -> DataFrame:
    """Incidents of the last ``days`` days before the newest one, both ends included."""
    newest = incidents.agg(F.max("regional_time")).scalar()
    return incidents.where(F.col("regional_time") >= newest - F.expr(f"interval {int(days)} days"))

"""Ingest of raw logs into typed tables, and the idempotent loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake import schema
from incidentlake.functions import timecols as T
from incidentlake.operators.skew import numbered
from incidentlake.session import local_table


def _renamed(raw: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Known columns under their table names; headers are matched with collapsed white space."""
    wanted = {" ".join(c.split()): c for c in raw.columns}
    return raw.select(*[F.col(f"`{wanted[h]}`").alias(name) for h, name in headers.items() if h in wanted])


def to_int(column: str):
    """Lenient integer: blanks and garbage are null, ``12.0`` is 12."""
    number = F.trim(column).try_cast("double")
    return F.when(number == F.floor(number), number).try_cast("int")


def normalize_incidents(raw: DataFrame) -> DataFrame:
    """Typed incidents with derived time columns from the all-string log."""
    df = _renamed(raw, {**V.INCIDENT_HEADERS, "incident_id": "incident_id"})
    typed = df.withColumns(
        {
            "host_count": to_int("host_count"),
            "threat_code": to_int("threat_code"),
            "success": to_int("success"),
            "incident_date": T.parse_lenient(F.col("incident_date")),
            "regional_time": T.parse_lenient(F.col("regional_time")),
        }
    )
    return T.derive_time_columns(typed)


def normalize_registry(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Typed registry rows: nullable code, zero-filled flags, nullable dates. ``extra`` columns are kept."""
    df = _renamed(raw, {**V.REGISTRY_HEADERS, **{name: name for name in extra}})
    changes = {"threat_code": to_int("threat_code")}
    for name in ("confidentiality_breach", "integrity_breach", "availability_breach"):
        if name in df.columns:
            changes[name] = F.coalesce(to_int(name), F.lit(0))
    for name in ("date_added", "last_modified"):
        if name in df.columns:
            changes[name] = T.parse_lenient(F.col(name))
    return df.withColumns(changes)


def clean_incidents(incidents: DataFrame) -> DataFrame:
    """Trim keys, drop rows with a missing required value or a success flag outside 0 / 1."""
    df = incidents.withColumns({c: F.trim(c) for c in ("industry", "organization_code", "region")})
    required = ["industry", "organization_code", "host_count", "threat_code", "success", "region", "regional_time"]
    return df.dropna("any", subset=required).where(F.col("success").isin(0, 1))


def dedup_registry(registry: DataFrame, order: str) -> DataFrame:
    """First row per threat code in file order, as an aggregate, so copies fold before the shuffle."""
    rest = [c for c in registry.columns if c not in ("threat_code", order)]
    return (
        registry.where(F.col("threat_code").isNotNull())
        .groupBy("threat_code")
        .agg(F.min_by(F.struct(*rest), order).alias("row"))
        .select("threat_code", "row.*")
    )


def model_base(incidents: DataFrame, registry: DataFrame) -> DataFrame:
    """Cleaned incidents with registry source, impact object and flags; unmatched codes get defaults.

    ``registry`` must be unique on threat_code.
    """
    dim = registry.select(
        "threat_code",
        F.trim("name").alias("threat_name"),
        F.trim("source_characteristics").alias("threat_source"),
        F.trim("object_of_impact").alias("impact_object"),
        "confidentiality_breach",
        "integrity_breach",
        "availability_breach",
    )
    df = clean_incidents(incidents).join(dim, "threat_code", "left")
    fills = {c: F.coalesce(c, F.lit(V.UNKNOWN)) for c in ("threat_name", "threat_source", "impact_object")}
    fills |= {
        c: F.coalesce(c, F.lit(0)) for c in ("confidentiality_breach", "integrity_breach", "availability_breach")
    }
    return df.withColumns(fills)


# ---- source choice ------------------------------------------------------------------------


def first_available(*sources: Callable[[], DataFrame | None]) -> DataFrame:
    """The first source that has rows: table, then file, then built-in rows."""
    for source in sources[:-1]:
        df = source()
        if df is not None and not df.isEmpty():
            return df
    return sources[-1]()


def saved(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame | None:
    """A stored table, or ``None`` when it is not there. ``fmt='jdbc'`` reads a database table."""
    try:
        reader = spark.read.format(fmt).options(**options)
        return reader.load() if fmt == "jdbc" else reader.load(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def builtin_incidents(spark: SparkSession) -> DataFrame:
    names = "organization_code,industry,host_count,threat_code,success,region,incident_date,regional_time".split(",")
    ddl = ", ".join(f"{n} {'int' if n in ('host_count', 'threat_code', 'success') else 'string'}" for n in names)
    df = local_table(spark, V.BUILTIN_INCIDENTS, ddl)
    times = {c: T.parse_lenient(F.col(c)) for c in ("incident_date", "regional_time")}
    return T.derive_time_columns(df.withColumns(times))


def builtin_registry(spark: SparkSession) -> DataFrame:
    df = local_table(
        spark, V.BUILTIN_REGISTRY, "threat_code int, name string, description string, object_of_impact string"
    )
    return df.withColumn("status", F.lit(V.BUILTIN_STATUS))


# ---- idempotent loads ---------------------------------------------------------------------


def seed_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: coded threats that the table does not hold yet."""
    return incoming.where(F.col("threat_code").isNotNull()).join(existing, "threat_code", "left_anti")


def build_organizations(incidents: DataFrame, existing: DataFrame) -> DataFrame:
    """New organizations (name, code), one per distinct incident code."""
    codes = incidents.select(F.col("organization_code").alias("code")).where("code is not null").distinct()
    return codes.join(existing, "code", "left_anti").select(
        F.concat(F.lit("Organization "), "code").alias("name"), "code"
    )


def seed_incidents(incidents: DataFrame, organizations: DataFrame) -> DataFrame:
    """Incidents with their organization id; rows of unknown organizations are skipped."""
    ids = organizations.select(F.col("code").alias("organization_code"), F.col("id").alias("organization_id"))
    return incidents.join(ids, "organization_code")


def append_if_empty(rows: DataFrame, path: str) -> bool:
    """Write ``rows`` as Parquet unless the folder already holds data; true when written."""
    current = saved(rows.sparkSession, path)
    if current is not None and not current.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def upsert_settings(existing: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """One settings row per organization: the newest update, else the stored row.

    Technologies are kept as JSON text. The newest row is an aggregate, so repeated updates
    of one organization fold before the shuffle.
    """
    columns = ["region", "industry", "host_count", "technologies"]

    def stored(df: DataFrame, rank) -> DataFrame:
        return df.select(
            "organization_id", "region", "industry", "host_count",
            F.to_json("technologies").alias("technologies"), rank.alias("rank"),
        )

    both = stored(existing, F.lit(None).cast("bigint")).unionByName(
        stored(updates, F.col(order).cast("bigint"))
    )
    newest = F.max_by(F.struct(*columns), F.coalesce("rank", F.lit(-(2**63 - 1)).cast("bigint")))
    return both.groupBy("organization_id").agg(newest.alias("row")).select("organization_id", "row.*")


def read_settings(stored: DataFrame) -> DataFrame:
    """Stored settings with the technologies back as a list."""
    return stored.withColumn(
        "technologies", F.from_json(F.coalesce("technologies", F.lit("[]")), "array<string>")
    )


# ---- configuration ----------------------------------------------------------------------


def rules_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Mapping rules in order, built in or from JSON documents, which count in the order of their names and are numbered by ranges."""
    if path is None:
        return local_table(spark, [(i, list(r[0]), *r[1:]) for i, r in enumerate(V.MAPPING_RULES)], schema.RULES)
    document = spark.read.schema(schema.RULES_JSON).option("multiLine", True).json(path)
    placed = document.select(F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("_at"), "*")
    ordered = numbered(placed, "_at", "_n").withColumn("rule_ord", (F.col("_n") - 1).cast("int"))
    return ordered.select("rule_ord", "tokens", "threat_id", "match_score", "reason", "recommendation_method")


def catalog_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path is None:
        rows = [(*t[:5], list(t[5]), list(t[6]), V.CATALOG_SOURCE) for t in V.CATALOG_THREATS]
        return local_table(spark, rows, schema.CATALOG)
    document = spark.read.schema(schema.CATALOG_JSON).option("multiLine", True).json(path)
    return document.select(F.inline("threats")).withColumn(
        "source", F.coalesce("source", F.lit(V.CATALOG_SOURCE))
    )


def recommendations_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path is None:
        seen: dict[str, int] = {}
        rows = []
        for method, *rest in V.RECOMMENDATIONS:
            seen[method] = seen.get(method, 0) + 1
            rows.append((method, seen[method], *rest))
        return local_table(spark, rows, schema.RECOMMENDATIONS)
    document = spark.read.schema(schema.CATALOG_JSON).option("multiLine", True).json(path)
    lists = document.select(F.explode("recommendations").alias("method", "list"))
    return lists.select("method", F.posexplode("list").alias("pos", "r")).select(
        "method", (F.col("pos") + 1).alias("pos"), "r.*"
    )


def scoring_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One-row scoring configuration."""
    if path is None:
        row = (*V.SCORING_WEIGHTS.values(), list(V.ASSET_CRITICALITY.items()))
        return local_table(spark, [row], schema.SCORING_JSON)
    return spark.read.schema(schema.SCORING_JSON).option("multiLine", True).json(path)


def read_vulnerabilities(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Vulnerability JSON: a bare array, or an object with a ``vulnerabilities`` array.

    One document per file by default; with ``multi_line=False`` one document per line, so
    that large files split.
    """
    item = ",".join(f"{f.split()[0]}:{f.split()[1]}" for f in schema.VULNERABILITIES.split(", "))
    both = f"{schema.VULNERABILITIES}, vulnerabilities array<struct<{item}>>"
    rows = spark.read.schema(both).option("multiLine", multi_line).json(path)
    flat = F.struct(*[f.split()[0] for f in schema.VULNERABILITIES.split(", ")])
    return rows.select(F.inline(F.coalesce("vulnerabilities", F.array(flat))))

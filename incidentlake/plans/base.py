"""Query registry, and the incident domain projected from the given tables.

Each domain view exists twice: as a DataFrame (``Domain``) and as a SQL text
(``VIEW_SQL``) for the check against a second engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake import schema
from incidentlake.functions import timecols as T
from incidentlake.session import local_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query written against a ``Domain``, with its SQL twin where there is one."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# ---- SQL text helpers ------------------------------------------------------------------


def quoted(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"cast({value!r} as double)"
    if isinstance(value, (tuple, list)):
        return "[" + ", ".join(quoted(v) for v in value) + "]"
    return str(value)


def values(rows, alias: str, columns: str) -> str:
    body = ",\n".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return f"(values {body}) as {alias}({columns})"


def sql_case(key: str, table: dict, default: str) -> str:
    branches = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in table.items())
    return f"case {key} {branches} else {default} end"


def sql_season(month: str) -> str:
    return (
        f"case when {month} in (12,1,2) then 'winter' when {month} in (3,4,5) then 'spring' "
        f"when {month} in (6,7,8) then 'summer' else 'autumn' end"
    )


def sql_tokens(text: str, rules, default: str) -> str:
    branches = " ".join(
        "when " + " or ".join(f"contains({text}, {quoted(t)})" for t in tokens) + f" then {quoted(label)}"
        for label, tokens in rules
    )
    return f"case {branches} else {quoted(default)} end"


SQL_TIME_OF_DAY = (
    "case when hour <= 5 then 'night' when hour <= 11 then 'morning' when hour <= 17 then 'afternoon' "
    "else 'evening' end"
)

REGISTRY_ROWS = (
    # the built-in threats with sources, flags and statuses, and one more row that hits two targets
    (*V.BUILTIN_REGISTRY[0], "Внешний нарушитель", 1, 0, 0, "Актуальна"),
    (*V.BUILTIN_REGISTRY[1], "Внешний нарушитель; Внутренний нарушитель", 1, 0, 0, "Актуальна"),
    (*V.BUILTIN_REGISTRY[2], None, 0, 1, 1, "Архивная"),
    (*V.BUILTIN_REGISTRY[3], "Внешний нарушитель", 1, 1, 0, "Актуальна"),
    (*V.BUILTIN_REGISTRY[4], "Внутренний нарушитель", 0, 1, 1, None),
    (106, "CRM account abuse", "Shared accounts.", "CRM, Рабочая станция", "Внутренний нарушитель", 1, 1, 1, "Актуальна"),
)
REGISTRY_COLUMNS = (
    "threat_code, name, description, object_of_impact, source_characteristics, "
    "confidentiality_breach, integrity_breach, availability_breach, status"
)
REGISTRY_ROW_SCHEMA = (
    "threat_code int, name string, description string, object_of_impact string, source_characteristics string, "
    "confidentiality_breach int, integrity_breach int, availability_breach int, status string"
)

VULNERABILITY_TEMPLATES = (
    # asset type, code, title, severity, description
    ("vpn_gateway", "CVE-2024-0001", "Weak password policy and missing MFA", "high",
     "VPN login is protected by weak password without MFA and lockout policy."),
    ("workstation", "GEN-2026-9999", "Suspicious malware loader", "medium",
     "Potential malware loader execution on workstation"),
    ("crm", "GEN-1", "Unknown issue", "low", "No known tokens here"),
    ("crm", "CVE-2023-1234", "SQL Injection", "critical", "Test vulnerability"),
    ("mail_gateway", "GEN-2", "Attachment macro", "medium", "Office macro drops a trojan"),
    ("file_server", "GEN-3", "Locker", "high", "Encrypts shared folder over SMB"),
    ("web_portal", "GEN-4", "Format error", "low", "Information leak"),
)

_threat_text = "lower(concat_ws(' ', name, description, object_of_impact))"
_target_text = "lower(concat_ws(' ', object_of_impact, name, description))"

# name -> (views it reads, SQL text); only the given tables are read directly
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "incidents_raw": ((), """
select e.event_id as incident_id, cast(e.user_id as varchar) as organization_code,
       lower(c.c_mktsegment) as industry,
       cast(floor(abs(c.c_acctbal)) as int) as host_count,
       cast(101 + e.event_id % 8 as int) as threat_code,
       cast(case when e.event_type in ('error','purchase') then 1 else 0 end as int) as success,
       n.n_name as region,
       case when e.event_id % 97 = 0 then null
            else cast(date_trunc('day', e.ts) as timestamp) + to_days(cast(e.event_id % 365 as int)) end as incident_date,
       case when e.event_id % 89 = 0 then null else e.ts end as regional_time
from events e join customer c on e.user_id = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey"""),
    "incidents": (("incidents_raw",), f"""
select *, {sql_season('month')} as season, {SQL_TIME_OF_DAY} as time_of_day
from (select *, cast(coalesce(hour(regional_time), 0) as int) as hour,
             cast(coalesce(month(incident_date), 1) as int) as month,
             cast(coalesce(isodow(incident_date), 1) as int) as day_of_week
      from incidents_raw)"""),
    "registry": ((), f"select * from {values(REGISTRY_ROWS, 't', REGISTRY_COLUMNS)}"),
    "registry_classes": (("registry",), f"""
select threat_code, {sql_tokens(_threat_text, V.METHOD_TOKENS, V.DEFAULT_METHOD)} as attack_method,
       {sql_tokens(_target_text, V.TARGET_TOKENS, V.DEFAULT_TARGET)} as target_object
from registry"""),
    "enriched": (("incidents", "registry", "registry_classes"), """
select *, case when points >= 4 then 'critical' when points >= 3 then 'high'
               when points >= 2 then 'medium' else 'low' end as risk_level
from (select *, 2 * success + case when host_count >= 1000 then 1 else 0 end
                + case when attack_method in ('ransomware', 'credential_stuffing') then 1 else 0 end as points
      from (select i.*, r.name, r.description, r.object_of_impact,
                   coalesce(k.attack_method, 'malware') as attack_method,
                   coalesce(k.target_object, 'workstation') as target_object
            from incidents i left join registry r on i.threat_code = r.threat_code
                             left join registry_classes k on i.threat_code = k.threat_code))"""),
    "organizations": ((), """
select c_custkey as id, 'Organization ' || c_custkey as name, cast(c_custkey as varchar) as code
from customer"""),
    "settings": ((), """
select c_custkey as organization_id,
       ['MSK','SPB','SIB','FAR_EAST','Tver'][cast(c_custkey % 5 as int) + 1] as region,
       case c_custkey % 6 when 0 then 'Finance' when 1 then 'Telecom' when 2 then 'Retail' when 3 then 'Gov'
            else lower(c_mktsegment) end as industry,
       cast(floor(abs(c_acctbal)) as int) as host_count,
       list_filter([case when c_custkey % 2 = 1 then 'docker' end, case when c_custkey % 3 = 1 then 'sql' end,
                    case when c_custkey % 5 = 1 then 'web' end, case when c_custkey % 7 = 1 then 'network' end],
                   lambda x: x is not null) as technologies
from customer"""),
    "requests": ((), f"""
select *, {sql_season('month(day)')} as season
from (select o.o_orderkey as request_id, cast(o.o_orderdate as date) as day,
       case when o.o_orderkey % 11 = 0 then 'org-' || o.o_orderkey when o.o_orderkey % 23 = 0 then ''
            else cast(o.o_custkey % 400 as varchar) end as organization_id,
       case o.o_orderkey % 13 when 0 then 'Atlantis' when 1 then upper(n.n_name) when 2 then lower(n.n_name)
            else n.n_name end as region,
       case when o.o_orderkey % 17 = 0 then '' when o.o_orderkey % 3 = 0 then '  ' || c.c_mktsegment || ' '
            else lower(c.c_mktsegment) end as industry,
       cast(isodow(o.o_orderdate) as int) as day_of_week, cast(o.o_orderkey % 24 as int) as hour,
       {quoted(list(V.TARGETS))}[cast(o.o_custkey % 7 as int) + 1] as asset_type,
       o.o_orderkey % 2 = 0 as has_external_access,
       cast(o.o_custkey % 15 as int) as privileged_accounts_count,
       cast(o.o_custkey % 9 as int) as known_vulnerabilities_count,
       o.o_orderkey % 5 = 0 as prefer_ml
      from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey)"""),
    "vulnerabilities": ((), f"""
select 'asset-' || (p.p_partkey // 2) as asset_id, 'Asset ' || p.p_name as asset_name, t.asset_type,
       t.code || '/' || p.p_partkey as vulnerability_code, t.title, t.severity,
       t.description || ' ' || p.p_name as description
from part p join {values([(i, *row) for i, row in enumerate(VULNERABILITY_TEMPLATES)], 't',
                         'ord, asset_type, code, title, severity, description')} on p.p_partkey % 7 = t.ord"""),
    "document_vulnerabilities": ((), f"""
select 'doc-' || doc_id as asset_id, source as asset_name,
       {quoted(list(V.TARGETS))}[cast(doc_id % 7 as int) + 1] as asset_type, 'DOC-' || doc_id as vulnerability_code,
       lang as title, {quoted(list(V.SEVERITIES))}[cast(doc_id % 4 as int) + 1] as severity, text as description
from documents"""),
    "catalog": ((), f"select * from {values([(*t, V.CATALOG_SOURCE) for t in V.CATALOG_THREATS], 't', 'threat_id, name, description, category, severity, likely_targets, common_methods, source')}"),
    "recommendations": ((), f"""
select method, cast(row_number() over (partition by method order by code) as int) as pos, code, title, description, priority
from {values(V.RECOMMENDATIONS, 't', 'method, code, title, description, priority')}"""),
    "rules": ((), f"select * from {values([(i, *r) for i, r in enumerate(V.MAPPING_RULES)], 't', 'rule_ord, tokens, threat_id, match_score, reason, recommendation_method')}"),
    "part_catalog": ((), """
select 'TH-' || p_partkey as threat_id, p_name as name, p_brand as description, lower(p_type) as category,
       case when p_partkey % 37 = 0 then 'extreme' else ['low','medium','high','critical'][cast(p_size % 4 as int) + 1] end as severity,
       list_filter([case when p_partkey % 2 = 0 then 'crm' end, case when p_partkey % 3 = 0 then 'workstation' end,
                    case when p_partkey % 41 = 0 then 'toaster' end], lambda x: x is not null) as likely_targets,
       list_filter([case when p_partkey % 5 = 0 then 'phishing' end, case when p_partkey % 7 > 2 then 'malware' end],
                   lambda x: x is not null) as common_methods,
       'part list' as source
from part"""),
    "part_rules": ((), """
select cast(p_partkey as int) as rule_ord,
       case when p_partkey % 53 = 0 then cast([] as varchar[]) else string_split(p_name, ' ') end as tokens,
       'TH-' || (p_partkey + case when p_partkey % 61 = 0 then 1000000000 else 0 end) as threat_id,
       case when p_partkey % 59 = 0 then 1.5 else p_size / 50.0 end::double as match_score,
       p_type as reason, case when p_partkey % 67 = 0 then 'magic' else 'malware' end as recommendation_method
from part"""),
    "scored": ((), """
select event_id as id, ts, cast(event_type in ('error','purchase') as int) as y,
       least(value / 500, 1)::double as proba from events"""),
}


def oracle(views: str, body: str) -> str:
    """Prefix a SQL text with the views it reads, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dependency in VIEW_SQL[name][0]:
                add(dependency)
            order.append(name)

    for name in views.split():
        add(name)
    if not order:
        return body
    return "with " + ",\n".join(f"{name} as ({VIEW_SQL[name][1]})" for name in order) + "\n" + body


# ---- DataFrame views -----------------------------------------------------------------------


def pick(items, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(i) for i in items]), index.cast("int") + 1)


def present(*pairs) -> F.Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(value)) for condition, value in pairs]))


class Domain:
    """Incident tables projected from the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, data, columns: str) -> DataFrame:
        return local_table(self.spark, data, columns)

    @cached_property
    def incidents_raw(self) -> DataFrame:
        customers = self.table("customer").join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
        event_id = F.col("event_id")
        return (
            self.table("events")
            .join(customers, F.expr("user_id = c_custkey"))
            .select(
                event_id.alias("incident_id"),
                F.col("user_id").cast("string").alias("organization_code"),
                F.lower("c_mktsegment").alias("industry"),
                F.floor(F.abs("c_acctbal")).cast("int").alias("host_count"),
                (F.lit(101) + event_id % 8).cast("int").alias("threat_code"),
                F.col("event_type").isin("error", "purchase").cast("int").alias("success"),
                F.col("n_name").alias("region"),
                F.when(
                    event_id % 97 != 0,
                    F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval((event_id % 365).cast("int")),
                ).alias("incident_date"),
                F.when(event_id % 89 != 0, F.col("ts")).alias("regional_time"),
            )
        )

    @cached_property
    def incidents(self) -> DataFrame:
        return T.derive_time_columns(self.incidents_raw)

    @cached_property
    def registry(self) -> DataFrame:
        return self.rows(REGISTRY_ROWS, REGISTRY_ROW_SCHEMA)

    @cached_property
    def organizations(self) -> DataFrame:
        code = F.col("c_custkey").cast("string")
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.concat(F.lit("Organization "), code).alias("name"), code.alias("code")
        )

    @cached_property
    def settings(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("organization_id"),
            pick(("MSK", "SPB", "SIB", "FAR_EAST", "Tver"), key % 5).alias("region"),
            F.coalesce(
                F.try_element_at(F.array(*map(F.lit, ("Finance", "Telecom", "Retail", "Gov"))), (key % 6).cast("int") + 1),
                F.lower("c_mktsegment"),
            ).alias("industry"),
            F.floor(F.abs("c_acctbal")).cast("int").alias("host_count"),
            present((key % 2 == 1, "docker"), (key % 3 == 1, "sql"), (key % 5 == 1, "web"), (key % 7 == 1, "network")).alias(
                "technologies"
            ),
        )

    @cached_property
    def requests(self) -> DataFrame:
        customers = self.table("customer").join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
        key, cust, region = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_name")
        return (
            self.table("orders")
            .join(customers, F.expr("o_custkey = c_custkey"))
            .select(
                key.alias("request_id"),
                F.to_date("o_orderdate").alias("day"),
                F.when(key % 11 == 0, F.concat(F.lit("org-"), key)).when(key % 23 == 0, "").otherwise(
                    (cust % 400).cast("string")
                ).alias("organization_id"),
                F.when(key % 13 == 0, "Atlantis").when(key % 13 == 1, F.upper(region)).when(
                    key % 13 == 2, F.lower(region)
                ).otherwise(region).alias("region"),
                F.when(key % 17 == 0, "").when(key % 3 == 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).otherwise(
                    F.lower("c_mktsegment")
                ).alias("industry"),
                T.iso_weekday(F.col("o_orderdate")).alias("day_of_week"),
                (key % 24).cast("int").alias("hour"),
                pick(V.TARGETS, cust % 7).alias("asset_type"),
                (key % 2 == 0).alias("has_external_access"),
                (cust % 15).cast("int").alias("privileged_accounts_count"),
                (cust % 9).cast("int").alias("known_vulnerabilities_count"),
                (key % 5 == 0).alias("prefer_ml"),
                T.season(F.month("o_orderdate")).alias("season"),
            )
        )

    @cached_property
    def vulnerabilities(self) -> DataFrame:
        templates = F.array(
            *[
                F.struct(*[F.lit(v).alias(c) for c, v in zip(("asset_type", "code", "title", "severity", "text"), row)])
                for row in VULNERABILITY_TEMPLATES
            ]
        )
        key = F.col("p_partkey")
        return (
            self.table("part")
            .withColumn("t", F.element_at(templates, (key % len(VULNERABILITY_TEMPLATES)).cast("int") + 1))
            .select(
                F.concat(F.lit("asset-"), F.floor(key / 2)).alias("asset_id"),
                F.concat(F.lit("Asset "), "p_name").alias("asset_name"),
                "t.asset_type",
                F.concat("t.code", F.lit("/"), key).alias("vulnerability_code"),
                "t.title",
                "t.severity",
                F.concat("t.text", F.lit(" "), "p_name").alias("description"),
            )
        )

    @cached_property
    def document_vulnerabilities(self) -> DataFrame:
        key = F.col("doc_id")
        return self.table("documents").select(
            F.concat(F.lit("doc-"), key).alias("asset_id"),
            F.col("source").alias("asset_name"),
            pick(V.TARGETS, key % 7).alias("asset_type"),
            F.concat(F.lit("DOC-"), key).alias("vulnerability_code"),
            F.col("lang").alias("title"),
            pick(V.SEVERITIES, key % 4).alias("severity"),
            F.col("text").alias("description"),
        )

    @cached_property
    def part_catalog(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            F.concat(F.lit("TH-"), key).alias("threat_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("description"),
            F.lower("p_type").alias("category"),
            F.when(key % 37 == 0, "extreme").otherwise(pick(V.SEVERITIES, F.col("p_size") % 4)).alias("severity"),
            present((key % 2 == 0, "crm"), (key % 3 == 0, "workstation"), (key % 41 == 0, "toaster")).alias("likely_targets"),
            present((key % 5 == 0, "phishing"), (key % 7 > 2, "malware")).alias("common_methods"),
            F.lit("part list").alias("source"),
        )

    @cached_property
    def part_rules(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.cast("int").alias("rule_ord"),
            F.when(key % 53 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " ")).alias("tokens"),
            F.concat(F.lit("TH-"), key + F.when(key % 61 == 0, 1000000000).otherwise(0)).alias("threat_id"),
            F.when(key % 59 == 0, 1.5).otherwise(F.col("p_size") / 50.0).alias("match_score"),
            F.col("p_type").alias("reason"),
            F.when(key % 67 == 0, "magic").otherwise("malware").alias("recommendation_method"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            "ts",
            F.col("event_type").isin("error", "purchase").cast("int").alias("y"),
            F.least(F.col("value") / 500, F.lit(1.0)).alias("proba"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        return self.rows([(i, list(r[0]), *r[1:]) for i, r in enumerate(V.MAPPING_RULES)], schema.RULES)

"""Statistics queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions import timecols as T
from incidentlake.operators import stats as S
from incidentlake.operators.stats import IncidentFilters
from incidentlake.plans.base import Domain, oracle, query

_filters = IncidentFilters(season="winter", success=1, time_of_day="morning", industry="building")
_all_filters_sql = "season = 'winter' and success = 1 and time_of_day = 'morning' and industry = 'building'"
_incident_columns = (
    "incident_id", "organization_code", "industry", "host_count", "threat_code", "success", "region",
    "incident_date", "regional_time", "hour", "month", "season", "time_of_day", "day_of_week",
)
_columns_sql = ", ".join(_incident_columns)
_dimension_sql = "\nunion all\n".join(
    f"select '{name}' as dimension, cast({expr} as varchar) as key, count(*) as n from enriched"
    f"{' where incident_date is not null' if name == 'month' else ''} group by 2"
    for name, expr in (
        [(d, d) for d in S.DIMENSIONS if d != "month"] + [("month", "strftime(incident_date, '%Y-%m')")]
    )
)


def _grain(d: Domain, filters=None, method=None, by=()):
    return S.grain(d.incidents, d.registry, filters, method, by)


@query("stats_by_dimension", oracle("enriched", _dimension_sql))
def _(d):
    return S.by_dimension(_grain(d))


@query("stats_by_org", oracle("enriched", _dimension_sql.replace("select '", "select organization_code, '").replace(
    "group by 2", "group by 1, 3")))
def _(d):
    by = ("organization_code",)
    return S.by_dimension(_grain(d, by=by), by=by)


@query("stats_total", oracle("incidents", "select count(*) as total_incidents from incidents"))
def _(d):
    return d.incidents.agg(F.count(F.lit(1)).alias("total_incidents"))


def _one(name: str, column: str) -> None:
    key = "strftime(incident_date, '%Y-%m')" if column == "month" else column
    where = "where incident_date is not null" if column == "month" else ""

    @query(name, oracle("enriched", f"select {key} as {column}, count(*) as n from enriched {where} group by 1"))
    def _(d):
        return S.by_one(_grain(d), column)


for _name, _column in (
    ("stats_by_risk", "risk_level"), ("stats_by_season", "season"), ("stats_by_time_of_day", "time_of_day"),
    ("stats_by_hour", "hour"), ("stats_by_region", "region"), ("stats_by_target", "target_object"),
    ("stats_by_month", "month"), ("stats_by_method", "attack_method"),
):
    _one(_name, _column)

_top_sql = """
select (select count(*) from {src}) as total_incidents,
       coalesce((select attack_method from {src} group by 1 order by count(*) desc, min(incident_id) limit 1), 'malware')
         as top_attack_method,
       coalesce((select target_object from {src} group by 1 order by count(*) desc, min(incident_id) limit 1), 'workstation')
         as top_target_object"""


@query("stats_top", oracle("enriched", _top_sql.format(src="enriched")))
def _(d):
    return S.top_method_target(_grain(d))


@query("stats_top_by_org", oracle("enriched", """
select organization_code, attack_method as top_attack_method from (
  select organization_code, attack_method,
         row_number() over (partition by organization_code order by count(*) desc, min(incident_id)) as rn
  from enriched group by 1, 2) where rn = 1"""))
def _(d):
    by = ("organization_code",)
    return S.top_of(_grain(d, by=by), "attack_method", by)


@query("stats_empty", oracle("enriched", _top_sql.format(src="(select * from enriched where region = 'nowhere')")))
def _(d):
    return S.top_method_target(_grain(d, IncidentFilters(region="nowhere")))


@query("stats_filtered_method", oracle("enriched", f"""
select dimension, key, n from ({_dimension_sql.replace('from enriched', "from (select * from enriched where attack_method = 'malware' and season = 'summer')")})"""))
def _(d):
    return S.by_dimension(_grain(d, IncidentFilters(season="summer"), "malware"))


@query("stats_document")
def _(d):
    return S.document(_grain(d))


@query("stats_document_rows", oracle("enriched", f"""
select case dimension when 'risk_level' then 'risk_distribution' else 'incidents_by_' || dimension end as section, key, n from (
  select *, row_number() over (partition by dimension order by n desc, key) as rn from ({_dimension_sql}))
where dimension <> 'region' or rn <= 15"""))
def _(d):
    return S.document_rows(S.document(_grain(d)))


@query("method_labels", oracle("enriched", f"""
select case attack_method {" ".join(f"when '{k}' then '{v}'" for k, v in V.METHOD_LABELS.items())} else attack_method end as label, count(*) as value
from enriched group by 1"""))
def _(d):
    return S.method_labels(_grain(d))


@query("filter_incidents", oracle("incidents", f"select {_columns_sql} from incidents where {_all_filters_sql}"))
def _(d):
    return S.filter_incidents(d.incidents, _filters).select(*_incident_columns)


@query("filter_threat_region", oracle("incidents", f"""
select {_columns_sql} from incidents where threat_code = 104 and region = 'NATION_3'"""))
def _(d):
    return S.filter_incidents(d.incidents, IncidentFilters(threat_code=104, region="NATION_3")).select(*_incident_columns)


@query("filter_date_range", oracle("incidents", f"""
select {_columns_sql} from incidents
where incident_date >= timestamp '2024-03-01' and incident_date <= timestamp '2024-05-31 23:59:59.999999'"""))
def _(d):
    return S.filter_incidents(
        d.incidents, IncidentFilters(date_from=date(2024, 3, 1), date_to=date(2024, 5, 31))
    ).select(*_incident_columns)


@query("filter_tenant", oracle("incidents", f"select {_columns_sql} from incidents where organization_code = '7'"))
def _(d):
    return S.filter_incidents(d.incidents, IncidentFilters(organization_code="7")).select(*_incident_columns)


@query("scan_incidents", oracle("incidents", f"select {_columns_sql} from incidents"))
def _(d):
    return d.incidents.select(*_incident_columns)


@query("derive_time_columns", oracle("incidents", """
select incident_id, hour, month, season, time_of_day, day_of_week from incidents"""))
def _(d):
    return T.derive_time_columns(d.incidents_raw).select(
        "incident_id", "hour", "month", "season", "time_of_day", "day_of_week"
    )


@query("incidents_enriched", oracle("enriched", """
select incident_id, threat_code, name, description, object_of_impact, attack_method, target_object, risk_level
from enriched"""))
def _(d):
    return S.enriched(d.incidents, d.registry).select(
        "incident_id", "threat_code", "name", "description", "object_of_impact", "attack_method", "target_object",
        "risk_level",
    )


@query("risk_level", oracle("enriched", "select incident_id, risk_level from enriched"))
def _(d):
    return S.enriched(d.incidents, d.registry).select("incident_id", "risk_level")


_index_sql = """
select round(least(1.0, sum(case risk_level when 'low' then 15 when 'medium' then 35 when 'high' then 65
                                            else 100 end)::double / (100 * count(*))), 6)::double as risk_index"""


@query("risk_index", oracle("enriched", f"""
select *, cast(risk_index > 0.55 as int) as elevated from ({_index_sql} from enriched)"""))
def _(d):
    return S.risk_index(_grain(d))


@query("risk_index_by_org", oracle("enriched", f"""
select *, cast(risk_index > 0.55 as int) as elevated from ({_index_sql}, organization_code from enriched group by 2)"""))
def _(d):
    by = ("organization_code",)
    return S.risk_index(_grain(d, by=by), by)


@query("kpi_elevated", oracle("enriched", """
select count(*) filter (where risk_level in ('high', 'critical')) as elevated from enriched"""))
def _(d):
    return S.kpi_elevated(_grain(d))


@query("kpi_peak_hour", oracle("incidents", """
select max(n) as peak from (select count(*) as n from incidents group by hour)"""))
def _(d):
    return S.kpi_peak_hour(_grain(d))


@query("hourly_series", oracle("incidents", """
select cast(h as int) as ord, h || ':00' as label, count(incident_id) as value
from range(24) r(h) left join incidents on hour = h group by h"""))
def _(d):
    return S.hourly_series(_grain(d))


@query("season_series", oracle("incidents", """
select ord, label, count(incident_id) as value
from (values (0,'winter','Зима'),(1,'spring','Весна'),(2,'summer','Лето'),(3,'autumn','Осень')) t(ord, k, label)
     left join incidents on season = k group by 1, 2"""))
def _(d):
    return S.season_series(_grain(d))


@query("tod_series", oracle("incidents", """
select ord, label, count(incident_id) as value
from (values (0,'morning','Утро'),(1,'afternoon','День'),(2,'evening','Вечер'),(3,'night','Ночь')) t(ord, k, label)
     left join incidents on time_of_day = k group by 1, 2"""))
def _(d):
    return S.time_of_day_series(_grain(d))


@query("top_regions", oracle("incidents", """
select region, count(*) as n from incidents group by 1 order by 2 desc, 1 limit 15"""))
def _(d):
    return S.top_regions(_grain(d))


@query("top_targets", oracle("enriched", """
select target_object, count(*) as n from enriched group by 1 order by 2 desc, 1 limit 5"""))
def _(d):
    return S.top_targets(_grain(d))


@query("label_dimensions", oracle("enriched", """
select case target_object when 'workstation' then 'Рабочая станция' when 'vpn_gateway' then 'VPN / сеть'
         when 'mail_gateway' then 'Почта' when 'web_portal' then 'Веб / портал' when 'db_server' then 'БД'
         when 'file_server' then 'Файлы' when 'crm' then 'CRM' else target_object end as label, count(*) as value
from enriched group by 1"""))
def _(d):
    return S.target_labels(_grain(d))


@query("heatmap_rows", oracle("incidents", """
select 'Текущая выборка' as day, lpad(cast(hour as varchar), 2, '0') || ':00' as hour, count(*) as value
from incidents group by 2"""))
def _(d):
    return S.heatmap_rows(_grain(d))


@query("risk_distribution_rows", oracle("enriched", """
select upper(risk_level) as category, count(*) as count from enriched group by 1"""))
def _(d):
    return S.risk_distribution_rows(_grain(d))


@query("facets", oracle("incidents", """
select distinct organization_code, 'region' as facet, region as value from incidents where region <> ''
union all
select distinct organization_code, 'industry', industry from incidents where industry <> ''"""))
def _(d):
    return S.facets(d.incidents)


@query("threat_frequency", oracle("incidents", """
select incident_id, threat_code, count(*) over (partition by threat_code) as threat_incidents from incidents"""))
def _(d):
    counts = S.key_frequency(d.incidents, "threat_code").select("threat_code", F.col("n").alias("threat_incidents"))
    rows = d.incidents.select("incident_id", "threat_code")
    return rows.join(counts, rows["threat_code"].eqNullSafe(counts["threat_code"])).drop(counts["threat_code"])


@query("region_frequency", oracle("incidents", """
select region, count(*) as n, round(count(*) / sum(count(*)) over (), 6)::double as share from incidents group by 1"""))
def _(d):
    return S.key_frequency(d.incidents, "region").withColumn("share", F.round("share", 6))


@query("data_summary", oracle("incidents", """
select count(*) as rows, round(avg(success), 6) as success_share, min(regional_time) as first_time,
       max(regional_time) as last_time from incidents"""))
def _(d):
    return S.data_summary(d.incidents)


@query("lookback_90d", oracle("incidents", """
select incident_id, regional_time from incidents
where regional_time >= (select max(regional_time) from incidents) - interval 90 days"""))
def _(d):
    return S.lookback(d.incidents).select("incident_id", "regional_time")


@query("lookback_10d", oracle("incidents", """
select incident_id, regional_time from incidents
where regional_time >= (select max(regional_time) from incidents) - interval 10 days"""))
def _(d):
    return S.lookback(d.incidents, 10).select("incident_id", "regional_time")

"""Intensity, scoring, prediction and request queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions import timecols as T
from incidentlake.operators import intensity, quality, scoring, stats
from incidentlake.plans.base import VIEW_SQL, Domain, oracle, query, quoted, sql_case, sql_season
from incidentlake.sources import tables

AS_OF = datetime(2026, 1, 11, 14, 30)

# each scope is counted by its own grouping of the incidents, then the chain is walked with joins
VIEW_SQL["asked"] = (("requests",), """
select *, nullif(organization_id, '') as s_org, lower(region) as s_region,
       case when industry <> '' then lower(trim(industry)) end as s_industry from requests""")
VIEW_SQL["scoped"] = (("asked", "incidents"), """
select a.request_id, a.hour, a.season, a.s_region, a.s_industry,
       case when a.s_org in (select organization_code from incidents) then a.s_org end as e_org
from asked a""")


def _scope_sql() -> tuple[str, str]:
    joins, picks = [], []
    for org in (True, False):
        for level, kept in enumerate((("region", "season"), ("season",), ())):
            for industry in (True, False):
                alias = f"p{int(org)}{level}{int(industry)}"
                keys = (["organization_code"] if org else []) + list(kept) + (["industry"] if industry else [])
                exprs = [f"lower({k})" if k in ("region", "industry") else k for k in keys]
                group = ", ".join(exprs + ["hour"])
                named = ", ".join(f"{e} as k_{k}" for e, k in zip(exprs, keys))
                inner = f"select {named + ',' if named else ''} hour, count(*) as n from incidents group by {group}"
                outer_keys = ", ".join(f"k_{k}" for k in keys)
                totals = (
                    f"select {outer_keys + ',' if keys else ''} sum(n) as total, count(*) as hours_present from ({inner}) "
                    + (f"group by {outer_keys}" if keys else "")
                )
                request = {"organization_code": "r.e_org", "region": "r.s_region", "season": "r.season", "industry": "r.s_industry"}
                on = [f"{request[k]} = {alias}.k_{k}" for k in keys] + [("r.e_org is not null" if org else "r.e_org is null")]
                on_hour = [f"{request[k]} = {alias}h.k_{k}" for k in keys] + [f"r.hour = {alias}h.hour"]
                joins.append(f"left join ({totals}) {alias} on {' and '.join(on)}")
                joins.append(f"left join ({inner}) {alias}h on {' and '.join(on_hour)}")
                enough = f"{alias}.total >= 3" if industry else f"{alias}.total is not null"
                value = f"cast(printf('%.2f', coalesce({alias}h.n, 0)::double / greatest({alias}.total::double / {alias}.hours_present, 1.0::double)) as double)"
                picks.append(f"when {enough} then {value}")
    return "\n".join(joins), " ".join(picks)


_joins, _picks = _scope_sql()
VIEW_SQL["intensity"] = (("scoped", "incidents"), f"""
select r.request_id, cast(case {_picks} else 0.0 end as double) as attack_intensity from scoped r {_joins}""")
VIEW_SQL["scored_requests"] = (("requests", "intensity"), f"""
select *, least(cast(printf('%.2f', 0.55::double + risk_score * 0.4::double) as double), 0.98::double) as confidence
from (select *, least(cast(printf('%.2f', (1.2::double * known_vulnerabilities_count + 2.4::double * attack_intensity
                             + 2.0::double * asset_criticality) / 10.0::double) as double), 0.99::double) as risk_score
      from (select q.*, i.attack_intensity, {sql_case('q.asset_type', V.ASSET_CRITICALITY, 'null')} as asset_criticality
            from requests q join intensity i using (request_id)))""")
_method_sql = sql_case("asset_type", V.METHOD_BY_ASSET, "'malware'")
_window_sql = (
    "case when hour <= 5 then '00:00-06:00' when hour <= 11 then '06:00-12:00' when hour <= 17 then '12:00-18:00' "
    "else '18:00-24:00' end"
)
VIEW_SQL["predictions"] = (("scored_requests",), f"""
select *, {_method_sql} as predicted_attack_method, asset_type as predicted_target_object,
       {_window_sql} as predicted_attack_time_window, timestamp '2026-01-11 14:30:00' as generated_at
from scored_requests""")


def _predictions(d: Domain) -> DataFrame:
    return scoring.predict(d.requests, d.incidents, tables.recommendations_table(d.spark), AS_OF)


@query("attack_intensity", oracle("intensity", "select request_id, attack_intensity from intensity"))
def _(d):
    return intensity.attack_intensity(d.requests, d.incidents).select("request_id", "attack_intensity")


@query("risk_score", oracle("scored_requests", """
select request_id, attack_intensity, asset_criticality, risk_score, confidence from scored_requests"""))
def _(d):
    return scoring.scored_requests(d.requests, d.incidents).select(
        "request_id", "attack_intensity", "asset_criticality", "risk_score", "confidence"
    )


_rationale_sql = f"""
select request_id, 'Known vulnerability count considered: ' || known_vulnerabilities_count || '.'
   || '|Attack intensity from history (region, season, hour; with enough data — industry ' || industry || '): '
   || printf('%.2f', attack_intensity) || '.'
   || '|Asset criticality for ' || asset_type || ': ' || printf('%.2f', asset_criticality) || '.'
   || case when has_external_access then '|{V.RATIONALE_EXTERNAL}' else '' end
   || case when privileged_accounts_count >= 10 then '|{V.RATIONALE_PRIVILEGED}' else '' end
   {{more}} as rationale from scored_requests"""


@query("rationale", oracle("scored_requests", _rationale_sql.format(more="")))
def _(d):
    return scoring.scored_requests(d.requests, d.incidents).select(
        "request_id", F.array_join(scoring.rationale(), "|").alias("rationale")
    )


@query("time_window", oracle("requests", f"select request_id, {_window_sql} as time_window from requests"))
def _(d):
    return d.requests.select("request_id", T.time_window(F.col("hour")).alias("time_window"))


@query("heuristic_method", oracle("requests", f"select request_id, {_method_sql} as method from requests"))
def _(d):
    return d.requests.select("request_id", scoring.heuristic_method("asset_type").alias("method"))


@query("recommendations", oracle("requests recommendations", f"""
select request_id, r.pos, r.code, r.title, r.priority
from (select *, {_method_sql} as method from requests) q join recommendations r on q.method = r.method"""))
def _(d):
    df = d.requests.select("request_id", scoring.heuristic_method("asset_type").alias("method"))
    lists = scoring.with_recommendations(df, tables.recommendations_table(d.spark), "method")
    return lists.select("request_id", F.inline("recommendations")).select("request_id", "pos", "code", "title", "priority")


@query("predict_batch", oracle("predictions recommendations", """
select request_id, generated_at, risk_score, predicted_attack_time_window, predicted_target_object,
       predicted_attack_method, confidence,
       (select string_agg(code, ',' order by pos) from recommendations r where r.method = p.predicted_attack_method) as codes
from predictions p"""))
def _(d):
    return _predictions(d).select(
        "request_id", "generated_at", "risk_score", "predicted_attack_time_window", "predicted_target_object",
        "predicted_attack_method", "confidence", F.array_join("recommendations.code", ",").alias("codes"),
    )


_ml_off = f"|| case when prefer_ml then '|{V.RATIONALE_ML_OFF}' else '' end"


def _slice_query(name: str, column: str) -> None:
    sql = f"""
select p.request_id, generated_at, {column}, confidence, t.rationale from predictions p
join ({_rationale_sql.format(more=_ml_off)}) t on p.request_id = t.request_id"""

    @query(f"predict_{name}", oracle("predictions", sql))
    def _(d):
        df = scoring.prediction_slice(_predictions(d), name)
        return df.withColumn("rationale", F.array_join("rationale", "|"))


for _name, _column in (
    ("time", "predicted_attack_time_window"), ("target", "predicted_target_object"), ("method", "predicted_attack_method"),
):
    _slice_query(_name, _column)


@query("predict_recommendations", oracle("predictions recommendations", """
select request_id, generated_at, predicted_attack_method, predicted_target_object, confidence, r.pos, r.code, r.priority
from predictions p join recommendations r on r.method = p.predicted_attack_method"""))
def _(d):
    df = scoring.prediction_slice(_predictions(d), "recommendations")
    return df.select("*", F.inline("recommendations")).select(
        "request_id", "generated_at", "predicted_attack_method", "predicted_target_object", "confidence", "pos",
        "code", "priority",
    )


@query("alert_band", oracle("scored_requests", """
select request_id, p as risk_percent, case when p > 60 then 'error' else 'warning' end as alert,
       case when p > 70 then 'exception' else 'active' end as progress
from (select request_id, cast(floor(risk_score * 100 + 0.5) as int) as p from scored_requests)"""))
def _(d):
    df = scoring.scored_requests(d.requests, d.incidents)
    return df.select("request_id", *[c.alias(n) for n, c in scoring.alert_band().items()])


_from_settings_sql = f"""
select organization_id, {sql_case('region', V.REGION_ALIASES, "'Moscow'")} as region,
       {sql_case('industry', V.INDUSTRY_ALIASES, "'telecom'")} as industry, 'winter' as season, 7 as day_of_week, 14 as hour,
       case when list_contains(technologies, 'network') then 'vpn_gateway' when list_contains(technologies, 'sql') then 'db_server'
            when list_contains(technologies, 'web') then 'web_portal' else 'workstation' end as asset_type,
       list_contains(technologies, 'web') or list_contains(technologies, 'network') as has_external_access,
       cast(greatest(1, floor(greatest(host_count, 1) / 40.0 + 0.5)) as int) as privileged_accounts_count,
       cast(greatest(1, floor(greatest(host_count, 1) / 100.0 + 0.5) + 2 * len(technologies)) as int) as known_vulnerabilities_count
from settings"""


@query("requests_from_settings", oracle("settings", _from_settings_sql))
def _(d):
    return scoring.requests_from_settings(d.settings, AS_OF)


def _sparse(d: Domain) -> DataFrame:
    k = F.col("request_id")

    def gap(column: str, every: int):
        return F.when(k % every != 0, F.col(column)).alias(column)

    return d.requests.select(
        "request_id", "organization_id", gap("region", 2), "industry", gap("season", 3), gap("day_of_week", 5),
        gap("hour", 7), gap("asset_type", 11), gap("has_external_access", 13), gap("privileged_accounts_count", 17),
        gap("known_vulnerabilities_count", 19), gap("prefer_ml", 23),
    )


def _gap_sql(column: str, every: int, default: str) -> str:
    return f"coalesce(case when request_id % {every} <> 0 then {column} end, {default}) as {column}"


@query("request_defaults", oracle("requests", f"""
select request_id, organization_id, {_gap_sql('region', 2, "'Moscow'")}, coalesce(nullif(industry, ''), 'telecom') as industry,
       {_gap_sql('season', 3, "'winter'")}, {_gap_sql('day_of_week', 5, '7')}, {_gap_sql('hour', 7, '14')},
       {_gap_sql('asset_type', 11, "'vpn_gateway'")}, {_gap_sql('has_external_access', 13, 'true')},
       {_gap_sql('privileged_accounts_count', 17, '12')}, {_gap_sql('known_vulnerabilities_count', 19, '3')},
       {_gap_sql('prefer_ml', 23, 'false')}
from requests"""))
def _(d):
    return scoring.fill_request_defaults(_sparse(d), AS_OF)


_region_codes = ("MSK", "SPB", "SIB", "FAR_EAST", "Tver")


@query("regional_clock", oracle("", f"""
select event_id, region, ts + (3 + case region when 'SIB' then 4 when 'FAR_EAST' then 7 else 0 end) * interval 1 hour as clock
from (select event_id, ts, {quoted(list(_region_codes))}[cast(event_id % 5 as int) + 1] as region from events)"""))
def _(d):
    from incidentlake.plans.base import pick

    df = d.table("events").select("event_id", "ts", pick(_region_codes, F.col("event_id") % 5).alias("region"))
    return df.select("event_id", "region", T.regional_clock(F.col("ts"), F.col("region")).alias("clock"))


_bad = {
    "season": (29, "monsoon"), "day_of_week": (31, 0), "hour": (37, 24), "asset_type": (41, "toaster"),
    "privileged_accounts_count": (43, -1), "known_vulnerabilities_count": (47, -5), "region": (53, None),
}


@query("validate_requests", oracle("requests", "select request_id, array_to_string(list_filter([" + ", ".join(
    [f"case when request_id % {every} = 0 then '{name}' end" for name, every in (
        ("region", 53), ("season", 29), ("day_of_week", 31), ("hour", 37), ("asset_type", 41),
        ("privileged_accounts_count", 43), ("known_vulnerabilities_count", 47))]
) + "], lambda x: x is not null), ';') as errors from requests"))
def _(d):
    k = F.col("request_id")
    planted = d.requests.withColumns(
        {
            name: F.when(k % every != 0, F.col(name)).otherwise(F.lit(value).cast(d.requests.schema[name].dataType))
            for name, (every, value) in _bad.items()
        }
    )
    return quality.check_requests(planted).select("request_id", F.array_join("errors", ";").alias("errors"))


@query("validate_settings", oracle("settings", """
select organization_id, array_to_string(list_filter([
   case when organization_id % 7 = 0 then 'region' end,
   case when organization_id % 11 = 0 then 'industry' end, case when host_count < 1 then 'host_count' end],
   lambda x: x is not null), ';') as errors
from (select organization_id, case when organization_id % 13 = 0 then 0 else host_count end as host_count from settings)"""))
def _(d):
    k = F.col("organization_id")
    planted = d.settings.withColumns(
        {
            "region": F.when(k % 7 == 0, "").otherwise(F.col("region")),
            "industry": F.when(k % 11 == 0, F.repeat(F.lit("x"), 65)).otherwise(F.col("industry")),
            "host_count": F.when(k % 13 == 0, 0).otherwise(F.col("host_count")),
        }
    )
    return quality.check_settings(planted).select("organization_id", F.array_join("errors", ";").alias("errors"))


@query("method_target_fallback", oracle("requests enriched", f"""
, org_m as (select organization_code, attack_method, row_number() over (partition by organization_code order by count(*) desc, min(incident_id)) as rn from enriched group by 1, 2)
, org_t as (select organization_code, target_object, row_number() over (partition by organization_code order by count(*) desc, min(incident_id)) as rn from enriched group by 1, 2)
, reg_m as (select region, attack_method, row_number() over (partition by region order by count(*) desc, min(incident_id)) as rn from enriched group by 1, 2)
, reg_t as (select region, target_object, row_number() over (partition by region order by count(*) desc, min(incident_id)) as rn from enriched group by 1, 2)
select q.request_id, coalesce(om.attack_method, rm.attack_method, {_method_sql}) as method,
       coalesce(ot.target_object, rt.target_object, asset_type) as target
from requests q
left join org_m om on om.organization_code = q.organization_id and om.rn = 1
left join org_t ot on ot.organization_code = q.organization_id and ot.rn = 1
left join reg_m rm on rm.region = q.region and rm.rn = 1
left join reg_t rt on rt.region = q.region and rt.rn = 1"""))
def _(d):
    grain = stats.grain(d.incidents, d.registry, by=("organization_code",))
    return scoring.method_target_fallback(d.requests, grain).select("request_id", "method", "target")

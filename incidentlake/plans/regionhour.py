"""Region-hour, forecast and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions import timecols as T
from incidentlake.operators import metrics as M
from incidentlake.operators import regionhour as R
from incidentlake.plans.base import VIEW_SQL, Domain, oracle, query
from incidentlake.sources import tables

VIEW_SQL["model_rows"] = (("incidents", "registry"), """
select i.*, date_trunc('hour', regional_time) as time_hour, coalesce(r.name, 'Неизвестно') as threat_name,
       coalesce(r.source_characteristics, 'Неизвестно') as threat_source,
       coalesce(r.object_of_impact, 'Неизвестно') as impact_object, coalesce(r.confidentiality_breach, 0) as c,
       coalesce(r.integrity_breach, 0) as g, coalesce(r.availability_breach, 0) as a
from incidents i left join registry r on i.threat_code = r.threat_code where regional_time is not null""")


def _mode_sql(column: str) -> str:
    return f"""(select region, time_hour, {column} as v, row_number() over (partition by region, time_hour order by count(*) desc, {column}) as rn
      from model_rows group by 1, 2, 3)"""


VIEW_SQL["hours"] = (("model_rows",), f"""
select h.*, mi.v as dominant_org_type, ms.v as dominant_threat_source, mo.v as dominant_impact_object
from (select region, time_hour, count(*) as incidents_count, sum(success)::bigint as successful_count,
             count(distinct organization_code) as unique_enterprises, count(distinct threat_code) as unique_threats,
             avg(host_count) as avg_host_count, median(host_count)::double as median_host_count,
             max(c + g + a) as threat_danger_score, max(success) as success_score
      from model_rows group by 1, 2) h
join {_mode_sql('industry')} mi on mi.region = h.region and mi.time_hour = h.time_hour and mi.rn = 1
join {_mode_sql('threat_source')} ms on ms.region = h.region and ms.time_hour = h.time_hour and ms.rn = 1
join {_mode_sql('impact_object')} mo on mo.region = h.region and mo.time_hour = h.time_hour and mo.rn = 1""")


def _fill_mode(column: str) -> str:
    return f"""(select region, {column} as v, row_number() over (partition by region order by count(*) desc, {column}) as rn from hours group by 1, 2)"""


VIEW_SQL["grid"] = (("hours",), f"""
select g.region, g.time_hour, coalesce(h.incidents_count, 0) as incidents_count, coalesce(h.successful_count, 0) as successful_count,
       coalesce(h.unique_enterprises, 0) as unique_enterprises, coalesce(h.unique_threats, 0) as unique_threats,
       cast(coalesce(h.threat_danger_score, 0) as int) as threat_danger_score,
       cast(coalesce(h.successful_count, 0) > 0 as int) as attack_present,
       coalesce(h.avg_host_count, m.avg_host) as avg_host_count, coalesce(h.median_host_count, m.median_host) as median_host_count,
       coalesce(h.dominant_org_type, a.v) as dominant_org_type, coalesce(h.dominant_threat_source, b.v) as dominant_threat_source,
       coalesce(h.dominant_impact_object, c.v) as dominant_impact_object
from (select region, unnest(generate_series((select min(time_hour) from hours), (select max(time_hour) from hours), interval 1 hour)) as time_hour
      from (select distinct region from hours)) g
left join hours h on h.region = g.region and h.time_hour = g.time_hour
join (select region, median(avg_host_count) as avg_host, median(median_host_count) as median_host from hours group by 1) m on m.region = g.region
join {_fill_mode('dominant_org_type')} a on a.region = g.region and a.rn = 1
join {_fill_mode('dominant_threat_source')} b on b.region = g.region and b.rn = 1
join {_fill_mode('dominant_impact_object')} c on c.region = g.region and c.rn = 1""")

_lag_sql = ", ".join(
    f"cast(coalesce(lag({column}, {k}) over w, 0) as bigint) as lag_{name}_{k}"
    for name, column in R._LAGGED.items()
    for k in V.LAGS
)
_rolling_sql = ", ".join(
    [f"round(coalesce(avg(attack_present) over (w rows between {k} preceding and 1 preceding), 0), 6) as rolling_attack_mean_{k}" for k in V.ROLLING]
    + [
        f"cast(coalesce(sum({column}) over (w rows between {k} preceding and 1 preceding), 0) as bigint) as rolling_{name}_sum_{k}"
        for name, column in (("incidents", "incidents_count"), ("success", "successful_count"))
        for k in V.ROLLING
    ]
)
_window = "window w as (partition by region order by time_hour)"
_calendar_sql = """
cast(hour(time_hour) as int) as hour, cast(isodow(time_hour) - 1 as int) as dayofweek, cast(month(time_hour) as int) as month,
cast(quarter(time_hour) as int) as quarter, cast(isodow(time_hour) >= 6 as int) as is_weekend,
cast(hour(time_hour) between 9 and 18 as int) as is_working_hours,
cast(hour(time_hour) in (10, 11, 14, 15, 16, 17) as int) as is_peak_hours,
case when month(time_hour) in (12,1,2) then 'winter' when month(time_hour) in (3,4,5) then 'spring'
     when month(time_hour) in (6,7,8) then 'summer' else 'autumn' end as season,
case when hour(time_hour) between 6 and 11 then 'morning' when hour(time_hour) between 12 and 17 then 'day'
     when hour(time_hour) >= 18 then 'evening' else 'night' end as day_period"""
_filled_sql = """round(avg_host_count, 6) as avg_host_count, round(median_host_count, 6) as median_host_count,
       dominant_org_type, dominant_threat_source, dominant_impact_object"""
_rounded = ("avg_host_count", "median_host_count")
_rolling_names = [c for c in V.NUMERIC_FEATURES if c.startswith("rolling_")]
_lag_names = [c for c in V.NUMERIC_FEATURES if c.startswith("lag_")]


def model_rows(d: Domain) -> DataFrame:
    return tables.model_base(d.incidents, d.registry)


def grid(d: Domain) -> DataFrame:
    return R.build(model_rows(d))


_means = tuple(f"rolling_attack_mean_{k}" for k in V.ROLLING)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_counts = ("region", "time_hour", "incidents_count", "successful_count", "unique_enterprises", "unique_threats")


@query("region_hour_agg", oracle("hours", f"""
select {', '.join(_counts)}, cast(threat_danger_score as int) as threat_danger_score, {_filled_sql} from hours"""))
def _(d):
    df = R.aggregate(model_rows(d)).withColumn("time_hour", T.index_to_hour(F.col("hour_index")))
    df = rounded(df, *_rounded)
    return df.select(*_counts, "threat_danger_score", *_rounded, *R._DOMINANT)


@query("region_hour_agg_noflags", oracle("hours", """
select region, time_hour, incidents_count, success_score as threat_danger_score from hours"""))
def _(d):
    df = R.aggregate(model_rows(d).drop(*R.FLAGS))
    return df.select("region", T.index_to_hour(F.col("hour_index")).alias("time_hour"), "incidents_count", "threat_danger_score")


@query("region_hour_grid", oracle("grid", f"select {', '.join(_counts)}, attack_present from grid"))
def _(d):
    return R.dense(R.hours_table(model_rows(d))).select(*_counts, "attack_present")


@query("region_hour_filled", oracle("grid", f"select region, time_hour, threat_danger_score, {_filled_sql} from grid"))
def _(d):
    return rounded(grid(d), *_rounded).select("region", "time_hour", "threat_danger_score", *_rounded, *R._DOMINANT)


@query("region_hour_lags", oracle("grid", f"select region, time_hour, {_lag_sql} from grid {_window}"))
def _(d):
    return R.blocked(grid(d), R.lag_columns()).select("region", "time_hour", *_lag_names)


@query("region_hour_rolling", oracle("grid", f"select region, time_hour, {_rolling_sql} from grid {_window}"))
def _(d):
    return rounded(R.blocked(grid(d), R.rolling_columns()), *_means).select("region", "time_hour", *_rolling_names)


_compat_sql = ", ".join(
    [f"round(coalesce(avg(p_attack) over (w rows between {k - 1} preceding and current row), 0), 6) as rolling_attack_mean_{k}" for k in V.ROLLING]
    + [
        f"cast(coalesce(sum(p_{name}) over (w rows between {k - 1} preceding and current row), 0) as bigint) as rolling_{name}_sum_{k}"
        for name in ("incidents", "success")
        for k in V.ROLLING
    ]
)


@query("region_hour_rolling_compat", oracle("grid", f"""
select region, time_hour, {_compat_sql}
from (select region, time_hour, lag(attack_present) over w as p_attack, lag(incidents_count) over w as p_incidents,
             lag(successful_count) over w as p_success from grid {_window})
window w as (order by region, time_hour)"""))
def _(d):
    return rounded(R.compat_rolling(grid(d)), *_means).select("region", "time_hour", *_rolling_names)


@query("region_hour_features", oracle("grid", f"""
select region, time_hour, attack_present, incidents_count, unique_enterprises, unique_threats, threat_danger_score, {_filled_sql},
       round(ln(1 + avg_host_count), 6) as avg_host_count_log, round(ln(1 + median_host_count), 6) as median_host_count_log,
       {_calendar_sql}, {_lag_sql}, {_rolling_sql} from grid {_window}"""))
def _(d):
    df = rounded(R.features(grid(d)), *_means, *_rounded, *[f"{c}_log" for c in R._HOSTS])
    return df.select("time_hour", "attack_present", *V.NUMERIC_FEATURES, *V.CATEGORICAL_FEATURES)


@query("calendar_features", oracle("", f"""
select event_id, {_calendar_sql}, cast(year(time_hour) as int) as year, cast(day(time_hour) as int) as day
from (select event_id, date_trunc('hour', ts) as time_hour from events)"""))
def _(d):
    df = d.table("events").select("event_id", T.hour_floor(F.col("ts")).alias("time_hour"))
    return (
        T.calendar_features(df)
        .withColumns({"year": F.year("time_hour"), "day": F.day("time_hour")})
        .drop("time_hour")
    )


@query("tail_per_region", oracle("grid", """
select region, time_hour, incidents_count from (
  select *, row_number() over (partition by region order by time_hour desc) as rn from grid) where rn <= 100"""))
def _(d):
    return R.tail_per_region(grid(d), 100).select("region", "time_hour", "incidents_count")


@query("resolve_region", oracle("requests grid", """
select request_id, case when region in (select region from grid) then region else (select min(region) from grid) end as resolved_region
from requests"""))
def _(d):
    return R.resolve_region(d.requests, R.dense(R.hours_table(model_rows(d)))).select("request_id", "resolved_region")


_fold_sql = """
select region, time_hour, position, cast(case when position < n - 3 * (n // 4) then 0 when position < n - 2 * (n // 4) then 1
       when position < n - (n // 4) then 2 else 3 end as int) as val_fold
from (select region, time_hour, {position} as position, {n} as n from grid)"""


@query("cv_folds", oracle("grid", _fold_sql.format(
    position="dense_rank() over (order by time_hour) - 1", n="(select count(distinct time_hour) from grid)")))
def _(d):
    return R.cv_folds(R.dense(R.hours_table(model_rows(d)))).select("region", "time_hour", "position", "val_fold")


@query("cv_folds_region", oracle("grid", _fold_sql.format(
    position="row_number() over (order by region, time_hour) - 1", n="(select count(*) from grid)")))
def _(d):
    folds = R.cv_folds(R.dense(R.hours_table(model_rows(d))), order="region")
    return folds.select("region", "time_hour", "position", "val_fold")


def forecast_targets(d: Domain) -> DataFrame:
    """Every region on dates before, inside and after the history, and one unknown region."""
    days = F.array(*[F.lit(x).cast("date") for x in ("2023-12-25", "2024-01-01", "2024-01-15", "2024-01-30", "2024-01-31", "2024-02-07")])
    regions = d.table("nation").select(F.col("n_name").alias("region"))
    regions = regions.unionByName(d.table("region").select(F.col("r_name").alias("region")).where("region = 'ASIA'"))
    return regions.select("region", F.explode(days).alias("date"))


@query("forecast_rows", oracle("grid", """
, targets as (select region, cast(d as timestamp) + h * interval 1 hour as time_hour
   from (select n_name as region from nation union all select r_name from region where r_name = 'ASIA'),
        (select unnest([date '2023-12-25', date '2024-01-01', date '2024-01-15', date '2024-01-30', date '2024-01-31', date '2024-02-07']) as d),
        range(24) r(h))
, past as (select t.region, t.time_hour, g.attack_present, g.incidents_count, g.successful_count,
                  row_number() over (partition by t.region, t.time_hour order by g.time_hour desc) as back
           from targets t join grid g on g.region = t.region and g.time_hour < t.time_hour)
, folded as (select region, time_hour, count(*) as seen,
     max(incidents_count) filter (where back = 1) as i1, max(incidents_count) filter (where back = 24) as i24,
     max(attack_present) filter (where back = 3) as a3, avg(incidents_count) filter (where back <= 6) as mean6,
     avg(attack_present) filter (where back <= 24) as am24, sum(successful_count) filter (where back <= 6) as s6 from past group by 1, 2)
, levels as (select region, median(avg_host_count) as h, median(threat_danger_score) as s from grid group by 1)
, tops as (select region, dominant_org_type as v, row_number() over (partition by region order by count(*) desc, dominant_org_type) as rn from grid group by 1, 2)
select t.region, t.time_hour, cast(coalesce(i1, 0) as bigint) as lag_incidents_1, cast(coalesce(i24, 0) as bigint) as lag_incidents_24,
       cast(coalesce(a3, 0) as bigint) as lag_attack_3, round(coalesce(mean6, 0), 6) as incidents_count,
       round(case when seen >= 24 then am24 else 0 end, 6) as rolling_attack_mean_24,
       cast(case when seen >= 6 then s6 else 0 end as bigint) as rolling_success_sum_6,
       round(coalesce(l.h, (select median(avg_host_count) from grid)), 6) as avg_host_count,
       coalesce(l.s, (select median(threat_danger_score) from grid)) as threat_danger_score,
       coalesce(o.v, (select dominant_org_type from grid group by 1 order by count(*) desc, 1 limit 1)) as dominant_org_type
from targets t left join folded f using (region, time_hour) left join levels l on l.region = t.region
     left join tops o on o.region = t.region and o.rn = 1"""))
def _(d):
    df = R.forecast_rows(grid(d), forecast_targets(d))
    return df.select(
        "region", "time_hour", "lag_incidents_1", "lag_incidents_24", "lag_attack_3",
        F.round("incidents_count", 6).alias("incidents_count"),
        F.round("rolling_attack_mean_24", 6).alias("rolling_attack_mean_24"), "rolling_success_sum_6",
        F.round("avg_host_count", 6).alias("avg_host_count"), "threat_danger_score", "dominant_org_type",
    )


_threshold_values = ", ".join(f"({i}, {t!r}::double)" for i, t in enumerate(M.thresholds()))
_sweep_sql = f"""
select cast(i as int) as i, t as threshold, count(*) filter (where y = 1 and proba >= t) as tp, count(*) filter (where y = 0 and proba >= t) as fp,
       count(*) filter (where y = 1 and proba < t) as fn
from scored, (values {_threshold_values}) v(i, t) group by 1, 2"""


@query("threshold_sweep", oracle("scored", f"""
select i, threshold, tp, fp, fn, round(case when 2 * tp + fp + fn = 0 then 0 else 2.0::double * tp / (2 * tp + fp + fn) end, 9) as f1
from ({_sweep_sql})"""))
def _(d):
    return M.threshold_sweep(d.scored).select("i", "threshold", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("best_threshold", oracle("scored", f"""
select threshold, round(f1, 9) as f1 from (select i, threshold, 2.0::double * tp / (2 * tp + fp + fn) as f1 from ({_sweep_sql}))
order by 2 desc, i limit 1"""))
def _(d):
    return M.best_threshold(d.scored).select("threshold", F.round("f1", 9).alias("f1"))


@query("binary_metrics", oracle("scored", """
select tp, fp, fn, tn, round(tp::double / (tp + fp), 9) as precision, round(tp::double / (tp + fn), 9) as recall,
       round(2.0::double * tp / (2 * tp + fp + fn), 9) as f1, round(auc, 9) as auc
from (select count(*) filter (where y = 1 and proba >= 0.5) as tp, count(*) filter (where y = 0 and proba >= 0.5) as fp,
             count(*) filter (where y = 1 and proba < 0.5) as fn, count(*) filter (where y = 0 and proba < 0.5) as tn from scored),
     (select (sum(r) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0::double)
             / (count(*) filter (where y = 1)::double * count(*) filter (where y = 0)) as auc
      from (select y, rank() over (order by proba) + (count(*) over (partition by proba) - 1) / 2.0::double as r from scored))"""))
def _(d):
    df = M.binary_metrics(d.scored, 0.5)
    return df.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "auc")])

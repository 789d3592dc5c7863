"""Model, matrix and clustering queries, with the library's defaults for rounds, grid, trees and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidentlake.ml import clustering as C
from incidentlake.ml import density, forest, region_risk
from incidentlake.operators import metrics as M
from incidentlake.operators import regionhour as R
from incidentlake.operators import scoring, stats
from incidentlake.plans.base import VIEW_SQL, Domain, oracle, query
from incidentlake.plans.ingest import scratch
from incidentlake.plans.regionhour import forecast_targets, grid, model_rows, rounded
from incidentlake.plans.requests import AS_OF
from incidentlake.session import local_table, materialized
from incidentlake.sources import tables

VIEW_SQL["active"] = (("incidents", "registry"), """
select i.*, r.object_of_impact, r.source_characteristics, r.confidentiality_breach, r.integrity_breach, r.availability_breach, r.status
from incidents i left join registry r on i.threat_code = r.threat_code where r.status is distinct from 'Архивная'""")
VIEW_SQL["repaired"] = (("active",), """
select a.* replace (f.host_count as host_count, f.region as region, f.industry as industry)
from active a join (select organization_code, arg_min(host_count, incident_id) as host_count, arg_min(region, incident_id) as region,
                           arg_min(industry, incident_id) as industry from active group by 1) f on a.organization_code is not distinct from f.organization_code""")
VIEW_SQL["matrix"] = (("repaired",), """
select *, count(*) over (partition by region) / (count(*) over ())::double as region_share
from (select incident_id, host_count, threat_code, success, region, industry, cast(year(incident_date) as int) as year,
       cast(month(incident_date) as int) as month, cast(day(incident_date) as int) as day,
       cast(isodow(incident_date) - 1 as int) as weekday, confidentiality_breach, integrity_breach, availability_breach,
       object_of_impact, source_characteristics from repaired
      where incident_date is not null and object_of_impact is not null and source_characteristics is not null
        and confidentiality_breach is not null)""")


@query("eda_active_incidents", oracle("active", "select incident_id, threat_code, status from active"))
def _(d):
    return C.active(d.incidents, d.registry).select("incident_id", "threat_code", "status")


@query("enterprise_first", oracle("repaired", "select incident_id, organization_code, host_count, region, industry from repaired"))
def _(d):
    return C.enterprise_first(C.active(d.incidents, d.registry)).select(
        "incident_id", "organization_code", "host_count", "region", "industry"
    )


_matrix_columns = ", ".join(c for c in C.MATRIX if c != "region_share")


@query("eda_matrix", oracle("matrix", f"select incident_id, {_matrix_columns}, round(region_share, 6) as region_share from matrix"))
def _(d):
    return rounded(C.matrix(d.incidents, d.registry).select("incident_id", *C.MATRIX), "region_share")


@query("multi_hot", oracle("matrix", """
select distinct incident_id, label from (
  select incident_id, 'object:' || unnest(string_split(object_of_impact, ', ')) as label from matrix
  union all select incident_id, 'source:' || unnest(string_split(source_characteristics, '; ')) from matrix
  union all select incident_id, 'industry:' || industry from matrix)"""))
def _(d):
    return C.multi_hot(C.matrix(d.incidents, d.registry))


@query("split_multivalue", oracle("incidents registry", """
select incident_id, unnest(string_split(object_of_impact, ', ')) as label from incidents i join registry r on i.threat_code = r.threat_code"""))
def _(d):
    return d.incidents.join(d.registry, "threat_code").select(
        "incident_id", F.explode(F.split("object_of_impact", ", ")).alias("label")
    )


@query("parse_technologies", oracle("", """
select p_partkey, trim(t) as technology from (select p_partkey, unnest(string_split(' ' || p_name || ', ,' || p_brand || ' ,', ',')) as t from part)
where trim(t) <> ''"""))
def _(d):
    text = F.concat(F.lit(" "), "p_name", F.lit(", ,"), "p_brand", F.lit(" ,"))
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return d.table("part").select("p_partkey", F.explode(items).alias("technology"))


def _numeric(d: Domain):
    return model_rows(d).select("incident_id", *C.PROFILE_NUMERIC, "industry", "region", "threat_name", "impact_object", "season")


_scaled_sql = ", ".join(
    f"round((x.{c} - m.{c}) / s.{c}, 6) as {c}" for c in C.PROFILE_NUMERIC
)


@query("standardize", oracle("model_rows", f"""
, x as (select incident_id, host_count::double as host_count, threat_code::double as threat_code, success::double as success,
        c::double as confidentiality_breach, g::double as integrity_breach, a::double as availability_breach from model_rows)
select x.incident_id, {_scaled_sql} from x,
  (select {', '.join(f'avg({c}) as {c}' for c in C.PROFILE_NUMERIC)} from x) m,
  (select {', '.join(f'stddev_pop({c}) as {c}' for c in C.PROFILE_NUMERIC)} from x) s"""))
def _(d):
    return rounded(C.standardized(_numeric(d)).select("incident_id", *C.PROFILE_NUMERIC), *C.PROFILE_NUMERIC)


_planted = {"host_count": 7, "threat_code": 11, "success": 13, "confidentiality_breach": 17, "integrity_breach": 19, "availability_breach": 23}
_planted_sql = ", ".join(f"case when incident_id % {n} = 0 then null else {column}::double end as {c}"
                         for (c, n), column in zip(_planted.items(), ("host_count", "threat_code", "success", "c", "g", "a")))


@query("standardize_imputed", oracle("model_rows", f"""
, x as (select incident_id, {_planted_sql} from model_rows)
, m as (select {', '.join(f'median({c}) as {c}' for c in C.PROFILE_NUMERIC)} from x)
, y as (select x.incident_id, {', '.join(f'coalesce(x.{c}, m.{c}) as {c}' for c in C.PROFILE_NUMERIC)} from x, m)
select y.incident_id, {', '.join(f'round((y.{c} - a.{c}) / case when s.{c} = 0 then 1 else s.{c} end, 6) as {c}' for c in C.PROFILE_NUMERIC)} from y,
  (select {', '.join(f'avg({c}) as {c}' for c in C.PROFILE_NUMERIC)} from y) a,
  (select {', '.join(f'stddev_pop({c}) as {c}' for c in C.PROFILE_NUMERIC)} from y) s"""))
def _(d):
    planted = {c: F.when(F.col("incident_id") % n != 0, F.col(c)) for c, n in _planted.items()}
    return rounded(C.standardized(_numeric(d).withColumns(planted)).select("incident_id", *C.PROFILE_NUMERIC), *C.PROFILE_NUMERIC)


_numeric_sql = " union all ".join(
    f"select season as cluster, 'numeric' as section, '{c}' as feature, '{name}' as item, {f}({column})::double as value from model_rows group by 1"
    for c, column in zip(C.PROFILE_NUMERIC, ("host_count", "threat_code", "success", "c", "g", "a"))
    for name, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"))
)
_top_sql = " union all ".join(
    f"""select cluster, 'top', '{c}', item, n::double from (select season as cluster, {c} as item, count(*) as n,
    row_number() over (partition by season order by count(*) desc, {c}) as rn from model_rows group by 1, 2) where rn <= 3"""
    for c in C.PROFILE_CATEGORIES
)


@query("cluster_profile_by_season", oracle("model_rows", f"""
select cluster, section, feature, item, round(value, 6) as value from (
  select season as cluster, 'size' as section, 'rows' as feature, 'rows' as item, count(*)::double as value from model_rows group by 1
  union all select season, 'size', 'rows', 'percent', 100.0::double * count(*) / (select count(*) from model_rows) from model_rows group by 1
  union all select season, 'size', 'success', 'success_rate', avg(success) from model_rows group by 1
  union all select season, 'danger', 'success', 'level', case when avg(success) > 0.6 then 2 when avg(success) > 0.4 then 1 else 0 end from model_rows group by 1
  union all {_numeric_sql} union all {_top_sql})"""))
def _(d):
    return rounded(C.cluster_profile(_numeric(d).withColumn("cluster", F.col("season"))), "value")


@query("cluster_profile")
def _(d):
    return C.cluster_profile(C.kmeans(C.assembled(_numeric(d)), 8))


@query("kmeans_sweep")
def _(d):
    return local_table(d.spark, C.kmeans_sweep(C.assembled(_numeric(d))), "k int, silhouette double, inertia double")


def _points(d: Domain):
    return C.vectors(C.matrix(d.incidents, d.registry))


@query("pca")
def _(d):
    points = _points(d)
    rows = [(k, i + 1, share) for k in (2, 5) for i, share in enumerate(C.pca(points, k).explained)]
    return local_table(d.spark, rows, "k int, component int, explained double")


@query("pca_loadings")
def _(d):
    loadings = C.pca(_points(d), 2).loadings
    rows = [(f, k + 1, float(v)) for f, row in enumerate(loadings) for k, v in enumerate(row)]
    return local_table(d.spark, rows, "feature int, component int, loading double")


@query("hierarchical_cluster")
def _(d):
    return local_table(d.spark, C.hierarchical_sweep(C.hierarchy(_points(d))), "k int, silhouette double")


@query("hierarchical_labels")
def _(d):
    tree = C.hierarchy(_points(d)).select("incident_id", F.posexplode("labels").alias("k", "cluster"))
    return tree.select("incident_id", (F.col("k") + 2).alias("k"), "cluster")


@query("density_cluster")
def _(d):
    points = _points(d)
    xy = C.pca(points, 2).points(points)
    flat = xy.select("incident_id", F.round(F.col("components")[0], 6).alias("x"), F.round(F.col("components")[1], 6).alias("y"))
    return density.density_cluster(materialized(flat), ["x", "y"], 0.3, 5, "incident_id")


EPS_VALUES, LEAST_VALUES = (0.02, 0.05, 0.21), (3, 6, 10)
_reached_sql = """
with recursive pts as materialized (select p_partkey as id, p_retailprice / 100 as x, p_size / 5.0::double as y from part)
, grid as (select e.eps, m.m from (values (0.02::double), (0.05::double), (0.21::double)) e(eps), (values (3), (6), (10)) m(m))
, near as materialized (
    select a.id as a, b.id as b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2
    from pts a join pts b on abs(a.x - b.x) <= 0.21 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.21::double * 0.21::double)
, core as materialized (select eps, m, a from near join grid on d2 <= eps * eps group by eps, m, a having count(*) >= any_value(m))
, links as materialized (
    select c.eps, c.m, n.a, n.b from near n join core c on c.a = n.a and n.d2 <= c.eps * c.eps
    join core e on e.a = n.b and e.eps = c.eps and e.m = c.m)
, labels(eps, m, a, label) using key (eps, m, a) as (
    select eps, m, a, a from core
    union
    select x.eps, x.m, x.a, min(y.label) from recurring.labels x join links l on l.a = x.a and l.eps = x.eps and l.m = x.m
      join labels y on y.a = l.b and y.eps = x.eps and y.m = x.m group by x.eps, x.m, x.a, x.label having min(y.label) < x.label)
, border as (
    select g.eps, g.m, n.a, min(l.label) as label from near n join grid g on n.d2 <= g.eps * g.eps
    join labels l on l.a = n.b and l.eps = g.eps and l.m = g.m group by 1, 2, 3)
, marked as (select g.eps, g.m, p.id, coalesce(c.label, b.label, -1) as cluster from grid g cross join pts p
    left join labels c on c.a = p.id and c.eps = g.eps and c.m = g.m left join border b on b.a = p.id and b.eps = g.eps and b.m = g.m)
, sizes as (select eps, m, cluster, count(*) as n from marked group by 1, 2, 3)
"""


def _flat_parts(d: Domain):
    return d.table("part").select("p_partkey", (F.col("p_retailprice") / 100).alias("x"), (F.col("p_size") / F.lit(5.0)).alias("y"))


@query("density_sweep", _reached_sql + """
select eps, m as min_samples, count(*) filter (where cluster >= 0) as clusters,
       coalesce(sum(n) filter (where cluster = -1), 0)::bigint as noise, coalesce(max(n) filter (where cluster >= 0), 0)::bigint as largest
from sizes group by 1, 2""")
def _(d):
    return density.density_sweep(_flat_parts(d), ["x", "y"], "p_partkey", EPS_VALUES, LEAST_VALUES)


@query("density_parts", _reached_sql + "select id as p_partkey, cluster from marked where eps = 0.05 and m = 6")
def _(d):
    return density.density_cluster(_flat_parts(d), ["x", "y"], 0.05, 6, "p_partkey").select("p_partkey", "cluster")


@query("method_training_set", oracle("enriched", """
select incident_id, organization_code, region, industry, season, day_of_week, hour,
       case when target_object in ('vpn_gateway', 'web_portal', 'mail_gateway') then 'True' else 'False' end as has_external_access,
       cast(round_even(greatest(host_count / 20.0::double, 1), 0) as int) as privileged_accounts_count,
       cast(count(*) over (partition by threat_code) as int) as known_vulnerabilities_count, attack_method, target_object
from enriched"""))
def _(d):
    return forest.training_set(d.incidents, d.registry)


def _forests(d: Domain):
    return forest.train(forest.training_set(d.incidents, d.registry))


@query("predict_ml_forest")
def _(d):
    ml = forest.ml_result(_forests(d), d.requests)
    df = scoring.predict(d.requests, d.incidents, tables.recommendations_table(d.spark), AS_OF, ml)
    return df.select("request_id", "prefer_ml", "predicted_attack_method", "predicted_target_object", "confidence", "risk_score")


@query("topk_labels")
def _(d):
    df = forest.predict(_forests(d), d.requests)
    return df.select("request_id", F.posexplode("top_attack_method").alias("pos", "m")).select("request_id", "pos", "m.*")


def _prepared(d: Domain):
    return region_risk.prepare(R.features(grid(d)))


_METRICS = "f1 double, threshold double, precision double, recall double, auc double, trees int, rounds int"


def _metric_rows(d: Domain, rows: list[dict], ddl: str):
    names = [c.split(" ")[0] for c in ddl.split(", ")]
    return local_table(d.spark, [tuple(r[c] for c in names) for r in rows], ddl)


_TRAINED: dict[tuple[str, str], region_risk.RiskModel] = {}


def _trained(d: Domain) -> region_risk.RiskModel:
    """The model of these tables, trained once in a session: the queries that score share it."""
    key = (d.spark.sparkContext.applicationId, d.sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = region_risk.train(_prepared(d))
    return _TRAINED[key]


@query("train_region_risk")
def _(d):
    return _metric_rows(d, _trained(d).cv, f"fold int, {_METRICS}")


@query("train_summary")
def _(d):
    model = _trained(d)
    folds = _metric_rows(d, model.cv, f"fold int, {_METRICS}")
    return M.cv_summary(folds, grid(d).select(F.col("attack_present").alias("y")), len(model.features))


_FOLDED_SCORES = """
, folded as (select id % 3 + 1 as fold, y, proba from scored)
, points as (select fold, proba, sum(y) as pos, sum(1 - y) as neg from folded group by 1, 2)
, swept as (select fold, i, t, sum(pos) filter (where proba >= t) as tp, sum(neg) filter (where proba >= t) as fp, sum(pos) filter (where proba < t) as fn
            from points, (values {values}) v(i, t) group by 1, 2, 3)
, best as (select fold, arg_min(t, (-2.0::double * tp / (2 * tp + fp + fn), i)) as threshold from
             (select fold, i, t, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn from swept) group by 1)
, judged as (select fold, threshold, count(*) filter (where y = 1 and proba >= threshold) as tp, count(*) filter (where y = 0 and proba >= threshold) as fp,
                    count(*) filter (where y = 1 and proba < threshold) as fn from folded join best using (fold) group by 1, 2)
, ranks as (select fold, (sum(r) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0::double)
                   / (count(*) filter (where y = 1)::double * count(*) filter (where y = 0)) as auc
            from (select fold, y, rank() over (partition by fold order by proba) + (count(*) over (partition by fold, proba) - 1) / 2.0::double as r from folded)
            group by 1)
, fold_rows as (select fold, threshold, 2.0::double * tp / (2 * tp + fp + fn) as f1, tp::double / (tp + fp) as precision, tp::double / (tp + fn) as recall, auc
                from judged join ranks using (fold))
""".format(values=", ".join(f"({i}, {t!r}::double)" for i, t in enumerate(M.thresholds())))


def _folded_scores(d: Domain):
    return d.scored.select((F.col("id") % 3 + 1).alias("fold"), "y", "proba")


@query("cv_metrics", oracle("scored", _FOLDED_SCORES + """
select fold, threshold, round(f1, 9) as f1, round(precision, 9) as precision, round(recall, 9) as recall, round(auc, 9) as auc from fold_rows"""))
def _(d):
    rows = M.fold_metrics(_folded_scores(d))
    return rows.select("fold", "threshold", *[F.round(c, 9).alias(c) for c in M.SUMMED])


@query("cv_summary", oracle("scored", _FOLDED_SCORES + """
select count(*) as folds, (select count(*) from folded) as train_rows, (select round(avg(y), 9) from folded) as prevalence, 6 as feature_count,
       """ + ", ".join(f"round(avg({c}), 9) as mean_{c}, round(stddev_samp({c}), 9) as std_{c}" for c in M.SUMMED) + """
from fold_rows"""))
def _(d):
    scores = _folded_scores(d)
    df = M.cv_summary(M.fold_metrics(scores), scores, 6)
    return df.select("folds", "train_rows", "feature_count", *[F.round(c, 9).alias(c) for c in df.columns if c.startswith(("mean_", "std_", "prev"))])


@query("grid_search")
def _(d):
    return _metric_rows(d, region_risk.grid_search(_prepared(d)), f"iterations int, depth int, learning_rate double, fold int, {_METRICS}")


@query("model_roundtrip")
def _(d):
    model = _trained(d)
    path = scratch(d, "region-risk")
    region_risk.save(model, d.spark, path)
    again = region_risk.load(d.spark, path)
    return region_risk.score_rows(again, R.features(grid(d))).select("region", "time_hour", "proba", "decision")


def _recent_grid(d: Domain):
    """The grid that scoring looks back on: incidents of the last 90 days before the newest one."""
    return R.build(stats.lookback(model_rows(d)))


@query("score_region_hours")
def _(d):
    return region_risk.score_region_hours(_trained(d), _recent_grid(d), forecast_targets(d))


@query("predict_ml_temporal")
def _(d):
    fallback = scoring.method_target_fallback(d.requests, stats.grain(d.incidents, d.registry, by=("organization_code",)))
    ml = region_risk.predict_requests(_trained(d), d.requests, _recent_grid(d), fallback, AS_OF.date())
    df = scoring.predict(d.requests, d.incidents, tables.recommendations_table(d.spark), AS_OF, ml)
    return df.select("request_id", "prefer_ml", "predicted_attack_method", "predicted_target_object", "confidence", "risk_score")

"""Vulnerability mapping, catalog and reference-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.operators import quality, vulnmap
from incidentlake.operators.skew import numbered
from incidentlake.plans.base import VIEW_SQL, Domain, oracle, query, quoted
from incidentlake.plans.ingest import scratch
from incidentlake.sources import tables


def _match_sql(source: str, fallback_ord: int) -> str:
    """Rules joined to every text, last rule per threat, fallback where nothing matched."""
    hit = "list_contains(r.tokens, '*') or len(list_filter(r.tokens, lambda t: contains(v.txt, lower(t)))) > 0"
    return f"""
, texts as (select vulnerability_code, lower(concat_ws(' ', asset_type, vulnerability_code, title, description)) as txt from {source})
, hits as (select v.vulnerability_code, r.* from texts v join rules r on ({hit}) where r.threat_id <> 'TH-005')
, spare as (select v.vulnerability_code, r.* from texts v join rules r on ({hit})
            where r.rule_ord = {fallback_ord} and v.vulnerability_code not in (select vulnerability_code from hits))
, ranked as (select *, row_number() over (partition by vulnerability_code, threat_id order by rule_ord desc) as rn,
                    min(rule_ord) over (partition by vulnerability_code, threat_id) as first_ord
             from (select * from hits union all select * from spare))
, matched as (select *, cast(row_number() over (partition by vulnerability_code order by match_score desc, first_ord) - 1 as int) as pos
              from ranked where rn = 1)
"""


_rows = "select vulnerability_code, pos, threat_id, match_score, recommendation_method from matched"


def _exploded(df):
    return vulnmap.exploded(df).select(
        "vulnerability_code", "pos", "threat_id", "match_score", "recommendation_method"
    )


@query("vuln_map", oracle("vulnerabilities rules catalog recommendations", _match_sql("vulnerabilities", 4) + """
select vulnerability_code, pos, m.threat_id, match_score, c.severity,
       (select string_agg(code, ',' order by r.pos) from recommendations r where r.method = m.recommendation_method) as codes
from matched m join catalog c on m.threat_id = c.threat_id"""))
def _(d):
    matched = vulnmap.map_vulnerabilities(d.vulnerabilities, tables.rules_table(d.spark))
    rows = vulnmap.with_threats(matched, tables.catalog_table(d.spark), tables.recommendations_table(d.spark))
    return rows.select(
        "vulnerability_code", "pos", "threat_id", "match_score", F.col("threat.severity").alias("severity"),
        F.array_join("recommendations.code", ",").alias("codes"),
    )


@query("vuln_map_wildcard", oracle("vulnerabilities rules", _match_sql("vulnerabilities", 5) + _rows))
def _(d):
    return _exploded(vulnmap.map_vulnerabilities(d.vulnerabilities, tables.rules_table(d.spark), wildcard_fallback=True))


@query("vuln_map_documents", oracle("document_vulnerabilities rules", _match_sql("document_vulnerabilities", 4) + _rows))
def _(d):
    return _exploded(vulnmap.map_vulnerabilities(d.document_vulnerabilities, tables.rules_table(d.spark)))


@query("vuln_totals", oracle("vulnerabilities", """
select count(distinct asset_id) as total_assets, count(*) as total_vulnerabilities from vulnerabilities"""))
def _(d):
    return vulnmap.totals(d.vulnerabilities)


@query("audit_rows", oracle("vulnerabilities rules", _match_sql("vulnerabilities", 4) + """
select upper(asset_name) as asset, vulnerability_code, cast((select count(*) from matched m where m.vulnerability_code = v.vulnerability_code) as int) as threats
from vulnerabilities v"""))
def _(d):
    return vulnmap.audit_rows(vulnmap.map_vulnerabilities(d.vulnerabilities, tables.rules_table(d.spark)))


VIEW_SQL["said"] = ((), "select string_split(lower(text), ' ') as w from benchmark")
VIEW_SQL["word_rules"] = (("said",), """
select cast(row_number() over (order by word) - 1 as int) as rule_ord, [word] as tokens, 'W-' || left(word, 2) as threat_id,
       len(word) / 20.0::double as match_score, word as reason, 'malware' as recommendation_method
from (select distinct unnest(w) as word from said union
      select distinct unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from said union select ' ')
where len(word) > 1 or word = ' '""")


@query("vuln_map_many_rules", oracle("document_vulnerabilities word_rules", """
, texts as (select vulnerability_code, lower(concat_ws(' ', asset_type, vulnerability_code, title, description)) as txt from document_vulnerabilities)
, hits as (select v.vulnerability_code, r.threat_id, r.reason from texts v join word_rules r on contains(v.txt, r.reason))
select vulnerability_code, threat_id, max(reason) as reason, cast(len(max(reason)) / 20.0 as double) as match_score
from hits group by 1, 2"""))
def _(d):
    """A rule for every word and every two neighbouring words of a table, and one whose token is in all texts."""
    words = F.split(F.lower("text"), " ")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    said = d.table("benchmark").select(F.explode(F.concat(words, pairs, F.array(F.lit(" ")))).alias("word"))
    said = said.where((F.length("word") > 1) | (F.col("word") == " ")).distinct()
    rules = numbered(said, "word", "rule_ord").select(
        "rule_ord",
        F.array("word").alias("tokens"),
        F.concat(F.lit("W-"), F.substring("word", 1, 2)).alias("threat_id"),
        (F.length("word") / 20.0).alias("match_score"),
        F.col("word").alias("reason"),
        F.lit("malware").alias("recommendation_method"),
    )
    matched = vulnmap.map_vulnerabilities(d.document_vulnerabilities, rules)
    return vulnmap.exploded(matched).select("vulnerability_code", "threat_id", "reason", "match_score")


@query("report_slice", oracle("vulnerabilities rules", _match_sql("vulnerabilities", 4) + _rows + " where pos < 2"))
def _(d):
    return _exploded(vulnmap.report_slice(vulnmap.map_vulnerabilities(d.vulnerabilities, tables.rules_table(d.spark)), 2))


@query("validate_vulnerabilities", oracle("vulnerabilities", """
select vulnerability_code, array_to_string(list_filter([case when p % 13 = 0 then 'asset_type' end,
       case when p % 17 = 0 then 'severity' end, case when p % 19 = 0 then 'title' end], lambda x: x is not null), ';') as errors
from (select *, cast(split_part(vulnerability_code, '/', 2) as bigint) as p from vulnerabilities)"""))
def _(d):
    p = F.split_part("vulnerability_code", F.lit("/"), F.lit(2)).cast("bigint")
    planted = quality.require_rows(d.vulnerabilities).withColumns(
        {
            "asset_type": F.when(p % 13 == 0, "toaster").otherwise(F.col("asset_type")),
            "severity": F.when(p % 17 == 0, "extreme").otherwise(F.col("severity")),
            "title": F.when(p % 19 != 0, F.col("title")),
        }
    )
    return quality.check_vulnerabilities(planted).select("vulnerability_code", F.array_join("errors", ";").alias("errors"))


@query("threat_list", oracle("part_catalog", """
select threat_id, name, category, severity, count(*) over () as total from part_catalog
where severity = 'critical' and category = 'economy'"""))
def _(d):
    kept = vulnmap.list_threats(d.part_catalog, severity="critical", category="economy")
    total = kept.agg(F.count(F.lit(1))).scalar()
    return kept.select("threat_id", "name", "category", "severity", total.alias("total"))


@query("catalog_rows", oracle("part_catalog", """
select threat_id, severity, category, list, cast(pos - 1 as int) as pos, value from (
  select threat_id, severity, category, 'likely_targets' as list, unnest(likely_targets) as value,
         generate_subscripts(likely_targets, 1) as pos from part_catalog
  union all select threat_id, severity, category, 'common_methods', unnest(common_methods),
         generate_subscripts(common_methods, 1) from part_catalog)"""))
def _(d):
    return vulnmap.catalog_rows(d.part_catalog)


@query("rule_rows", oracle("part_rules", """
select rule_ord, threat_id, match_score, cast(pos - 1 as int) as pos, token from (
  select rule_ord, threat_id, match_score, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from part_rules)"""))
def _(d):
    return vulnmap.rule_rows(d.part_rules)


@query("config_violations", oracle("part_catalog part_rules", f"""
select 'rule' as kind, cast(rule_ord as varchar) as id, 'tokens must not be empty' as violation from part_rules where len(tokens) = 0
union all select 'rule', cast(rule_ord as varchar), 'match_score out of range' from part_rules where match_score not between 0 and 1
union all select 'rule', cast(rule_ord as varchar), 'unknown recommendation method' from part_rules where recommendation_method not in {tuple(V.METHODS)}
union all select 'threat', threat_id, 'unknown severity' from part_catalog where severity not in {tuple(V.SEVERITIES)}
union all select 'threat', threat_id, 'unknown target' from part_catalog where not list_has_all({quoted(list(V.TARGETS))}, likely_targets)
union all select 'threat', threat_id, 'unknown method' from part_catalog where not list_has_all({quoted(list(V.METHODS))}, common_methods)"""))
def _(d):
    return quality.rule_violations(d.part_rules).unionByName(quality.catalog_violations(d.part_catalog))


def _rules_json(d: Domain):
    """The rules of the part table, written as JSON documents of a hundred rules and read again."""
    rules = numbered(d.part_rules.select(F.col("rule_ord").alias("_at"), "tokens", "threat_id", "match_score", "reason", "recommendation_method"), "_at", "_n")
    rule = F.to_json(F.struct("tokens", "threat_id", "match_score", "reason", "recommendation_method"))
    part = F.format_string("%09d", F.floor((F.col("_n") - 1) / 100))
    documents = rules.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("_n", rule.alias("rule")))).alias("rules"))
    path = scratch(d, "rules-json")
    text = F.concat(F.lit("[\n"), F.array_join(F.col("rules.rule"), ",\n"), F.lit("\n]"))
    documents.select("part", text.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return tables.rules_table(d.spark, path)


VIEW_SQL["json_rules"] = (("part_rules",), "select * replace (cast(row_number() over (order by rule_ord) - 1 as int) as rule_ord) from part_rules")


@query("rules_from_json", oracle("json_rules", """
select rule_ord, threat_id, match_score, array_to_string(tokens, ' ') as tokens, reason, recommendation_method from json_rules"""))
def _(d):
    return _rules_json(d).select("rule_ord", "threat_id", "match_score", F.array_join("tokens", " ").alias("tokens"), "reason", "recommendation_method")


@query("config_violations_json", oracle("json_rules", f"""
select 'rule' as kind, cast(rule_ord as varchar) as id, 'tokens must not be empty' as violation from json_rules where len(tokens) = 0
union all select 'rule', cast(rule_ord as varchar), 'match_score out of range' from json_rules where match_score not between 0 and 1
union all select 'rule', cast(rule_ord as varchar), 'unknown recommendation method' from json_rules where recommendation_method not in {tuple(V.METHODS)}
union all select 'recommendation', 'PR-' || p_partkey, 'unknown method' from part where p_partkey % 29 = 0
union all select 'recommendation', 'PR-' || p_partkey, 'priority out of range' from part where p_size % 7 not between 1 and 5
union all select 'scoring', 'scoring', 'risk_score_normalizer must be positive' from (select min(p_size) as m from part) where m - 1 <= 0
union all select 'scoring', 'scoring', 'confidence_base out of range' from (select max(p_size) as m from part) where m > 1"""))
def _(d):
    """Rules read from JSON, recommendations of the part table, and a scoring row with its numbers replaced."""
    part = d.table("part")
    recommendations = part.select(
        F.concat(F.lit("PR-"), "p_partkey").alias("code"), F.when(F.col("p_partkey") % 29 == 0, "magic").otherwise("malware").alias("method"),
        (F.col("p_size") % 7).alias("priority"),
    )
    sizes = part.agg(F.min("p_size").alias("low"), F.max("p_size").alias("high")).first()
    scoring = tables.scoring_table(d.spark).withColumns(
        {"risk_score_normalizer": F.lit(float(sizes.low - 1)), "confidence_base": F.lit(float(sizes.high))}
    )
    checks = (quality.rule_violations(_rules_json(d)), quality.recommendation_violations(recommendations), quality.scoring_violations(scoring))
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query("require_threats", oracle("part_catalog json_rules", """
select rule_ord, threat_id from json_rules where threat_id in (select threat_id from part_catalog)"""))
def _(d):
    rules = _rules_json(d)
    known = rules.join(quality.rule_orphans(rules, d.part_catalog).select("rule_ord"), "rule_ord", "left_anti")
    return quality.require_threats(known, d.part_catalog).select("rule_ord", "threat_id")


@query("rule_orphans", oracle("part_catalog part_rules", """
select rule_ord, threat_id from part_rules where threat_id not in (select threat_id from part_catalog)"""))
def _(d):
    return quality.rule_orphans(d.part_rules, d.part_catalog)


@query("orphan_threat_placeholders", oracle("incidents registry", f"""
select distinct threat_code, 'Threat ' || threat_code as name, '{V.PLACEHOLDER_DESCRIPTION}' as description,
       0 as confidentiality_breach, 0 as integrity_breach, 0 as availability_breach
from incidents i where not exists (select 1 from registry r where r.threat_code = i.threat_code)"""))
def _(d):
    return quality.orphan_threat_placeholders(d.incidents, d.registry).select(
        "threat_code", "name", "description", "confidentiality_breach", "integrity_breach", "availability_breach"
    )


@query("orphan_orgs", oracle("incidents organizations", """
select distinct 'Organization ' || organization_code as name, organization_code as code from incidents i
where not exists (select 1 from organizations o where o.code = i.organization_code and o.id % 5 <> 0)"""))
def _(d):
    return quality.orphan_orgs(d.incidents, d.organizations.where("id % 5 <> 0"))


@query("backfill_org_id", oracle("incidents organizations", """
select incident_id, organization_code,
       (select o.id from organizations o where o.code = i.organization_code and o.id % 5 <> 0) as organization_id
from incidents i"""))
def _(d):
    return quality.backfill_org_id(d.incidents, d.organizations.where("id % 5 <> 0")).select(
        "incident_id", "organization_code", "organization_id"
    )


@query("org_by_code", oracle("organizations", "select id, name, code from organizations where code = '42'"))
def _(d):
    return quality.organization_by_code(d.organizations, "  42 ")

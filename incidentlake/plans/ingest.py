"""Ingest, cleaning, seeding and source queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions import timecols as T
from incidentlake.functions.classify import classify_registry
from incidentlake.operators import quality as Q
from incidentlake.plans.base import REGISTRY_ROWS, VIEW_SQL, Domain, oracle, pick, query, quoted, sql_tokens
from incidentlake.session import shared_dir
from incidentlake.sources import delimited, tables

_H = list(V.INCIDENT_HEADERS)
_R = list(V.REGISTRY_HEADERS)
_names = [r[1] for r in REGISTRY_ROWS]
_texts = [r[2] for r in REGISTRY_ROWS]
_impacts = [r[3] for r in REGISTRY_ROWS]
_sources = ["Внешний нарушитель", "Внешний нарушитель; Внутренний нарушитель"]
_flags = ["1", "0", "", "x"]

VIEW_SQL["raw_incidents"] = (("incidents_raw",), """
select incident_id, upper(industry) as industry, ' ' || organization_code as organization_code,
       case when incident_id % 31 = 0 then 'н/д' when incident_id % 37 = 0 then '' when incident_id % 7 = 0 then host_count || '.0'
            else cast(host_count as varchar) end as host_count,
       cast(threat_code as varchar) as threat_code,
       case when incident_id % 41 = 0 then '2' else cast(success as varchar) end as success,
       case when incident_id % 43 = 0 then null else ' ' || region || ' ' end as region,
       case when incident_id % 101 = 0 then 'garbage' when incident_date is null then ''
            when incident_id % 5 = 0 then strftime(incident_date, '%Y-%m-%d') when incident_id % 5 = 1 then strftime(incident_date, '%-d/%-m/%Y')
            when incident_id % 5 = 2 then strftime(incident_date, '%d-%m-%y') else strftime(incident_date, '%d.%m.%Y') end as incident_date,
       case when incident_id % 4 = 0 then strftime(regional_time, '%Y-%m-%d %H:%M:%S')
            when incident_id % 4 = 1 then strftime(regional_time, '%Y-%m-%dT%H:%M:%S') || '.25'
            when incident_id % 4 = 2 then strftime(regional_time, '%d/%m/%y %-H:%M')
            else strftime(regional_time, '%d.%m.%Y %H:%M') end as regional_time
from incidents_raw""")


def _sql_int(c: str) -> str:
    return f"try_cast(case when try_cast(trim({c}) as double) = floor(try_cast(trim({c}) as double)) then try_cast(trim({c}) as double) end as int)"


def _sql_time(c: str) -> str:
    # two-digit years first: %Y would read 21 as the year 21
    days = [f"%d{mark}%m{mark}%{year}" for mark in "./-" for year in ("y", "Y")] + ["%Y-%m-%d"]
    formats = [day + clock for day in days for clock in ("", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f")]
    return f"try_strptime(replace(trim({c}), 'T', ' '), {quoted(formats)})"


VIEW_SQL["typed_incidents"] = (("raw_incidents",), f"""
select *, case when month in (12,1,2) then 'winter' when month in (3,4,5) then 'spring' when month in (6,7,8) then 'summer'
               else 'autumn' end as season,
       case when hour <= 5 then 'night' when hour <= 11 then 'morning' when hour <= 17 then 'afternoon' else 'evening' end as time_of_day
from (select *, cast(coalesce(hour(regional_time), 0) as int) as hour, cast(coalesce(month(incident_date), 1) as int) as month,
             cast(coalesce(isodow(incident_date), 1) as int) as day_of_week
      from (select incident_id, industry, organization_code, {_sql_int('host_count')} as host_count,
                   {_sql_int('threat_code')} as threat_code, {_sql_int('success')} as success, region,
                   {_sql_time('incident_date')} as incident_date, {_sql_time('regional_time')} as regional_time
            from raw_incidents))""")
VIEW_SQL["clean"] = (("typed_incidents",), """
select * replace (trim(industry) as industry, trim(organization_code) as organization_code, trim(region) as region)
from typed_incidents
where industry is not null and organization_code is not null and host_count is not null and threat_code is not null
  and success in (0, 1) and region is not null and regional_time is not null""")
VIEW_SQL["raw_registry"] = ((), f"""
select p_partkey as ord,
       case when p_partkey % 50 = 7 then 'н/д' else cast(p_partkey - case when p_partkey % 10 = 9 then 1 else 0 end as varchar) end as threat_code,
       {quoted(_names)}[cast(p_partkey % 6 as int) + 1] || ' ' || p_name as name,
       {quoted(_texts)}[cast(p_partkey % 6 as int) + 1] as description,
       case when p_partkey % 5 <> 0 then {quoted(_sources)}[cast(p_partkey % 2 as int) + 1] end as source_characteristics,
       case when p_partkey % 13 <> 0 then {quoted(_impacts)}[cast(p_partkey % 6 as int) + 1] end as object_of_impact,
       {quoted(_flags)}[cast(p_partkey % 4 as int) + 1] as confidentiality_breach,
       {quoted(_flags)}[cast(p_partkey % 3 as int) + 1] as integrity_breach,
       case when p_size > 25 then '1' else '0' end as availability_breach,
       case when p_partkey % 3 = 0 then strftime(date '2015-01-01' + cast(p_partkey % 3000 as int), '%Y-%m-%d')
            else strftime(date '2015-01-01' + cast(p_partkey % 3000 as int), '%d.%m.%Y') end as date_added,
       case when p_partkey % 4 = 0 then '' else strftime(date '2020-01-01' + cast(p_partkey % 900 as int), '%d.%m.%Y') end as last_modified,
       case when p_partkey % 9 = 0 then 'Архивная' when p_partkey % 11 <> 0 then 'Актуальна' end as status,
       case when p_partkey % 2 = 0 then p_brand end as notes
from part""")
VIEW_SQL["typed_registry"] = (("raw_registry",), f"""
select * replace ({_sql_int('threat_code')} as threat_code,
                  coalesce({_sql_int('confidentiality_breach')}, 0) as confidentiality_breach,
                  coalesce({_sql_int('integrity_breach')}, 0) as integrity_breach,
                  coalesce({_sql_int('availability_breach')}, 0) as availability_breach,
                  {_sql_time('date_added')} as date_added, {_sql_time('last_modified')} as last_modified)
from raw_registry""")
VIEW_SQL["base"] = (("clean", "registry"), """
select i.*, coalesce(r.name, 'Неизвестно') as threat_name, coalesce(r.source_characteristics, 'Неизвестно') as threat_source,
       coalesce(r.object_of_impact, 'Неизвестно') as impact_object,
       coalesce(r.confidentiality_breach, 0) as confidentiality_breach, coalesce(r.integrity_breach, 0) as integrity_breach,
       coalesce(r.availability_breach, 0) as availability_breach
from clean i left join registry r on i.threat_code = r.threat_code""")

_typed = ("incident_id", "organization_code", "industry", "host_count", "threat_code", "success", "region",
          "incident_date", "regional_time", "hour", "month", "season", "time_of_day", "day_of_week")
_typed_sql = ", ".join(_typed)
_registry_columns = tuple(V.REGISTRY_HEADERS.values())
_registry_sql = ", ".join(_registry_columns)


def raw_incidents(d: Domain) -> DataFrame:
    """The incident log as all-string columns under the source headers, with bad cells planted."""
    i, day, time = F.col("incident_id"), F.col("incident_date"), F.col("regional_time")
    hosts = F.col("host_count").cast("string")
    return d.incidents_raw.select(
        "incident_id",
        F.upper("industry").alias(_H[0]),
        F.concat(F.lit(" "), "organization_code").alias(_H[1]),
        F.when(i % 31 == 0, "н/д").when(i % 37 == 0, "").when(i % 7 == 0, F.concat(hosts, F.lit(".0"))).otherwise(hosts).alias(_H[2]),
        F.col("threat_code").cast("string").alias(_H[3]),
        F.when(i % 41 == 0, "2").otherwise(F.col("success").cast("string")).alias(_H[4]),
        F.when(i % 43 != 0, F.concat(F.lit(" "), "region", F.lit(" "))).alias(_H[5]),
        F.when(i % 101 == 0, "garbage").when(day.isNull(), "").when(i % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(i % 5 == 1, F.date_format(day, "d/M/yyyy")).when(i % 5 == 2, F.date_format(day, "dd-MM-yy"))
        .otherwise(F.date_format(day, "dd.MM.yyyy")).alias(_H[6]),
        F.when(i % 4 == 0, F.date_format(time, "yyyy-MM-dd HH:mm:ss")).when(i % 4 == 1, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'.25'"))
        .when(i % 4 == 2, F.date_format(time, "dd/MM/yy H:mm")).otherwise(F.date_format(time, "dd.MM.yyyy HH:mm")).alias(_H[7]),
    )


def raw_registry(d: Domain) -> DataFrame:
    """A threat registry as long as the part table, all strings under the source headers."""
    k = F.col("p_partkey")

    def day(start: str, span: int):
        return F.date_add(F.lit(start).cast("date"), (k % span).cast("int"))

    added = day("2015-01-01", 3000)
    return d.table("part").select(
        k.alias("ord"),
        F.when(k % 50 == 7, "н/д").otherwise((k - (k % 10 == 9).cast("int")).cast("string")).alias(_R[0]),
        F.concat(pick(_names, k % 6), F.lit(" "), "p_name").alias(_R[1]),
        pick(_texts, k % 6).alias(_R[2]),
        F.when(k % 5 != 0, pick(_sources, k % 2)).alias(_R[3]),
        F.when(k % 13 != 0, pick(_impacts, k % 6)).alias(_R[4]),
        pick(_flags, k % 4).alias(_R[5]),
        pick(_flags, k % 3).alias(_R[6]),
        F.when(F.col("p_size") > 25, "1").otherwise("0").alias(_R[7]),
        F.when(k % 3 == 0, F.date_format(added, "yyyy-MM-dd")).otherwise(F.date_format(added, "dd.MM.yyyy")).alias(_R[8]),
        F.when(k % 4 == 0, "").otherwise(F.date_format(day("2020-01-01", 900), "dd.MM.yyyy")).alias(_R[9]),
        F.when(k % 9 == 0, "Архивная").when(k % 11 != 0, "Актуальна").alias(_R[10]),
        F.when(k % 2 == 0, F.col("p_brand")).alias(_R[11]),
    )


def base_rows(d: Domain) -> DataFrame:
    return tables.model_base(tables.normalize_incidents(raw_incidents(d)), d.registry)


def scratch(d: Domain, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(d.spark)}/{name}-{uuid.uuid4().hex}"


@query("ingest_incidents", oracle("typed_incidents", f"select {_typed_sql} from typed_incidents"))
def _(d):
    return tables.normalize_incidents(raw_incidents(d)).select(*_typed)


@query("ingest_registry", oracle("typed_registry", f"select ord, {_registry_sql} from typed_registry"))
def _(d):
    return tables.normalize_registry(raw_registry(d), ("ord",)).select("ord", *_registry_columns)


@query("scan_registry", oracle("typed_registry", """
select threat_code, name, object_of_impact from typed_registry where threat_code is not null"""))
def _(d):
    return (
        tables.normalize_registry(raw_registry(d))
        .where("threat_code is not null")
        .select("threat_code", "name", "object_of_impact")
    )


@query("parse_dates", oracle("raw_incidents", f"""
select incident_id, {_sql_time('incident_date')} as incident_date, {_sql_time('regional_time')} as regional_time,
       try_strptime(regional_time, '%d.%m.%Y %H:%M') as strict_time, try_strptime(incident_date, '%d.%m.%Y') as strict_date
from raw_incidents"""))
def _(d):
    day, time = F.col(_H[6]), F.col(_H[7])
    return raw_incidents(d).select(
        "incident_id",
        T.parse_lenient(day).alias("incident_date"),
        T.parse_lenient(time).alias("regional_time"),
        T.parse_strict(time, "dd.MM.yyyy HH:mm").alias("strict_time"),
        T.parse_strict(day, "dd.MM.yyyy").alias("strict_date"),
    )


@query("clean_incidents", oracle("clean", f"select {_typed_sql} from clean"))
def _(d):
    return tables.clean_incidents(tables.normalize_incidents(raw_incidents(d))).select(*_typed)


_dedup_sql = """
select threat_code, name, description, object_of_impact, status from (
  select *, row_number() over (partition by threat_code order by ord) as rn from typed_registry where threat_code is not null)
where rn = 1"""


@query("registry_dedup", oracle("typed_registry", _dedup_sql))
def _(d):
    return tables.dedup_registry(tables.normalize_registry(raw_registry(d), ("ord",)), "ord").select(
        "threat_code", "name", "description", "object_of_impact", "status"
    )


_method_sql = sql_tokens("lower(concat_ws(' ', name, description, object_of_impact))", V.METHOD_TOKENS, V.DEFAULT_METHOD)
_target_sql = sql_tokens("lower(concat_ws(' ', object_of_impact, name, description))", V.TARGET_TOKENS, V.DEFAULT_TARGET)


def _classified(d: Domain) -> DataFrame:
    return classify_registry(tables.normalize_registry(raw_registry(d), ("ord",)))


@query("classify_method", oracle("raw_registry", f"select ord, {_method_sql} as attack_method from raw_registry"))
def _(d):
    return _classified(d).select("ord", "attack_method")


@query("classify_target", oracle("raw_registry", f"select ord, {_target_sql} as target_object from raw_registry"))
def _(d):
    return _classified(d).select("ord", "target_object")


_base_columns = ("incident_id", "organization_code", "industry", "region", "threat_name", "threat_source",
                 "impact_object", "confidentiality_breach", "integrity_breach", "availability_breach")


@query("model_base", oracle("base", f"select {', '.join(_base_columns)} from base"))
def _(d):
    return base_rows(d).select(*_base_columns)


def _write_log(d: Domain, rows_per_file: int = 250_000) -> str:
    """The raw log as separated text files, each with a title line and its own header line."""
    path = scratch(d, "incident-log")
    raw = raw_incidents(d)
    parts = max(4, raw.count() // rows_per_file)
    columns = ["incident_id", *_H]
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    body = raw.select((F.col("incident_id") % parts).cast("int").alias("part"), F.lit(2).alias("line"), F.concat_ws(";", *cells).alias("value"))
    heads = d.spark.range(parts).select(
        F.col("id").cast("int").alias("part"),
        F.inline(F.array(
            F.struct(F.lit(0).alias("line"), F.concat(F.lit("Журнал инцидентов "), F.col("id")).alias("value")),
            F.struct(F.lit(1).alias("line"), F.lit(" ;".join(columns)).alias("value")),
        )),
    )
    lines = heads.unionByName(body).repartition(parts, "part").sortWithinPartitions("part", "line")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return path


@query("header_detect", oracle("clean", f"select {_typed_sql} from clean"))
def _(d):
    raw = delimited.read_with_header(d.spark, _write_log(d), V.INCIDENT_HEADERS, V.INCIDENT_HEADER_ROWS)
    typed = tables.normalize_incidents(raw.withColumn("incident_id", F.col("incident_id").cast("bigint")))
    return tables.clean_incidents(typed).select(*_typed)


def _text_files(d: Domain, name: str, lines: DataFrame, parts: int) -> str:
    """(part, line, value) as one text file per part, lines in order; values may hold bytes of any encoding."""
    path = scratch(d, name)
    placed = lines.repartition(parts, "part").sortWithinPartitions("part", "line")
    placed.select("part", "value").write.partitionBy("part").text(path)
    return path


_MIXED = ((";", "utf-8"), (",", "cp1251"), ("|", "utf-8"), ("\t", "cp1251"))


def _mixed(cells: list, part) -> F.Column:
    """Cells joined with the separator and in the encoding of their part."""
    value = F.lit(None).cast("string")
    for i, (separator, encoding) in enumerate(_MIXED):
        joined = F.concat_ws(separator, *cells)
        made = joined if encoding == "utf-8" else delimited.in_cp1251(joined).cast("string")
        value = F.when(part == i, made).otherwise(value)
    return value


@query("read_headerless", oracle("clean", f"select {_typed_sql} from clean"))
def _(d):
    raw = raw_incidents(d)
    columns = ["incident_id", *_H]
    part = (F.col("incident_id") % len(_MIXED)).cast("int")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    lines = raw.select(part.alias("part"), F.col("incident_id").alias("line"), _mixed(cells, part).alias("value"))
    read = delimited.read_headerless(d.spark, _text_files(d, "bare-log", lines, len(_MIXED)), columns)
    typed = tables.normalize_incidents(read.withColumn("incident_id", F.col("incident_id").cast("bigint")))
    return tables.clean_incidents(typed).select(*_typed)


@query("header_detect_registry", oracle("typed_registry", _dedup_sql))
def _(d):
    """The registry in files of several separators and encodings, with three lines above the header."""
    raw = raw_registry(d)
    columns = ["ord", *[c for c in raw.columns if c != "ord"]]
    part = (F.col("ord") % len(_MIXED)).cast("int")
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit("")), F.lit('"')) for c in columns]
    body = raw.select(part.alias("part"), F.col("ord").cast("bigint").alias("line"), _mixed(cells, part).alias("value"))
    own = F.col("part")
    header = _mixed([F.lit(f'"{c}"') for c in columns], own)
    title = _mixed([F.lit("Выгрузка реестра угроз")], own)
    above = [F.struct(F.lit(i - 10).cast("bigint").alias("line"), x.alias("value")) for i, x in enumerate((title, F.lit("-"), F.lit("-"), header))]
    heads = d.spark.range(len(_MIXED)).select(F.col("id").cast("int").alias("part")).select("part", F.inline(F.array(*above)))
    path = _text_files(d, "registry-log", heads.unionByName(body), len(_MIXED))
    read = delimited.read_with_header(d.spark, path, V.REGISTRY_REQUIRED_HEADERS, V.REGISTRY_HEADER_ROWS)
    typed = tables.normalize_registry(read.withColumn("ord", F.col("ord").cast("bigint")), ("ord",))
    return tables.dedup_registry(typed, "ord").select("threat_code", "name", "description", "object_of_impact", "status")


@query("seed_if_empty", oracle("incidents", f"select {_typed_sql} from incidents"))
def _(d):
    """The second write finds rows and is left out."""
    path = scratch(d, "seeded")
    written = [tables.append_if_empty(d.incidents, path) for _ in range(2)]
    if written != [True, False]:
        raise AssertionError(written)
    return tables.saved(d.spark, path).select(*_typed)


@query("source_precedence", oracle("incidents", f"select {_typed_sql} from incidents"))
def _(d):
    return tables.first_available(
        lambda: d.incidents.where("region = 'nowhere'"),
        lambda: tables.saved(d.spark, f"{shared_dir(d.spark)}/no-such-table"),
        lambda: d.incidents,
        lambda: tables.builtin_incidents(d.spark),
    ).select(*_typed)


@query("seed_registry", oracle("typed_registry", f"""
with firsts as ({_dedup_sql}) select threat_code, name from firsts where threat_code % 3 <> 0""".replace("with firsts as", ", firsts as")))
def _(d):
    incoming = tables.dedup_registry(tables.normalize_registry(raw_registry(d), ("ord",)), "ord")
    existing = d.table("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("int").alias("threat_code"))
    return tables.seed_registry(existing, incoming).select("threat_code", "name")


@query("build_organizations", oracle("incidents", """
select distinct 'Organization ' || organization_code as name, organization_code as code from incidents
where organization_code not in (select cast(c_custkey as varchar) from customer where c_custkey % 3 = 0)"""))
def _(d):
    return tables.build_organizations(d.incidents, d.organizations.where("id % 3 = 0"))


@query("seed_incidents", oracle("incidents organizations", """
select o.id as organization_id, i.* from incidents i join organizations o on i.organization_code = o.code
where o.id % 3 <> 0"""))
def _(d):
    known = d.organizations.where("id % 3 <> 0")
    return tables.seed_incidents(d.incidents, known).select("organization_id", *_typed)


@query("settings_upsert", oracle("settings", """
, updates as (select organization_id, 'upd-' || region as region, industry, host_count + 1 as host_count, technologies, 1 as seq from settings where organization_id % 2 = 0
  union all select organization_id, region, 'fresh' as industry, host_count + 2, list_value('docker'), 2 from settings where organization_id % 4 = 0)
select organization_id, region, industry, host_count, array_to_string(technologies, '|') as technologies from (
  select *, row_number() over (partition by organization_id order by seq desc) as rn
  from (select *, 0 as seq from settings union all select * from updates)) where rn = 1"""))
def _(d):
    s = d.settings
    first = s.where("organization_id % 2 = 0").select(
        "organization_id", F.concat(F.lit("upd-"), "region").alias("region"), "industry",
        (F.col("host_count") + 1).alias("host_count"), "technologies", F.lit(1).alias("seq"),
    )
    second = s.where("organization_id % 4 = 0").select(
        "organization_id", "region", F.lit("fresh").alias("industry"), (F.col("host_count") + 2).alias("host_count"),
        F.array(F.lit("docker")).alias("technologies"), F.lit(2).alias("seq"),
    )
    stored = tables.upsert_settings(s, first.unionByName(second), "seq")
    return tables.read_settings(stored).withColumn("technologies", F.concat_ws("|", "technologies"))


@query("table_counts", oracle("incidents registry organizations settings", """
select 'organizations' as table_name, count(*) as n, null as warning from organizations
union all select 'settings', count(*), null from settings
union all select 'incidents', count(*), null from incidents
union all select 'fstec_threats', count(*), null from registry
union all select 'archive', 0, 'archive is empty'"""))
def _(d):
    return Q.table_counts(
        {
            "organizations": d.organizations,
            "settings": d.settings,
            "incidents": d.incidents,
            "fstec_threats": d.registry,
            "archive": d.incidents.where("region = 'nowhere'"),
        }
    )


@query("vuln_ingest", oracle("vulnerabilities", """
select asset_id, asset_name, asset_type, vulnerability_code, title, severity, description from vulnerabilities"""))
def _(d):
    path = scratch(d, "vulnerabilities")
    # one document per line keeps the file splittable; wrapped and bare documents are mixed
    rows = d.vulnerabilities
    wrapped = F.to_json(F.struct(F.array(F.struct(*rows.columns)).alias("vulnerabilities")))
    bare = F.to_json(F.array(F.struct(*rows.columns)))
    is_even = F.crc32(F.col("vulnerability_code").cast("binary")) % 2 == 0
    rows.select(F.when(is_even, wrapped).otherwise(bare).alias("value")).write.text(path)
    return tables.read_vulnerabilities(d.spark, path, multi_line=False)

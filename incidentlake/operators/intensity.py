"""Attack intensity of many requests at once, with the fallback chain of scopes.

A request looks at its own organization's incidents (all organizations when it has none),
narrowed to region and season, else season, else everything, and to its industry when
at least three rows of that scope share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions.numbers import round2
from incidentlake.session import materialized

#: Columns a scope keeps besides its organization, narrowest first.
_LEVELS = (("region", "season"), ("season",), ())
_NONE = "\0"  # stands for null in keys
_UNKNOWN_HOUR = 24  # slot of incidents whose hour is unknown: they count in totals, and as one hour


def _key(c: Column) -> Column:
    """Null as a value of its own, so that keys are compared, hashed and grouped alike."""
    return F.coalesce(c, F.lit(_NONE))


def counts(incidents: DataFrame) -> DataFrame:
    """Incidents folded once to organization x region x season x industry x hour."""
    return incidents.groupBy(
        "organization_code",
        _key(F.lower("region")).alias("region"),
        _key(F.col("season")).alias("season"),
        F.lower("industry").alias("industry"),
        F.coalesce("hour", F.lit(_UNKNOWN_HOUR)).alias("hour"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _entry(by_hour: str) -> str:
    """Counts by hour with their total, and their mean over the hours present, at least 1."""
    total = f"aggregate({by_hour}, 0L, (a, b) -> a + b)"
    return f"named_struct('by_hour', {by_hour}, 'base', greatest({total} / size(filter({by_hour}, n -> n > 0)), 1D), 'total', {total})"


def profile(folded: DataFrame, org: tuple[str, ...]) -> DataFrame:
    """Counts by hour of every scope (three levels, within organizations or over all), and of its industries.

    One row per scope: the entry ``whole``, and ``by_industry`` that of each industry with rows enough to be
    used. The lists are as long as there are industries; hours are plain sums, so the steps stay hash aggregates.
    """
    slots = range(_UNKNOWN_HOUR + 1)
    sets = [[F.col(c) for c in (*org, *level, "industry")] for level in _LEVELS]
    keys = [F.col(c) for c in (*org, "region", "season", "industry")]
    by_hour = "array(" + ", ".join(f"sum(if(hour = {h}, n, 0))" for h in slots) + ")"
    industries = folded.groupingSets(sets, *keys).agg(
        F.expr(by_hour).alias("by_hour"), F.expr("cast(grouping(region) + grouping(season) as int)").alias("level")
    )
    industries = industries.withColumn("entry", F.expr(_entry("by_hour")))
    used = F.expr(f"if(entry.total >= {V.MIN_INDUSTRY_ROWS} and industry is not null, struct(industry, entry), null)")
    whole = "array(" + ", ".join(f"sum(by_hour[{h}])" for h in slots) + ")"
    return (
        industries.groupBy(*org, _key(F.col("region")).alias("region"), _key(F.col("season")).alias("season"), "level")
        .agg(F.expr(whole).alias("by_hour"), F.map_from_entries(F.collect_list(used)).alias("by_industry"))
        .select(*org, "region", "season", "level", F.expr(_entry("by_hour")).alias("whole"), "by_industry")
    )


def _ratio(whole: str, by_industry: str) -> Column:
    """Incidents in the asked hour over the mean of the hours present, in the industry's counts if there are any; null without a scope."""
    entry = f"coalesce(try_element_at({by_industry}, s_industry), {whole})"
    asked = f"if(s_hour between 0 and {_UNKNOWN_HOUR - 1}, get({entry}.by_hour, s_hour), 0)"
    return F.expr(f"if({whole} is null, null, coalesce({asked}, 0) / {entry}.base)")


def attack_intensity(requests: DataFrame, incidents: DataFrame) -> DataFrame:
    """Requests with ``attack_intensity``: incidents in the asked hour over the mean of the hours present.

    Equal request scopes are folded first, so a hot organization costs few lookups. A scope looks up its three
    levels in its own organization; where that has no incidents, region and season over all organizations. The two
    last levels over all are one map by season and one entry, which reach every row as scalars: no
    key is shared by all scopes.
    """
    keyed = requests.withColumns(
        {
            "s_org": _key(F.nullif("organization_id", F.lit(""))),
            "s_region": _key(F.lower("region")),
            "s_season": _key(F.col("season")),
            "s_industry": _key(F.when(F.col("industry") != "", F.lower(F.trim("industry")))),
            "s_hour": F.coalesce("hour", F.lit(-1)),
        }
    )
    scope = ["s_org", "s_region", "s_season", "s_industry", "s_hour"]
    # read once and checkpointed: scopes and hours, not incidents
    folded = materialized(counts(incidents))
    own = profile(folded.where("organization_code is not null"), ("organization_code",)).withColumnsRenamed(
        {"organization_code": "s_org", "region": "c_region", "season": "c_season"}
    )
    everyone = materialized(profile(folded.groupBy("region", "season", "industry", "hour").agg(F.sum("n").alias("n")), ()))

    # the levels within the organization; the first one found counts
    levels = F.array(
        *[
            F.struct(
                F.lit(i).alias("level"),
                (F.col("s_region") if "region" in level else F.lit(_NONE)).alias("c_region"),
                (F.col("s_season") if "season" in level else F.lit(_NONE)).alias("c_season"),
            )
            for i, level in enumerate(_LEVELS)
        ]
    )
    asked = keyed.select(*scope).distinct().select("*", F.inline(levels))
    found = asked.join(own, ["s_org", "level", "c_region", "c_season"], "left").withColumn("ratio", _ratio("whole", "by_industry"))
    best = found.groupBy(*scope).agg(F.min_by("ratio", F.when(F.col("ratio").isNotNull(), F.col("level"))).alias("own_ratio"))

    local = everyone.where("level = 0").select(
        F.col("region").alias("s_region"), F.col("season").alias("s_season"), F.col("whole").alias("a_whole"), F.col("by_industry").alias("a_industry")
    )
    counted = F.struct("whole", "by_industry")
    seasons = everyone.where("level = 1").agg(F.map_from_entries(F.collect_list(F.struct("season", counted)))).scalar()
    whole = everyone.where("level = 2").select(counted).scalar()
    answers = (
        best.join(local, ["s_region", "s_season"], "left")
        .withColumns({"_season": F.when(F.col("own_ratio").isNull(), F.try_element_at(seasons, F.col("s_season"))), "_whole": whole})
        .select(
            *scope,
            round2(
                F.coalesce(
                    "own_ratio", _ratio("a_whole", "a_industry"),
                    _ratio("_season.whole", "_season.by_industry"), _ratio("_whole.whole", "_whole.by_industry"),
                )
            ).alias("attack_intensity"),
        )
    )
    return keyed.join(answers, scope, "left").withColumn("attack_intensity", F.coalesce("attack_intensity", F.lit(0.0))).select(
        *requests.columns, "attack_intensity"
    )

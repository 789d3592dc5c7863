"""Dense region x hour table with fills, lags and rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions import timecols as T
from incidentlake.operators.medians import overall_medians
from incidentlake.session import materialized

HALO = max(*V.LAGS, *V.ROLLING)
BLOCK_HOURS = 28 * 24
FLAGS = ("confidentiality_breach", "integrity_breach", "availability_breach")
_FACETS = {
    "org": "organization_code", "threat": "threat_code", "hosts": "host_count", "org_type": "industry",
    "threat_source": "threat_source", "impact_object": "impact_object",
}
_COUNTS = ("incidents_count", "successful_count", "unique_enterprises", "unique_threats")
_HOSTS = ("avg_host_count", "median_host_count")
_DOMINANT = ("dominant_org_type", "dominant_threat_source", "dominant_impact_object")


def aggregate(base: DataFrame) -> DataFrame:
    """One row per region and hour that has incidents.

    First the incidents are folded to (region, hour, facet, value) counts, which splits a hot
    region-hour over its values; distinct counts, modes and the median then run over those
    counts, so no group ever holds raw incidents.
    """
    flagged = set(FLAGS) <= set(base.columns)
    danger = sum((F.coalesce(F.col(c), F.lit(0)) for c in FLAGS), F.lit(0)) if flagged else F.col("success")
    rows = base.select(
        "region", T.hour_index(F.col("regional_time")).alias("hour_index"), "success", danger.alias("danger"),
        *[F.col(c).cast("string").alias(name) for name, c in _FACETS.items()],
    )
    counts = (
        rows.unpivot(["region", "hour_index", "success", "danger"], list(_FACETS), "facet", "value")
        .groupBy("region", "hour_index", "facet", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("success").alias("successes"),
            F.max("danger").alias("danger"),
        )
    )

    def of(facet: str, value: Column) -> Column:
        return F.when(F.col("facet") == facet, value)

    def dominant(facet: str) -> Column:
        known = (F.col("facet") == facet) & F.col("value").isNotNull()
        best = F.min_by(F.when(known, F.col("value")), F.when(known, F.struct(-F.col("n"), F.col("value"))))
        return F.coalesce(best, F.lit(V.UNKNOWN))

    hosts = of("hosts", F.col("value").try_cast("int"))
    weight = of("hosts", F.when(F.col("value").isNotNull(), F.col("n")))
    return counts.groupBy("region", "hour_index").agg(
        F.sum(of("org", F.col("n"))).alias("incidents_count"),
        F.sum(of("org", F.col("successes"))).alias("successful_count"),
        F.count(of("org", F.col("value"))).alias("unique_enterprises"),
        F.count(of("threat", F.col("value"))).alias("unique_threats"),
        (F.sum(hosts * weight) / F.sum(weight)).alias("avg_host_count"),
        F.percentile(hosts, 0.5, F.coalesce(weight, F.lit(0))).alias("median_host_count"),
        *[dominant(name.removeprefix("dominant_")).alias(name) for name in _DOMINANT],
        F.max("danger").alias("threat_danger_score"),
    )


def dense(hours: DataFrame) -> DataFrame:
    """Every region x every hour from the first to the last; counts zero in the gaps.

    ``hours`` is read several times here; see ``build``.
    """
    first, last = (hours.agg(f("hour_index")).scalar() for f in (F.min, F.max))
    grid = hours.select("region").distinct().select(
        "region", F.explode(F.sequence(first, last)).alias("hour_index")
    )
    zeros = {c: F.coalesce(c, F.lit(0)) for c in (*_COUNTS, "threat_danger_score")}
    return (
        grid.join(hours, ["region", "hour_index"], "left")
        .withColumns(zeros)
        .withColumn("attack_present", (F.col("successful_count") > 0).cast("int"))
        .withColumn("time_hour", T.index_to_hour(F.col("hour_index")))
    )


def filled(grid: DataFrame, hours: DataFrame) -> DataFrame:
    """Host statistics by the region's median, then the overall one; dominant values by the region's mode.

    Groups are the hours of one region, so their size follows the time span, not the incidents.
    """
    fills = hours.groupBy("region").agg(
        *[F.median(c).alias(f"_{c}") for c in _HOSTS],
        *[F.mode(c, True).alias(f"_{c}") for c in _DOMINANT],
    )
    overall = overall_medians(hours, _HOSTS)
    changes = {c: F.coalesce(c, f"_{c}", F.lit(overall[c]).cast("double")) for c in _HOSTS}
    changes |= {c: F.coalesce(c, f"_{c}", F.lit(V.UNKNOWN)) for c in _DOMINANT}
    return grid.join(fills, "region", "left").withColumns(changes).drop(*[f"_{c}" for c in (*_HOSTS, *_DOMINANT)])


def blocked(grid: DataFrame, add: dict[str, Column], place: str = "hour_index") -> DataFrame:
    """Add window columns of at most ``HALO`` preceding places, in parallel over blocks of places.

    Places are cut into blocks; every block also gets the last ``HALO`` places of the
    block before it, which are dropped again afterwards. Expressions use ``history()``.
    """
    own = F.floor(F.col(place) / BLOCK_HOURS)
    also = F.when(F.pmod(place, F.lit(BLOCK_HOURS)) >= BLOCK_HOURS - HALO, own + 1)
    return (
        grid.withColumn("_block", F.explode(F.array_compact(F.array(own, also))))
        .withColumns(add)
        .where(F.col("_block") == own)
        .drop("_block")
    )


def history(by: tuple[str, ...] = ("region",), place: str = "hour_index") -> Window:
    return Window.partitionBy(*by, "_block").orderBy(place)


_LAGGED = {"attack": "attack_present", "incidents": "incidents_count", "success": "successful_count"}


def lag_columns() -> dict[str, Column]:
    w = history()
    return {
        f"lag_{name}_{k}": F.coalesce(F.lag(column, k).over(w), F.lit(0)).cast("bigint")
        for name, column in _LAGGED.items()
        for k in V.LAGS
    }


def _rolled(name: str, column: str, w) -> tuple[str, Column]:
    if name == "attack":
        return "attack_mean", F.coalesce(F.avg(column).over(w), F.lit(0.0))
    return f"{name}_sum", F.coalesce(F.sum(column).over(w), F.lit(0)).cast("bigint")


def rolling_columns() -> dict[str, Column]:
    """Rolling means and sums over the k hours before each row, from one row on."""
    out = {}
    for name, column in _LAGGED.items():
        for k in V.ROLLING:
            label, value = _rolled(name, column, history().rowsBetween(-k, -1))
            out[f"rolling_{label}_{k}"] = value
    return out


def compat_rolling(grid: DataFrame) -> DataFrame:
    """Rolling columns that run on from one region into the next, in name order, however short the regions are.

    The grid is dense, so a row's place in (region, hour) order is arithmetic; the windows run over blocks of
    places, which may hold the end of a region, many whole ones and the start of another. Values are lagged
    within their region first.
    """
    lagged = blocked(grid, {f"_{name}": F.lag(column, 1).over(history()) for name, column in _LAGGED.items()})
    first, last = (grid.agg(f("hour_index")).scalar() for f in (F.min, F.max))
    ranks = grid.select("region").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("region")) - 1)  # regions only
    place = F.col("_rank") * (last - first + 1) + F.col("hour_index") - first
    placed = lagged.join(ranks, "region").withColumn("_place", place.cast("bigint")).drop("_rank")
    add = {}
    for name in _LAGGED:
        for k in V.ROLLING:
            label, value = _rolled(name, f"_{name}", history((), "_place").rowsBetween(1 - k, 0))
            add[f"rolling_{label}_{k}"] = value
    return blocked(placed, add, "_place").drop("_place", *[f"_{name}" for name in _LAGGED])


def features(grid: DataFrame, compat: bool = False) -> DataFrame:
    """All model features of a filled grid."""
    df = compat_rolling(grid) if compat else grid
    df = blocked(df, lag_columns() | ({} if compat else rolling_columns()))
    df = T.calendar_features(df)
    return df.withColumns({f"{c}_log": F.log1p(c) for c in _HOSTS})


def hours_table(base: DataFrame) -> DataFrame:
    """The aggregate, checkpointed: it is small (regions x hours) and read several times below."""
    return materialized(aggregate(base))


def build(base: DataFrame) -> DataFrame:
    """Filled dense grid of a merged incident frame. Incidents are read once."""
    hours = hours_table(base)
    return filled(dense(hours), hours)


def tail_per_region(grid: DataFrame, n: int) -> DataFrame:
    """The last ``n`` hours of every region; the grid is dense, so this is a range of hours."""
    return grid.where(F.col("hour_index") > grid.agg(F.max("hour_index")).scalar() - n)


def resolve_region(requests: DataFrame, grid: DataFrame) -> DataFrame:
    """``resolved_region``: the asked region, or the most frequent one (smallest name) when unknown."""
    known = grid.groupBy("region").agg(F.count(F.lit(1)).alias("_rows"))
    fallback = known.agg(F.min_by("region", F.struct(-F.col("_rows"), F.col("region")))).scalar()
    named = known.select(F.col("region").alias("_known"))
    return (
        requests.join(named, F.col("region") == F.col("_known"), "left")
        .withColumn("resolved_region", F.coalesce("_known", fallback, "region"))
        .drop("_known")
    )


def cv_folds(grid: DataFrame, folds: int = V.FOLDS, order: str = "time") -> DataFrame:
    """Expanding-window folds: ``val_fold`` is the fold a row validates, 0 for rows that only train.

    A row trains fold f when ``position < f's first position``, kept as ``fold_starts``. The grid
    is dense, so positions are arithmetic: the hour offset, or with ``order='region'`` the row
    number in (region, hour) order.
    """
    first, last = (grid.agg(f("hour_index")).scalar() for f in (F.min, F.max))
    hours = last - first + 1
    offset = F.col("hour_index") - first
    if order == "region":
        ranks = grid.select("region").distinct().withColumn(
            "_rank", F.row_number().over(Window.orderBy("region")) - 1
        )
        grid = grid.join(ranks, "region")
        position, n = F.col("_rank") * hours + offset, grid.select("region").distinct().agg(F.count("*")).scalar() * hours
    else:
        position, n = offset, hours
    df = grid.withColumns({"position": position.cast("bigint"), "_n": n.cast("bigint")}).drop("_rank")
    size = F.floor(F.col("_n") / (folds + 1))
    start = F.col("_n") - size * folds
    return (
        df.withColumn("fold_starts", F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: start + i * size))
        .withColumn("val_fold", F.size(F.filter("fold_starts", lambda s: s <= F.col("position"))))
        .drop("_n")
    )


# ---- forecast rows --------------------------------------------------------------------------


_LEVELS = (*_HOSTS, "threat_danger_score")


def base_levels(grid: DataFrame) -> DataFrame:
    """Medians and modes of the filled grid per region (groups are the hours of one region)."""
    return grid.groupBy("region").agg(
        *[F.median(c).alias(c) for c in _LEVELS],
        *[F.mode(c, True).alias(c) for c in _DOMINANT],
    )


def overall_levels(grid: DataFrame) -> dict[str, Column]:
    """The same of the whole grid, as values: medians without one task, modes from counts per value."""
    levels = {c: F.lit(v).cast("double") for c, v in overall_medians(grid, _LEVELS).items()}
    modes = grid.agg(*[F.mode(c, True).alias(c) for c in _DOMINANT]).first()
    return levels | {c: F.lit(modes[c]) for c in _DOMINANT}


def forecast_rows(grid: DataFrame, targets: DataFrame) -> DataFrame:
    """Feature rows for every hour of (region, date) targets, from history strictly before each hour.

    Hours after the end see the end, so the as-of lookup is an equi-join on
    ``least(hour, last + 1)`` to windows over the grid with one extra row per region. Hours
    before the start and unknown regions have no history; unknown regions use overall levels.
    """
    last = grid.agg(F.max("hour_index")).scalar()
    used = ("attack_present", "incidents_count", "successful_count", "unique_enterprises", "unique_threats")
    past = grid.select("region", "hour_index", *used)
    extra = grid.select("region").distinct().withColumn("hour_index", last + 1)
    w6 = history().rowsBetween(-6, -1)
    columns = lag_columns()
    for c in ("incidents_count", "unique_enterprises", "unique_threats"):
        columns[f"mean_{c}"] = F.coalesce(F.avg(c).over(w6), F.lit(0.0))
    for name, column in _LAGGED.items():
        for k in V.ROLLING:
            frame = history().rowsBetween(-k, -1)
            label, value = _rolled(name, column, frame)
            columns[f"rolling_{label}_{k}"] = F.when(F.count(column).over(frame) == k, value).otherwise(0)
    windows = blocked(past.unionByName(extra, allowMissingColumns=True), columns).drop(*used)
    windows = windows.withColumnsRenamed({"region": "w_region", "hour_index": "w_hour"})

    asked = (
        targets.select("region", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_h"), F.col("date").cast("date").alias("_d"))
        .withColumn("hour_index", F.date_diff("_d", F.lit("1970-01-01").cast("date")) * 24 + F.col("_h"))
        .withColumn("time_hour", T.index_to_hour(F.col("hour_index")))
        .drop("_h", "_d")
    )
    joined = asked.join(
        windows, (F.col("region") == F.col("w_region")) & (F.least(F.col("hour_index"), last + 1) == F.col("w_hour")), "left"
    )
    levels = base_levels(grid).withColumnRenamed("region", "l_region")
    df = joined.join(levels, F.col("region") == F.col("l_region"), "left")
    overall = overall_levels(grid)
    names = tuple(overall)
    df = df.withColumns({c: F.coalesce(F.col(c), value) for c, value in overall.items()})
    computed = [c for c in columns if c not in names]
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in computed})
    df = df.withColumnsRenamed({f"mean_{c}": c for c in ("incidents_count", "unique_enterprises", "unique_threats")})
    df = df.withColumns({f"{c}_log": F.log1p(c) for c in _HOSTS})
    return T.calendar_features(df).drop("w_region", "w_hour", "l_region")

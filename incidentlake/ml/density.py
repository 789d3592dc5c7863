"""Density clustering of low-dimensional points (two or three coordinates), for one setting or a grid of them.

Equal points fold to one weighted point. Space is cut into cells whose diagonal is eps, so the
points of a cell are neighbours without being paired. Only points of thin cells (fewer than
min_samples points) are compared with each other, which is linear work. Whatever meets a full cell
(another full cell, or a thin point that asks whether, or how often, it is reached) meets boxes around
parts of its points, which are halved only while they are undecided; a box is never opened once its
side of the question is settled, so no cell of any size is read by one task point by point.

A grid of settings is one job: settings are part of the cells' names, so all of them share the rounds.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake.session import materialized

REACH = 2  # cells of side eps / sqrt(d), d <= 3: neighbours lie at most two cells away


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _square_distance(a: str, b: str, dims: int) -> Column:
    return _sum((F.col(f"{a}x{i}") - F.col(f"{b}x{i}")) ** 2 for i in range(dims))


def _cell(cols: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in cols])


def _around(dims: int) -> Column:
    """Keys of all cells within reach of the row's cell, in its setting."""
    return F.array(
        *[
            _cell([F.col("setting"), *[F.col(f"c{i}") + step[i] for i in range(dims)]])
            for step in product(range(-REACH, REACH + 1), repeat=dims)
        ]
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _boxes(members: DataFrame, level: int, dims: int, wanted: DataFrame | None = None) -> DataFrame:
    """Boxes around the points of each unit's parts, halved ``level`` times; only children of ``wanted`` (unit, parent)."""
    sub = [F.floor(F.col(f"x{i}") / F.col("side") * 2**level) for i in range(dims)]
    rows = members.withColumns({"box": _cell(sub), "parent": _cell([F.floor(s / 2) for s in sub])})
    if wanted is not None:
        rows = rows.join(wanted, ["unit", "parent"], "left_semi")
    return rows.groupBy("unit", "box", "parent").agg(
        *[f(f"x{i}").alias(f"{name}{i}") for i in range(dims) for name, f in (("lo", F.min), ("hi", F.max))],
        *[F.min_by(f"x{i}", "pid").alias(f"x{i}") for i in range(dims)],
        F.sum("w").alias("w"),
        F.min("eps").alias("eps"),
    )


def _touching(members: DataFrame, pairs: DataFrame, dims: int) -> DataFrame:
    """Which of the pairs (left, right) of units have two points within eps.

    A pair of boxes is settled when the boxes are too far apart, or when a known point of each lies
    within eps; otherwise both are halved. One-point boxes are always settled, so the answer is exact.
    """
    axes = range(dims)
    found = None
    level = 0
    first = _boxes(members, 0, dims)
    open_pairs = pairs.join(_prefixed(first, "a_"), F.col("left") == F.col("a_unit")).join(
        _prefixed(first, "b_"), F.col("right") == F.col("b_unit")
    )
    while True:
        gap = _sum(
            F.greatest(F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.lit(0.0)) ** 2
            for i in axes
        )
        single = reduce(
            lambda a, b: a & b, (F.col(f"{p}_lo{i}") == F.col(f"{p}_hi{i}") for i in axes for p in "ab")
        )
        square = F.col("a_eps") ** 2
        judged = materialized(
            open_pairs.withColumns(
                {"near": _square_distance("a_", "b_", dims) <= square, "apart": gap > square, "single": single}
            ).select("left", "right", "a_box", "b_box", "near", "apart", "single")
        )
        hits = judged.where("near").select("left", "right").distinct()
        found = materialized(hits if found is None else found.unionByName(hits).distinct())
        rest = judged.where("not near and not single and not apart").join(found, ["left", "right"], "left_anti")
        rest = materialized(rest.select("left", "right", "a_box", "b_box"))
        if rest.isEmpty():
            return found
        level += 1
        wanted = rest.select(F.col("left").alias("unit"), F.col("a_box").alias("parent")).union(rest.select("right", "b_box"))
        halves = materialized(_boxes(members, level, dims, wanted.distinct()))
        open_pairs = rest.withColumnsRenamed({"a_box": "pa", "b_box": "pb"})
        for prefix, unit, parent in (("a_", "left", "pa"), ("b_", "right", "pb")):
            open_pairs = open_pairs.join(
                _prefixed(halves, prefix), (F.col(unit) == F.col(f"{prefix}unit")) & (F.col(parent) == F.col(f"{prefix}parent"))
            )
        open_pairs = open_pairs.drop("pa", "pb")


def _counted(asked: DataFrame, members: DataFrame, pairs: DataFrame, dims: int) -> DataFrame:
    """(left, got): weight of the units' points within eps of each asked point, followed until it is ``needed`` or known.

    ``asked`` has (left, x0.., needed), ``pairs`` (left, right). A box counts as a whole once all of it is within eps.
    """
    axes = range(dims)
    got, level = None, 0
    open_pairs = pairs.join(asked, "left").join(_prefixed(_boxes(members, 0, dims), "b_"), F.col("right") == F.col("b_unit"))
    while True:
        off = [(F.col(f"x{i}") - F.col(f"b_lo{i}"), F.col(f"x{i}") - F.col(f"b_hi{i}")) for i in axes]
        most = _sum(F.greatest(F.abs(a), F.abs(b)) ** 2 for a, b in off)
        least = _sum(F.greatest(-a, b, F.lit(0.0)) ** 2 for a, b in off)
        square = F.col("b_eps") ** 2
        judged = materialized(
            open_pairs.withColumns({"inside": most <= square, "apart": least > square}).select(
                "left", "right", "b_box", "b_w", "inside", "apart", "needed", *[f"x{i}" for i in axes]
            )
        )
        more = judged.where("inside").select("left", F.col("b_w").alias("got"))
        got = materialized((more if got is None else got.unionByName(more)).groupBy("left").agg(F.sum("got").alias("got")))
        rest = judged.where("not inside and not apart").join(got, "left", "left").where(F.coalesce("got", F.lit(0)) < F.col("needed"))
        rest = materialized(rest.select("left", "right", F.col("b_box").alias("parent"), "needed", *[f"x{i}" for i in axes]))
        if rest.isEmpty():
            return got
        level += 1
        halves = _boxes(members, level, dims, rest.select(F.col("right").alias("unit"), "parent").distinct())
        open_pairs = rest.join(
            _prefixed(halves, "b_"), (F.col("right") == F.col("b_unit")) & (F.col("parent") == F.col("b_parent"))
        ).drop("parent")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest start label of each connected part.

    Every round takes the smallest label around a node and then that label's own label, so
    labels travel in growing steps; each round is checkpointed. Nodes may have a column ``setting``:
    labels of different settings then have nothing to do with each other.
    """
    if "setting" not in nodes.columns:
        nodes = nodes.withColumn("setting", F.lit(0))
    both = materialized(
        edges.select("left", "right").unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right")))
    )
    labels = materialized(nodes.select("node", "setting", "label"))
    while True:
        near = both.join(labels, F.col("right") == F.col("node")).groupBy("left").agg(F.min("label").alias("near"))
        least = (
            labels.join(near, F.col("node") == F.col("left"), "left")
            .select("node", "setting", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        )
        # a label's own newest label: the smallest one any of its members saw
        jump = least.groupBy("setting", F.col("label").alias("low")).agg(F.min("low").alias("jump"))
        stepped = materialized(
            least.join(jump, ["setting", "low"], "left").select(
                "node", "setting", "label", F.least("low", F.coalesce("jump", "low")).alias("next")
            )
        )
        if stepped.where("next <> label").isEmpty():
            return labels.select("node", "label")
        labels = stepped.select("node", "setting", F.col("next").alias("label"))


def _labelled(df: DataFrame, columns: list[str], settings: list[tuple[float, int]], key: str) -> DataFrame:
    """Distinct points under every setting: (setting, x0.., w, cluster)."""
    dims = len(columns)
    if dims not in (2, 3):
        raise ValueError("project the points to two or three coordinates first")
    xs = [f"x{i}" for i in range(dims)]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in columns))
    folded = df.where(known).groupBy(*[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs)]).agg(
        F.min(key).alias("pid"), F.count(F.lit(1)).alias("w")
    )
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("setting"), F.lit(float(eps)).alias("eps"), F.lit(int(m)).alias("least"),
                     F.lit(float(eps) / dims**0.5 * (1 - 1e-9)).alias("side"))
            for i, (eps, m) in enumerate(settings)
        ]
    )
    placed = folded.select("*", F.inline(grid)).withColumns({f"c{i}": F.floor(F.col(f"x{i}") / F.col("side")) for i in range(dims)})
    cell = _cell([F.col("setting"), *[F.col(f"c{i}") for i in range(dims)]])
    placed = materialized(placed.withColumns({"cell": cell, "self": F.concat_ws(":", "setting", "pid")}))
    sizes = placed.groupBy("cell").agg(F.sum("w").alias("cell_w"))
    points = materialized(placed.join(sizes, "cell").withColumn("full", F.col("cell_w") >= F.col("least")))

    # a full cell is one unit of points, a thin point is one by itself
    full = points.where("full").withColumn("unit", F.col("cell"))
    thin = points.where("not full").withColumn("unit", F.col("self"))
    full_cells = materialized(full.select("cell", "setting", *[f"c{i}" for i in range(dims)]).distinct())
    around = materialized(thin.select("self", "cell", "eps", "least", *xs, F.explode(_around(dims)).alias("seek")))
    near_full = materialized(
        around.select("self", "seek").join(full_cells.select(F.col("cell").alias("seek")), "seek", "left_semi")
        .select(F.col("self").alias("left"), F.col("seek").alias("right"))
    )

    # thin points against each other, fewer than min_samples a cell
    close = materialized(
        _prefixed(around, "p_")
        .join(_prefixed(thin.select("self", "cell", "w", *xs), "q_"), F.col("p_seek") == F.col("q_cell"))
        .where(_square_distance("p_", "q_", dims) <= F.col("p_eps") ** 2)
        .select("p_self", "p_cell", "q_self", "q_cell", "q_w")
    )
    seen = close.groupBy(F.col("p_self").alias("left")).agg(F.sum("q_w").alias("_seen"))
    needed = materialized(thin.join(seen, F.col("self") == F.col("left")).select("left", "cell", *xs, (F.col("least") - F.col("_seen")).alias("needed")))
    more = _counted(needed.where("needed > 0").drop("cell"), full, near_full, dims)
    thin_core = needed.join(more, "left", "left").where(F.coalesce("got", F.lit(0)) >= F.col("needed")).select(F.col("left").alias("self"), "cell")
    thin_core = materialized(thin_core)

    # cells with core points, joined where two of their core points are close
    thin_edges = (
        close.join(thin_core.select(F.col("self").alias("q_self")), "q_self", "left_semi")
        .join(thin_core.select(F.col("self").alias("p_self")), "p_self", "left_semi")
        .where("p_cell <> q_cell")
        .select(F.col("p_cell").alias("left"), F.col("q_cell").alias("right"))
    )
    full_pairs = (
        full_cells.select(F.col("cell").alias("left"), F.explode(_around(dims)).alias("right"))
        .where(F.col("left") < F.col("right"))
        .join(full_cells.select(F.col("cell").alias("right")), "right", "left_semi")
        .select("left", "right")
    )
    columns_used = ["unit", "pid", *xs, "w", "eps", "side"]
    members = full.select(*columns_used).unionByName(thin.select(*columns_used))
    touched = materialized(_touching(members, full_pairs.unionByName(near_full), dims))
    core_of = thin_core.select(F.col("self").alias("left"), F.col("cell").alias("_cell"))
    # a full cell's name stands for itself, a thin point's for the cell it lies in if it is a core point
    thin_full = touched.join(core_of, "left").select(F.col("_cell").alias("left"), "right")
    full_full = touched.join(full_cells.select(F.col("cell").alias("left")), "left", "left_semi")
    edges = thin_edges.unionByName(thin_full).unionByName(full_full.select("left", "right")).distinct()
    core = full.select("cell", "setting", "pid").unionByName(thin.join(thin_core.select("self"), "self", "left_semi").select("cell", "setting", "pid"))
    labels = components(core.groupBy(F.col("cell").alias("node"), "setting").agg(F.min("pid").alias("label")), edges)

    of_cell = labels.select(F.col("node").alias("cell"), "label")
    core_labels = materialized(thin_core.join(of_cell, "cell").select("self", "label"))
    by_thin = close.join(core_labels.withColumnRenamed("self", "q_self"), "q_self").select(F.col("p_self").alias("self"), "label")
    by_full = touched.join(of_cell, F.col("right") == F.col("cell")).select(F.col("left").alias("self"), "label")
    border = by_thin.unionByName(by_full).groupBy("self").agg(F.min("label").alias("label")).join(core_labels, "self", "left_anti")
    thin_labels = core_labels.unionByName(border)
    named = full.join(of_cell, "cell").select("setting", *xs, "w", "label").unionByName(
        thin.join(thin_labels, "self", "left").select("setting", *xs, "w", "label")
    )
    return named.select("setting", *xs, "w", F.coalesce("label", F.lit(-1)).alias("cluster"))


def density_cluster(df: DataFrame, columns: list[str], eps: float, min_samples: int, key: str) -> DataFrame:
    """``df`` with ``cluster``: the smallest ``key`` among the cluster's core points, -1 for noise.

    A border point within reach of several clusters goes to the one with the smallest label. Points
    with an unknown coordinate are noise.
    """
    named = _labelled(df, columns, [(eps, min_samples)], key)
    named = named.select(*[F.col(f"x{i}").alias(f"_x{i}") for i in range(len(columns))], "cluster")
    same = reduce(lambda a, b: a & b, (F.col(c).cast("double") == F.col(f"_x{i}") for i, c in enumerate(columns)))
    return df.join(named, same, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1))).drop(*[f"_x{i}" for i in range(len(columns))])


def density_sweep(df: DataFrame, columns: list[str], key: str, eps_values, min_samples_values) -> DataFrame:
    """(eps, min_samples, clusters, noise, largest) for a grid of both parameters; noise and largest are rows."""
    settings = [(float(eps), int(m)) for eps in eps_values for m in min_samples_values]
    named = _labelled(df, columns, settings, key)
    sizes = named.groupBy("setting", "cluster").agg(F.sum("w").alias("n"))
    found = sizes.groupBy("setting").agg(
        F.count_if(F.col("cluster") >= 0).alias("clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") == -1, F.col("n"))), F.lit(0)).alias("noise"),
        F.coalesce(F.max(F.when(F.col("cluster") >= 0, F.col("n"))), F.lit(0)).alias("largest"),
    )
    grid = F.array(*[F.struct(F.lit(eps).alias("eps"), F.lit(m).alias("min_samples")) for eps, m in settings])
    return found.select(F.get(grid, F.col("setting")).alias("g"), "clusters", "noise", "largest").select("g.*", "clusters", "noise", "largest")

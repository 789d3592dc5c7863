"""Clustering against brute force, and small fits of the models."""

import random
import statistics
import threading
import time
from collections import Counter
from functools import partial
from math import dist

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.functions.numbers import round2
from incidentlake.ml import boosting, clustering, density, forest, region_risk
from incidentlake.operators import medians, metrics
from incidentlake.operators import regionhour as R
from incidentlake.session import concurrently, materialized


def brute_dbscan(points, eps, min_samples):
    near = {i: [j for j, q in enumerate(points) if dist(p, q) <= eps] for i, p in enumerate(points)}
    core = {i for i in near if len(near[i]) >= min_samples}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo, label[i] = [i], i
        while todo:
            for j in near[todo.pop()]:
                if j in core and j not in label:
                    label[j] = i
                    todo.append(j)
    for i in near:
        if i not in core:
            label[i] = min((label[j] for j in near[i] if j in core), default=-1)
    return label


@pytest.mark.parametrize("dims,seed,eps,min_samples", [(2, 1, 0.35, 5), (2, 2, 0.8, 8), (3, 3, 0.5, 4)])
def test_density_matches_brute_force(spark, dims, seed, eps, min_samples):
    rng = random.Random(seed)
    centers = [[rng.uniform(-4, 4) for _ in range(dims)] for _ in range(4)]
    points = [tuple(round(rng.gauss(c, 0.5), 2) for c in rng.choice(centers)) for _ in range(260)]
    points += [points[0]] * 90 + [tuple(rng.uniform(-5, 5) for _ in range(dims)) for _ in range(30)]
    names = [f"v{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id bigint, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.cluster for r in density.density_cluster(df, names, eps, min_samples, "id").collect()}
    assert got == brute_dbscan(points, eps, min_samples)


def test_density_of_a_full_cell_and_odd_points(spark):
    """Most points in one cell, thin points around it, unknown coordinates, and a grid of settings at once."""
    rng = random.Random(11)
    points = [(round(rng.uniform(0, 0.2), 3), round(rng.uniform(0, 0.2), 3)) for _ in range(500)]
    points += [(round(rng.uniform(-1, 1.4), 2), round(rng.uniform(-1, 1.4), 2)) for _ in range(40)]
    odd = [(None, 0.1), (0.1, None), (float("nan"), 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points + odd)], "id bigint, a double, b double")
    got = {r.id: r.cluster for r in density.density_cluster(df, ["a", "b"], 0.3, 7, "id").collect()}
    assert got == {**brute_dbscan(points, 0.3, 7), 540: -1, 541: -1, 542: -1}
    rows = density.density_sweep(df, ["a", "b"], "id", [0.1, 0.25, 0.4], [3, 8]).collect()
    assert len(rows) == 6
    for r in rows:
        labels = Counter(brute_dbscan(points, r.eps, r.min_samples).values())
        noise = labels.pop(-1, 0)
        assert (r.clusters, r.noise, r.largest) == (len(labels), noise, max(labels.values(), default=0))


def test_settings_of_a_grid_keep_their_labels_apart(spark):
    """A chain that is one cluster under a wide setting and many under a narrow one."""
    points = [(0.5 * (i // 4) + 0.01 * (i % 4), 0.0) for i in range(80)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id bigint, a double, b double").repartition(3)
    rows = {r.eps: r for r in density.density_sweep(df, ["a", "b"], "id", [0.1, 0.6], [3]).collect()}
    assert (rows[0.1].clusters, rows[0.1].largest, rows[0.6].clusters, rows[0.6].largest) == (20, 4, 1, 80)


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.range(n).select(F.col("id").cast("string").alias("node"), "id").withColumnRenamed("id", "label")
    edges = spark.range(n - 2).select(F.col("id").cast("string").alias("left"), (F.col("id") + 1).cast("string").alias("right"))
    got = {r.node: r.label for r in density.components(nodes, edges).collect()}
    assert got == {**{str(i): 0 for i in range(n - 1)}, str(n - 1): n - 1}


def test_top_labels(spark):
    df = spark.range(1).select(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)).alias("p"))
    got = df.select(forest.top_labels(F.col("p"), ["a", "b", "c"], 2).alias("t")).first().t
    assert [(x.label, x.probability) for x in got] == [("b", 0.5), ("c", 0.3)]


def test_region_risk_learns_a_daily_pattern(spark, tmp_path):
    rows = [
        (region, 480000 + i, 2 * hot, hot, hot, hot, hot, 10.0, 10.0, "a", "b", "c", 1)
        for region in ("A", "B") for i in range(24 * 10) for hot in [int((480000 + i) % 24 in range(8, 14))]
    ]
    df = spark.createDataFrame(
        rows,
        "region string, hour_index bigint, incidents_count int, successful_count int, unique_enterprises int, unique_threats int, "
        "attack_present int, avg_host_count double, median_host_count double, dominant_org_type string, dominant_threat_source string, "
        "dominant_impact_object string, threat_danger_score int",
    ).withColumn("time_hour", R.T.index_to_hour(F.col("hour_index")))
    prepared = region_risk.prepare(R.features(df))
    model = region_risk.train(prepared, {"iterations": 4, "depth": 3, "learning_rate": 0.3})
    assert [r["fold"] for r in model.cv] == [1, 2, 3] and min(r["f1"] for r in model.cv) > 0.9
    assert not set(region_risk.CURRENT_HOUR) & set(model.features)
    path = str(tmp_path / "model")
    region_risk.save(model, spark, path)
    again = region_risk.load(spark, path)
    assert (again.threshold, again.features) == (model.threshold, model.features)
    first = region_risk.score_rows(model, prepared).orderBy("region", "hour_index").select("proba", "decision").collect()
    assert first == region_risk.score_rows(again, prepared).orderBy("region", "hour_index").select("proba", "decision").collect()


def test_forest_needs_ten_rows(spark):
    df = spark.range(9).select(F.lit("malware").alias("attack_method"))
    assert forest.train(df) is None
    assert (V.FOREST_TREES, V.FOREST_MIN_ROWS) == (200, 10)


def test_round2_is_one_rule_for_every_size(spark):
    values = [0.0, 0.005, 0.125, 0.575, 255.995, 256.125, 256.375, 12345.675, 2.0**40 + 0.125, 1e17]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
    assert [r.r for r in df.select(round2(F.col("x")).alias("r")).collect()] == [*(round(x, 2) for x in values), None]


def test_organizations_keep_their_own_history(spark):
    rows = [(f"org{o}", "a" if o % 2 else "b", "x") for o in range(300) for _ in range(10)]
    rows += [("few", "a", "x")] * 9 + [(None, "b", "x")]
    df = spark.createDataFrame(rows, "organization_code string, attack_method string, target_object string")
    history, overall = forest.label_history(df, {"attack_method": ["a", "b"], "target_object": ["x"]})
    asked = spark.createDataFrame([("org7",), ("org8",), ("few",), ("new",), (None,)], "organization_code string")
    got = {r.organization_code: r.attack_method_0_share for r in forest.with_history(asked, history, overall).collect()}
    common = (1500 + 9) / 3010
    assert got == {"org7": 1.0, "org8": 0.0, "few": pytest.approx(common), "new": pytest.approx(common), None: pytest.approx(common)}


# boosting with patience


def test_best_prefix_waits_for_patience():
    falling = [1.0 / (i + 1) for i in range(30)]
    assert boosting.best_prefix(falling, 5) == (30, False)
    assert boosting.best_prefix([3.0, 2.0, 2.5, 2.4, 2.3, 1.0], 3) == (2, True)
    assert boosting.best_prefix([3.0, 2.0, 2.5, 2.4, 1.9, 1.95], 3) == (5, False)
    assert boosting.best_prefix([2.0, 2.0, 2.0], 2) == (1, True) and boosting.best_prefix([1.0], 50) == (1, False)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(3000)]
    rows = [(i, a, b, c, int(rng.random() < 0.15 + 0.7 * ((a > 0.5) != (b > 0.4)))) for i, a, b, c in rows]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, attack_present int").repartition(2, "id")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumn("weight", F.lit(1.0))
    return materialized(df)


def test_boosting_keeps_the_best_prefix(spark, noisy):
    train, held = noisy.where("id % 3 > 0"), noisy.where("id % 3 = 0")
    params = {"iterations": 60, "depth": 3, "learning_rate": 0.4}
    boosted = boosting.fit(train, held, params, 7, 32, patience=6)
    best = min(range(len(boosted.losses)), key=lambda i: boosted.losses[i]) + 1
    assert boosted.trees == best and 3 < best < 60 and len(boosted.losses) == best + 6
    # the same trees as of a fit of just so many rounds, and the loss that was promised
    plain = GBTClassifier(labelCol="attack_present", weightCol="weight", maxIter=best, maxDepth=3, stepSize=0.4, maxBins=32, seed=7).fit(train)
    assert boosted.model.treeWeights == plain.treeWeights and boosted.model.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]
    assert boosted.model.evaluateEachIteration(held)[-1] == pytest.approx(boosted.losses[best - 1])
    # where every round helps, all rounds allowed are kept
    assert boosting.fit(train, train, params | {"iterations": 9}, 7, 32, patience=3).trees == 9


def test_grid_and_folds_run_side_by_side(spark):
    started, most, lock = [], [], threading.Lock()

    def job(i):
        with lock:
            started.append(i)
            most.append(len(started))
        spark.range(50_000).selectExpr("max(sha2(string(id), 256))").collect()
        time.sleep(0.3)
        with lock:
            started.remove(i)
        return i, spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    got = concurrently(spark, [partial(job, i) for i in range(4)])
    assert [g[0] for g in got] == [0, 1, 2, 3] and max(most) > 1 and len({g[1] for g in got}) == 4
    assert concurrently(spark, []) == []


def test_scores_take_missing_features_as_zero(spark, noisy):
    fitted = boosting.fit(noisy, noisy, {"iterations": 3, "depth": 2, "learning_rate": 0.3}, 1, 32)
    assembler = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    model = region_risk.RiskModel(PipelineModel([assembler, fitted.model]), ["a", "b", "c"], [], 0.5, [])
    rows = noisy.select("id", "a", "b")
    got = region_risk.score_rows(model, rows).orderBy("id").select("proba", "decision").collect()
    assert got == region_risk.score_rows(model, rows.withColumn("c", F.lit(0))).orderBy("id").select("proba", "decision").collect()
    assert all(r.decision == int(r.proba >= 0.5) for r in got) and {r.decision for r in got} == {0, 1}


def test_metrics_of_folds_on_any_partitioning(spark):
    rng = random.Random(9)
    rows = [(f, int(rng.random() < s), round(s, 2)) for f in (1, 2, 3) for s in [rng.random() for _ in range(400)]] + [(1, 1, None), (2, None, 0.4)]
    df = spark.createDataFrame(rows, "fold int, y int, proba double").repartition(7)
    got = {r.fold: r for r in metrics.fold_metrics(df).collect()}
    for fold in (1, 2, 3):
        own = [(y, p) for f, y, p in rows if f == fold and y is not None and p is not None]

        def f1(t):
            tp, fp, fn = (sum(1 for y, p in own if y == a and (p >= t) == b) for a, b in ((1, True), (0, True), (1, False)))
            return 2 * tp / (2 * tp + fp + fn), tp / (tp + fp), tp / (tp + fn)

        best = max(metrics.thresholds(), key=lambda t: (f1(t)[0], -t))
        won = sum((p > q) + (p == q) / 2 for y, p in own if y for z, q in own if not z)
        area = won / (sum(y for y, _ in own) * sum(1 - y for y, _ in own))
        assert got[fold].threshold == best and got[fold].auc == pytest.approx(area)
        assert (got[fold].f1, got[fold].precision, got[fold].recall) == pytest.approx(f1(best))
    summary = metrics.cv_summary(metrics.fold_metrics(df), df.select("y"), 4).first()
    f1s = [got[f].f1 for f in (1, 2, 3)]
    assert (summary.folds, summary.train_rows, summary.feature_count) == (3, len(rows), 4)
    assert summary.mean_f1 == pytest.approx(statistics.mean(f1s)) and summary.std_f1 == pytest.approx(statistics.stdev(f1s))


# medians, windows that run on, projections, the cluster tree, label shares


def test_medians_of_columns_and_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(9)]), rng.choice([0.5, None, rng.random()])) for _ in range(500)] + [("one", 4, None)]
    df = spark.createDataFrame(rows, "g string, x int, y double").repartition(6)
    got = {(r.g, r.feature): r.median for r in medians.medians(df, ["x", "y"], ("g",)).collect()}
    want = {}
    for g in ("a", "b", None, "one"):
        for i, c in ((1, "x"), (2, "y")):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            if values:
                want[g, c] = statistics.median(values)
    assert got == pytest.approx(want)
    assert medians.overall_medians(df, ["x", "y"])["x"] == statistics.median([r[1] for r in rows if r[1] is not None])
    assert medians.overall_medians(df.where("x < 0"), ["x"]) == {"x": None}


@pytest.mark.parametrize("hours,regions", [(5, 3), (1, 40), (30, 4), (700, 2)])
def test_windows_run_on_over_any_number_of_short_regions(spark, hours, regions):
    rng = random.Random(hours)
    rows = [(f"R{r:02d}", 1000 + h, rng.randrange(2), rng.randrange(5), rng.randrange(3)) for r in range(regions) for h in range(hours)]
    df = spark.createDataFrame(rows, "region string, hour_index bigint, attack_present int, incidents_count int, successful_count int").repartition(5)
    got = {(r.region, r.hour_index): r for r in R.compat_rolling(df).collect()}
    assert len(got) == len(rows)
    lagged = [(None,) * 3 if i % hours == 0 else rows[i - 1][2:] for i in range(len(rows))]
    for i, row in enumerate(rows):
        for k in V.ROLLING:
            seen = [x for x in lagged[max(0, i - k + 1) : i + 1]]
            known = [x for x in seen if x[0] is not None]
            r = got[row[:2]]
            assert r[f"rolling_attack_mean_{k}"] == pytest.approx(sum(x[0] for x in known) / len(known) if known else 0.0)
            assert r[f"rolling_incidents_sum_{k}"] == sum(x[1] for x in known) and r[f"rolling_success_sum_{k}"] == sum(x[2] for x in known)


def test_projection_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 9)) @ rng.normal(size=(9, 9)) * np.array([9, 5, 3, 1, 1, 1, 1, 1, 1]) + 4
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x.tolist())], ["id", "features"]).repartition(3)
    found = clustering.pca(df, 3, rounds=40, extra=2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = vectors[:, ::-1][:, :3]
    want = want * np.sign(want[np.abs(want).argmax(axis=0), range(3)])
    assert np.allclose(found.loadings, want, atol=1e-5) and np.allclose(found.explained, values[::-1][:3] / values.sum(), atol=1e-9)
    placed = {r.id: r.components for r in found.points(df).collect()}
    assert np.allclose([placed[i] for i in range(400)], (x - x.mean(axis=0)) @ want, atol=1e-3)
    whole = clustering.pca(df, 9, rounds=3)  # as many as there are: exact at once
    assert sum(whole.explained) == pytest.approx(1.0)


def test_cluster_tree_is_nested(spark):
    rng = random.Random(8)
    centers = [(9, 1, 1), (1, 9, 1), (1, 1, 9), (9, 9, 1)]
    rows = [(i, Vectors.dense([c + rng.gauss(0, 0.3) for c in centers[i % 4]])) for i in range(200)]
    tree = clustering.hierarchy(spark.createDataFrame(rows, ["id", "features"]), 6)
    labels = {r.id: r["labels"] for r in tree.collect()}
    for k in range(2, 7):
        at = [labels[i][k - 2] for i in range(200)]
        assert sorted(set(at)) == list(range(k))
        if k > 2:  # every cluster lies in one of the cut before
            assert len({(labels[i][k - 2], labels[i][k - 3]) for i in range(200)}) == k
    assert len({tuple(sorted(i for i in range(200) if labels[i][2] == c)) for c in range(4)} & {tuple(range(c, 200, 4)) for c in range(4)}) == 4
    scores = dict(clustering.hierarchical_sweep(tree, most=6))
    assert max(scores, key=scores.get) == 4
    same = spark.createDataFrame([(i, Vectors.dense([1.0, 2.0])) for i in range(5)], ["id", "features"])
    assert {tuple(r["labels"]) for r in clustering.hierarchy(same, 4).collect()} <= {(), (0,), (0, 0), (0, 0, 0)}


def test_label_shares_leave_the_own_label_out(spark):
    """With random labels, shares of the other folds tell nothing; shares with the own label would."""
    rng = random.Random(6)
    rows = [(i, f"org{i % 200}", rng.choice(["a", "b"]), "x") for i in range(2400)]
    df = spark.createDataFrame(rows, "incident_id int, organization_code string, attack_method string, target_object string")
    values = {"attack_method": ["a", "b"], "target_object": ["x"]}
    history, overall = forest.label_history(df, values)

    def lift(known):
        got = known.select(F.corr((F.col("attack_method") == "a").cast("double"), "attack_method_0_share")).first()[0]
        return got or 0.0

    assert lift(forest.with_history(df, history, overall)) > 0.2
    assert lift(forest.out_of_fold(df, values, overall, least=5)) < 0.05
    few = spark.createDataFrame([(1, "o", "a", "x"), (2, None, "a", "x")], df.schema)
    assert {r.attack_method_0_share for r in forest.out_of_fold(few, values, overall).collect()} == {overall["attack_method_0_share"]}

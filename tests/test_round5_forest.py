"""Forests grown from counts on large tables: MLlib's trees, whatever the partitions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from incidentlake.ml import forest, levelforest

ROW = "id int, c string, b string, x double, h int, y string"
ASKED = [("zz", None, 9.0, 99), (None, "l", -1.0, 5)]


def rows(n=1500):
    rng = random.Random(4)
    for i in range(n):
        c, b, x, h = rng.choice("pqrstu"), rng.choice("kl"), rng.random(), rng.randrange(24)
        y = rng.choice("abc") if rng.random() < 0.5 else ("a" if c in "pq" and h > 11 else "b" if x > 0.3 and b == "k" else "c")
        yield i % (n - 50), c, b, x, h, y


def fitted(df, trees, **more):
    return levelforest.fit(df, 1500, "id", ["c", "b"], ["x", "h"], {"y": ["a", "b", "c"]}, trees, 5, 42, **more)["y"]


def scores(model, df):
    asked = df.select("c", "b", "x", "h").union(df.sparkSession.createDataFrame(ASKED, "c string, b string, x double, h int"))
    scored = model.transform(asked.withColumn("y", F.lit("a"))).select("c", "b", "x", "h", vector_to_array("probability").alias("p"))
    return sorted((str(r[:4]), r.p) for r in scored.collect())


def test_same_trees_as_mllib(spark):
    df = spark.createDataFrame([*rows()], ROW)
    stages = [
        StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc"),
        StringIndexer(inputCols=["c", "b"], outputCols=["ci", "bi"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["ci", "bi"], outputCols=["ch", "bh"], handleInvalid="keep"),
        VectorAssembler(inputCols=["ch", "bh", "x", "h"], outputCol="features"),
        RandomForestClassifier(numTrees=1, maxDepth=5, seed=42, bootstrap=False),
    ]
    theirs, ours = scores(Pipeline(stages=stages).fit(df), df), scores(fitted(df, 1, bootstrap=False), df)
    assert [key for key, _ in ours] == [key for key, _ in theirs]
    assert np.allclose([p for _, p in ours], [p for _, p in theirs], rtol=0, atol=1e-12)


def test_trees_follow_the_rows_not_their_partitions(spark, monkeypatch):
    df = spark.createDataFrame([*rows()], ROW)
    one, five = fitted(df.repartition(1, "id"), 6), fitted(df.orderBy(F.desc("x")).repartition(5, "id"), 6)
    monkeypatch.setattr(levelforest, "MOST_COUNTS", 1)  # a tree a pass
    parts = fitted(df.repartition(3, "id"), 6)
    for other in (five, parts):
        assert (one.tests == other.tests).all() and (one.test == other.test).all() and (one.leaves == other.leaves).all()
    assert len({tuple(t) for t in one.test}) == 6


def test_draws_are_poisson_and_copies_are_drawn_on_their_own():
    keys = np.sort(np.repeat(np.arange(20_000, dtype=np.int64) * 7919, 2))
    binning = levelforest.Binning({"c": ["p"]}, {})
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(["p"] * len(keys)), pa.array(["a"] * len(keys))], ["_key", "c", "y"])
    blocks = [*levelforest._encoded(iter([batch.slice(0, 15_001), batch.slice(15_001)]), binning, [["a"]])]
    own = np.frombuffer(blocks[0].column(0)[0].as_buffer(), np.uint64)
    assert len(blocks) == 1 and len(np.unique(own)) == len(keys)
    step = levelforest.Level(binning, [levelforest.Grown.empty(9, 1, 1)], {(0, t): {0: [0]} for t in range(9)}, 42, True)
    times = np.zeros((9, len(own)))
    for t, drawn, weights in step.drawn(own):
        times[t, drawn] = weights
    assert times.mean(axis=1) == pytest.approx(1, abs=0.03) and times.var(axis=1) == pytest.approx(1, abs=0.05)
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert (times == k).mean() == pytest.approx(share, abs=0.004)
    assert abs(np.corrcoef(times) - np.eye(9)).max() < 0.03
    assert abs(np.corrcoef(times[0, ::2], times[0, 1::2])[0, 1]) < 0.03


def test_cuts_as_mllib_sets_them():
    assert levelforest.cuts(np.array([3.0, 1.0, 2.0, 2.0])).tolist() == [1.5, 2.5]
    assert levelforest.cuts(np.array([5.0, 5.0])).tolist() == []
    many = levelforest.cuts(np.arange(1000.0))
    assert len(many) == 31 and abs(np.diff(many) - 1000 / 32).max() <= 1


def test_missing_numbers_raise_as_before():
    binning = levelforest.Binning({"c": ["p"]}, {"x": np.array([0.5])})
    assert binning.bins([pa.array(["p", None, "q"]), pa.array([0.5, 0.6, 0.0])]).tolist() == [[0, 1, 1], [0, 1, 0]]
    for missing in (None, float("nan")):
        with pytest.raises(ValueError, match="x"):
            binning.bins([pa.array(["p"]), pa.array([missing], pa.float64())])


def test_large_tables_get_the_same_forest_from_counts(spark, monkeypatch):
    rng = random.Random(1)
    made = []
    for i in range(900):
        hour, region = rng.randrange(24), rng.choice("RST")
        noisy = rng.random() < 0.3
        made.append((i, f"o{i % 3}", region, rng.choice("ij"), "winter", 1 + i % 7, hour, "True", rng.randrange(9), 1,
                     rng.choice("ab") if noisy else "ab"[hour > 11], rng.choice("cd") if noisy else "cd"[region == "R"]))
    ddl = "incident_id bigint, organization_code string, region string, industry string, season string, day_of_week int, hour int, " \
        "has_external_access string, privileged_accounts_count int, known_vulnerabilities_count int, attack_method string, target_object string"  # fmt: skip
    known = spark.createDataFrame(made, ddl)
    asked = known.where("incident_id < 200").withColumnsRenamed({"incident_id": "request_id", "organization_code": "organization_id"})

    def answers(forests):
        found = forest.predict(forests, asked, 2).collect()
        return {r.request_id: [{x.label: x.probability for x in r[f"top_{c}"]} for c in forest.LABELS] for r in found}

    small = answers(forest.train(known, trees=40))
    monkeypatch.setattr(forest, "TASK_ROWS", 100)
    forests = forest.train(known, trees=40)
    assert all(isinstance(model, levelforest.LevelForest) for model, _ in forests.models.values())
    large = answers(forests)
    assert small.keys() == large.keys() and len(large) == 200
    gaps = [abs(a[k] - b[k]) for r in large for a, b in zip(small[r], large[r]) for k in a]
    assert np.mean(gaps) < 0.05


def test_results_of_a_large_table_name_every_request(spark, monkeypatch):
    """Without MLlib's fit: one row per request, the labels that the rows teach, the number of all rows."""
    ddl = "incident_id bigint, organization_code string, region string, industry string, season string, day_of_week int, hour int, " \
        "has_external_access string, privileged_accounts_count int, known_vulnerabilities_count int, attack_method string, target_object string"  # fmt: skip
    made = [(i, f"o{i % 3}", "RST"[i % 3], "i", "winter", 1 + i % 7, i % 24, "True", 1, 1, "ab"[i % 24 > 11], "cd"[i % 24 > 11]) for i in range(600)]
    monkeypatch.setattr(forest, "TASK_ROWS", 100)
    monkeypatch.setattr(forest, "RandomForestClassifier", None)
    forests = forest.train(spark.createDataFrame(made, ddl), trees=30)
    asked = [(1, "o1", "R", "i", "winter", 1, 2, True, 1, 1), (2, "new", "nowhere", None, "winter", 1, 20, False, 1, 1)]
    asked_ddl = "request_id bigint, organization_id string, region string, industry string, season string, day_of_week int, hour int, " \
        "has_external_access boolean, privileged_accounts_count int, known_vulnerabilities_count int"  # fmt: skip
    got = {r.request_id: r for r in forest.ml_result(forests, spark.createDataFrame(asked, asked_ddl)).collect()}
    assert {k: (r.ml_method, r.ml_target) for k, r in got.items()} == {1: ("a", "c"), 2: ("b", "d")}
    assert all(0.5 < r.ml_confidence <= 1 and "600" in r.ml_rationale[0] for r in got.values())

"""Training rows dealt to tasks by their number, and the rounds that boosting repeats."""

import random

from incidentlake.ml import boosting, forest, region_risk
from incidentlake.session import dealt


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(4000).coalesce(1)
    parts = [len(p) for p in dealt(rows, 4000, "id", 100).rdd.glom().collect()]
    assert len(parts) == 8 and max(parts) < 700
    assert dealt(rows, 50, "id", 100).rdd.getNumPartitions() == 1


def test_forest_rows_are_dealt(spark, monkeypatch):
    rng = random.Random(1)
    row = lambda i: (i, f"o{i % 3}", "r", "i", "winter", 1, i % 24, "True", 1, 1, rng.choice("ab"), rng.choice("cd"))
    ddl = "incident_id bigint, organization_code string, region string, industry string, season string, day_of_week int, hour int, " \
        "has_external_access string, privileged_accounts_count int, known_vulnerabilities_count int, attack_method string, target_object string"  # fmt: skip
    seen = []
    monkeypatch.setattr(forest, "TASK_ROWS", 20, raising=False)
    monkeypatch.setattr(forest, "materialized", lambda df, made=forest.materialized: seen.append(made(df)) or seen[-1])
    forest.train(spark.createDataFrame([row(i) for i in range(400)], ddl).coalesce(1), trees=2, depth=2)
    known = next(df for df in seen if "attack_method_0_share" in df.columns and "incident_id" in df.columns)
    assert known.rdd.getNumPartitions() == 8


def test_risk_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(region_risk, "TASK_ROWS", 50, raising=False)
    rows = spark.range(400).selectExpr("'r' as region", "cast(id % 24 as int) as hour", "cast(id % 2 as int) as attack_present", "id as position", "array(100L) as fold_starts", "1 as val_fold")
    assert region_risk._Table.of(rows.coalesce(1), False).rows.rdd.getNumPartitions() == 8


def test_few_rounds_are_repeated(spark, monkeypatch):
    asked = []

    class Fitted:
        def evaluateEachIteration(self, held):
            return [1.0 / (i + 1) for i in range(asked[-1])]

    class Asked:
        def __init__(self, maxIter, **rest):
            asked.append(maxIter)

        def fit(self, train):
            return Fitted()

    monkeypatch.setattr(boosting, "GBTClassifier", Asked)
    monkeypatch.setattr(boosting, "truncated", lambda model, rounds: model)
    boosting.fit(None, None, {"iterations": 700, "depth": 2, "learning_rate": 0.1}, 1, 32, 50)
    assert asked[-1] == 700 and sum(asked) <= 1100

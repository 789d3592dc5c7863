"""Joins that sent the large side, searches for many tokens, and numbering by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from incidentlake import schema
from incidentlake.operators import skew, vulnmap
from incidentlake.operators.tokensearch import Tokens
from incidentlake.sources import tables


def sent(plan: str) -> str:
    """The subtrees below the broadcasts of a plan."""
    out, depth = [], None
    for line in plan.split("\n"):
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if depth is not None and at > depth:
            out.append(line)
        else:
            depth = at if "BroadcastExchange" in line else None
    return "\n".join(out)


def rules_frame(spark, tokens):
    rows = [(i, t, f"T{i % 3}", 0.1 * i, f"r{i}", "malware") for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, schema.RULES)


@pytest.mark.parametrize("few", [True, False])
def test_texts_are_never_broadcast_and_both_ways_agree(spark, monkeypatch, few):
    rng = random.Random(5)
    texts = [(f"k{i:03d}", "".join(rng.choice("abc ") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    tokens = [["abc", "ccc a"], ["*", "zzz"], ["A", ""], [], ["bca b"], ["b "], ["never here"], ["cab", None]]
    plans = []

    def noted(df, made=vulnmap.materialized):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made(df)

    monkeypatch.setattr(vulnmap, "materialized", noted)
    if not few:
        monkeypatch.setattr(vulnmap, "fits", lambda df: False, raising=False)
    vulnerabilities = spark.createDataFrame([("x", "n", "", k, "", "low", t) for k, t in texts], schema.VULNERABILITIES)
    matched = vulnmap.map_vulnerabilities(vulnerabilities, rules_frame(spark, tokens), None)
    plans.append(matched._jdf.queryExecution().executedPlan().toString())
    got = {r.vulnerability_code: {(m.threat_id, m.reason) for m in r.matches} for r in matched.collect()}
    assert not [p for p in plans if "_text" in sent(p)]
    for key, text in texts:
        whole = f" {key}  {text}"
        hits = [i for i, ts in enumerate(tokens) if any(t == "*" or t.lower() in whole for t in ts if t is not None)]
        assert got[key] == {(f"T{k}", f"r{max(i for i in hits if i % 3 == k)}") for k in {i % 3 for i in hits}}


def test_token_search_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        letters = "ab é😀\n"[: rng.randint(1, 6)]
        word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))  # noqa: B023, E731
        tokens = sorted({word(7) for _ in range(rng.randint(1, 30))})
        texts = [word(30) for _ in range(rng.randint(1, 12))]
        assert [sorted(x) for x in Tokens(tokens).found(texts)] == [[i for i, t in enumerate(tokens) if t in x] for x in texts]


def test_checkpointed_side_is_measured(spark):
    few = skew.materialized(spark.range(1000).withColumn("s", F.lit("x")))
    many = skew.materialized(spark.range(40_000).withColumn("s", F.lit("x" * 200)))
    assert skew.fits(few) and not skew.fits(many)


def test_json_rules_are_numbered_by_ranges(spark, tmp_path):
    for part in range(30):
        (tmp_path / f"{part:02d}.json").write_text("[" + ",".join(f'{{"tokens": ["t"], "threat_id": "T{part}-{i}"}}' for i in range(20)) + "]")
    rules = tables.rules_table(spark, str(tmp_path))
    assert "file_path" not in rules._jdf.queryExecution().optimizedPlan().toString()  # numbered behind a checkpoint, not in one window
    assert dict(rules.dtypes)["rule_ord"] == "int"
    assert [(r.rule_ord, r.threat_id) for r in rules.orderBy("rule_ord").collect()] == [(20 * p + i, f"T{p}-{i}") for p in range(30) for i in range(20)]

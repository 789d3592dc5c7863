"""The registered corpus queries: same rows as their SQL, and the pipeline against brute force."""

import os

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from check_oracle import compare, connect
from helpers import ascii_lower, components, removed_words, words_of
from incidentlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    status, _, _, note = compare(spark, connect(SF), name, SF, ORACLES[name])
    assert status == "ok", note


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]


def test_pipeline_stage_by_stage(spark):
    """Each filtering stage is held against brute force on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, kept = docs.columns, docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, spark.createDataFrame(before, docs.schema), SF)
        assert frame.columns == columns
        after = frame.collect()
        kept[name] = {r["doc_id"] for r in after}
        if name == "near_dedup":
            roots, _ = components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert kept[name] == set(roots.values())
        if name == "substring_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before]
            gone = removed_words(rows, 20)
            want = {i: [x for k, x in enumerate(words_of(t)) if not gone[n, k]] for n, (i, t) in enumerate(rows)}
            assert {r["doc_id"]: words_of(r["text"]) for r in after} == {i: w for i, w in want.items() if w}
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()

            def plain(text):
                return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in ascii_lower(text)).split()

            wins = {tuple(w[i : i + 10]) for b in bench for w in [plain(b["text"])] for i in range(max(1, len(w) - 9))}
            clean = {r["doc_id"] for r in before if not any(tuple(w[i : i + 10]) in wins for w in [plain(r["text"])] for i in range(len(w) - 9))}
            assert kept[name] == clean
        before = after
    assert len(kept["quality_classifier"]) > 0.6 * docs.count()


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(fill.values()) <= 2048 and os.path.exists(f"{SF}/documents.parquet")

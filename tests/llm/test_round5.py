"""Memory of Python workers: what they get at a time follows bytes, not rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from incidentlake.llm import classifier
from incidentlake.llm.words import BATCH_BYTES, BATCH_SETTING, annotate


@pytest.fixture(scope="module")
def texts(spark):
    return spark.range(0, 8000, 1, 1).select("id", F.repeat(F.lit("some words "), 200).alias("text"))  # 17 MB in one partition


@pytest.fixture
def body():
    return lambda column, *_: [pa.array([column.buffers()[2].size] * len(column), pa.int64())]


def most(spark, out) -> int:
    """Bytes of the largest batch that a worker got."""
    try:
        rows = out.select("row.id", "got").collect()
    finally:
        spark.conf.unset(BATCH_SETTING)
    assert sorted(r.id for r in rows) == list(range(8000))
    return max(r.got for r in rows)


def test_annotated_texts_come_in_small_batches(spark, texts, body):
    assert most(spark, annotate(texts, "text", body, "got bigint", ["id"])) <= BATCH_BYTES + 4096


def test_classified_texts_come_in_small_batches(spark, texts, body):
    assert most(spark, classifier._annotated(texts, body, "got bigint", ["id"])) <= BATCH_BYTES + 4096


def test_a_setting_of_the_session_stays(spark, texts, body):
    spark.conf.set(BATCH_SETTING, str(1 << 20))
    assert most(spark, annotate(texts, "text", body, "got bigint", ["id"])) <= (1 << 20) + 4096

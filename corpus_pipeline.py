"""From raw documents to packed training sequences, in five stages.

Each stage gets the documents that the one before it kept, reads what else it needs from ``sf_dir`` and
returns a frame; ``run`` writes each result to the folder that all executors share and reads it again.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlake.llm import classifier, decontaminate, neardup, packing, substring
from incidentlake.llm.queries import CAPACITY, TOKENIZER, read
from incidentlake.llm.tables import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return classifier.classify(docs, read(spark, sf_dir, "labels"), docs.columns).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 on shingles of five words."""
    return neardup.near_duplicates(docs, docs.columns).filter("first_row").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 20 words that start earlier; a text of which no word is left goes."""
    cut = substring.remove_repeats(docs, [c for c in docs.columns if c not in ("text", "n_chars")])
    left = cut.filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    return left.select("row.*", "text", F.length("text").cast("bigint").alias("n_chars")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.scan(docs, read(spark, sf_dir, "benchmark"), docs.columns).filter("n_hit = 0").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their sequence and offset."""
    placed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), CAPACITY)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, suffix structures and tokenizers can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

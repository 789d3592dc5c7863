"""Chunks of documents that exchange numbers with the parts of an index.

A chunk sends sorted numbers, cut into the ranges of the parts; a part answers every chunk. The chunks
are a bucketed table in the shared folder, so each pass over the texts reads them in place and only
numbers are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from incidentlake.llm.tables import new_path

CHUNKS_A_BUCKET = 4
MOST_BUCKETS = 50_000  # Spark takes 100 000; with more chunks a bucket holds more of them, read one by one


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of sorted numbers, byte by byte, which compresses well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def split(values: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of sorted numbers of ``bits`` bits that go to each part."""
    edges = np.array([((p << bits) + parts - 1) // parts for p in range(1, parts)], np.uint64)
    cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if hi > lo:
            yield part, lo, hi


def blobs(rows: list[tuple[int, int, bytes]], names: tuple[str, str]) -> pa.Table:
    return pa.table({names[0]: pa.array([r[0] for r in rows], pa.int32()), names[1]: pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def chunk_table(dealt: DataFrame, chunks: int) -> DataFrame:
    """The rows as a table bucketed by their column ``chunk``."""
    buckets = min(MOST_BUCKETS, max(4, -(-chunks // CHUNKS_A_BUCKET)))
    spark, name = dealt.sparkSession, f"chunks_{uuid.uuid4().hex}"
    (
        dealt.repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").sortBy("chunk")
        .option("path", new_path(spark, "chunks")).option("compression", "zstd").saveAsTable(name)
    )
    return spark.table(name)

"""Sharding by weighted rendezvous hashing.

Every shard draws -ln(u) / weight for a record key, u a hash of key and shard number in (0, 1); the
smallest draw owns the record. Draws of the other shards don't change when one is added, so a
record moves only into the new shard.

A null key hashes like a key of its own. Null text has no bytes. Records of one key share a shard.
Repeated rows are kept. Extra columns are kept by ``assign`` unless they carry the name of its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake.llm.tables import with_rank


def owner(key: Column, weights: list[float]) -> Column:
    """Number of the shard that owns the key. Weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = []
    for shard, weight in enumerate(weights):
        # 53 bits of the hash, moved by a half so that u is never 0 or 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return F.least(*draws)["shard"] if len(draws) > 1 else F.lit(0)


def assign(df: DataFrame, key: str, weights: list[float], name: str = "shard") -> DataFrame:
    """The rows with the shard that owns their key; no shuffle."""
    return df.withColumn(name, owner(F.col(key), weights).cast("int"))


def write_shards(df: DataFrame, key: str, weights: list[float], path: str, writers: int = 8) -> None:
    """Write each shard below ``path`` as its own folder, a hot shard by several tasks."""
    placed = assign(df, key, weights)
    placed.repartition("shard", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(writers))).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``slot`` numbers the rows of a shard from 0 without gaps; texts stay where they are read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        owner(F.col(key), weights).cast("int").alias("shard"),
        owner(F.col(key), grown).cast("int").alias("grown_shard"),
    )
    return with_rank(placed, ["shard"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

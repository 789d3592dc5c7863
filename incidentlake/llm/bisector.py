"""Centroid clustering by bisector tournaments, in exact integers.

The vectors that are nearer to centroid j than to centroid i lie on one side of the plane halfway between
them: ``2 * (c_j - c_i) . x > |c_j|**2 - |c_i|**2``. These integer normals and thresholds are made once for
every pair of centroids. A vector then plays ``k - 1`` linear sign tests: the winner so far meets the next
centroid, a positive sign makes that one the winner, and zero keeps the smaller number. Only the distance
to the last winner is computed, exactly.

A vector takes part if it has ``dims`` components, none null or non-finite (also after scaling); other rows
are not returned. Components become ``floor(scale * x)``. Products are summed as doubles while every sum
stays below 2**53, as 64-bit integers while below 2**63, and as Python's integers beyond; a distance or an
inertia beyond the largest long is null.

The first centroids are the vectors with the smallest hashes of their ids; a null id hashes as an empty one,
and vectors of one id are ordered by their components. Repeated rows count as often as they occur. With
fewer than ``k`` vectors, there are fewer centroids; an empty table gives an empty result.

Each round is one pass over the table. Tasks send one partial sum for each centroid and component, so
what is shuffled does not depend on the rows, and a centroid that holds most rows is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlake.llm.tables import written
from incidentlake.session import local_table

LONGEST = 2**63 - 1
_LIMB = 32  # sums beyond 64 bits are sent in pieces of so many bits


def usable(vectors: pa.ListArray, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that take part, and their scaled components rounded down, as doubles."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dims)
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * flat.astype(np.float64).reshape(-1, dims)) + 0.0
    fine = np.isfinite(x).all(axis=1)
    return rows[fine], x[fine]


def exact(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers in doubles as ``kind``, without loss."""
    if kind is object:
        return np.array([int(v) for v in x.reshape(-1)], object).reshape(x.shape)
    return x.astype(kind)


def kind_for(limit: float, dims: int) -> type:
    """The fastest numbers in which no sum of a sign test or a distance is rounded."""
    most = 5 * dims * int(limit) ** 2
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


@dataclass
class Tournament:
    """Centroids with the normals and thresholds of all their pairs."""

    centroids: np.ndarray  # (k, dims), as ``kind``
    normals: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]], kind: type) -> Tournament:
        c = np.array(centroids, object)
        square = (c * c).sum(axis=1)
        normals, thresholds = 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None]
        return cls(c.astype(kind), normals.astype(kind), thresholds.astype(kind))

    def winners(self, x: np.ndarray) -> np.ndarray:
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = (x * self.normals[best, j]).sum(axis=1) - self.thresholds[best, j]
            best[side > 0] = j
        return best

    def distances(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        off = x - self.centroids[best]
        return (off * off).sum(axis=1)


def _batches(batches: Iterator[pa.RecordBatch], dims: int, scale: float):
    for batch in batches:
        row, vectors = batch.columns
        rows, x = usable(vectors, dims, scale)
        if len(rows):
            yield row.take(pa.array(rows)), x


def _start(source: DataFrame, k: int, dims: int, scale: float) -> tuple[list[list[int]], float]:
    """The first centroids, and the largest component of any vector."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, tuple[float, ...]]] = []
        limit = 0.0
        for hashes, x in _batches(batches, dims, scale):
            limit = max(limit, float(np.abs(x).max()))
            key = np.array(hashes.to_pylist())
            last = np.sort(key)[min(k, len(key)) - 1]
            if len(best) == k:
                last = min(last, best[-1][0])
            at = np.flatnonzero(key <= last)
            best = sorted(best + [(str(key[i]), tuple(x[i].tolist())) for i in at])[:k]
        if best:
            columns = [pa.array([b[0] for b in best]), pa.array([list(b[1]) for b in best], pa.list_(pa.float64())), pa.array([limit] * len(best))]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "vector", "most"])

    found = written(source.select("hash", "vector").mapInArrow(smallest, "hash string, vector array<double>, most double"), "seeds")
    limit = found.agg(F.max("most")).first()[0]
    first = found.orderBy("hash", "vector").limit(k).select("vector").collect()  # at most k rows
    return [[int(v) for v in r.vector] for r in first], limit


def _averages(source: DataFrame, tournament: Tournament, kind: type, limit: float, scale: float) -> dict[int, list[int]]:
    """Componentwise floors of the averages of every centroid that won a vector."""
    k, dims = tournament.centroids.shape
    # a task's sum is below 2**40 times the largest component
    limbs = 1 if kind is not object else (int(limit).bit_length() + 40) // _LIMB + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k, np.int64)
        sums = np.zeros((k, dims), object if kind is object else np.int64)
        for _, x in _batches(batches, dims, scale):
            x = exact(x, kind)
            best = tournament.winners(x)
            counts += np.bincount(best, minlength=k)
            for c in np.unique(best):
                total = x[best == c].sum(axis=0)
                sums[c] += total if kind is object else total.astype(np.int64)
        some = np.flatnonzero(counts)
        rows = [(c, -1, int(counts[c])) for c in some]
        for c in some:
            for i, total in enumerate(sums[c].tolist()):
                for limb in range(limbs - 1):
                    rows.append((c, i * limbs + limb, (total >> (_LIMB * limb)) & (2**_LIMB - 1)))
                rows.append((c, i * limbs + limbs - 1, total >> (_LIMB * (limbs - 1))))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                ["cluster", "slot", "value"],
            )

    parts = source.select("hash", "vector").mapInArrow(partial, "cluster int, slot int, value bigint")
    totals = parts.groupBy("cluster", "slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    counts = {r.cluster: int(r.value) for r in totals if r.slot < 0}
    sums = {c: [0] * dims for c in counts}
    for r in totals:
        if r.slot >= 0:
            sums[r.cluster][r.slot // limbs] += int(r.value) << (_LIMB * (r.slot % limbs))
    return {c: [s // counts[c] for s in sums[c]] for c in counts}


def cluster(
    vectors: DataFrame, keep: list[str], k: int = 16, dims: int = 64, rounds: int = 3, scale: float = 64.0, seed: int = 1,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, cluster, distance, cluster_inertia, inertia and centroid_sha256 (of its integers)."""
    spark = vectors.sparkSession
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    source = vectors.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.sha2(name, 256).alias("hash"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    centroids, limit = _start(source, k, dims, scale)
    kept = source.schema["row"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"row {kept}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    kind = kind_for(limit, dims)
    for _ in range(rounds):
        for c, average in _averages(source, Tournament.of(centroids, kind), kind, limit, scale).items():
            centroids[c] = average
    last = Tournament.of(centroids, kind)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x in _batches(batches, dims, scale):
            x = exact(x, kind)
            best = last.winners(x)
            far = [int(d) if d <= LONGEST else None for d in last.distances(x, best)] if kind is object else last.distances(x, best).astype(np.int64)
            yield pa.RecordBatch.from_arrays([row, pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["row", "cluster", "distance"])

    won = written(source.select("row", "vector").mapInArrow(assign, f"row {kept}, cluster int, distance bigint"), "assigned")
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r.cluster: r.total for r in won.groupBy("cluster").agg(whole.alias("total")).collect()}  # at most k rows

    def long(total) -> int | None:
        return int(total) if total is not None and total <= LONGEST else None

    over_all = None if None in inertia.values() else long(sum(inertia.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = local_table(
        spark, [(c, long(inertia[c]), over_all, digest[c]) for c in sorted(inertia)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return won.join(F.broadcast(told), "cluster").select("row", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

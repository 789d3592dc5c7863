"""Exploratory feature matrix and clustering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from incidentlake import fixed_values as V
from incidentlake.operators.medians import medians, overall_medians
from incidentlake.session import concurrently, materialized

PROFILE_NUMERIC = (
    "host_count", "threat_code", "success", "confidentiality_breach", "integrity_breach", "availability_breach",
)
PROFILE_CATEGORIES = ("industry", "region", "threat_name", "impact_object")
MATRIX = (
    "host_count", "threat_code", "success", "region_share", "year", "month", "day", "weekday",
    "confidentiality_breach", "integrity_breach", "availability_breach",
)


def active(incidents: DataFrame, registry: DataFrame) -> DataFrame:
    """Incidents with their registry row, without archived threats; unknown and null status stay."""
    dim = registry.select(
        "threat_code", "object_of_impact", "source_characteristics", "confidentiality_breach", "integrity_breach",
        "availability_breach", "status",
    )
    return incidents.join(dim, "threat_code", "left").where(~F.col("status").eqNullSafe(V.ARCHIVED_STATUS))


def enterprise_first(df: DataFrame, columns=("host_count", "region", "industry")) -> DataFrame:
    """Replace columns by the organization's first non-null value in id order.

    An aggregate and a join instead of a window, so a hot organization folds before the shuffle
    and its rows may be split on the join.
    """
    firsts = df.groupBy("organization_code").agg(
        *[
            F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("incident_id"))).alias(f"_{c}")
            for c in columns
        ]
    )
    same = df["organization_code"].eqNullSafe(firsts["organization_code"])  # rows without an organization are a group too
    return df.join(firsts, same).drop(firsts["organization_code"]).drop(*columns).withColumnsRenamed({f"_{c}": c for c in columns})


def matrix(incidents: DataFrame, registry: DataFrame) -> DataFrame:
    """Tabular part of the exploratory matrix; label lists stay arrays. Rows with a null are dropped."""
    day = F.col("incident_date")
    rows = (
        enterprise_first(active(incidents, registry))
        .select(
            "incident_id", "host_count", "threat_code", "success", "region", "industry",
            F.year(day).alias("year"), F.month(day).alias("month"), F.day(day).alias("day"), F.weekday(day).alias("weekday"),
            "confidentiality_breach", "integrity_breach", "availability_breach",
            F.split("object_of_impact", ", ").alias("impact_objects"),
            F.split("source_characteristics", "; ").alias("threat_sources"),
        )
        .dropna("any")
    )
    counts = rows.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    share = counts.select("region", (F.col("_n") / counts.agg(F.sum("_n")).scalar()).alias("region_share"))
    return rows.join(share, "region")


def multi_hot(rows: DataFrame) -> DataFrame:
    """Sparse one / multi-hot form: (incident_id, label), labels prefixed by their list."""
    labels = F.concat(
        F.transform("impact_objects", lambda x: F.concat(F.lit("object:"), x)),
        F.transform("threat_sources", lambda x: F.concat(F.lit("source:"), x)),
        F.array(F.concat(F.lit("industry:"), "industry")),
    )
    return rows.select("incident_id", F.explode(F.array_distinct(labels)).alias("label"))


def scaled_columns(df: DataFrame, columns=PROFILE_NUMERIC) -> dict:
    """Median-imputed columns scaled by mean and population deviation, as expressions.

    The fitted values are one row of numbers, fetched like those of any fitted scaler.
    """
    middle = overall_medians(df, columns)

    def filled(c: str):
        return F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double"))

    fitted = df.agg(
        *[F.avg(filled(c)).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(filled(c)).alias(f"{c}_std") for c in columns],
    ).first()
    return {c: (filled(c) - F.lit(fitted[f"{c}_mean"])) / F.lit(fitted[f"{c}_std"] or 1.0) for c in columns}


def standardized(df: DataFrame, columns=PROFILE_NUMERIC) -> DataFrame:
    return df.withColumns(scaled_columns(df, columns))


def vectors(rows: DataFrame) -> DataFrame:
    """(incident_id, features): scaled tabular columns with the multi-hot and one-hot parts."""
    df = standardized(materialized(rows), MATRIX)
    for name in ("impact_objects", "threat_sources"):
        df = CountVectorizer(inputCol=name, outputCol=f"{name}_hot", binary=True, vocabSize=(1 << 31) - 1).fit(df).transform(df)
    df = StringIndexer(inputCol="industry", outputCol="industry_index").fit(df).transform(df)
    df = OneHotEncoder(inputCol="industry_index", outputCol="industry_hot", dropLast=False).fit(df).transform(df)
    parts = [*MATRIX, "impact_objects_hot", "threat_sources_hot", "industry_hot"]
    return materialized(VectorAssembler(inputCols=parts, outputCol="features").transform(df).select("incident_id", "features"))


def assembled(df: DataFrame, columns=PROFILE_NUMERIC) -> DataFrame:
    """The table with scaled ``features``, materialized for the passes of a clustering."""
    parts = {f"_{c}": value for c, value in scaled_columns(df, columns).items()}
    points = VectorAssembler(inputCols=list(parts), outputCol="features").transform(df.withColumns(parts))
    return materialized(points.drop(*parts))


def _silhouette(predicted: DataFrame, measure: str = "squaredEuclidean") -> float:
    if predicted.select("prediction").distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(distanceMeasure=measure).evaluate(predicted)


def kmeans_sweep(points: DataFrame, ks=range(2, 11)) -> list[tuple[int, float, float]]:
    """(k, silhouette, inertia) per number of clusters, fitted side by side on one table."""

    def one(k: int) -> tuple[int, float, float]:
        model = KMeans(k=k, seed=V.SEED).fit(points)
        return k, _silhouette(model.transform(points)), float(model.summary.trainingCost)

    return concurrently(points.sparkSession, [partial(one, k) for k in ks])


def kmeans(points: DataFrame, k: int) -> DataFrame:
    return KMeans(k=k, seed=V.SEED).fit(points).transform(points).withColumnRenamed("prediction", "cluster")


def hierarchy(points: DataFrame, most: int = 10, measure: str = "cosine") -> DataFrame:
    """``points`` with ``labels``: the cluster numbers at 2, 3 .. ``most`` clusters, from one top-down tree.

    The largest cluster is split in two, again and again: the half with the smaller number of rows (ties: the second)
    gets the next free number. So the clusterings are nested, and each split reads the rows of one cluster only. Ends early
    when the largest cluster can't be split any more.
    """
    tree = materialized(points.withColumns({"_label": F.lit(0), "labels": F.array().cast("array<int>")}))
    sizes = {0: tree.count()}
    for k in range(2, most + 1):
        chosen = max(sizes, key=lambda c: (sizes[c], -c))
        part = tree.where(F.col("_label") == chosen)
        halves = KMeans(k=2, seed=V.SEED, distanceMeasure=measure, predictionCol="_half").fit(part)
        split = halves.transform(tree)
        counts = {r[0]: r[1] for r in split.where(F.col("_label") == chosen).groupBy("_half").count().collect()}
        if len(counts) < 2:
            break
        smaller = 0 if counts[0] < counts[1] else 1
        moved = (F.col("_label") == chosen) & (F.col("_half") == smaller)
        label = F.when(moved, F.lit(k - 1)).otherwise(F.col("_label"))
        tree = materialized(
            split.withColumn("_label", label).withColumn("labels", F.concat("labels", F.array("_label"))).drop("_half")
        )
        sizes[chosen], sizes[k - 1] = counts[1 - smaller], counts[smaller]
    return tree.drop("_label")


def hierarchical_sweep(tree: DataFrame, measure: str = "cosine", most: int = 10) -> list[tuple[int, float]]:
    """(k, silhouette) of every cut of a hierarchy."""

    def one(k: int) -> tuple[int, float]:
        cut = tree.withColumn("prediction", F.get("labels", F.lit(k - 2))).where("prediction is not null")
        return k, _silhouette(cut, measure)

    return concurrently(tree.sparkSession, [partial(one, k) for k in range(2, most + 1)])


@dataclass
class Projection:
    """Components (one column of loadings each), the explained shares, and the mean that is taken off first."""

    loadings: np.ndarray
    explained: list[float]
    mean: np.ndarray

    def points(self, points: DataFrame) -> DataFrame:
        """``points`` with ``components``, the coordinates in the projection."""
        loadings, mean = self.loadings, self.mean

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _dense(batch.column("_x"), len(mean)) - mean
                made = pa.array(list(x @ loadings), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], "components"])

        kept = points.withColumn("_x", vector_to_array("features")).drop("features")
        schema = StructType([*kept.drop("_x").schema.fields, StructField("components", ArrayType(DoubleType()))])
        return kept.mapInArrow(project, schema)


def _dense(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def pca(points: DataFrame, k: int, rounds: int = 8, extra: int = 10) -> Projection:
    """The first ``k`` principal components, by subspace iteration over the rows.

    A pass sends ``k + extra`` directions to the tasks; each adds up its rows' part of covariance times
    directions, and the parts are summed by Spark. So the driver holds features x directions, never features x
    features, and the rows stay where they are. Components point to where their largest loading is positive.
    """
    rows = points.select(vector_to_array("features").alias("x"))
    dims = len(rows.first().x)
    width = min(dims, k + extra)

    def summed(directions: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(sums of squares, covariance sums times directions, rows) around a mean."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((dims, directions.shape[1] + 2)), 0
            for batch in batches:
                x = _dense(batch.column(0), dims) - mean
                total[:, :-2] += x.T @ (x @ directions)
                total[:, -2] += (x * x).sum(axis=0)
                total[:, -1] += x.sum(axis=0)
                n += len(x)
            if n:
                columns = [pa.array(np.arange(dims + 1), pa.int32()), pa.array([*total, np.full(total.shape[1], float(n))], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "sums"])

        parts = rows.mapInArrow(part, "feature int, sums array<double>")
        sums = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(directions.shape[1] + 2)])
        got = np.array([r.sums for r in parts.groupBy("feature").agg(sums.alias("sums")).orderBy("feature").collect()])
        return got[:-1, -1], got[:-1, :-1], int(got[-1, 0])

    zero = np.zeros(dims)
    total, _, n = summed(np.zeros((dims, 1)), zero)
    mean = total / n
    basis = np.linalg.qr(np.random.default_rng(V.SEED).normal(size=(dims, width)))[0]
    for _ in range(rounds):
        _, got, _ = summed(basis, mean)
        # the image of the directions in the subspace they span, then the subspace one step on
        small = basis.T @ got[:, :-1]
        values, turn = np.linalg.eigh((small + small.T) / 2)
        variance, vectors, image = float(got[:, -1].sum()), basis @ turn[:, ::-1], got[:, :-1]
        basis = np.linalg.qr(image)[0]
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(min(k, width))])
    return Projection(vectors, [float(v / variance) if variance else 0.0 for v in values[::-1][:k]], mean)


def cluster_profile(df: DataFrame, n_top: int = 3) -> DataFrame:
    """Long profile of a table with ``cluster``: (cluster, section, feature, item, value).

    Sections: size (rows, percent, success_rate), danger, numeric (mean, median, std) and
    top (most frequent values, ties by name).
    """
    total = df.agg(F.count(F.lit(1))).scalar()

    def cell(section, feature, item, value):
        return F.struct(
            F.lit(section).alias("section"), F.lit(feature).alias("feature"), F.lit(item).alias("item"),
            value.cast("double").alias("value"),
        )

    stats = {"mean": F.avg, "std": F.stddev_samp}
    agg = df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("success").alias("success_rate"),
        *[f(c).alias(f"{name}_{c}") for c in PROFILE_NUMERIC for name, f in stats.items()],
    )
    danger = F.lit(0)
    for points, (bound, _) in zip((2, 1), V.DANGER_BANDS):
        danger = F.greatest(danger, F.when(F.col("success_rate") > bound, points).otherwise(0))
    cells = [
        cell("size", "rows", "rows", F.col("rows")),
        cell("size", "rows", "percent", 100 * F.col("rows") / total),
        cell("size", "success", "success_rate", F.col("success_rate")),
        cell("danger", "success", "level", danger),
        *[cell("numeric", c, name, F.col(f"{name}_{c}")) for c in PROFILE_NUMERIC for name in stats],
    ]
    numeric = agg.select("cluster", F.inline(F.array(*cells)))
    middle = medians(df, PROFILE_NUMERIC, ("cluster",)).select(
        "cluster", F.lit("numeric").alias("section"), "feature", F.lit("median").alias("item"), F.col("median").alias("value")
    )
    every = agg.select("cluster", F.explode(F.array(*[F.lit(c) for c in PROFILE_NUMERIC])).alias("feature"))
    middle = every.join(middle, ["cluster", "feature"], "left").select(
        "cluster", F.lit("numeric").alias("section"), "feature", F.lit("median").alias("item"), "value"
    )
    counts = (
        df.select("cluster", *PROFILE_CATEGORIES)
        .unpivot(["cluster"], list(PROFILE_CATEGORIES), "feature", "item")
        .where("item is not null")
        .groupBy("cluster", "feature", "item")
        .agg(F.count(F.lit(1)).alias("value"))
    )
    rank = F.row_number().over(Window.partitionBy("cluster", "feature").orderBy(F.desc("value"), "item"))
    top = counts.withColumn("_rank", rank).where(F.col("_rank") <= n_top).select(
        "cluster", F.lit("top").alias("section"), "feature", "item", F.col("value").cast("double").alias("value")
    )
    return numeric.unionByName(middle).unionByName(top)

"""Clusters of phrase vectors and their statistics."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from phraselens.config import ELBOW_ITERATIONS, ELBOW_K, KMEANS_ITERATIONS, KMEANS_K, SEED
from phraselens.functions import ratio as fr
from phraselens.functions.vectors import array_to_vector, vector_to_array
from phraselens.operators.sampling import fixed_sample
from phraselens.operators.similarity import top_k_neighbours

MODEL_BYTES = 32 << 20
SAMPLES_SHOWN = 3


def with_features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def with_unit_features(vectors: DataFrame) -> DataFrame:
    """Unit vectors for clustering; a zero vector stays zero."""
    return (Normalizer(p=2.0, inputCol="_raw", outputCol="features")
            .transform(with_features(vectors).withColumnRenamed("features", "_raw")).drop("_raw"))


def distinct_points(vectors: DataFrame) -> int:
    """How many different vectors there are."""
    return vectors.select(F.xxhash64("embedding").alias("key")).distinct().count()


def fit_kmeans(vectors: DataFrame, k: int = KMEANS_K, iterations: int = KMEANS_ITERATIONS, seed: int = SEED) -> KMeansModel:
    """k-means on the unit vectors of all rows, kept in memory (or on disk) while it scans them repeatedly.

    There are never more clusters than different vectors.
    """
    k = max(2, min(k, distinct_points(vectors)))
    points = with_unit_features(vectors).select("features").persist()
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    points.unpersist()
    return model


def elbow_curve(vectors: DataFrame, id_col: str, ks: Iterable[int] = ELBOW_K, iterations: int = ELBOW_ITERATIONS,
                seed: int = SEED, parallelism: int = 4, fraction: float | None = None, cap: int | None = None) -> DataFrame:
    """Objective per k on all rows or, if a fraction is given, on one fixed sample of them (at most `cap` rows).

    The rows are kept in memory or on disk for all the fits. Ends where k exceeds the number of different vectors.
    """
    spark = vectors.sparkSession
    rows = vectors if fraction is None else fixed_sample(vectors, id_col, fraction, cap, seed)
    sample = with_unit_features(rows).select("embedding", "features").persist()
    ks = list(ks)
    most = distinct_points(sample)

    def cost(k: int) -> tuple[int, float]:
        model = KMeans(k=k, maxIter=iterations, seed=seed).fit(sample.select("features"))
        return k, float(model.summary.trainingCost)

    # The fits are independent small jobs; submitted one after the other they would mostly wait.
    with ThreadPoolExecutor(parallelism) as pool:
        points = list(pool.map(inheritable_thread_target(spark)(cost), [k for k in ks if k <= most]))
    sample.unpersist()
    return spark.createDataFrame(points, "k int, inertia double")


def centroid_table(spark: SparkSession, model: KMeansModel) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>")


def assign_with_model(vectors: DataFrame, model: KMeansModel) -> DataFrame:
    return model.transform(with_unit_features(vectors)).drop("features")


def assign_centroids(vectors: DataFrame, centroids: DataFrame, id_col: str = "phrase_id", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Nearest centroid by Euclidean distance, the lower cluster number on a tie.

    A table of centroids up to model_bytes goes to every task. A larger one is searched like any index: the nearest
    centroid c of x is that with the largest x.c - c.c/2, an inner product after one more entry.
    """
    facts = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("dim")).first()
    if facts["n"] * (facts["dim"] or 0) * 8 > model_bytes:
        half = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x) / -2
        index = centroids.select(F.col("cluster").alias("phrase_id"), F.concat("centroid", F.array(half)).alias("embedding"))
        asked = vectors.select(F.col(id_col).alias("q_id"), F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0))).alias("embedding"))
        found = top_k_neighbours(asked, index, 1, local_bytes=model_bytes)
        return vectors.join(found.select(F.col("q_id").alias(id_col), F.col("phrase_id").alias("cluster")), id_col, "left").select(*vectors.columns, "cluster")
    rows = sorted(centroids.collect(), key=lambda r: r["cluster"])
    numbers = np.array([r["cluster"] for r in rows], dtype=np.int32)
    matrix = np.array([r["centroid"] for r in rows], dtype=np.float64)
    half_sq = (matrix ** 2).sum(axis=1) / 2

    @F.pandas_udf("int")
    def nearest(batch: pd.Series) -> pd.Series:
        points = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, matrix.shape[1]))
        closeness = np.floor((points @ matrix.T - half_sq) * 1e9 + 0.5)   # equal up to rounding noise is a tie
        return pd.Series(numbers[np.argmax(closeness, axis=1)])

    return vectors.withColumn("cluster", nearest("embedding"))


def centroid_means(assigned: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Mean vector per cluster (one Lloyd update); an empty cluster keeps its previous centroid."""
    means = (with_features(assigned.where(F.col("cluster").isNotNull()))
             .groupBy("cluster").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("centroid")))
    if previous is None:
        return means
    old = previous.select("cluster", F.col("centroid").alias("old"))
    return old.join(means, "cluster", "left").select("cluster", F.coalesce("centroid", "old").alias("centroid"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def attach_clusters(phrases: DataFrame, assigned: DataFrame, key: str = "phrase_id") -> DataFrame:
    """Phrases keep their row when no cluster is known."""
    return phrases.join(assigned.select(key, "cluster"), key, "left")


def cluster_samples(phrases: DataFrame, shown: int = SAMPLES_SHOWN, kept: int = 5) -> DataFrame:
    """The most frequent phrases of each cluster as one text.

    The rank limit is applied before the exchange, so a huge cluster sends `kept` rows per task.
    """
    order = W.partitionBy("cluster").orderBy(F.desc("total_frequency"), "phrase")
    top = (phrases.where(F.col("cluster").isNotNull()).select("cluster", "phrase", "total_frequency")
           .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept))
    ranked = F.sort_array(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", "phrase"))))
    return top.groupBy("cluster").agg(
        F.array_join(F.transform(ranked, lambda r: r["phrase"]), ", ").alias("sample_phrases"))


def cluster_statistics(phrases: DataFrame) -> DataFrame:
    """Size, frequency and label statistics per cluster; phrases without a cluster are left out.

    The stored ratio is rounded to 0.1 % because decisions are defined on the rounded value
    (`ratio_milli` holds it as a whole number); the band uses the unrounded one. Without label
    columns the ratio is null and the band 'N/A'.
    """
    labelled = {"hate_count", "non_hate_count"} <= set(phrases.columns)
    measures = [F.count(F.lit(1)).alias("size"), F.sum("total_frequency").alias("total_phrase_frequency"),
                F.avg("total_frequency").alias("avg_phrase_frequency")]
    if labelled:
        measures += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hate_count", "non_hate_count")]
    stats = phrases.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(*measures)
    if labelled:
        total = F.col("hate_count") + F.col("non_hate_count")
        milli = fr.ratio_milli(F.col("hate_count"), total)
        stats = stats.select(
            "*", milli.alias("ratio_milli"), (milli / 1000).alias("cluster_hate_ratio"),
            fr.cluster_band(fr.ratio(F.col("hate_count"), total)).alias("hate_indicator"))
    else:
        stats = stats.select(
            "*", *[F.lit(None).cast("long").alias(c) for c in ("hate_count", "non_hate_count", "ratio_milli")],
            F.lit(None).cast("double").alias("cluster_hate_ratio"), F.lit("N/A").alias("hate_indicator"))
    return stats.join(cluster_samples(phrases), "cluster", "left")


def read_ratio(stats: DataFrame) -> DataFrame:
    """cluster, ratio_milli from any accepted form of the statistics: the ratio column may carry
    its old name, and may hold a number or a percent text."""
    if "ratio_milli" in stats.columns:
        return stats.select("cluster", "ratio_milli")
    name = "cluster_hate_ratio" if "cluster_hate_ratio" in stats.columns else "hate_ratio"
    column = F.col(name)
    value = fr.parse_percent(column) if stats.schema[name].dataType.typeName() == "string" else column
    return stats.select("cluster", F.floor(value * 1000 + 0.5).cast("long").alias("ratio_milli"))


def last_cluster_per_phrase(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """For a phrase listed several times the last row wins."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))

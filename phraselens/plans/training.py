"""From a labelled corpus to the searchable phrase index."""

from __future__ import annotations

from dataclasses import dataclass
import hashlib

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, functions as F

from phraselens.config import EXTRACT, Settings
from phraselens.functions.words import BOOST_WORDS, custom_stop_words
from phraselens.operators import checks, classify, cluster, phrases
from phraselens.operators.embed import HashedEmbedder, phrase_id
from phraselens.sources.snapshots import read_snapshot, stage, write_snapshot


def phrase_table(corpus: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Frequent phrases with counts, ratio, band and id. Rare ones go before anything is embedded."""
    return (phrases.phrase_report(phrases.phrase_counts(corpus), settings.min_frequency)
            .withColumn("phrase_id", phrase_id(F.col("phrase"))))


@dataclass
class Trained:
    phrases: DataFrame
    vectors: DataFrame
    model: KMeansModel
    statistics: DataFrame
    index: DataFrame


def run_digest(corpus: DataFrame, settings: Settings, embedder) -> str:
    """One digest of everything the stages depend on; the corpus enters as its row count and an order-free hash sum."""
    rows, total = corpus.agg(F.count(F.lit(1)), F.sum(F.xxhash64("text", "label").cast("decimal(38,0)"))).first()
    parts = (settings.digest(), embedder.fingerprint(), EXTRACT, custom_stop_words(), BOOST_WORDS, rows, str(total))
    return hashlib.md5(repr(parts).encode()).hexdigest()


def train(corpus: DataFrame, root: str, settings: Settings = Settings(), embedder=None) -> Trained:
    """Phrases -> vectors -> clusters -> statistics -> index, each stage kept as a snapshot under `root`.

    A second run under the same root reuses what is complete, but only for the same settings, embedder, extraction,
    words and corpus: all of them are in the digest of the snapshots.
    """
    spark, embedder = corpus.sparkSession, embedder or HashedEmbedder(settings.dim)
    digest = run_digest(corpus, settings, embedder)
    table = stage(spark, root, "phrases", digest, lambda: phrase_table(corpus, settings))
    vectors = stage(spark, root, "vectors", digest,
                    lambda: embedder.embed(table.select("phrase_id", "phrase"), "phrase").drop("phrase"))
    checks.require_consistent(table, vectors)

    model_path = f"{root}/model-{digest}"
    assigned = read_snapshot(spark, root, "assigned", digest)
    if assigned is None:
        model = cluster.fit_kmeans(vectors, settings.k, settings.iterations, settings.seed)
        model.write().overwrite().save(model_path)
        write_snapshot(cluster.centroid_table(spark, model), root, "centroids", digest)
        assigned = write_snapshot(cluster.assign_with_model(vectors, model).select("phrase_id", "cluster"),
                                  root, "assigned", digest)
    else:
        model = KMeansModel.load(model_path)
    clustered = stage(spark, root, "clustered", digest, lambda: cluster.attach_clusters(table, assigned))
    stats = stage(spark, root, "statistics", digest, lambda: cluster.cluster_statistics(clustered))
    index = stage(spark, root, "index", digest, lambda: classify.phrase_index(
        clustered.select("phrase_id", "phrase", "cluster").join(vectors, "phrase_id"), cluster.read_ratio(stats)))
    return Trained(table, vectors, model, stats, index)

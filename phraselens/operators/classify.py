"""Verdicts on phrases and texts from the clusters of their nearest phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phraselens.config import PHRASE_NEIGHBOURS, TEXT_NEIGHBOURS
from phraselens.functions import ratio as fr
from phraselens.operators.skew import broadcast_if_small

UNABLE = "Unable to classify"
NO_PHRASES = "No phrases could be extracted for analysis."
UNMAPPED_THRESHOLD = 0.50


def phrase_index(phrases: DataFrame, ratios: DataFrame) -> DataFrame:
    """The searched table: phrase_id, embedding, ... with cluster (-1 when unknown) and ratio_milli.

    Looking the ratio up here, once per indexed phrase, spares the lookup for every neighbour.
    """
    known = phrases.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    usable = ratios.where(F.col("cluster") >= 0).select("cluster", "ratio_milli")
    return known.join(broadcast_if_small(usable), "cluster", "left")


def neighbour_ratios(neighbours: DataFrame) -> DataFrame:
    """Per query: sum and number of the neighbours' known ratios, their mean, top similarity and the
    nearest neighbour's cluster."""
    facts = neighbours.groupBy("q_id").agg(
        F.coalesce(F.sum("ratio_milli"), F.lit(0)).alias("milli_sum"), F.count("ratio_milli").alias("mapped"),
        F.max("similarity").alias("top_similarity"), F.min_by("cluster", "rank").alias("nearest_cluster"))
    mean = F.when(F.col("mapped") > 0, F.col("milli_sum") / (F.col("mapped") * 1000.0))
    return facts.withColumn("mean_ratio", mean)


def phrase_verdicts(facts: DataFrame, neighbours: int = PHRASE_NEIGHBOURS) -> DataFrame:
    """cluster_id is null ('Unknown') and hate_ratio 'N/A' when no neighbour has a ratio."""
    mapped = F.col("mapped") > 0
    return facts.select(
        "q_id", F.when(mapped, F.col("nearest_cluster")).alias("cluster_id"), "mean_ratio",
        F.when(mapped, fr.three_decimals(fr.mean_milli(F.col("milli_sum"), F.col("mapped"))))
        .otherwise("N/A").alias("hate_ratio"),
        F.when(mapped, fr.phrase_verdict(F.col("mean_ratio"))).otherwise(UNABLE).alias("classification"),
        F.col("top_similarity").alias("confidence"),
        fr.low_confidence(F.col("top_similarity")).alias("low_confidence"),
        F.when(mapped, f"KNN-based ({neighbours} neighbors)").otherwise("N/A").alias("classification_method"))


def text_verdicts(facts: DataFrame, neighbours: int = TEXT_NEIGHBOURS) -> DataFrame:
    """Without a mapped neighbour ratio and confidence are 0 and the verdict stays open."""
    mapped = F.col("mapped") > 0
    threshold = F.when(mapped, fr.adaptive_threshold(F.col("top_similarity"))).otherwise(UNMAPPED_THRESHOLD)
    mean = F.coalesce("mean_ratio", F.lit(0.0))
    shown = F.when(mapped, fr.mean_milli(F.col("milli_sum"), F.col("mapped"))).otherwise(F.lit(0))
    return facts.select(
        "q_id",
        F.when(mapped, fr.text_verdict(mean, threshold)).otherwise(UNABLE).alias("overall_classification"),
        F.when(mapped, F.col("top_similarity")).otherwise(0.0).alias("similarity_confidence"),
        mean.alias("avg_hate_ratio"), threshold.alias("threshold"),
        fr.summary_text(neighbours, shown).alias("summary"))


def phrase_explanations(phrases: DataFrame, verdicts: DataFrame, key: str = "text_key") -> DataFrame:
    """Verdicts of a text's phrases as one array in rank order (at most top_k per text)."""
    fields = ["rank", "phrase", "score", "cluster_id", "hate_ratio", "classification", "confidence",
              "low_confidence", "classification_method"]
    return phrases.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("phrases"))

"""Consistency between phrases and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


SKETCH_BITS = 14            # a relative error of about 0.8 %


def _sides(phrases: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    left = phrases.select(key, F.lit(True).alias("in_phrases"))
    right = vectors.select(key, F.lit(True).alias("in_vectors"))
    return left.join(right, key, "full_outer")


def consistency_counts(phrases: DataFrame, vectors: DataFrame, key: str = "phrase_id") -> DataFrame:
    """Rows on both sides, without vector, and without phrase."""
    in_phrases, in_vectors = F.col("in_phrases").isNotNull(), F.col("in_vectors").isNotNull()
    return _sides(phrases, vectors, key).agg(
        F.count_if(in_phrases & in_vectors).alias("matched"),
        F.count_if(in_phrases & ~in_vectors).alias("without_vector"),
        F.count_if(~in_phrases & in_vectors).alias("without_phrase"))


def require_consistent(phrases: DataFrame, vectors: DataFrame, key: str = "phrase_id") -> None:
    found = consistency_counts(phrases, vectors, key).first()
    if found["without_vector"] or found["without_phrase"]:
        raise ValueError(f"phrases and vectors do not match: {found.asDict()}")


def corpus_summary(phrases: DataFrame) -> DataFrame:
    """Rows, different phrases, clusters and mean cluster size."""
    return phrases.agg(
        F.count(F.lit(1)).alias("phrase_rows"), F.count_distinct("phrase").alias("distinct_phrases"),
        F.count_distinct("cluster").alias("clusters"),
        (F.count("cluster") / F.count_distinct("cluster")).alias("mean_cluster_size"))


def distinct_sketch(rows: DataFrame, column: str, group: str | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """A sketch of the different values of a column, per group if one is given: some kilobytes whatever the number of rows.

    Sketches can be kept with each snapshot or batch and united later, without the rows.
    """
    return rows.groupBy(*([group] if group else [])).agg(F.hll_sketch_agg(column, F.lit(bits)).alias("sketch"))


def united_estimate(sketches: DataFrame) -> DataFrame:
    """How many different values all sketches together have seen, within some 1.04 / sqrt(2 ** bits) of the truth as a rule."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))

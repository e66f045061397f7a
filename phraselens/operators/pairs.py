"""Sentence pairs for training and judging a text encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phraselens.config import SEED
from phraselens.functions.vectors import cosine
from phraselens.operators.order import counted_before, first_by_hash, numbered, order_hash
from phraselens.operators.skew import broadcast_if_small, join_unique
from phraselens.session import written


def _binary(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("text").isNotNull() & F.col("label").isin(0, 1))


def _counts(corpus: DataFrame) -> tuple[int, int]:
    """Positive and negative rows."""
    found = {r["label"]: r["count"] for r in corpus.groupBy("label").count().collect()}
    return found.get(1, 0), found.get(0, 0)


def _ids(corpus: DataFrame, id_col: str) -> DataFrame:
    """Labels and ids, written once: the passes that choose pairs read neither texts nor what the corpus was made from."""
    return written(corpus.select("label", F.col(id_col).alias("id")), "pair-ids")


def _pairs(corpus: DataFrame, ids: DataFrame, cap: int | None, n_neg: int, seed: int, id_col: str) -> DataFrame:
    """Pairs by ids first; the texts are looked up for the ids that were chosen, last."""
    if cap is not None:
        takes = corpus.sparkSession.createDataFrame([(0, cap + 1), (1, cap + 1)], "g int, take long")
        sizes = ids.groupBy(F.col("label").cast("int").alias("g")).count()
        takes = takes.join(sizes, "g").select("g", F.least("take", "count").alias("take"))
        ids = first_by_hash(ids.withColumn("label", F.col("label").cast("int")), "id", seed, takes, "label").where("first")
    listed = written(numbered(ids.select(F.col("label").alias("g"), order_hash("id", seed).alias("h"), "id")), "pair-rows")
    first = listed if cap is None else listed.where(F.col("i") < cap)
    after = listed.select("g", F.col("id").alias("id_b"), (F.col("i") - 1).alias("i"))
    same = first.join(after, ["g", "i"]).select(
        F.col("id").alias("id_a"), "id_b", F.lit(1.0).alias("score"), F.when(F.col("g") == 1, "same_positive").otherwise("same_negative").alias("kind"))
    pairs = same
    if n_neg:
        positives = first.where(F.col("g") == 1).select(F.col("id").alias("id_a"), (F.col("i") % n_neg).alias("i"))
        negatives = listed.where(F.col("g") == 0).select(F.col("id").alias("id_b"), "i")
        # A negative is used n_pos / n_neg times: often only if there are few of them.
        cross = positives.join(broadcast_if_small(negatives), "i")
        pairs = same.unionByName(cross.select("id_a", "id_b", F.lit(0.0).alias("score"), F.lit("cross").alias("kind")))
    texts = corpus.select(F.col(id_col).alias("id_a"), F.col("text").alias("text_a"))
    left = written(written(pairs, "pairs").join(texts, "id_a"), "pairs-left")
    both = join_unique(left, texts.withColumnsRenamed({"id_a": "id_b", "text_a": "text_b"}), "id_b", "inner")
    return both.select("text_a", "text_b", "score", "kind")


def training_pairs(corpus: DataFrame, cap: int | None = None, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """Neighbours within a class (score 1) and across classes (score 0), as many per kind as the
    smaller class allows, at most `cap` if it is given."""
    corpus = _binary(corpus)
    ids = _ids(corpus, id_col)
    n_pos, n_neg = _counts(ids)
    return _pairs(corpus, ids, min(n_pos, n_neg, *([] if cap is None else [cap])), n_neg, seed, id_col)


def validation_pairs(corpus: DataFrame, cap: int | None = None, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """All such pairs, at most `cap` per kind if it is given."""
    corpus = _binary(corpus)
    ids = _ids(corpus, id_col)
    return _pairs(corpus, ids, cap, _counts(ids)[1], seed, id_col)


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("kind", "score").agg(F.count(F.lit(1)).alias("pairs"))


def pair_correlation(pairs: DataFrame) -> DataFrame:
    """How well the cosine of vec_a and vec_b follows the pair score: Pearson and Spearman.

    Equal values share the mean of their ranks. Pairs are first counted per (score, cosine); ranks come from those
    counts, so no window spans all pairs and a score that most pairs have is no hot key.
    """
    # Cosines that differ by rounding alone are the same value.
    scored = pairs.select(F.col("score").cast("double").alias("score"), (F.floor(cosine(F.col("vec_a"), F.col("vec_b")) * 1e9 + 0.5) / 1e9).alias("cosine"))
    joint = written(scored.groupBy("score", "cosine").agg(F.count(F.lit(1)).alias("n")), "joint-counts")
    total = joint.agg(F.sum("n")).first()[0] or 0

    def centred_ranks(column: str) -> DataFrame:
        values = joint.groupBy(column).agg(F.sum("n").alias("of_value"))
        return counted_before(values, column, "of_value").select(
            column, (F.col("before") + (F.col("of_value") + 1) / 2 - (total + 1) / 2).alias(f"rank_{column}"))
    ranked = joint
    for column in ("score", "cosine"):
        ranked = ranked.join(broadcast_if_small(centred_ranks(column)), column)

    def correlation(x, y, mean_x, mean_y):
        def moment(a, b):
            return F.sum(F.col("n") * a * b)
        dx, dy = F.col(x) - mean_x, F.col(y) - mean_y
        spread = F.sqrt(moment(dx, dx)) * F.sqrt(moment(dy, dy))
        return F.when(spread > 0, moment(dx, dy) / spread)
    means = joint.agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in ("score", "cosine")]).first()
    zero = F.lit(0.0)
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), correlation("score", "cosine", F.lit(means["score"]), F.lit(means["cosine"])).alias("pearson"),
        correlation("rank_score", "rank_cosine", zero, zero).alias("spearman"))

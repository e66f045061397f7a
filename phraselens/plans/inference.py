"""Explained verdicts for a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phraselens.config import INFER, PHRASE_NEIGHBOURS, TEXT_NEIGHBOURS, ExtractProfile, Settings
from phraselens.operators import classify, mmr
from phraselens.operators.candidates import distinct_texts, text_key
from phraselens.operators.similarity import Index, prepare, top_k_neighbours
from phraselens.operators.skew import join_unique
from phraselens.session import written


def prepared(index: DataFrame | Index, settings: Settings = Settings()) -> Index:
    """The phrase index made ready once for texts and phrases; pass the result on to search it again and again."""
    return index if isinstance(index, Index) else prepare(index, max(settings.text_neighbours, settings.phrase_neighbours), cosine=True)


def classify_phrase_set(phrases: DataFrame, index: DataFrame | Index, embedder, k: int = PHRASE_NEIGHBOURS) -> DataFrame:
    """Verdict for every different phrase; each is embedded and searched once however many texts share it."""
    vectors = embedder.embed(phrases.select("phrase").distinct(), "phrase").withColumnRenamed("phrase", "q_id")
    found = top_k_neighbours(vectors, index, k, cosine=True)
    return classify.phrase_verdicts(classify.neighbour_ratios(found), k).withColumnRenamed("q_id", "phrase")


def classify_text_set(texts: DataFrame, index: DataFrame | Index, embedder, k: int = TEXT_NEIGHBOURS) -> DataFrame:
    """Verdict for every text of texts(text_key, text)."""
    vectors = embedder.embed(texts.select(F.col("text_key").alias("q_id"), "text"), "text").drop("text")
    found = top_k_neighbours(vectors, index, k, cosine=True)
    return classify.text_verdicts(classify.neighbour_ratios(found), k).withColumnRenamed("q_id", "text_key")


def explain_distinct(texts: DataFrame, index: DataFrame | Index, embedder, profile: ExtractProfile = INFER, settings: Settings = Settings()) -> DataFrame:
    """One result per text of texts(text_key, text). A text without phrases is not classified."""
    index = prepared(index, settings)
    phrases = written(mmr.diverse_phrases(texts, profile).select("text_key", "rank", "phrase", "score"), "phrases")
    by_phrase = classify_phrase_set(phrases, index, embedder, settings.phrase_neighbours)
    explained = written(classify.phrase_explanations(join_unique(phrases, by_phrase, "phrase"), "text_key"), "explanations")
    # All texts are embedded where they are read, those without phrases too: a join that leaves them out would move every text.
    verdicts = classify_text_set(texts, index, embedder, settings.text_neighbours)
    joined = texts.select("text_key").join(explained, "text_key", "left").join(verdicts, "text_key", "left")
    has_phrases = F.col("phrases").isNotNull()
    # A text with phrases but no reachable neighbour at all (empty index) stays open as well.
    return joined.select(
        "text_key", F.coalesce(F.when(has_phrases, F.col("overall_classification")), F.lit(classify.UNABLE)).alias("overall_classification"),
        F.coalesce("phrases", F.array()).alias("phrases"),
        F.coalesce(F.when(has_phrases, F.col("summary")), F.lit(classify.NO_PHRASES)).alias("summary"),
        F.when(has_phrases, F.struct("similarity_confidence", "avg_hate_ratio", "threshold")).alias("text_analysis"))


def explain(docs: DataFrame, index: DataFrame | Index, embedder, id_col: str = "doc_id", text_col: str = "text",
            profile: ExtractProfile = INFER, settings: Settings = Settings()) -> DataFrame:
    """Explained result per row of `docs`; copies of a text are analysed once, a missing text is not classified."""
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    texts = written(distinct_texts(rows, None).select("text_key", "text"), "texts")
    results = written(explain_distinct(texts, index, embedder, profile, settings), "results")
    keyed = rows.select(id_col, text_key(F.col("text")).alias("text_key"))
    return join_unique(keyed, results, "text_key").drop("text_key").withColumns({
        "overall_classification": F.coalesce("overall_classification", F.lit(classify.UNABLE)),
        "phrases": F.coalesce("phrases", F.array()), "summary": F.coalesce("summary", F.lit(classify.NO_PHRASES))})

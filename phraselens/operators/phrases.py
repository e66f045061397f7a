"""Key phrases per text, and their statistics over a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phraselens.config import EXTRACT, MIN_PHRASE_FREQUENCY, ExtractProfile
from phraselens.functions import ratio as fr
from phraselens.functions.words import BOOST_WORDS, custom_stop_words
from phraselens.operators.candidates import Grams, choose_phrases, shortened
from phraselens.operators.progress import Progress

CHOSEN = "rank int, phrase string, score double"


def extract_phrases(texts: DataFrame, profile: ExtractProfile = EXTRACT, stop_words=None, carry=("text_key",), boost_words=BOOST_WORDS) -> DataFrame:
    """Key phrases of every text by plain ranking and boost: rank, phrase, score, beside the columns to carry along.

    Of the best 2 * top_k candidates, scores are rounded to 4 decimals, those of phrases with a relevant word are boosted, and
    the best top_k stay; equal boosted scores keep their order.
    """
    def choose(grams: Grams):
        top, _ = grams.ranked(np.arange(len(grams.text)), grams.score, 2 * profile.top_k)
        score = shortened(grams.score[top])
        boosted = np.where(grams.has_word(top, boost_words), score * profile.boost, score) if profile.boost else score
        kept, rank = grams.ranked(top, boosted, profile.top_k)
        return grams.text[top[kept]], {"rank": pa.array((rank + 1).astype(np.int32)), "phrase": grams.phrases(top[kept]), "score": pa.array(boosted[kept])}
    return choose_phrases(texts, profile, custom_stop_words() if stop_words is None else stop_words, choose, CHOSEN, carry)


def phrase_counts(corpus: DataFrame, profile: ExtractProfile = EXTRACT, stop_words=None, progress: Progress | None = None) -> DataFrame:
    """Per phrase: texts it was chosen for, positive ones and the others. The only exchange is that of phrase counts."""
    chosen = extract_phrases(progress.texts(corpus) if progress else corpus, profile, stop_words, carry=("label",))
    chosen = progress.phrases(chosen) if progress else chosen
    positive = F.count_if(F.col("label") == 1)
    return chosen.groupBy("phrase").agg(
        F.count(F.lit(1)).alias("total_frequency"), positive.alias("hate_count"), (F.count(F.lit(1)) - positive).alias("non_hate_count"))


def frequent(counts: DataFrame, minimum: int = MIN_PHRASE_FREQUENCY) -> DataFrame:
    return counts.where(F.col("total_frequency") >= minimum)


def phrase_report(counts: DataFrame, minimum: int = MIN_PHRASE_FREQUENCY) -> DataFrame:
    """Frequent phrases with positive ratio and band; order with `sorted_report` for display."""
    value = fr.ratio(F.col("hate_count"), F.col("total_frequency"))
    return (frequent(counts, minimum)
            .select("phrase", "total_frequency", "hate_count", "non_hate_count", value.alias("hate_ratio"))
            .withColumn("hate_indicator", fr.phrase_band(F.col("hate_ratio"))))


def sorted_report(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("total_frequency"), "phrase")


def band_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("hate_indicator").agg(F.count(F.lit(1)).alias("phrases"))

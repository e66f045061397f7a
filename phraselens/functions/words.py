"""Fixed word lists and the stop-word algebra built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

# Spark's own English stop words (StopWordsRemover), written out so that neither a session nor a jar is needed.
BASE_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd",
    "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't",
    "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't",
    "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought",
    "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
)

# Words that carry meaning for the verdict. They are kept out of the stop words, and
# phrases holding one of them are boosted during extraction.
RELEVANT_WORDS = (
    "hate", "love", "like", "dislike", "fear",
    "not", "no", "never", "nothing", "nobody", "nowhere", "neither", "nor", "n't",
    "very", "really", "so", "too", "quite", "extremely", "totally", "completely",
    "should", "must", "ought", "need", "have", "has", "had",
    "all", "every", "each", "any", "some", "few", "many", "most", "several",
    "they", "them", "their", "those", "these", "we", "us", "our",
    "back", "away", "out", "off", "down",
    "more", "less", "better", "worse", "best", "worst",
    "only", "just", "still", "even", "again", "against",
)

# The boost looks for these in addition to the kept words.
BOOST_ONLY_WORDS = ("racist", "sexist")
BOOST_WORDS = RELEVANT_WORDS + BOOST_ONLY_WORDS

# Words without value for the task, added to the stop words.
EXTRA_STOP_WORDS = ("said", "says", "saying", "say", "would", "could", "might", "may")


def base_stop_words() -> list[str]:
    """Spark's own English list; any other list can be passed to the operators instead."""
    return list(BASE_STOP_WORDS)


def custom_stop_words(base=None, keep=RELEVANT_WORDS, extra=EXTRA_STOP_WORDS) -> list[str]:
    """(base minus keep) plus extra, sorted."""
    base = base_stop_words() if base is None else base
    return sorted((set(base) - set(keep)) | set(extra))


def word_table(spark: SparkSession, words) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def custom_stop_word_table(base: DataFrame, keep: DataFrame, *extra: DataFrame) -> DataFrame:
    """The same algebra for word lists that live in tables."""
    return reduce(lambda acc, more: acc.unionByName(more), extra, base.select("word").subtract(keep)).distinct()

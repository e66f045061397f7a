"""Diverse key phrases: maximal marginal relevance, for all texts of a slice at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phraselens.config import INFER, ExtractProfile
from phraselens.functions.words import custom_stop_words
from phraselens.operators.candidates import Grams, choose_phrases, shortened
from phraselens.operators.phrases import CHOSEN


def greedy_picks(text: np.ndarray, score: np.ndarray, square: np.ndarray, words: np.ndarray, limit: int, diversity: float) -> np.ndarray:
    """Rows chosen in every text by (1-d)*score - d*(largest similarity to a chosen row); the first of equals wins.

    Rows stand text by text; `words` holds a row's word numbers, -1 where it has fewer. One step chooses a row in every
    text: a maximum per text, the first row that has it, and what all rows share with the row chosen in their text.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.diff(text, prepend=text[0] - 1))
    segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(text))))
    here, value, near, picks = np.arange(len(text)), score.copy(), np.zeros(len(score)), []
    columns = np.ascontiguousarray(words.T)
    for step in range(limit):
        best = np.maximum.reduceat(value, starts)
        first = np.minimum.reduceat(np.where(value == best[segment], here, len(text)), starts)
        first = first[np.isfinite(best)]
        if not len(first):
            break
        picks.append(first)
        chosen = np.full(len(starts), first[0])
        chosen[segment[first]] = first
        shared = np.zeros(len(text), np.int8)
        for theirs in columns[:, chosen]:
            other = np.where(theirs < 0, -2, theirs)[segment]
            for mine in columns:
                shared += (mine == other).view(np.int8)
        # Only rows that share a word come nearer to what is chosen.
        touched = np.flatnonzero(shared)
        now = shared[touched] / np.sqrt((square[touched] * square[chosen][segment[touched]]).astype(np.float64))
        near[touched] = np.maximum(near[touched], now)
        changed = touched if step else here
        gone = value == -np.inf
        value[changed] = (1 - diversity) * score[changed] - diversity * near[changed]
        value[gone] = -np.inf
        value[first] = -np.inf
    return np.sort(np.concatenate(picks))


def drop_stop_phrases(phrases: DataFrame, stop_words: list[str]) -> DataFrame:
    return phrases.where(~F.lower("phrase").isin(list(stop_words)))


def diverse_phrases(texts: DataFrame, profile: ExtractProfile = INFER, stop_words=None, carry=("text_key",)) -> DataFrame:
    """Explaining phrases of every text: rank, phrase, score (4 decimals), beside the columns to carry along.

    2 * top_k phrases are chosen greedily; those that are a stop word by themselves are dropped; the rest is ranked by
    score to the text, then alphabetically, and the first top_k stay.
    """
    stop_words = custom_stop_words() if stop_words is None else list(stop_words)
    stop = set(stop_words)

    def choose(grams: Grams):
        picks = greedy_picks(grams.text, grams.score, grams.square, grams.words, 2 * profile.top_k, profile.diversity)
        named = np.array([p.lower() not in stop for p in grams.phrases(picks).to_pylist()], bool)
        picks = picks[named]
        score = shortened(grams.score[picks])
        kept, rank = grams.ranked(picks, score, profile.top_k)
        return grams.text[picks[kept]], {"rank": pa.array((rank + 1).astype(np.int32)), "phrase": grams.phrases(picks[kept]), "score": pa.array(score[kept])}
    return choose_phrases(texts, profile, stop_words, choose, CHOSEN, carry)

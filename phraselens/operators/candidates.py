"""Candidate phrases of texts, their lexical scores, and the choice of the best, made where the texts are read.

Spark splits a text into tokens; a kernel takes the tokens of many texts of an Arrow batch as one flat array of word
numbers and forms, merges and scores the n-grams of all of them with sorts and sums over that array. Texts are never
shuffled: what leaves the kernel is a few phrases per text (or all candidates, where these are asked for). Copies
of a text within a batch are worked on once, so a text that makes up a third of a corpus costs next to nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from phraselens.config import MAX_NGRAM, ExtractProfile
from phraselens.functions import text as ft

SLICE_TOKENS = 100_000      # tokens worked on at a time; a text is never cut
DECIMALS = 1e4              # scores of chosen phrases have four decimals


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def distinct_texts(corpus: DataFrame, label: str | None = "label") -> DataFrame:
    """One row per different text: text_key, text, n_docs and, with a label, n_hate."""
    measures = [F.first("text").alias("text"), F.count(F.lit(1)).alias("n_docs")]
    if label:
        measures.append(F.count_if(F.col(label) == 1).alias("n_hate"))
    return (corpus.where(F.col("text").isNotNull())
            .groupBy(text_key(F.col("text")).alias("text_key")).agg(*measures))


def shortened(score: np.ndarray) -> np.ndarray:
    return np.floor(score * DECIMALS + 0.5) / DECIMALS


class Grams:
    """The different n-grams of several texts, in text order and within a text alphabetically, with their scores.

    `words` holds the numbers of an n-gram's words, -1 beyond its length; equal numbers are equal words of one text.
    `score` is the cosine of n-gram and text as word counts: sums are whole numbers, so the only rounding is in one
    square root and one division.
    """

    def __init__(self, tokens: pa.ListArray, most: np.ndarray, stop: pa.Array):
        self.texts = len(tokens)
        coded = tokens.flatten().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        self.vocabulary = coded.dictionary.take(order)
        number = np.empty(len(order), np.int64)             # place of each word in the alphabet of this slice
        number[order.to_numpy()] = np.arange(len(order))
        codes = coded.indices.to_numpy()
        # Stop words go before n-grams are formed, so an n-gram may span the gap they leave.
        kept = ~pc.is_in(coded.dictionary, value_set=stop).to_numpy(zero_copy_only=False)[codes]
        text = np.repeat(np.arange(self.texts), tokens.value_lengths().to_numpy())[kept]
        size = max(len(order), 1)
        key, own, times = np.unique(text * size + number[codes[kept]], return_inverse=True, return_counts=True)
        self.alphabet = key % size                          # of each word of a text
        text_square = np.bincount(text, times[own].astype(np.float64), self.texts)
        levels = [(None, key // size, times, np.ones(len(key), np.int64), np.arange(len(key))[:, None])]
        begin, prefix = np.arange(len(text)), own
        for n in range(2, MAX_NGRAM + 1):
            begin = begin[begin + n - 1 < len(text)]
            begin = begin[(text[begin + n - 1] == text[begin]) & (most[text[begin]] >= n)]
            if not len(begin):
                break
            _, of, dot, square, words = levels[-1]
            # Sorted by the n-gram without its last word, then by that word: alphabetically, as level by level before.
            found, which = np.unique(prefix[begin] * len(key) + own[begin + n - 1], return_inverse=True)
            parent, last = found // len(key), found % len(key)
            again = (words[parent] == last[:, None]).sum(axis=1)
            levels.append((parent, of[parent], dot[parent] + times[last], square[parent] + 1 + 2 * again, np.column_stack([words[parent], last])))
            prefix = np.full(len(text), -1)
            prefix[begin] = which
        # In the alphabet an n-gram comes right before the longer ones that begin with it.
        family = [np.ones(len(level[1]), np.int64) for level in levels]
        for i in range(len(levels) - 1, 0, -1):
            family[i - 1] += np.bincount(levels[i][0], family[i], len(family[i - 1])).astype(np.int64)
        total = sum(len(level[1]) for level in levels)
        self.text, self.n, self.square = np.empty(total, np.int64), np.empty(total, np.int8), np.empty(total, np.int64)
        self.words, dots, place = np.full((total, MAX_NGRAM), -1, np.int32), np.empty(total, np.int64), None
        for n, (parent, of, dot, square, words) in enumerate(levels, 1):
            ahead = np.cumsum(family[n - 1]) - family[n - 1]
            place = ahead if parent is None else place[parent] + 1 + ahead - ahead[np.searchsorted(parent, parent)]
            self.text[place], self.n[place], dots[place], self.square[place], self.words[place, :n] = of, n, dot, square, words
        self.score = dots / np.sqrt(text_square[self.text] * self.square) if total else np.zeros(0)

    def phrases(self, rows: np.ndarray) -> pa.Array:
        words = self.words[rows]
        parts = [self.vocabulary.take(pa.array(self.alphabet[w] if len(self.alphabet) else w, mask=w < 0)) for w in words.T]
        return pc.binary_join_element_wise(*parts, " ", null_handling="skip").cast(pa.string())

    def ranked(self, rows: np.ndarray, score: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows, the best `limit` of each text by score, equal ones in the given order; and their ranks from 0."""
        order = np.lexsort((np.arange(len(rows)), -score, self.text[rows]))
        text = self.text[rows[order]]
        rank = np.arange(len(order)) - np.searchsorted(text, text)
        return order[rank < limit], rank[rank < limit]

    def has_word(self, rows: np.ndarray, wanted) -> np.ndarray:
        """Whether a word of the n-gram is one of `wanted`."""
        listed = pc.is_in(self.vocabulary, value_set=pa.array(list(wanted), self.vocabulary.type)).to_numpy(zero_copy_only=False)
        words = self.words[rows]
        return ((words >= 0) & (listed[self.alphabet[words]] if len(self.alphabet) else False)).any(axis=1)


Choice = Callable[[Grams], tuple[np.ndarray, dict[str, pa.Array]]]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about SLICE_TOKENS tokens, at least one text each."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > SLICE_TOKENS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _worked(choose: Choice, tokens: pa.ListArray, most: np.ndarray, stop: pa.Array, keep_errors: bool) -> Iterator[tuple[int, int, np.ndarray, dict]]:
    """(start, end, text, columns) of the choice for texts; what fails is halved down to the texts that do.

    With keep_errors a text that fails is one row without values but its error; without, the error is raised.
    """
    try:
        text, columns = choose(Grams(tokens, most, stop))
        if keep_errors:
            columns["error"] = pa.nulls(len(text), pa.string())
        yield 0, len(tokens), text, columns
    except Exception as error:
        if not keep_errors:
            raise
        if len(tokens) == 1:
            yield 0, 1, np.zeros(1, np.int64), {"error": pa.array([f"{type(error).__name__}: {error}"])}
            return
        half = len(tokens) // 2
        yield from _worked(choose, tokens.slice(0, half), most[:half], stop, True)
        for start, end, text, columns in _worked(choose, tokens.slice(half), most[half:], stop, True):
            yield start + half, end + half, text, columns


def _kernel(choose: Choice, carry: list[str], stop_words: list[str], fields: pa.Schema, keep_errors: bool):
    def run(batches):
        stop = pa.array(list(stop_words), pa.string())
        for batch in batches:
            _, first, which = np.unique(batch["_same"].dictionary_encode().indices.to_numpy(), return_index=True, return_inverse=True)
            tokens, most = batch["_tokens"].take(pa.array(first)), batch["_most"].to_numpy()[first]
            rows_of = np.argsort(which, kind="stable")      # rows of the batch by their text
            edges = np.searchsorted(which[rows_of], np.arange(len(first) + 1))
            for begin, stop_at in _slices(tokens.value_lengths().to_numpy()):
                for start, end, text, columns in _worked(choose, tokens.slice(begin, stop_at - begin), most[begin:stop_at], stop, keep_errors):
                    if not len(text):
                        continue
                    start, end = start + begin, end + begin
                    found = np.searchsorted(text, np.arange(end - start + 1))
                    rows = rows_of[edges[start]:edges[end]]
                    size = np.diff(found)[which[rows] - start]
                    taken = pa.array(np.repeat(found[which[rows] - start] - (np.cumsum(size) - size), size) + np.arange(size.sum()))
                    owners = pa.array(np.repeat(rows, size))
                    made = [columns[f.name].take(taken) if f.name in columns else pa.nulls(len(taken), f.type) for f in fields]
                    yield pa.RecordBatch.from_arrays([*[batch[c].take(owners) for c in carry], *made], [*carry, *fields.names])
    return run


def choose_phrases(texts: DataFrame, profile: ExtractProfile, stop_words: list[str], choose: Choice, fields: str, carry=("text_key",), keep_errors: bool = False) -> DataFrame:
    """What `choose` makes of the candidates of every row of texts(text, ...), beside the columns to carry along.

    `choose` gets the n-grams of several texts and returns the text of each chosen row, ascending, and columns as named in
    `fields`. Rows whose text is null or too short have no candidate. With keep_errors there is a column `error`, and a text
    that the choice fails on is one row that has nothing else; without, it fails the job.
    """
    text = F.col("text")
    key = F.col("text_key") if "text_key" in texts.columns else text_key(text)
    carried = [key.alias(c) if c == "text_key" else F.col(c) for c in carry]
    tokenised = texts.where(text.isNotNull() & ft.has_min_chars(text, profile.min_chars)).select(
        *carried, key.alias("_same"), ft.tokens(text).alias("_tokens"), ft.profile_ngram_limit(text, profile.banded).alias("_most"))
    kinds = ", ".join(f"`{c}` {tokenised.schema[c].dataType.simpleString()}" for c in carry)
    fields += ", error string" if keep_errors else ""
    arrow = to_arrow_schema(StructType.fromDDL(fields))
    return tokenised.mapInArrow(_kernel(choose, list(carry), stop_words, arrow, keep_errors), f"{kinds}{', ' if carry else ''}{fields}")


def score_texts(texts: DataFrame, profile: ExtractProfile, stop_words: list[str], carry=("text_key",)) -> DataFrame:
    """All different n-grams of every text: phrase, n, score, beside the columns to carry along."""
    def everything(grams: Grams):
        rows = np.arange(len(grams.text))
        return grams.text, {"phrase": grams.phrases(rows), "n": pa.array(grams.n.astype(np.int32)), "score": pa.array(grams.score)}
    return choose_phrases(texts, profile, stop_words, everything, "phrase string, n int, score double", carry)


def count_candidates(texts: DataFrame, profile: ExtractProfile, stop_words: list[str], carry=("text_key",)) -> DataFrame:
    """Of every text and length n: the number of different n-grams, the first and the last of them as strings."""
    def counted(grams: Grams):
        # Words have no character below a blank, so n-grams come in the order of their strings.
        order = np.lexsort((np.arange(len(grams.text)), grams.n, grams.text))
        key = grams.text[order] * (MAX_NGRAM + 1) + grams.n[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(starts[1:], len(key)) - 1 if len(key) else starts
        first = order[starts]
        return grams.text[first], {"n": pa.array(grams.n[first].astype(np.int32)), "candidates": pa.array(ends - starts + 1, pa.int64()),
                                   "first_phrase": grams.phrases(first), "last_phrase": grams.phrases(order[ends])}
    return choose_phrases(texts, profile, stop_words, counted, "n int, candidates long, first_phrase string, last_phrase string", carry)


def best_candidates(texts: DataFrame, profile: ExtractProfile, stop_words: list[str], limit: int, carry=("text_key",)) -> DataFrame:
    """The `limit` best-scored n-grams of every text: rank, phrase, score; equal scores alphabetically."""
    def best(grams: Grams):
        rows, rank = grams.ranked(np.arange(len(grams.text)), grams.score, limit)
        return grams.text[rows], {"rank": pa.array((rank + 1).astype(np.int32)), "phrase": grams.phrases(rows), "score": pa.array(grams.score[rows])}
    return choose_phrases(texts, profile, stop_words, best, "rank int, phrase string, score double", carry)

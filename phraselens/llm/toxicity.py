"""Toxicity by cumulative-link ordinal regression over sparse word features.

Grades of severity are ordered; one weight vector w is shared by all thresholds t_1 < t_2 < ...:
    P(grade >= k) = sigmoid(w . x - t_k),
so a document's expected severity is the sum of these chances. x holds the shares of hashed words in the text, hence a
score is the mean weight of a text's words and needs no vector per document. The model is fitted on a sample of at most
about SAMPLE labelled documents; every document is scored on its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phraselens.llm.common import MARKS, Coder, drawn, mixed, shared, word_hashes, words

SAMPLE = 8_000
BUCKETS = 1 << 17
PREFIXES = (4, 5, 6)     # bytes of a word's beginning that are features besides the word
MIN_DOCUMENTS = 6       # documents of the sample that must hold a word's bucket for it to get a weight
SCALE, PENALTY, STEPS, RATE = 80.0, 1e-4, 400, 0.05
TOXIC = 0.4              # chance of a grade of at least 1


def word_buckets(vocabulary: list[bytes]) -> np.ndarray:
    """(words x 1 + prefixes) buckets of each word, without the marks around it, and of its beginnings.

    What a word does not have, marks only or a longer beginning, is in the last bucket, which weighs nothing.
    """
    bare = [w.strip(MARKS) for w in vocabulary]
    out = np.full((len(bare), 1 + len(PREFIXES)), BUCKETS - 1)
    for i, parts in enumerate([bare, *([w[:n] if len(w) > n else b"" for w in bare] for n in PREFIXES)]):
        there = np.array([bool(w) for w in parts], bool)
        found = mixed(word_hashes(parts) + np.uint64(i)) % np.uint64(BUCKETS - 1)
        out[there, i] = found[there].astype(np.int64)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """weights per bucket and ordered thresholds, fitted by gradient steps (Adam) on the penalised likelihood."""

    def __init__(self, rows: np.ndarray, buckets: np.ndarray, shares: np.ndarray, grades: np.ndarray):
        self.weights, self.top = np.zeros(BUCKETS), int(grades.max(initial=0))
        counts = np.array([(grades >= k).sum() for k in range(1, self.top + 1)], float)
        odds = np.log((counts + 0.5) / (len(grades) - counts + 0.5))
        self.thresholds = -odds
        held = np.bincount(buckets, minlength=BUCKETS) >= MIN_DOCUMENTS
        keep = held[buckets] & (buckets < BUCKETS - 1)
        rows, buckets, x = rows[keep], buckets[keep], shares[keep] * SCALE
        used, place = np.unique(buckets, return_inverse=True)
        if not self.top or not len(used):
            return
        # Parameters: weights, first threshold, logarithms of the gaps between thresholds.
        gaps = np.log(np.maximum(np.diff(self.thresholds), 1e-3))
        p = np.concatenate([np.zeros(len(used)), self.thresholds[:1], gaps])
        m, v, n, one = np.zeros_like(p), np.zeros_like(p), len(grades), np.arange(1, self.top + 1)
        turn = (grades[:, None] + 1 == one).astype(float) - (grades[:, None] == one)
        for step in range(1, STEPS + 1):
            w, t = p[:len(used)], np.cumsum(np.concatenate([p[len(used):len(used) + 1], np.exp(p[len(used) + 1:])]))
            s = np.bincount(rows, w[place] * x, n)
            above = np.hstack([np.ones((n, 1)), sigmoid(s[:, None] - t), np.zeros((n, 1))])
            chance = np.maximum(above[np.arange(n), grades] - above[np.arange(n), grades + 1], 1e-12)
            slope = above * (1 - above)
            by_score = (slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / chance
            by_threshold = (turn * slope[:, 1:-1] / chance[:, None]).sum(axis=0)
            later = np.cumsum(by_threshold[::-1])[::-1]
            g = -np.concatenate([np.bincount(place, by_score[rows] * x, len(used)), later[:1], later[1:] * np.exp(p[len(used) + 1:])]) / n
            g[:len(used)] += PENALTY * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weights[used] = p[:len(used)]
        self.thresholds = np.cumsum(np.concatenate([p[len(used):len(used) + 1], np.exp(p[len(used) + 1:])]))


def _features(batches):
    for batch in batches:
        coder = Coder()
        codes = [coder.codes(words(t)) for t in batch["text"].to_pylist()]
        bucket = word_buckets(list(coder))
        found = [np.unique(bucket[c].ravel(), return_counts=True) for c in codes]
        yield pa.RecordBatch.from_arrays(
            [batch["grade"], pa.array([b.astype(np.int32).tobytes() for b, _ in found]),
             pa.array([(n / max(len(c), 1)).astype(np.float32).tobytes() for (_, n), c in zip(found, codes)])], ["grade", "buckets", "shares"])


def _scorer(sent):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])

    def score(batches):
        model = sent.value
        for batch in batches:
            coder = Coder()
            codes = [coder.codes(words(t)) for t in batch["text"].to_pylist()]
            weight = model.weights[word_buckets(list(coder))].sum(axis=1) if coder else np.empty(0)
            sizes = np.array([len(c) for c in codes], np.int64)
            s = np.array([weight[c].mean() * SCALE if len(c) else 0.0 for c in codes])
            above = sigmoid(s[:, None] - model.thresholds) * (sizes > 0)[:, None] if model.top else np.zeros((len(codes), 1))
            each = -np.diff(np.hstack([np.ones((len(codes), 1)), above, np.zeros((len(codes), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes), pa.array(above.sum(axis=1)), pa.array(above[:, 0]),
                 pa.array(each.argmax(axis=1).astype(np.int32))], schema=schema)
    return score


def learn(documents: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from texts and a table with doc_id and grade (0, 1, ...); a document's highest grade counts."""
    known = grades.where("doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    total = known.count()
    chosen = known.where(drawn("doc_id", sample / max(total, 1), 10))
    rows, buckets, shares, labels = [], [], [], []
    features = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInArrow(
        _features, "grade int, buckets binary, shares binary")
    for row in features.toLocalIterator():
        buckets.append(np.frombuffer(row["buckets"], np.int32))
        shares.append(np.frombuffer(row["shares"], np.float32))
        rows.append(np.full(len(buckets[-1]), len(labels)))
        labels.append(row["grade"])

    def joined(parts, kind):
        return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return Model(joined(rows, np.int64), joined(buckets, np.int64), joined(shares, np.float64), np.array(labels, np.int64))


def severity(documents: DataFrame, grades: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_words, severity, p_toxic, grade, toxic: one row per row of documents (doc_id, text).

    grades has doc_id and grade; held_out rows (a Boolean expression; null counts as false) are not learned from.
    severity is the expected grade, p_toxic the chance of a grade of at least 1, grade the likeliest one, toxic that
    p_toxic is at least TOXIC. A text that is null or without words has severity 0, as has every text if nothing is
    labelled.
    """
    flag = F.coalesce(held_out, F.lit(False))
    sent = shared(documents.sparkSession, learn(documents.where(~flag), grades, sample))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scorer(sent), "doc_id long, n_words long, severity double, p_toxic double, grade int")
    return scored.select("doc_id", flag.alias("held_out"), "n_words", "severity", "p_toxic", "grade", (F.col("p_toxic") >= TOXIC).alias("toxic"))

"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines inside it.

Features are hashed three-byte sequences of the lower-cased letters, as shares of a text's sequences; so a decision is
an average of weights over the text and needs no vector per document. The machines are trained on a sample of at most
SAMPLE labelled documents per language; everything that is predicted is read whole.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from phraselens.llm.common import drawn, shared

SAMPLE = 400            # labelled documents per language, fewer if there are more than SAMPLE_ALL / SAMPLE languages
SAMPLE_ALL = 6_000
BUCKETS = 1 << 13
EPOCHS, COST = 30, 10.0
UNDETERMINED = "und"

# Families of common languages; any other language is in the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga cy br gd",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he am mt",
    "indo-aryan": "hi bn ur pa mr gu ne si",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
    "sino-tibetan": "zh my bo",
    "japonic": "ja",
    "koreanic": "ko",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
NO_LETTERS = re.compile(r"[\W\d_]+")


def sequences(text: str | None) -> np.ndarray:
    """Bucket numbers of the three-byte sequences of a text's letters; empty if it has no letter."""
    letters = NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, letters)):
        return np.empty(0, np.int64)
    b = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def support_vector_machine(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of a linear machine for labels +1 and -1, by dual coordinate descent."""
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal, rng = (x * x).sum(axis=1, dtype=np.float64), np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            old = alpha[i]
            alpha[i] = min(max(old - (y[i] * (x[i] @ weights) - 1) / diagonal[i], 0.0), cost)
            if alpha[i] != old:
                weights += (alpha[i] - old) * y[i] * x[i]
    return weights


class Model:
    """Languages, their families and a weight column per pair of families and per pair of languages of a family."""

    def __init__(self, counts: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        family = {v: FAMILY_OF.get(v.lower().replace("_", "-").split("-")[0], "other") for v in self.languages}
        self.families = sorted(set(family.values()))
        self.members = {f: [v for v in self.languages if family[v] == f] for f in self.families}
        label, groups = np.array(labels), np.array([family[v] for v in labels])
        self.duels = [(a, b) for a, b in combinations(self.families, 2)]
        tasks = [(groups == a, groups == b) for a, b in self.duels]
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                self.duels.append((a, b))
                tasks.append((label == a, label == b))
        x = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.scale = float(1 / np.maximum(np.sqrt((x * x).sum(axis=1)).mean(), 1e-9)) if len(x) else 1.0
        x = np.hstack([x * self.scale, np.ones((len(x), 1))]).astype(np.float32)
        columns = [support_vector_machine(x[first | second], np.where(first[first | second], 1.0, -1.0)) for first, second in tasks]
        self.weights = np.array(columns).reshape(len(columns), BUCKETS + 1)


def _winner(names: list[str], chance: dict) -> tuple[str, float]:
    """The name that wins most duels, ties by the sum of its chances, then by name; and its mean chance."""
    if len(names) == 1:
        return names[0], 1.0
    won = {n: [chance[n, m] for m in names if m != n] for n in names}
    best = min(names, key=lambda n: (-sum(c > 0.5 for c in won[n]), -sum(won[n]), n))
    return best, sum(won[best]) / len(won[best])


def _decide(model, text: str | None) -> tuple[str, float]:
    found = sequences(text)
    if not len(found) or not model.languages:
        return UNDETERMINED, 0.0
    share = np.bincount(found, minlength=BUCKETS) * (model.scale / len(found))
    margins = model.weights[:, :-1] @ share + model.weights[:, -1] if len(model.duels) else []
    chance = {}
    for (a, b), margin in zip(model.duels, margins):
        p = 1 / (1 + np.exp(-np.clip(2 * margin, -50, 50)))
        chance[a, b], chance[b, a] = p, 1 - p
    family, first = _winner(model.families, chance)
    name, second = _winner(model.members[family], chance)
    return name, float(first * second)


def _predictor(sent):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches):
        model = sent.value
        for batch in batches:
            found = [_decide(model, t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([n for n, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], schema=schema)
    return predict


def _counter(batches):
    for batch in batches:
        found = [np.unique(sequences(t), return_counts=True) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["lang"], pa.array([b.astype(np.int32).tobytes() for b, _ in found]), pa.array([n.astype(np.int32).tobytes() for _, n in found])],
            ["lang", "buckets", "counts"])


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from a table with doc_id, text and lang: of every language about `sample` documents, chosen by a hash."""
    rows = labelled.where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model(np.zeros((0, BUCKETS), np.float32), [])
    sample = min(sample, SAMPLE_ALL / len(totals))
    chosen = F.lit(False)
    for lang, n in totals.items():
        chosen = chosen | ((F.col("lang") == lang) & drawn("doc_id", sample / n, 8))
    counts, labels = [], []
    for row in rows.where(chosen).select("lang", "text").mapInArrow(_counter, "lang string, buckets binary, counts binary").toLocalIterator():
        line = np.zeros(BUCKETS, np.float32)
        line[np.frombuffer(row["buckets"], np.int32)] = np.frombuffer(row["counts"], np.int32)
        if line.any():
            counts.append(line)
            labels.append(row["lang"])
    return Model(np.array(counts, np.float32).reshape(-1, BUCKETS), labels)


def _keeper(sent):
    def keep(batches):
        model = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            names = [_decide(model, t)[0] for t in texts]
            stays = pa.array([n != UNDETERMINED if model.languages else len(sequences(t)) > 0 for n, t in zip(names, texts)], pa.bool_())
            told = pa.array([n if n != UNDETERMINED else None for n in names], pa.string())
            columns = [pa.compute.coalesce(batch[c], told) if c == "lang" else batch[c] for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(stays)
    return keep


def keep_determined(documents: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """The rows of documents whose language identify() determines, a missing lang filled in; all columns stay.

    If no row is labelled, the rows whose text has a letter.
    """
    labelled = documents.where(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text", "lang")
    sent = shared(documents.sparkSession, learn(labelled, sample))
    return documents.mapInArrow(_keeper(sent), documents.schema)


def identify(documents: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of documents, which has doc_id, text and lang.

    held_out rows (a Boolean expression; null counts as false) are not learned from. Nothing but the text enters a
    prediction. lang_pred is 'und' with score 0 for a text that is null or has no letter, and for all if no row has a
    language. score is the mean chance of the family's duels times that of the language's.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sent = shared(documents.sparkSession, learn(rows.where("not held_out"), sample))
    return rows.select("doc_id", "text", "held_out").mapInArrow(
        _predictor(sent), "doc_id long, held_out boolean, lang_pred string, score double")

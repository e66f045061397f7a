"""Candidates, ranking, counting and diverse phrases against plain Python on whole small texts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings as hsettings, strategies as st
from pyspark.sql import functions as F

from phraselens.config import EXTRACT, INFER, ExtractProfile
from phraselens.functions.words import BOOST_WORDS, custom_stop_words
from phraselens.operators import candidates as oc, mmr, phrases as op

TEXTS = [
    "the cat sat on the mat and the cat never left the mat",
    "they never said they would hate every cat, every dog and every bird in all of the towns around here again and again",
    "word " * 30 + "other thing other thing",
    "ab", "   ", "the and of", "x y z", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen",
    "Ça va bien, ça va très bien! Привет мир привет",
]
CORPUS = [(i, t, i % 2) for i, t in enumerate(TEXTS + TEXTS[:3] + TEXTS[:1] * 3)] + [(99, None, 1)]


def key(text):
    return hashlib.md5(text.encode()).digest()


def brute_candidates(text, banded):
    words = len(text.split())
    max_n = (4 if words > 20 else 3 if words > 15 else 2) if banded else 4
    stop = set(custom_stop_words())
    tokens = [t for t in re.findall(r"\w\w+", text.lower()) if t not in stop]
    tf = Counter(tokens)
    out = {}
    for n in range(1, max_n + 1):
        for i in range(len(tokens) - n + 1):
            gram = Counter(tokens[i:i + n])
            dot = sum(c * tf[w] for w, c in gram.items())
            out[" ".join(tokens[i:i + n])] = (dot / math.sqrt(sum(c * c for c in tf.values()) * sum(c * c for c in gram.values())), gram)
    return out


def brute_extract(text):
    if len(text.strip()) < 3:
        return []
    top = sorted(brute_candidates(text, True).items(), key=lambda x: (-x[1][0], x[0]))[:6]
    scored = [(p, math.floor(s * 1e4 + 0.5) / 1e4 * (1.2 if set(p.split()) & set(BOOST_WORDS) else 1)) for p, (s, _) in top]
    return [p for p, _ in sorted(scored, key=lambda x: -x[1])[:3]]


def brute_mmr(text, limit, d, top_k):
    cand = brute_candidates(text, False)
    chosen = []
    near = {p: 0.0 for p in cand}
    for step in range(min(limit, len(cand))):
        value = {p: cand[p][0] if step == 0 else (1 - d) * cand[p][0] - d * near[p] for p in cand if p not in chosen}
        best = min(value, key=lambda p: (-value[p], p))
        chosen.append(best)
        g = cand[best][1]
        for p in cand:
            h = cand[p][1]
            dot = sum(c * h[w] for w, c in g.items())
            near[p] = max(near[p], dot / math.sqrt(sum(c * c for c in g.values()) * sum(c * c for c in h.values())))
    return sorted(chosen, key=lambda p: (-math.floor(cand[p][0] * 1e4 + 0.5) / 1e4, p))[:top_k]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string, label int")


@pytest.mark.parametrize("profile", [EXTRACT, INFER])
def test_candidates_and_scores(corpus, profile):
    got = {}
    for r in oc.score_texts(oc.distinct_texts(corpus), profile, custom_stop_words()).collect():
        got.setdefault(bytes(r["text_key"]), {})[r["phrase"]] = r["score"]
    for text in TEXTS:
        want = brute_candidates(text, profile.banded) if len(text.strip()) >= profile.min_chars else {}
        assert got.get(key(text), {}) == {p: s for p, (s, _) in want.items()}, text


def test_extraction(corpus):
    got = {}
    for r in op.extract_phrases(oc.distinct_texts(corpus)).orderBy("rank").collect():
        got.setdefault(bytes(r["text_key"]), []).append(r["phrase"])
    for text in TEXTS:
        assert got.get(key(text), []) == brute_extract(text), text


def test_counts_follow_copies_and_labels(corpus):
    want = {}
    for _, text, label in CORPUS:
        for p in brute_extract(text) if text else []:
            c = want.setdefault(p, [0, 0, 0])
            c[0] += 1
            c[1 if label == 1 else 2] += 1
    got = {r["phrase"]: [r["total_frequency"], r["hate_count"], r["non_hate_count"]] for r in op.phrase_counts(corpus).collect()}
    assert got == want
    report = op.phrase_report(op.phrase_counts(corpus)).collect()
    assert {r["phrase"] for r in report} == {p for p, c in want.items() if c[0] >= 3}
    assert all(r["hate_count"] + r["non_hate_count"] == r["total_frequency"] for r in report)


@pytest.mark.parametrize("partitions", ["1", "8", "64"])
def test_partitioning_does_not_matter(spark, corpus, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = sorted(map(tuple, op.phrase_counts(corpus).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, op.phrase_counts(corpus.repartition(3)).collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_diverse_phrases(corpus):
    got = {}
    for r in mmr.diverse_phrases(oc.distinct_texts(corpus, None)).orderBy("rank").collect():
        got.setdefault(bytes(r["text_key"]), []).append(r["phrase"])
    for text in TEXTS:
        want = brute_mmr(text, 10, 0.7, 5) if text.strip() else []
        assert got.get(key(text), []) == want, text


@given(st.lists(st.lists(st.integers(0, 20), max_size=30), min_size=1, max_size=5))
@hsettings(max_examples=50, deadline=None)
def test_without_diversity_the_best_scores_win(texts):
    score = np.array([s for t in texts for s in t], dtype=float)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    words = np.stack([np.arange(len(score)), *[np.full(len(score), -1)] * 3], axis=1)
    picks = mmr.greedy_picks(text, score, np.ones(len(score), int), words, 10, 0.0)
    best = [sorted(np.flatnonzero(text == i), key=lambda r: (-score[r], r))[:10] for i in range(len(texts))]
    assert sorted(picks) == sorted(r for rows in best for r in rows)


def test_slices_and_copies_do_not_matter(spark, monkeypatch):
    """Texts cut into slices of one, copies within a batch, and a text without any word give what whole batches give."""
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, mmr.diverse_phrases(docs, carry=("doc_id",)).collect()))
    assert {r[0] for r in want} == {i for i, t in rows if brute_candidates(t, False) and t.strip()}
    assert {tuple(r[1:]) for r in want if r[0] == 0} == {tuple(r[1:]) for r in want if r[0] == len(TEXTS)}
    monkeypatch.setattr(oc, "SLICE_TOKENS", 1)
    assert sorted(map(tuple, mmr.diverse_phrases(docs, carry=("doc_id",)).collect())) == want


def test_stop_phrases_are_dropped(spark):
    df = spark.createDataFrame([("Not",), ("not me",)], "phrase string")
    assert [r[0] for r in mmr.drop_stop_phrases(df, ["not"]).collect()] == ["not me"]


def test_boost_ties_keep_rank(spark):
    """Scores that are equal to four decimals, and boosted ones that become equal, stay in the order of the exact scores."""
    profile = ExtractProfile(4, 1, False, 1.0, None)
    text = " ".join(["bb"] * 1000 + ["aa"] * 1001 + ["cc"] * 1000 + ["dd"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chosen = [r["phrase"] for r in op.extract_phrases(docs, profile, [], ("doc_id",), ["bb"]).orderBy("rank").collect()]
    exact = sorted(brute_candidates(text, False).items(), key=lambda x: (-x[1][0], x[0]))[:8]
    assert chosen == [p for p, _ in sorted(exact, key=lambda x: -math.floor(x[1][0] * 1e4 + 0.5))][:4]
    boosted = [r["phrase"] for r in op.extract_phrases(docs, ExtractProfile(4, 1, False, 2.0, None), [], ("doc_id",), ["bb"]).orderBy("rank").collect()]
    assert all("bb" in p.split() for p in boosted[:2])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_needs_no_exchange_and_tokenises_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("label"))
    for chosen in (op.extract_phrases(docs), mmr.diverse_phrases(docs), oc.score_texts(docs, EXTRACT, [])):
        text = plan(chosen)
        assert "Exchange" not in text and "Sort" not in text and text.count("regexp_extract_all(lower(") == 1
        assert "ReadSchema: struct<text:string>" in text
    counts = plan(op.phrase_counts(docs))
    assert counts.count("Exchange") == 1 and "Exchange hashpartitioning(phrase" in counts


def test_candidates_are_counted_where_texts_are_read(spark):
    """Numbers, first and last n-grams of texts against all their n-grams, copies and short texts included."""
    rows = [(1, "one two three one two, Über_die über 9 ab abc ab_c ab"), (2, "one"), (3, None), (4, "b a"), (5, "b a"), (6, " ".join(f"w{i % 7}x{i}" for i in range(40)))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    every = oc.score_texts(texts, EXTRACT, ["one"], ("doc_id",)).groupBy("doc_id", "n").agg(
        F.count("*").alias("candidates"), F.min("phrase"), F.max("phrase")).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, oc.count_candidates(texts, EXTRACT, ["one"], ("doc_id",)).collect())) and every

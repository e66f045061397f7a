"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least four times as long as q, that no neighbouring word extends.
All texts of an Arrow batch are one sequence of word numbers, with a number of its own between two texts, and go through
the dyadic scales T = 2, 4, 8, ... together; scale T finds the periods from 1.5 T up to 3 T, exclusive:

* A position is highly periodic at scale T if the T words from it on have a period of at most T/4. They then lie in a
  run found at a smaller scale, or in one of the periods 1 and 2, which are detected separately by comparing each word
  with the next two.
* The synchronising set has the positions i for which the smallest hash of T words starting in i..i+T, highly periodic
  positions left out, is that of i or of i+T. Membership depends on the 2T words from i on only, its context, so equal
  contexts are chosen alike; and of any T consecutive positions one is chosen, unless they lie in a highly periodic
  region. So a run of period q has a chosen position in its first q+T words, and its equal context is chosen q later,
  inside the run, because 2q + 3T <= 4q.
* Chosen positions with equal contexts at a distance q of that scale propose the period q. A proposal is extended word
  by word in both directions; it counts if the stretch has 4q words and its root is no power of a shorter word.

Hashes only propose; runs are found by comparing words, so the result is exact: a collision costs a comparison, and
equal contexts always have equal hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phraselens.llm.common import Coder, mixed

TIMES = 4               # a run is at least so many periods long
LEAST = 6               # and has at least so many words
RUNS = "array<struct<start:long,length:long,period:long>>"


def _stretches(equal: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of period q, from equal[i]: word i is the same as word i + q."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    start, end = edges[::2], edges[1::2] + q
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


def _extend(words: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from i on in direction step (1, -1) are the same as the word q after them; galloping."""
    last, done, size = (len(words) - q, 0, 64) if step > 0 else (i + 1, 0, 64)
    reach = last - i if step > 0 else i + 1
    while done < reach:
        size = min(size, reach - done)
        a = words[i + done:i + done + size] if step > 0 else words[i - done - size + 1:i - done + 1][::-1]
        b = words[i + q + done:i + q + done + size] if step > 0 else words[i + q - done - size + 1:i + q - done + 1][::-1]
        differs = np.flatnonzero(a != b)
        if len(differs):
            return done + int(differs[0])
        done += size
        size *= 2
    return done


def _primitive(words: np.ndarray, start: int, q: int) -> bool:
    """Whether the q words from start on, of a stretch with period q and at least 2q words, are no power of a shorter word."""
    rest, prime = q, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            p = q // prime
            if np.array_equal(words[start:start + q], words[start + p:start + p + q]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _joined(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2 * size words from hashes of size words."""
    after = np.concatenate([hashed[size:], np.zeros(min(size, len(hashed)), np.uint64)])
    return mixed(hashed * np.uint64(0xD6E8FEB86659FD93) + after + np.uint64(size))


def _periodic(found: list[tuple[int, int, int]], scale: int, n: int) -> np.ndarray:
    """Whether the `scale` words from a position on have a period of at most scale / TIMES."""
    start, length, q = np.array(found, np.int64).reshape(-1, 3).T
    inside = (TIMES * q <= scale) & (length >= scale)
    change = np.bincount(start[inside], minlength=n + 1) - np.bincount(start[inside] + length[inside] - scale + 1, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _chosen(words_hash: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising set: positions i where the least hash starting in i..i+scale is that of i or of i+scale."""
    most = np.iinfo(np.uint64).max
    masked = np.where(periodic, most, words_hash)
    if len(masked) <= scale:
        return np.zeros(0, np.int64)
    least = _window_min(masked, scale + 1)
    n = len(least)
    return np.flatnonzero((least != most) & ((least == masked[:n]) | (least == masked[scale:scale + n])))


def _proposals(chosen: np.ndarray, context: np.ndarray, scale: int) -> np.ndarray:
    """(period, position) rows of the chosen positions with equal contexts at a distance from 1.5 to 3 times the scale."""
    found, own, shift = [], context[chosen], 1
    while shift < len(chosen):
        distance = chosen[shift:] - chosen[:-shift]
        if not (distance < 3 * scale).any():
            break
        hit = (2 * distance >= 3 * scale) & (distance < 3 * scale) & (own[shift:] == own[:-shift])
        found.append(np.stack([distance[hit], chosen[:-shift][hit]], axis=1))
        shift += 1
    rows = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least TIMES periods, in one array of texts, by start.

    `lengths` are the numbers of words per text; `words` has one number after each text that occurs nowhere else.
    """
    found = []
    for q in (1, 2):
        for start, end in _stretches(words[:-q] == words[q:], q, TIMES * q):
            if q == 1 or words[start] != words[start + 1]:
                found.append((start, end - start, q))
    begins, scale = np.cumsum(lengths + 1) - lengths - 1, 1
    with np.errstate(over="ignore"):
        hashed = mixed(words.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        joined = _joined(hashed, scale)
        while True:
            scale, hashed = 2 * scale, joined           # of as many words as the scale says
            alive = 2 * lengths >= 3 * scale * TIMES    # a shorter text has no run of these periods
            if not alive.any():
                return sorted(set(found))
            joined = _joined(hashed, scale)
            high = _periodic(found, scale, len(words))
            low, top = begins[alive], begins[alive] + lengths[alive] + 1
            apart = low[1:] != top[:-1]                 # texts that stand side by side are looked at together
            for first, end in zip(low[np.append(True, apart)].tolist(), top[np.append(apart, True)].tolist()):
                chosen = _chosen(hashed[first:end], high[first:end], scale)
                last, until = 0, -1
                for q, i in _proposals(chosen, joined[first:end], scale).tolist():
                    i += first
                    if q == last and i + q < until:
                        continue                        # inside the stretch that was extended last
                    begin = i + 1 - _extend(words, i, q, -1)
                    until, last = i + q + _extend(words, i, q, 1), q
                    if until - begin >= TIMES * q and _primitive(words, begin, q):
                        found.append((begin, until - begin, q))


def _finder(least: int):
    schema = pa.schema([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def find(batches):
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch["text"].to_pylist()]
            coder = Coder()
            lengths = np.array([len(t) for t in texts], np.int64)
            begins = np.cumsum(lengths + 1) - lengths - 1
            words = np.empty(int(lengths.sum()) + len(texts), np.int64)
            words[begins + lengths] = -1 - np.arange(len(texts))
            for b, t in zip(begins.tolist(), texts):
                words[b:b + len(t)] = coder.codes(t)
            spans: list[list] = [[] for _ in texts]
            keep = np.ones(len(words), bool)
            for start, length, q in runs(words, lengths) if len(words) > 1 else []:
                if length >= least:
                    text = int(np.searchsorted(begins, start, "right")) - 1
                    spans[text].append({"start": start - int(begins[text]), "length": length, "period": q})
                    keep[start + q:start + length] = False
            collapsed = [b" ".join(t) if not s else b" ".join([w for w, k in zip(t, keep[b:b + len(t)].tolist()) if k])
                         for b, t, s in zip(begins.tolist(), texts, spans)]
            made = [pa.array(spans, schema.field("runs").type), pa.array([c.decode("utf-8", "surrogatepass") for c in collapsed], pa.string())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], ["doc_id", *schema.names])
    return find


def find_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs, collapsed: one row per row of documents, which has doc_id and text; other columns are ignored.

    runs are (start, length, period) in words, by start, then period: every stretch of smallest period q with at least
    `least` words and 4q words that no neighbouring word extends. collapsed is the text's words joined by one space,
    without those that a run contains after its first q. Null and empty texts have no word, no run and an empty result.
    A word is whatever stands between ASCII white space. Texts never meet, so there is no shuffle, no skew and no state;
    a text has to fit into one Python worker.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _finder(least), f"doc_id long, runs {RUNS}, collapsed string")


def text_words(text: Column) -> Column:
    """The words of a text as an array; empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def with_periodic_tails(documents: DataFrame) -> DataFrame:
    """doc_id, text: every tenth text by its id's checksum repeats itself from a word on that the checksum names."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    parts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), (F.coalesce(h % 10, F.lit(1)) == 0).alias("tail"))
    # A generator keeps the word array from being computed again for every word.
    listed = parts.select("doc_id", "text", "g", "tail", F.explode(F.array(F.when(F.col("tail"), text_words(F.col("text"))))).alias("w"))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    bound = listed.select("doc_id", "text", "w", n.alias("n"), F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"), "tail")
    repeated = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return bound.select("doc_id", F.when(F.col("tail") & (F.col("n") > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length/period (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.select("*", best.alias("best"), lines.alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.expr("(1000 * best.length) div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

"""Benchmark decontamination: a BM25 index of the test items with block-max WAND, then question and answer overlap.

Every text is cut into passages of two steps of as many words as the longest item has, one step apart, so that each
stretch as long as an item lies in a passage. A passage is a query to the index of items; an item's score is the BM25
sum over the words it shares with the passage, as a share of the item's score for itself, so it reads the same for
short and long items. All items above a share of THRESHOLD are retrieved.

WAND runs over a batch of passages at a time: passages whose sum of word maxima stays below the threshold are skipped,
then blocks of BLOCK items whose sum of block maxima does; items are scored in the blocks that are left. Both sums are
upper bounds, so nothing above the threshold is missed. A retrieved item counts when the passage also holds the given
shares of the word trigrams of its question and of its answer, or nearly all trigrams of the whole item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phraselens.llm.common import MARKS, Coder, shared, words
from phraselens.session import written

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.6
WHOLE_MISSING = 0.25            # share of all the item's trigrams
SHORT_ANSWER = 5                # words
MIN_WORDS = 8                   # shorter items are too common to prove a leak and are left out
BLOCK = 16
CELLS = 1 << 20                 # passages and items scored at a time
INDEX_BYTES = 64 << 20          # one broadcast index as built
WORD_BYTES, TERM_BYTES = 64, 160    # at most: of each word its code, posting and entry; of each term its place in the dictionary

HITS = "doc_id long, same long, n_passages long, n_retrieved long, score double, items array<long>"


def terms(tokens: list[bytes]) -> list[bytes]:
    """Words without marks around them; what is nothing but marks goes."""
    return [w for w in (t.strip(MARKS) for t in tokens) if w]


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is an item's last line or, if it has one line, its last sentence or else the last quarter of its words."""
    lines = [x for x in text.split("\n") if terms(words(x))]
    if len(lines) < 2:
        lines = [x for x in text.replace("? ", "?\n").replace(". ", ".\n").split("\n") if terms(words(x))]
    if len(lines) < 2:
        whole = terms(words(text))
        return whole[:-(len(whole) // 4)], whole[-(len(whole) // 4):]
    return terms(words(" ".join(lines[:-1]))), terms(words(lines[-1]))


def grams(sequence: list, size: int = 3) -> set:
    size = min(size, len(sequence))
    return {tuple(sequence[i:i + size]) for i in range(len(sequence) - size + 1)} if size else set()


class Index:
    """Postings of the items of one group by term, cut into blocks of BLOCK items; numbers are float64 throughout.

    Postings lie term by term in item order: items and impacts. Entry e is the part of one term in one block: block[e],
    its maximum top[e], its postings from starts[e] to starts[e + 1]; term t has the entries from edges[t] to edges[t + 1].
    """

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], total: int, mean: float):
        self.ids = [i for i, _ in items]
        coder = Coder()
        self.parts = [tuple(coder.codes(p).astype(np.int32) for p in question_answer(t)) for _, t in items]
        self.term = dict(coder)
        idf = np.log1p([(total - frequency[w] + 0.5) / (frequency[w] + 0.5) for w in coder])
        term, item, impact = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for n, parts in enumerate(self.parts):
            found, count = np.unique(np.concatenate(parts), return_counts=True)
            weight = idf[found] * count * (K1 + 1) / (count + K1 * (1 - B + B * sum(map(len, parts)) / mean))
            term.append(found), item.append(np.full(len(found), n, np.int32)), impact.append(weight / weight.sum())
        term, item, impact = map(np.concatenate, (term, item, impact))
        order = np.argsort(term, kind="stable")
        term, self.items, self.impacts = term[order], item[order], impact[order]
        block = self.items // BLOCK
        begins = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
        self.block = block[begins]
        self.top = np.maximum.reduceat(self.impacts, begins) if len(begins) else np.zeros(0)
        self.starts = np.append(begins, len(term))
        self.edges = np.searchsorted(term[begins], np.arange(len(coder) + 1))
        self.term_max = np.maximum.reduceat(self.top, self.edges[:-1]) if len(coder) else np.zeros(0)


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    size = end - first
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _different(keys: np.ndarray) -> np.ndarray:
    """The different keys in ascending order."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def leaked(passage: list[int], question: list[int], answer: list[int], question_share: float, answer_share: float) -> bool:
    """Whether the passage holds the shares of both parts, or all of the item but WHOLE_MISSING of its trigrams or one word.

    No answer is marked, so that the whole item decides too. Answers of at most SHORT_ANSWER words match by words.
    """
    def held(part, size):
        wanted = grams(part, size)
        size = min(size, len(part))
        return len(wanted & grams(passage, size)), len(wanted)
    (q, n_q), (a, n_a) = held(question, 3), held(answer, 1 if len(answer) <= SHORT_ANSWER else 3)
    if q >= question_share * max(n_q, 1) and a >= answer_share * max(n_a, 1):
        return True
    found, wanted = held(question + answer, 3)
    return wanted - found <= max(3, WHOLE_MISSING * wanted)


def _above(index, begins: np.ndarray, edges: np.ndarray, follows: np.ndarray, term: np.ndarray, threshold: float) -> tuple[list, list, list]:
    """(first step, item, score) of all passages and items above the threshold; a passage is a step and the one that follows it.

    All passages together: their different terms, then the bounds of their blocks, then the postings of the blocks that are left.
    """
    n_terms, n_blocks, n_items = len(index.term_max), -(-len(index.ids) // BLOCK), len(index.ids)
    low, high = edges[begins], edges[begins + 1 + follows[begins]]
    held = _different(np.repeat(np.arange(len(begins)) * n_terms, high - low) + term[_ranges(low, high)])
    passage, mine = held // n_terms, held % n_terms
    entries = _ranges(index.edges[mine], index.edges[mine + 1])
    passage = np.repeat(passage, index.edges[mine + 1] - index.edges[mine])
    cell = passage * n_blocks + index.block[entries]
    live = np.bincount(cell, index.top[entries], len(begins) * n_blocks) >= threshold
    entries, passage = entries[live[cell]], passage[live[cell]]
    postings = _ranges(index.starts[entries], index.starts[entries + 1])
    passage = np.repeat(passage, index.starts[entries + 1] - index.starts[entries])
    scores = np.bincount(passage * n_items + index.items[postings], index.impacts[postings], 0)
    above = np.flatnonzero(scores >= threshold)
    return begins[above // n_items].tolist(), (above % n_items).tolist(), scores[above].tolist()


def _finder(sent, step: int, threshold: float, question_share: float, answer_share: float):
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("n_passages", pa.int64()), ("n_retrieved", pa.int64()),
                        ("score", pa.float64()), ("items", pa.list_(pa.int64()))])

    def find(batches):
        index = sent.value
        for batch in batches:
            coder = Coder()
            codes = [coder.codes(words(t)) for t in batch["text"].to_pylist()]
            vocabulary = [w.strip(MARKS) for w in coder]
            term_of = np.array([index.term.get(w, -1) for w in vocabulary] + [-1], np.int64)
            solid = np.array([bool(w) for w in vocabulary] + [False])
            codes = [c[solid[c]] for c in codes]            # words that are only marks are no words
            steps = np.array([-(-len(c) // step) for c in codes], np.int64)
            first = np.cumsum(steps) - steps                # number of each text's first step
            passages = np.maximum(steps - 1, (steps > 0).astype(np.int64))
            n_steps, n_terms = int(steps.sum()), len(index.term_max)
            retrieved, best = np.zeros(len(codes), np.int64), np.zeros(len(codes))
            items: list[set] = [set() for _ in codes]
            if n_steps and n_terms:
                at = np.concatenate([f + np.arange(len(c)) // step for f, c in zip(first, codes)])
                term = term_of[np.concatenate(codes)]
                held = _different(at[term >= 0] * n_terms + term[term >= 0])
                at, term = held // n_terms, held % n_terms
                bound = np.bincount(at, index.term_max[term], n_steps)
                text_of = np.repeat(np.arange(len(codes)), steps)
                follows = np.append(text_of[1:] == text_of[:-1], False)
                begins = np.flatnonzero(follows | (np.repeat(steps, steps) == 1))
                pair = bound[begins] + np.where(follows[begins], np.append(bound, 0.0)[begins + 1], 0.0)
                edges = np.searchsorted(at, np.arange(n_steps + 1))
                hopeful = begins[pair >= threshold]
                size = max(1, CELLS // max(len(index.ids), 1))
                for part in (hopeful[i:i + size] for i in range(0, len(hopeful), size)):
                    for b, n, score in zip(*_above(index, part, edges, follows, term, threshold)):
                        text = text_of[b]
                        place = (b - first[text]) * step
                        passage = term_of[codes[text][place:place + 2 * step]].tolist()
                        retrieved[text] += 1
                        if leaked(passage, *(p.tolist() for p in index.parts[n]), question_share, answer_share):
                            items[text].add(index.ids[n])
                            best[text] = max(best[text], score)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["same"], pa.array(passages), pa.array(retrieved), pa.array(best),
                 pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], schema=schema)
    return find


def _terms_udf(batches):
    for batch in batches:
        lists = [terms(words(t)) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(lists, pa.list_(pa.binary()))], ["item_id", "terms"])


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question_share: float = QUESTION_SHARE,
               answer_share: float = ANSWER_SHARE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, text_hash, n_passages, n_retrieved, score, items, contaminated: one row per row of documents.

    documents has doc_id and text, benchmark item_id and text; text_hash is xxhash64 of the text. Other columns are ignored. items are the ids of the
    items found, score the best of theirs (0 without one). Items that are null, or have fewer than MIN_WORDS words, are
    left out; null and empty texts have no passage. Repeated items are all reported. Statistics are those of the whole
    benchmark; the index is broadcast in groups of items of about index_bytes of built index, each of which is one pass
    over the documents; there are at most as many groups as items.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    listed = items.mapInArrow(_terms_udf, "item_id long, terms array<binary>").where(F.size("terms") >= MIN_WORDS)
    total, mean, longest, size = listed.agg(
        F.count("*"), F.avg(F.size("terms")), F.max(F.size("terms")), F.sum(F.size("terms").cast("long"))).first()
    frequency = listed.select(F.explode(F.array_distinct("terms")).alias("w")).groupBy("w").count()
    terms_size = frequency.agg(F.sum(F.octet_length("w") + TERM_BYTES)).first()[0]
    groups = min(1 + ((size or 0) * WORD_BYTES + (terms_size or 0)) // index_bytes, max(total, 1))
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
    found = None
    for g in range(groups):
        chosen = [(r["item_id"], r["text"]) for r in items.where(group == g).toLocalIterator() if len(terms(words(r["text"]))) >= MIN_WORDS]
        own = listed.where(group == g).select(F.explode(F.array_distinct("terms")).alias("w")).distinct()
        counts = {bytes(r["w"]): r["count"] for r in frequency.join(own, "w").toLocalIterator()}
        index = shared(spark, Index(sorted(chosen), counts, total, mean or 1.0))
        part = texts.mapInArrow(_finder(index, longest or 1, threshold, question_share, answer_share), HITS)
        if groups > 1:
            # One group at a time: its hits are stored and its index is freed before the next is built.
            # Equal rows are answered alike.
            part = written(part.dropDuplicates(["doc_id", "same"]), "leaks-of-group")
            index.unpersist()
        found = part if found is None else found.unionAll(part)
    if groups > 1:
        key = [F.col("doc_id"), F.col("same")]
        summed = found.groupBy(*key).agg(
            F.max("n_passages").alias("n_passages"), F.sum("n_retrieved").alias("n_retrieved"), F.max("score").alias("score"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        rows = documents.select(F.col("doc_id").cast("long").alias("r_id"), F.xxhash64("text").alias("r_same"))
        found = rows.join(summed, F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_same") == F.col("same"))).drop("r_id", "r_same")
    return found.select("doc_id", F.col("same").alias("text_hash"), "n_passages", "n_retrieved", "score", "items", (F.size("items") > 0).alias("contaminated"))

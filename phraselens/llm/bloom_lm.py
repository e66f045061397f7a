"""A bigram language model whose counts live in a log-frequency Bloom filter.

A pair of words with count c goes into the filter as the entries (pair, 1) ... (pair, q), q = 1 + floor(log2 c). Probing
(pair, 1), (pair, 2), ... until the first miss gives q back, hence the count to within a factor of two; a pair never
seen passes a probe with probability 2 ** -PROBES. The probability of a word is
    P(w | h) = l * count(h, w) / count(h) + (1 - l) * P(w),
P(w) being the half-smoothed word frequency and 1 - l the Good-Turing share of pairs seen once; after a word without
training count it is P(w).

Flow: the texts are coded block by block (a block is one Arrow batch) and written; word counts are summed in shards of
the vocabulary and sent back to the blocks, so a common word costs a number per block and not a row per document.
Pairs are counted per block, dealt to segments by their hash and turned into one piece of the filter per segment.
Segments are broadcast in groups of at most BROADCAST_BYTES; each group scores the pairs that it holds, and the partial
sums of a document add up. The filter grows with the corpus, a single broadcast does not.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from phraselens.llm.common import Coder, mixed, word_hashes, words
from phraselens.session import written

PROBES = 8
SEGMENT_BYTES = 24 << 20        # text per filter segment
SHARD_BYTES = 48 << 20          # text per vocabulary shard
BROADCAST_BYTES = 96 << 20
PART = 1 << 18                  # prints whose bits are found at a time
END = b"\n"                     # no word holds white space, so this can stand for the end of a text

CODED = ("kind int, block string, row int, doc_id long, held boolean, codes binary, shard int, words binary, counts binary")
REPLY = "block string, shard int, counts binary, n long, v long"
PAIRS = "segment int, prints binary, counts binary"
FILTER = "segment int, bits long, filter binary, pairs long, singles long"
SCORES = ("block string, row int, doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double")


def coded(texts: list[str | None]) -> tuple[Coder, list[np.ndarray]]:
    coder = Coder({END: 0})
    return coder, [coder.codes([*words(t), END]) for t in texts]


def shards_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(shards)).astype(np.int64)


def pair_hashes(hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(hashes[left] * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[right]))


def prints_of(pairs: np.ndarray) -> np.ndarray:
    """40 bits of a pair's hash; the segment comes from the other bits."""
    return pairs & np.uint64((1 << 40) - 1)


def segments_of(pairs: np.ndarray, segments: int) -> np.ndarray:
    return ((pairs >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)      # 1 + floor(log2 c)


def bit_positions(prints: np.ndarray, level: int, bits, probe: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        first = mixed(prints * np.uint64(64) + np.uint64(level))
        step = mixed(first) | np.uint64(1)
        return (first + np.uint64(probe) * step) % bits


def build_filter(prints: np.ndarray, counts: np.ndarray, probes: int) -> tuple[int, bytes]:
    levels = levels_of(counts)
    bits = max(8, math.ceil(int(levels.sum()) * probes / math.log(2)))
    cells = np.zeros(bits, np.bool_)
    for level in range(1, int(levels.max(initial=0)) + 1):
        stored = prints[levels >= level]
        for start in range(0, len(stored), PART):
            for probe in range(probes):
                cells[bit_positions(stored[start:start + PART], level, np.uint64(bits), probe)] = True
    return bits, np.packbits(cells, bitorder="little").tobytes()


def probe_filter(table: np.ndarray, offsets: np.ndarray, bits: np.ndarray, prints: np.ndarray, probes: int) -> np.ndarray:
    """Levels found for prints whose segment starts at byte offset `offsets` and has `bits` bits."""
    levels, left, level = np.zeros(len(prints), np.int64), np.arange(len(prints)), 0
    while len(left):
        level += 1
        for probe in range(probes):
            at = bit_positions(prints[left], level, bits[left], probe)
            byte = table[offsets[left] + (at >> np.uint64(3)).astype(np.int64)]
            left = left[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        levels[left] = level
    return levels


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


CODED_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.string()), ("row", pa.int32()), ("doc_id", pa.int64()),
                         ("held", pa.bool_()), ("codes", pa.binary()), ("shard", pa.int32()), ("words", pa.binary()),
                         ("counts", pa.binary())])


def _coder(shards: int):
    def code(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            block, held = f"{part}-{number}", batch["held"].to_pylist()
            number += 1
            coder, codes = coded(batch["text"].to_pylist())
            n = len(codes)
            yield _batch({"kind": [0] * n, "block": [block] * n, "row": list(range(n)), "doc_id": batch["doc_id"].to_pylist(),
                          "held": held, "codes": [c.astype(np.int32).tobytes() for c in codes]}, CODED_ARROW)
            train = [c for c, h in zip(codes, held) if not h]
            counts = np.bincount(np.concatenate(train) if train else np.empty(0, np.int64), minlength=len(coder))
            vocabulary = list(coder)
            shard = shards_of(word_hashes(vocabulary), shards)
            order, found = np.argsort(shard, kind="stable"), np.unique(shard)
            bounds = np.searchsorted(shard[order], found, "left").tolist() + [len(order)]
            own = [order[a:b] for a, b in zip(bounds, bounds[1:])]
            yield _batch({"kind": [1] * len(own), "block": [block] * len(own), "shard": found.tolist(),
                          "words": [b" ".join([vocabulary[i] for i in o.tolist()]) for o in own],
                          "codes": [o.astype(np.int32).tobytes() for o in own],
                          "counts": [counts[o].astype(np.int64).tobytes() for o in own]}, CODED_ARROW)
    return code


def _sum_shard(table: pa.Table) -> pa.Table:
    coder = Coder()
    codes = [coder.codes(w.split(b" ")) for w in table["words"].to_pylist()]
    total = np.zeros(len(coder), np.int64)
    for c, n in zip(codes, table["counts"].to_pylist()):
        total[c] += np.frombuffer(n, np.int64)      # the words of a row are different
    rows = len(codes)
    return pa.table({"block": pa.array([*table["block"].to_pylist(), None], pa.string()),
                     "shard": pa.array([table["shard"][0].as_py()] * (rows + 1), pa.int32()),
                     "counts": pa.array([*(total[c].tobytes() for c in codes), None], pa.binary()),
                     "n": pa.array([None] * rows + [int(total.sum())], pa.int64()),
                     "v": pa.array([None] * rows + [int((total > 0).sum())], pa.int64())})


def _pair_counter(segments: int):
    schema = pa.schema([("segment", pa.int32()), ("prints", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        for batch in batches:
            coder, codes = coded(batch["text"].to_pylist())
            hashes = word_hashes(list(coder))
            right = np.concatenate(codes)
            left = np.concatenate([np.concatenate(([0], c[:-1])) for c in codes])
            pairs, counts = np.unique(left * len(coder) + right, return_counts=True)
            pairs = pair_hashes(hashes, pairs // len(coder), pairs % len(coder))
            segment = segments_of(pairs, segments)
            order, found = np.argsort(segment, kind="stable"), np.unique(segment)
            bounds = np.searchsorted(segment[order], found, "left").tolist() + [len(order)]
            own = [order[a:b] for a, b in zip(bounds, bounds[1:])]
            narrow = prints_of(pairs)
            yield _batch({"segment": found.tolist(),
                          "prints": [narrow[o].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for o in own],
                          "counts": [counts[o].astype(np.int32).tobytes() for o in own]}, schema)
    return count


def counted_prints(pieces: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Different prints in ascending order and the sums of their counts.

    A print has 40 bits and a count goes into the other 24, as several parts of it if it must, so that both are sorted in place.
    """
    most, packed = (1 << 24) - 1, []
    for prints, counts in pieces:
        wide = np.zeros((len(counts) // 4, 8), np.uint8)
        wide[:, 3:] = np.frombuffer(prints, np.uint8).reshape(-1, 5)
        wide, left = wide.view(np.uint64).ravel(), np.frombuffer(counts, np.int32).astype(np.int64)
        while len(left):
            packed.append(wide | np.minimum(left, most).astype(np.uint64))
            wide, left = wide[left > most], left[left > most] - most
    both = np.concatenate(packed) if packed else np.zeros(0, np.uint64)
    packed.clear()
    both.sort()
    first = np.ones(len(both), bool)
    first[1:] = both[1:] >> np.uint64(24) != both[:-1] >> np.uint64(24)
    starts = np.flatnonzero(first)
    prints = both[starts] >> np.uint64(24)
    both &= np.uint64(most)
    return prints, np.add.reduceat(both, starts).astype(np.int64) if len(both) else np.zeros(0, np.int64)


def _segment_filter(probes: int):
    def build(table: pa.Table) -> pa.Table:
        prints, counts = counted_prints([*zip(table["prints"].to_pylist(), table["counts"].to_pylist())])
        bits, cells = build_filter(prints, counts, probes)
        return pa.table({"segment": pa.array([table["segment"][0].as_py()], pa.int32()), "bits": [bits], "filter": [cells],
                         "pairs": [int(counts.sum())], "singles": [int((counts == 1).sum())]})
    return build


def _scorer(shared, segments: int, first: int, last: int, total: int, distinct: int, trust: float, probes: int):
    """Sums over the pairs whose segment lies in [first, last); the other columns are whole each time."""
    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        table, starts, sizes = shared.value
        of_shard = dict(zip(replies["shard"].to_pylist(), replies["counts"].to_pylist()))
        is_doc = np.asarray(texts["kind"]) == 0
        lists, docs = texts.filter(pa.array(~is_doc)), texts.filter(pa.array(is_doc))
        place = np.concatenate([np.frombuffer(x, np.int32) for x in lists["codes"].to_pylist()])
        known, hashes = np.empty(len(place), np.int64), np.empty(len(place), np.uint64)
        known[place] = np.concatenate([np.frombuffer(of_shard[x], np.int64) for x in lists["shard"].to_pylist()])
        hashes[place] = word_hashes([w for x in lists["words"].to_pylist() for w in x.split(b" ")])
        plain = (known + 0.5) / (total + 0.5 * (distinct + 1))
        codes = [np.frombuffer(x, np.int32).astype(np.int64) for x in docs["codes"].to_pylist()]
        sizes_of = np.array([len(c) for c in codes])
        begins = np.cumsum(sizes_of) - sizes_of
        right = np.concatenate(codes)
        left = np.concatenate([np.concatenate(([0], c[:-1])) for c in codes])
        pairs, where = np.unique(left * len(place) + right, return_inverse=True)
        h, w = pairs // len(place), pairs % len(place)
        hashed = pair_hashes(hashes, h, w)
        segment = segments_of(hashed, segments)
        ours = (segment >= first) & (segment < last)
        seen = np.flatnonzero(ours & (known[h] > 0) & (known[w] > 0))
        levels = probe_filter(table, starts[segment[seen] - first], sizes[segment[seen] - first], prints_of(hashed[seen]), probes)
        counts = np.zeros(len(pairs))
        counts[seen] = np.where(levels > 0, np.ldexp(1.0, np.maximum(levels - 1, 0)), 0.0)
        counts = np.minimum(counts, np.minimum(known[h], known[w]))
        p = np.where(known[h] > 0, trust * counts / np.maximum(known[h], 1) + (1 - trust) * plain[w], plain[w])
        term = np.where(ours, np.log10(p, out=np.zeros_like(p), where=p > 0), 0.0)
        return pa.table({
            "block": docs["block"], "row": docs["row"], "doc_id": docs["doc_id"], "held": docs["held"],
            "n_tokens": pa.array(sizes_of, pa.int64()),
            "n_known": pa.array(np.add.reduceat((known > 0)[right].astype(np.int64), begins), pa.int64()),
            "base_score": pa.array(np.add.reduceat(np.log10(plain)[right], begins)),
            "score": pa.array(np.add.reduceat(term[where.ravel()], begins))})
    return score


def score(documents: DataFrame, held_out, probes: int = PROBES, segment_bytes: int = SEGMENT_BYTES,
          shard_bytes: int = SHARD_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of documents.

    documents has doc_id and text; held_out is a Boolean column expression over it: those rows are scored but not
    learned from (null counts as false). Tokens are the lower-cased words and one end per text, so a null or empty text
    has one token. base_score uses word frequencies alone, score the bigram model. Repeated rows are learned repeatedly.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments, shards = 1 + size // segment_bytes, 1 + size // shard_bytes
    code = written(docs.mapInArrow(_coder(shards), CODED), "lm-coded")
    replies = written(code.where("kind = 1").select("block", "shard", "words", "counts").groupBy("shard")
                      .applyInArrow(_sum_shard, REPLY), "lm-counts")
    total, distinct = replies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    replies = replies.where("block is not null").select("block", "shard", "counts")
    pieces = written(docs.where("not held").select("text").mapInArrow(_pair_counter(segments), PAIRS).groupBy("segment")
                     .applyInArrow(_segment_filter(probes), FILTER), "lm-filter")
    pairs, singles, longest = pieces.agg(F.sum("pairs"), F.sum("singles"), F.max(F.length("filter"))).first()
    trust = 1 - singles / pairs if pairs else 0.0
    group = max(1, broadcast_bytes // longest) if longest else segments

    parts = []
    for first in range(0, segments, group):
        last = min(first + group, segments)
        sizes, cells = np.full(last - first, 8, np.uint64), [b"\0"] * (last - first)
        for piece in pieces.where(F.col("segment").between(first, last - 1)).select("segment", "bits", "filter").toLocalIterator():
            sizes[piece["segment"] - first], cells[piece["segment"] - first] = piece["bits"], bytes(piece["filter"])
        lengths = np.array([len(c) for c in cells])
        shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(cells), np.uint8), np.cumsum(lengths) - lengths, sizes))
        del cells
        parts.append(code.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
            _scorer(shared, segments, first, last, total, distinct, trust, probes), SCORES))
    if len(parts) == 1:
        scored = parts[0]
    else:
        scored = reduce(DataFrame.unionAll, parts).groupBy("block", "row", "doc_id", "held", "n_tokens", "n_known").agg(
            F.max("base_score").alias("base_score"), F.sum("score").alias("score"))
    return scored.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

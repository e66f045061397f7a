"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature holds SYMBOLS minima of a document's shingles. The first CHUNKS * WIDTH of them, BITS bits each, are the
index: two documents that differ in fewer than CHUNKS * 2 of these symbols differ in at most one symbol of some chunk
(pigeonhole), so they share one of that chunk's keys "all symbols but one". At similarity 0.75 a pair shares no key with
probability (1 - 0.738) ** 8 = 2e-5. All SYMBOLS, two bits each, are compared as bit planes where documents meet: a pair
that differs in more symbols than SLACK standard deviations above what the threshold lets expect (probability 3e-5) is
no candidate. Every candidate is decided on the full shingle sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phraselens.llm.common import Coder, components, mixed, small, word_hashes, words
from phraselens.session import written

SHINGLE = 5
SIMILARITY = 75          # percent
CHUNKS, WIDTH, BITS = 8, 4, 16
SYMBOLS, SLACK = 512, 4.0
STAR_ROUNDS, LEADERS = 1, 4
PIECE = 1 << 16          # shingles whose minima are taken at a time, to stay in the processor's cache

SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, index array<long>, planes array<long>"
SHINGLES = "doc_id long, shingles binary"


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted different shingle hashes of each text, one after the other, and how many each has."""
    coder = Coder()
    codes = [coder.codes(words(t)) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    if not coder:
        return np.empty(0, np.uint64), sizes
    h = mixed(word_hashes(list(coder)))[np.concatenate(codes)]
    n = len(h)
    rolled, factor = np.zeros(max(n - width + 1, 0), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(width if len(rolled) else 0):
        rolled = rolled * factor + h[i:n - width + 1 + i]
    rolled = mixed(rolled)
    sets, start = [], 0
    for size in sizes.tolist():
        if size >= width:
            sets.append(np.unique(rolled[start:start + size - width + 1]))
        elif size:
            whole = np.uint64(size)
            for x in h[start:start + size]:
                whole = whole * factor + x
            sets.append(mixed(np.array([whole ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
        start += size
    return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def minima(hashes: np.ndarray, sizes: np.ndarray, symbols: int) -> np.ndarray:
    """(rows x symbols) minima of 32-bit hash functions over sets of positive sizes."""
    factors = np.random.default_rng(7).integers(0, 2**31, symbols, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    narrow, out = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((len(sizes), symbols), np.uint32)
    ends = np.cumsum(sizes)
    row = begin = 0
    while row < len(sizes):
        last = max(row + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        piece, starts = narrow[begin:ends[last - 1]], ends[row:last] - sizes[row:last] - begin
        for k in range(symbols):
            out[row:last, k] = np.minimum.reduceat(piece * factors[k], starts)
        row, begin = last, int(ends[last - 1])
    return out


def band_keys(symbols: np.ndarray, chunks: int, width: int, bits: int) -> np.ndarray:
    """Keys (rows x chunks*width) of mixed minima (rows x chunks*width)."""
    symbols = (symbols & np.uint64((1 << bits) - 1)).reshape(len(symbols), chunks, width)
    keys = np.empty(symbols.shape, np.uint64)
    for left_out in range(width):
        key = np.broadcast_to(np.arange(chunks, dtype=np.uint64) * np.uint64(width) + np.uint64(left_out + 1),
                              symbols.shape[:2])
        for i in range(width):
            if i != left_out:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, :, i])
        keys[:, :, left_out] = key
    return keys.reshape(len(symbols), -1)


def packed(symbols: np.ndarray, chunks: int, width: int, bits: int) -> np.ndarray:
    """The symbols of each chunk side by side in one 64-bit word."""
    symbols = (symbols & np.uint64((1 << bits) - 1)).reshape(len(symbols), chunks, width)
    return np.bitwise_or.reduce(symbols << (np.arange(width, dtype=np.uint64) * np.uint64(bits)), axis=2).view(np.int64)


def bit_planes(symbols: np.ndarray) -> np.ndarray:
    """Two bits of every symbol: first all lower, then all upper bits, as 64-bit words (symbols per row: a multiple of 64)."""
    return np.concatenate([np.packbits(((symbols >> np.uint64(20 + bit)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                           for bit in (0, 1)], axis=1)


def _signer(width: int, chunks: int, symbols: int, bits: int, total: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("index", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))])

    def sign(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                hashes, sizes = shingle_sets(batch["text"].to_pylist(), width)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                s1, s2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                keys, index, planes = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
                if len(full):
                    s1[full] = np.add.reduceat(hashes, starts)
                    s2[full] = np.add.reduceat(mixed(hashes + np.uint64(1)), starts)
                    drawn = mixed(minima(hashes, sizes[full], total).astype(np.uint64) + np.uint64(1))
                    head = drawn[:, :chunks * symbols]
                    found = zip(full.tolist(), band_keys(head, chunks, symbols, bits).view(np.int64),
                                packed(head, chunks, symbols, bits), bit_planes(drawn))
                    for row, key, chunk, plane in found:
                        keys[row], index[row], planes[row] = key, chunk, plane
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(sizes), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(index, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))], schema=schema)
    return sign


def _setter(width: int):
    def sets(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                hashes, sizes = shingle_sets(batch["text"].to_pylist(), width)
            ends = np.cumsum(sizes).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([hashes[e - s:e].tobytes() for s, e in zip(sizes.tolist(), ends)], pa.binary())],
                ["doc_id", "shingles"])
    return sets


def _judge(percent: int):
    def judge(batches):
        for batch in batches:
            close = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                close.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(close, pa.bool_()))
    return judge


def _first_meeting(x: Column, y: Column, slot: Column, width: int, bits: int) -> Column:
    """Whether `slot` (chunk * width + symbol left out) is the first at which two indexes meet, so that a pair is made once."""
    ones = (1 << bits) - 1
    others = [~(ones << k * bits) & ((1 << 64) - 1) for k in range(width)]
    masks = [F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in others]

    def meets(a, b):
        return reduce(Column.__or__, [a.bitwiseXOR(b).bitwiseAND(m) == 0 for m in masks])
    chunk = F.floor(slot / width).cast("int") + 1
    return (F.array_position(F.zip_with(x, y, meets), True) == chunk) & (
        (F.element_at(x, chunk) != F.element_at(y, chunk)) | (slot % width == 0))


def _differing(x: Column, y: Column, words: int) -> Column:
    """In how many symbols two signatures differ."""
    return reduce(Column.__add__, [F.bit_count(x[i].bitwiseXOR(y[i]).bitwiseOR(x[i + words].bitwiseXOR(y[i + words])))
                                   for i in range(words)])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return written(x.join(small(pairs), "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(
        _judge(percent), "a long, b long"), "minhash-links")


def _listed(batches):
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch["shingles"].to_pylist()]
        ids = np.repeat(np.asarray(batch["doc_id"]), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets))], ["doc_id", "shingle"])


def _linkable(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Ids of the documents that can still have a link among the open ones.

    A document that shares a share of less than `percent` of its shingles with all others together has none with any.
    """
    ids = small(written(opened.select("doc_id").distinct(), "minhash-open-ids"))
    listed = sets.join(ids, "doc_id", "left_semi").mapInArrow(_listed, "doc_id long, shingle long")
    listed = written(listed, "minhash-listed")
    common = listed.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    counts = listed.join(common, "shingle").groupBy("doc_id").agg(F.count("*").alias("shared"))
    sizes = opened.select("doc_id", "n_shingles").distinct()
    return written(sizes.join(counts, "doc_id").where(F.col("shared") * 100 >= F.col("n_shingles") * percent)
                   .select("doc_id"), "minhash-linkable")


def _unsettled(opened: DataFrame) -> DataFrame:
    """The slots of keys whose documents lie in more than one component c."""
    keys = opened.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    return written(opened.join(keys, "key"), "minhash-open")


def near_duplicates(documents: DataFrame, width: int = SHINGLE, percent: int = SIMILARITY, chunks: int = CHUNKS,
                    symbols: int = WIDTH, bits: int = BITS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for a table with doc_id and text; other columns are ignored.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of word shingles. component_id is the
    smallest id reachable over links; kept marks the documents that carry it. Texts that are null or hold no word have
    an empty set and stay alone. Rows without an id stay alone too and are kept (component_id null). Rows that share
    an id are one row each with that id's component. Equal sets are one class from the start (128-bit set hash), so
    copies cost no pairs. Of the sets that share a key, first each is compared with LEADERS of the key's group, drawn
    anew in each of STAR_ROUNDS rounds; documents that can have no link are set aside; then all pairs of the group that still lie in different components are
    compared. So no link between components is lost, and a group of n mutually close texts costs about n comparisons.
    """
    sign = _signer(width, chunks, symbols, bits, SYMBOLS)
    sigs = written(documents.select("doc_id", "text").mapInArrow(sign, SIGNATURE), "minhash-signatures")
    differ = (1 - percent / 100) * 3 / 4        # two bits agree by chance in a quarter of the cases
    limit = round(SYMBOLS * differ + SLACK * (SYMBOLS * differ * (1 - differ)) ** 0.5)
    usable, same = sigs.where("doc_id is not null and n_shingles > 0"), ["s1", "s2", "n_shingles"]
    classes = usable.groupBy(same).agg(F.min("doc_id").alias("rep"))
    copies = usable.select("doc_id", *same).join(classes, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = usable.groupBy(same).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("planes").alias("planes"), F.first("index").alias("index"))
    slots = first.select("doc_id", "n_shingles", F.posexplode("keys").alias("slot", "key"))
    shared = slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    slots = written(slots.join(shared, "key").join(first.select("doc_id", "planes", "index"), "doc_id"), "minhash-slots")
    wanted = small(written(slots.select("doc_id").distinct(), "minhash-wanted"))
    sets = written(documents.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
                   .mapInArrow(_setter(width), SHINGLES), "minhash-sets")
    size, near = F.col("n_shingles"), None
    # The documents that meet most others are the likeliest centres of their groups.
    weight = slots.groupBy("doc_id").agg((-F.sum("n")).alias("weight"))
    slots = written(slots.drop("n").join(weight, "doc_id"), "minhash-slots")
    opened = slots.withColumn("c", F.col("doc_id"))
    for round_ in range(star_rounds + 1):
        if round_:
            label = small(components(near, "minhash-components")).withColumnsRenamed({"id": "doc_id", "component": "c"})
            opened = slots.join(label, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
            opened = _unsettled(opened)
            if round_ == 1 and not opened.isEmpty():
                slots = opened.select(*slots.columns)
                slots = slots.join(small(_linkable(opened, sets, percent)), "doc_id", "left_semi")
                opened = _unsettled(slots.join(label, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")))
            if opened.isEmpty():
                break
        member = F.struct("doc_id", "c", "n_shingles", "planes", "index")
        if round_ < star_rounds:
            orders = [F.col("weight") if round_ + i == 0 else F.xxhash64("doc_id", F.lit(LEADERS * round_ + i)) for i in range(LEADERS)]
            drawn = [F.min(F.struct(o.alias("o"), member.alias("l"))).alias(f"l{i}") for i, o in enumerate(orders)]
            lead = opened.groupBy("key").agg(*drawn).select(
                "key", F.explode(F.array_distinct(F.array(*[f"l{i}.l" for i in range(LEADERS)]))).alias("l"))
        else:
            lead = opened.select("key", member.alias("l"))
        pairs = opened.join(lead, "key").where(
            (F.col("c") != F.col("l.c")) & (size * 100 >= F.col("l.n_shingles") * percent)
            & (F.col("l.n_shingles") * 100 >= size * percent)
            & (_differing(F.col("planes"), F.col("l.planes"), SYMBOLS // 64) <= limit))
        if round_ == star_rounds:
            pairs = pairs.where((F.col("doc_id") > F.col("l.doc_id"))
                                & _first_meeting(F.col("index"), F.col("l.index"), F.col("slot"), symbols, bits))
        pairs = pairs.select(F.greatest("doc_id", "l.doc_id").alias("a"), F.least("doc_id", "l.doc_id").alias("b")).distinct()
        found = _confirmed(written(pairs, "minhash-pairs"), sets, percent)
        near = found if near is None else near.unionAll(found)
    label = small(components(copies.unionAll(near), "minhash-components")).withColumnRenamed("id", "doc_id")
    return (sigs.select("doc_id", "n_shingles").join(label, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component", "doc_id")).drop("component")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))

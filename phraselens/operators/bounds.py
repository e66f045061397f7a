"""Blocks of a vector index with upper bounds on what a query can find in them.

Two kinds, chosen by the data. Dense vectors lie in balls: a block has a centre and a radius, and no vector in it scores
more than the query's score with the centre plus radius times the query's norm. Sparse vectors without negative entries lie
in an inverted index: a vector stands in the list of each bucket it uses, lists are cut by falling weight, and bounds come
from the largest weight of a list. Both say which blocks a query should read first, and which of the others can still
hold one of its best, given the K-th best score so far.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phraselens.session import written

CENTRE_BYTES = 32 << 20     # all centres together, and the sample they are fitted on
CENTRE_SAMPLE = 16          # sampled vectors per centre
LLOYD_STEPS = 4
BALLS_A_BLOCK = 2           # blocks are half full on average, so that few have to be split
FIRST_BALLS, FIRST_LISTS = 1, 2
LIST_LEVELS = 8
MAX_LISTS = 1 << 20
EPSILON = 1e-7              # more than rounding of similarities and bounds together


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; a zero row stays zero."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def matrix(column, keep: bool = False) -> np.ndarray:
    """The rows of a list column of equal lengths, in double precision, or in single precision if `keep` and stored so."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = rows.flatten().to_numpy(zero_copy_only=False)
    values = values if keep and values.dtype == np.float32 else values.astype(np.float64)
    return values.reshape(len(rows), -1) if len(rows) else values.reshape(0, 1)


def _most(bounds: np.ndarray, count: int) -> np.ndarray:
    """Mask of the `count` largest entries of each row."""
    if bounds.shape[1] <= count:
        return np.ones(bounds.shape, bool)
    best = np.argpartition(-bounds, count - 1, axis=1)[:, :count]
    mask = np.zeros(bounds.shape, bool)
    np.put_along_axis(mask, best, True, axis=1)
    return mask


class Balls:
    """Blocks of near vectors: centre and radius of each."""

    def __init__(self, centres: np.ndarray, centre_of: np.ndarray, radius: np.ndarray, cosine: bool):
        self.centres, self.centre_of, self.radius, self.cosine = centres, centre_of, radius, cosine

    def bounds(self, q: np.ndarray) -> np.ndarray:
        q = unit(q) if self.cosine else q
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))
        return (q @ self.centres.T)[:, self.centre_of] + norm[:, None] * self.radius

    def first(self, q: np.ndarray) -> np.ndarray:
        """The block whose bound is largest."""
        return _most(self.bounds(q), FIRST_BALLS)

    def rest(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """All other blocks that may hold a score of `least` or more."""
        return (self.bounds(q) >= least[:, None] - EPSILON) & ~self.first(q)


class Lists:
    """Blocks of an inverted index: bucket, largest and smallest weight of each; the last block holds the smallest ids."""

    def __init__(self, dim: int, bucket: np.ndarray, high: np.ndarray, low: np.ndarray, most_used: int, norm: float, cosine: bool):
        self.dim, self.bucket, self.high, self.low = dim, bucket, high, low
        self.most_used, self.norm, self.cosine = most_used, norm, cosine

    def _queries(self, q: np.ndarray) -> np.ndarray:
        return unit(q) if self.cosine else q

    def first(self, q: np.ndarray) -> np.ndarray:
        """The lists with the largest possible share of a score, and the smallest ids: whatever scores nothing is ranked by id."""
        share = self._queries(q)[:, self.bucket] * self.high
        return np.concatenate([_most(share, FIRST_LISTS) & (share > 0), np.ones((len(q), 1), bool)], axis=1)

    def rest(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """All other lists that a vector with a score of `least` or more must stand in.

        A vector uses at most most_used buckets. Buckets in which a query can gain least are left out as long as a vector
        that uses none but those stays below; every other vector stands in one of the remaining lists. Of these the parts
        are read whose weights still allow the score.
        """
        first, q = self.first(q)[:, :-1], self._queries(q)
        gain, least = np.zeros_like(q), least[:, None] - EPSILON
        for b, high in zip(self.bucket.tolist(), self.high.tolist()):
            gain[:, b] = np.maximum(gain[:, b], q[:, b] * high)
        order = np.argsort(gain, axis=1, kind="stable")
        total = np.cumsum(np.take_along_axis(gain, order, axis=1), axis=1)
        before = np.concatenate([np.zeros((len(q), self.most_used)), total], axis=1)[:, :total.shape[1]]
        length = np.sqrt(np.cumsum(np.take_along_axis(q, order, axis=1) ** 2, axis=1)) * self.norm
        needed = np.zeros(q.shape, bool)
        np.put_along_axis(needed, order, np.minimum(total - before, length) >= least, axis=1)
        own = q[:, self.bucket]
        others = np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] - own * own, 0)) * np.sqrt(np.maximum(self.norm ** 2 - self.low ** 2, 0))
        reach = needed[:, self.bucket] & (own > 0) & (own * self.high + others >= least) & ~first
        return np.concatenate([reach, np.zeros((len(q), 1), bool)], axis=1)


def _fit_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a sample: rows drawn by their squared distance to the nearest one before, then a few steps of Lloyd's method."""
    rng, chosen = np.random.default_rng(1), [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(rng.choice(len(sample), p=far / far.sum())))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centres = sample[chosen]
    for _ in range(LLOYD_STEPS if len(centres) > 1 else 0):
        nearest = _nearest(sample, centres)[0]
        used, sizes = np.unique(nearest, return_counts=True)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres[used] = sums[used] / sizes[:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest centre."""
    where, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, 4_000_000 // max(len(centres), 1))
    half = np.einsum("ij,ij->i", centres, centres) / 2
    for start in range(0, len(x), step):
        part = x[start:start + step]
        where[start:start + step] = np.argmax(part @ centres.T - half, axis=1)
        gap = part - centres[where[start:start + step]]
        far[start:start + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return where, far


def build_balls(index: DataFrame, n: int, dim: int, block_rows: int, cosine: bool) -> tuple[DataFrame, Balls]:
    """index(phrase_id, embedding, ...) with `block`, and the blocks; a ball with more than block_rows vectors is split by id."""
    spark = index.sparkSession
    room = max(1, CENTRE_BYTES // (8 * dim * CENTRE_SAMPLE))
    count = min(math.ceil(BALLS_A_BLOCK * n / block_rows), room)
    drawn = index.select("embedding").orderBy(F.xxhash64("embedding", "phrase_id"), "phrase_id").limit(CENTRE_SAMPLE * count).toArrow()["embedding"]
    sample = matrix(drawn)
    centres = _fit_centres(unit(sample) if cosine else sample, count)
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            x = matrix(batch["embedding"])
            where, far = _nearest(unit(x) if cosine else x, sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where.astype(np.int32)), pa.array(far)], [*batch.schema.names, "centre", "distance"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    assigned = written(index.mapInArrow(assign, f"{plain}, centre int, distance double"), "balls")
    facts = assigned.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).orderBy("centre").collect()
    parts = np.array([math.ceil(r["n"] / block_rows) for r in facts], np.int64)
    starts = np.cumsum(parts) - parts
    lookup = spark.createDataFrame([(r["centre"], int(s), int(p)) for r, s, p in zip(facts, starts, parts)], "centre int, start int, parts int")
    rows = assigned.join(F.broadcast(lookup), "centre").withColumn(       # as many rows as centres, whose size is checked above
        "block", (F.col("start") + F.pmod(F.xxhash64("phrase_id"), F.col("parts"))).cast("int")).drop("centre", "distance", "start", "parts")
    centre_of = np.repeat([r["centre"] for r in facts], parts)
    return rows, Balls(centres, centre_of, np.repeat([r["radius"] for r in facts], parts), cosine)


def sparse_columns(x: np.ndarray) -> list[pa.Array]:
    """Used buckets, their weights and the squared norm of each row."""
    rows, buckets = np.nonzero(x)
    offsets = pa.array(np.searchsorted(rows, np.arange(len(x) + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(buckets.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x[rows, buckets])),
            pa.array(np.einsum("ij,ij->i", x, x))]


def thinned(index: DataFrame) -> DataFrame:
    """index with `at`, `weight`, `square` instead of the embedding."""
    others = [f for f in index.schema if f.name != "embedding"]

    def thin(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in others], *sparse_columns(matrix(batch["embedding"]))], [*[f.name for f in others], "at", "weight", "square"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return written(index.mapInArrow(thin, f"{plain}, at array<int>, weight array<double>, square double"), "sparse")


def build_lists(index: DataFrame, dim: int, k: int, most_used: int, block_rows: int, cosine: bool) -> tuple[DataFrame, Lists]:
    """Postings (bucket lists) of index with `at`, `weight`, `square` instead of the embedding and `block`; and the blocks.

    Lists are cut by weight, each level a factor of about 0.7 below the one before, and long ones further by id.
    """
    spark = index.sparkSession
    others = [f for f in index.schema if f.name != "embedding"]
    rows = thinned(index)
    norm = 1.0 if cosine else math.sqrt(rows.agg(F.max("square")).first()[0] or 0.0)
    each = rows.select("*", F.posexplode("at").alias("_i", "bucket")).withColumn(
        "own", F.get("weight", "_i") / F.sqrt("square") if cosine else F.get("weight", "_i"))
    level = F.least(F.lit(LIST_LEVELS - 1), F.greatest(F.lit(0), F.floor(-2 * F.log2(F.col("own") / norm)))).cast("int")
    levelled = each.withColumn("level", level)
    facts = levelled.groupBy("bucket", "level").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("high"), F.min("own").alias("low")).orderBy("bucket", "level").collect()
    parts = np.array([math.ceil(r["n"] / block_rows) for r in facts], np.int64)
    starts = np.cumsum(parts) - parts
    lookup = spark.createDataFrame([(r["bucket"], r["level"], int(s), int(p)) for r, s, p in zip(facts, starts, parts)], "bucket int, level int, start int, parts int")
    names = [f.name for f in others] + ["at", "weight", "square"]
    placed = levelled.join(F.broadcast(lookup), ["bucket", "level"]).select(       # at most MAX_LISTS rows
        *names, (F.col("start") + F.pmod(F.xxhash64("phrase_id"), F.col("parts"))).cast("int").alias("block"))
    smallest = rows.orderBy("phrase_id").limit(k + 1).select(*names, F.lit(int(parts.sum())).alias("block"))
    bounds = Lists(dim, *(np.repeat(np.array([r[c] for r in facts]), parts) for c in ("bucket", "high", "low")), most_used, norm, cosine)
    return placed.unionAll(smallest), bounds

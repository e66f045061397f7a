"""Hard-negative mining by threshold joins in the manner of L2AP.

For every anchor two joins run: its best rows of the same label (positives), then, for every positive, the best rows of
other labels whose score lies in a window below the positive's. A join finds all rows that reach a threshold:

* Components are ordered so that those with most weight come last. A row's leading components are left out of the
  inverted index as long as their norm cannot reach the least threshold of the anchors, per unit of their norm; so a row whose
  whole norm stays below is in no list at all.
* Lists are visited from the last component on, STEP at a time, for all anchors of a cell; after each step a row is
  dropped if for no anchor the partial score plus the product of the norms of what remains reaches its threshold.
* What is left is scored on the full vectors, in whole numbers.

Thresholds start where a bounded sample of rows expects a few more than are wanted, and are lowered for the anchors
whose windows did not fill, at last to the window's own end; so the result is exact whatever the sample says. A round is
one job; rows and anchors meet in cells of bounded size, and a cell passes on at most as many rows per window as are wanted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from phraselens.llm.common import shared
from phraselens.session import written

POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
SAMPLE = 4_096                  # rows, at most, that first thresholds are read from
SLACK, LOWER = 2, 8             # the first threshold expects SLACK times what is wanted, the second LOWER times that
ROW_BLOCK, ANCHOR_BLOCK = 8_192, 4_096
ANCHORS_AT_ONCE, STEP = 256, 16
LEAST, MOST = -(1 << 62), 1 << 62
WINDOWS = "array<struct<key:long,high:long,levels:array<long>>>"


def matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def threshold_join(rows: np.ndarray, anchors: np.ndarray, thresholds: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose inner product reaches the anchor's threshold; whole numbers throughout."""
    none = np.zeros(0, np.int64)
    if not len(rows) or not len(anchors):
        return none, none, none
    dim = rows.shape[1]
    order = np.argsort((rows[:SAMPLE].astype(np.float64) ** 2).sum(axis=0), kind="stable")
    x, q = rows[:, order].astype(np.float64), anchors[:, order].astype(np.float64)
    # norms of the first j components, for j = 0 .. dim
    x_norm, q_norm = (np.sqrt(np.concatenate([np.zeros((len(m), 1)), np.cumsum(m * m, axis=1)], axis=1)) for m in (x, q))
    # Scores are whole numbers, and rounding stays far below the second term.
    wanted = thresholds - 0.5 - 1e-9 * q_norm[:, -1] * x_norm[:, -1].max()
    reach = float(np.min(np.divide(wanted, q_norm[:, -1], out=np.full(len(q), -np.inf), where=q_norm[:, -1] > 0)))
    left_out = (x_norm[:, 1:] < reach).sum(axis=1)          # leading components that are not in the index
    by_start = np.argsort(left_out, kind="stable")
    by_start = by_start[left_out[by_start] < dim] if reach > 0 else by_start
    left_out, x, x_norm = left_out[by_start], x[by_start], x_norm[by_start]
    listed = np.where(np.arange(dim) < left_out[:, None], 0.0, x)
    # The list of component d is the beginning of the rows: those whose index starts at d or before.
    partial, alive = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)), bool)
    for end in range(dim, 0, -step):
        begin = max(end - step, 0)
        n = int(np.searchsorted(left_out, end))
        partial[:, :n] += q[:, begin:end] @ listed[:n, begin:end].T
        # Rows whose index starts at `end` or later have their whole partial score; they stay in question all the same.
        rest = np.maximum(left_out, begin)
        alive = partial + q_norm[:, rest] * x_norm[np.arange(len(x)), rest] >= wanted[:, None]
        stays = alive.any(axis=0)
        if begin and len(x) and stays.mean() < 0.8:
            kept = np.flatnonzero(stays)
            by_start, left_out, x_norm, listed, partial = by_start[kept], left_out[kept], x_norm[kept], listed[kept], partial[:, kept]
            x = x[kept]
    a, r = np.nonzero(alive)
    r = by_start[r]
    scores = np.concatenate([np.einsum("ij,ij->i", anchors[a[i:i + 100_000]], rows[r[i:i + 100_000]]) for i in range(0, len(a), 100_000)] or [none])
    enough = scores >= thresholds[a]
    return a[enough], r[enough], scores[enough]


def _cell(same: bool, wanted: int):
    """Of every open window of the anchors of a cell, the best rows of the cell, as many as are wanted."""
    schema = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("row_id", pa.int64()), ("score", pa.int64())])

    def search(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros((0, 4), np.int64)]
        rows = rows.sort_by("row_id")
        ids, labels, x = np.asarray(rows["row_id"]), rows["label"].to_pylist(), matrix(rows["vector"])
        code = {v: i for i, v in enumerate(dict.fromkeys(labels + asks["label"].to_pylist()))}
        labels, mine = np.array([code[v] for v in labels], np.int64), np.array([code[v] for v in asks["label"].to_pylist()], np.int64)
        own, q, windows = np.asarray(asks["anchor"]), matrix(asks["vector"]), asks["windows"].to_pylist()
        least = np.array([min(w["levels"][0] for w in ws) for ws in windows], np.float64)
        groups = [(np.flatnonzero(mine == v), np.flatnonzero(labels == v)) for v in np.unique(mine)] if same else [(np.arange(len(own)), np.arange(len(ids)))]
        for group, part in groups:
            group = group[np.argsort(-least[group], kind="stable")]
            for chunk in np.split(group, range(ANCHORS_AT_ONCE, len(group), ANCHORS_AT_ONCE)):
                a, r, score = threshold_join(x[part], q[chunk], least[chunk])
                a, r = chunk[a], part[r]
                fits = (ids[r] != own[a]) & ((labels[r] == mine[a]) == same)
                a, r, score = a[fits], r[fits], score[fits]
                order = np.lexsort((r, -score, a))
                a, r, score = a[order], r[order], score[order]
                for i in chunk.tolist():
                    low, top = np.searchsorted(a, [i, i + 1])
                    for w in windows[i]:
                        falling = -score[low:top]
                        first, last = np.searchsorted(falling, -w["high"], "left"), np.searchsorted(falling, -w["levels"][0], "right")
                        best = np.arange(low + first, low + min(last, first + wanted))
                        out.append(np.stack([np.full(len(best), own[i]), np.full(len(best), w["key"]), ids[r[best]], score[best]], axis=1))
        return pa.Table.from_arrays([pa.array(c) for c in np.concatenate(out).T], schema=schema)
    return search


class Sample:
    """Rows that first thresholds are read from."""

    def __init__(self, rows):
        self.ids = np.array([r["row_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], object)
        self.x = np.array([r["vector"] for r in rows], np.int64)


def _planner(sent, same: bool, wanted: int, share: float, low_percent: int, high_percent: int):
    """Windows of every anchor with falling thresholds: scores of the sample at the expected ranks, then the window's end."""
    def plan(batches):
        sample = sent.value
        rank = max(1, math.ceil(SLACK * wanted * share))
        for batch in batches:
            q, labels, ids = matrix(batch["vector"]), batch["label"].to_pylist(), batch["anchor"].to_pylist()
            scored = q @ sample.x.T if len(sample.x) else np.zeros((len(q), 0), np.int64)
            out = []
            for i, keys in enumerate(batch["keys"].to_pylist()):
                fits = (sample.labels == labels[i]) == same
                scores = -np.sort(-scored[i][fits & (sample.ids != ids[i])])
                windows = []
                for key in keys:
                    high = MOST if same else key * high_percent // 100
                    low = LEAST if same else -(-key * low_percent // 100)
                    inside = scores[(scores <= high) & (scores >= low)]
                    levels = [int(inside[r - 1]) for r in (rank, LOWER * rank) if r <= len(inside)]
                    if low <= high:
                        windows.append({"key": key, "high": high, "levels": [*dict.fromkeys([*levels, low])]})
                out.append(windows)
            kind = pa.list_(pa.struct([("key", pa.int64()), ("high", pa.int64()), ("levels", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch["anchor"], batch["label"], batch["vector"], pa.array(out, kind)], ["anchor", "label", "vector", "windows"])
    return plan


def _fill(asks: DataFrame, rows: DataFrame, n_rows: int, same: bool, wanted: int, name: str) -> DataFrame:
    """anchor, key, rank, row_id, score: the first `wanted` rows of every window of asks(anchor, label, vector, windows).

    Every round searches the windows that are still open at their first level; those that did not fill and have a level
    left go on with it.
    """
    spark = asks.sparkSession
    row_blocks = 1 + n_rows // ROW_BLOCK
    x_cells = rows.select("row_id", "label", "vector", F.pmod(F.xxhash64("row_id"), F.lit(row_blocks)).cast("int").alias("xb"))
    best = W.partitionBy("anchor", "key").orderBy(F.desc("score"), "row_id")
    full, asks = None, written(asks.where(F.size("windows") > 0), name)
    while True:
        n = asks.count()
        if not n:
            break
        anchor_blocks = 1 + n // ANCHOR_BLOCK
        left = asks.select("*", F.pmod(F.xxhash64("anchor"), F.lit(anchor_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("xb"))
        right = x_cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("qb"))
        found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInArrow(_cell(same, wanted), "anchor long, key long, row_id long, score long")
        found = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted), name)
        counts = found.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("n"))
        filled = counts.groupBy("anchor").agg(F.collect_set(F.when(F.col("n") >= wanted, F.col("key"))).alias("filled"))
        open_ = asks.join(filled, "anchor", "left").select(
            "anchor", "label", "vector",
            F.transform(F.filter("windows", lambda w: (F.size(w["levels"]) > 1) & ~F.array_contains(F.coalesce("filled", F.array().cast("array<long>")), w["key"])),
                        lambda w: F.struct(w["key"].alias("key"), w["high"].alias("high"), F.slice(w["levels"], 2, F.size(w["levels"])).alias("levels"))).alias("windows"))
        asks = written(open_.where(F.size("windows") > 0), name)
        again = asks.select("anchor", F.explode("windows").alias("w")).select("anchor", F.col("w.key").alias("key"))
        done = found.join(again, ["anchor", "key"], "left_anti")
        full = done if full is None else full.unionAll(done)
    empty = spark.createDataFrame([], "anchor long, key long, row_id long, score long, rank int")
    return (empty if full is None else full).select("anchor", "key", "rank", "row_id", "score")


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has row_id, label and vector (whole numbers); `anchor` is a Boolean expression over it. Scores are inner products;
    higher ones come first, ties by smaller row_id. Of every anchor the first `positives` other rows of its label are its
    positives, and for each of them the first `negatives` rows of other labels with
    low_percent * positive_score <= 100 * score <= high_percent * positive_score are returned, fewer if there are fewer.
    Rows with a null id, label, vector or component take no part, nor do empty vectors, those of another dimension than the most
    frequent one, or of a squared norm of 2^62 and more (their scores are no long). Of rows with the same id the one with
    the smallest label, then vector counts. Labels may be of any type. Every row meets every block of anchors: that is
    the work the exact result asks for; the pruning is within cells.
    """
    valid = rows.select(F.col("row_id").cast("long").alias("row_id"), "label", F.col("vector").cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asked")).where(
        "row_id is not null and label is not null and vector is not null and size(vector) > 0 and forall(vector, v -> v is not null) "
        f"and aggregate(vector, 0D, (s, v) -> s + double(v) * double(v)) < {MOST}D")
    common = valid.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    single = valid.where(F.size("vector") == (common["d"] if common else 1)).groupBy("row_id").agg(F.min(F.struct("label", "vector", "asked")).alias("r"))
    entries = written(single.select("row_id", "r.*"), "mine-rows")
    n_rows = entries.count()
    spark, drawn = rows.sparkSession, entries.select("row_id", "label", "vector").orderBy(F.xxhash64("row_id", F.lit(13)), "row_id").limit(SAMPLE).collect()

    sent = shared(spark, Sample(drawn))

    def asks(of: DataFrame, same: bool, wanted: int) -> DataFrame:
        kind = dict(entries.dtypes)["label"]
        return of.mapInArrow(_planner(sent, same, wanted, len(drawn) / max(n_rows, 1), low_percent, high_percent), f"anchor long, label {kind}, vector array<long>, windows {WINDOWS}")
    asked = entries.where("asked").select(F.col("row_id").alias("anchor"), "label", "vector")
    whole = asked.withColumn("keys", F.array(F.lit(0).cast("long")))
    near = written(_fill(asks(whole, True, positives), entries, n_rows, True, positives, "mine-positives").select(
        "anchor", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")
    keys = near.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("keys"))
    hard = _fill(asks(asked.join(keys, "anchor"), False, negatives), entries, n_rows, False, negatives, "mine-negatives")
    return near.join(hard.withColumnRenamed("key", "positive_score"), ["anchor", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

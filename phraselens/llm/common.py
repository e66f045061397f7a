"""What several operators share: words, hashing, bounded Arrow batches and connected components."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phraselens.session import tune, written

MARKS = b".,;:!?\"'()[]{}*#$%&|-"       # stripped from words where only the word matters
BATCH_ROWS = 2_000
BATCH_BYTES = "8m"
BROADCAST_ROWS = 500_000       # of a few numbers each


def settings(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded bytes, so that a Python worker's memory does not follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return tune(spark)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of everything but ASCII white space; bytes.lower and bytes.split know just these."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash per word."""
    table = np.empty(len(vocabulary), object)
    table[:] = vocabulary
    return pd.util.hash_array(table, categorize=False)


class Coder(dict):
    """Numbers the different words it is asked for from 0 on."""

    def __missing__(self, word):
        self[word] = code = len(self)
        return code

    def codes(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def shared(spark: SparkSession, thing):
    """A broadcast of an object's attributes; a plain namespace needs no package on the executors."""
    return spark.sparkContext.broadcast(SimpleNamespace(**vars(thing)))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, which must be a few numbers wide; else df as it is.

    For written tables, whose rows are counted from the files' footers.
    """
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def drawn(id_col: str, share: float, seed: int) -> Column:
    """Whether a row is in a sample of about that share, by a hash of its id; the threshold has 62 bits, so that a share of a
    few rows in many billions still draws some."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 62)) < F.lit(int(min(1.0, max(share, 0.0)) * (1 << 62)))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b); ids without an edge are absent.

    Each round maps every id to its smallest neighbour, follows that map once more and contracts the edges; at least
    the ids that have a smaller neighbour vanish. Every round is a written table, so nothing is recomputed when an
    executor is lost, and only counts reach the driver.
    """
    rest = written(edges.where("a != b").select("a", "b").distinct(), name)
    labels = None
    while not rest.isEmpty():
        both = rest.unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to"))
        up = written(up, name)
        step = small(up.select(F.col("id").alias("to"), F.col("to").alias("next")))
        up = written(up.join(step, "to").select("id", F.col("next").alias("to")), name)
        if labels is None:
            labels = up
        else:
            step = small(up.select(F.col("id").alias("to"), F.col("to").alias("next")))
            labels = labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        a, b = (small(up.select(F.col("id").alias(c), F.col("to").alias(f"{c}2"))) for c in "ab")
        rest = written(rest.join(a, "a").join(b, "b").where("a2 != b2").select(
            F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct(), name)
    if labels is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return written(labels.select("id", F.col("to").alias("component")), name)

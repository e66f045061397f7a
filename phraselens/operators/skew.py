"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phraselens.session import written

BROADCAST_ROWS = 10_000
HOT_KEYS = 10_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger table is returned unhinted.

    For written tables, and others that cost little to compute twice.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left",
                hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join many rows to a written table with few rows per key, whatever share of `rows` one key holds.

    A key is hot when it holds more than 1/hot_keys of the rows, so there are at most `hot_keys`
    of them: their lookup rows are broadcast and their rows never move. All other keys are shuffled,
    and none of their groups can be large. With no more rows than hot_keys no key can be large.
    """
    total = rows.count()
    if total <= hot_keys:
        return rows.join(lookup, key, how)
    counts = rows.groupBy(key).count().where(F.col("count") > total / hot_keys)
    hot = written(counts.select(key, F.lit(True).alias("_hot")), "hot-keys")
    flagged = rows.join(F.broadcast(hot), key, "left")
    hot_rows = flagged.where(F.col("_hot")).drop("_hot")
    cold_rows = flagged.where(F.col("_hot").isNull()).drop("_hot")
    hot_lookup = lookup.join(F.broadcast(hot.select(key)), key, "left_semi")
    return (hot_rows.join(F.broadcast(hot_lookup), key, how)
            .unionByName(cold_rows.join(lookup, key, how)))

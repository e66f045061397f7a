"""Orders without gathering: cuts, numbers and ranks of rows of which no group is ever sorted in one place.

Rows are counted per beginning of their hash, or per range of their values; sums over those few counts say where a
row stands, and only the rows that share a beginning are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from phraselens.operators.skew import broadcast_if_small
from phraselens.session import written

PREFIX = 3                  # hexadecimal digits: rows of a group are counted in 4,096 parts
PREFIX_ROWS = 200_000       # counts of parts that a join may broadcast, three numbers each


def order_hash(id_col: str, seed: int) -> Column:
    """Seeded pseudo-random order of rows that does not depend on their partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def _parts(rows: DataFrame) -> DataFrame:
    """(g, p, n, before): rows of each group per beginning of the hash, and how many come before it."""
    counts = rows.groupBy("g", F.substring("h", 1, PREFIX).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("before", F.sum("n").over(W.partitionBy("g").orderBy("p")) - F.col("n"))


def cuts(rows: DataFrame, takes: DataFrame) -> DataFrame:
    """(g, last_h, last_id): the last of the first `take` rows of every group in hash order.

    rows has g, h (a hash in hexadecimal digits) and id, takes one row per group: g, take. All groups are cut by the same two
    jobs, however many there are. Ids must be unique within a group.
    """
    edge = _parts(rows).join(takes, "g").where((F.col("take") > F.col("before")) & (F.col("take") <= F.col("before") + F.col("n"))).select(
        "g", "p", (F.col("take") - F.col("before")).alias("left"))
    edge = broadcast_if_small(written(edge, "cut-parts"))
    inside = rows.withColumn("p", F.substring("h", 1, PREFIX)).join(edge, ["g", "p"])
    place = F.row_number().over(W.partitionBy("g").orderBy("h", "id"))
    return inside.withColumn("place", place).where(F.col("place") == F.col("left")).select("g", F.col("h").alias("last_h"), F.col("id").alias("last_id"))


def first_by_hash(df: DataFrame, id_col: str, seed: int, takes: DataFrame, group: str | None = None) -> DataFrame:
    """df with the Boolean column `first`: whether a row is among the first takes.take rows of its group in hash order.

    takes has g and take, g being the group's value (0 without a group); groups that it does not name have no first row. A
    group may be null.
    """
    g = F.col(group) if group else F.lit(0)
    narrow = written(df.select(g.alias("g"), order_hash(id_col, seed).alias("h"), F.col(id_col).alias("id")), "cut-rows")
    found = broadcast_if_small(written(cuts(narrow, takes), "cuts"))
    h, row_id = order_hash(id_col, seed), F.col(id_col)
    before = (h < F.col("last_h")) | ((h == F.col("last_h")) & (row_id <= F.col("last_id")))
    joined = df.withColumn("_g", g).join(found.withColumnRenamed("g", "_g"), "_g", "left")
    return joined.withColumn("first", F.coalesce(before, F.lit(False))).select(*df.columns, "first")


def numbered(rows: DataFrame) -> DataFrame:
    """rows(g, h, id, ...) with `i`: the place from 0 in the hash order of the group."""
    parts = broadcast_if_small(written(_parts(rows).select("g", "p", "before"), "parts"), PREFIX_ROWS)
    own = F.row_number().over(W.partitionBy("g", "p").orderBy("h", "id")) - 1
    return rows.withColumn("p", F.substring("h", 1, PREFIX)).withColumn("own", own).join(parts, ["g", "p"]).withColumn(
        "i", F.col("own") + F.col("before")).drop("p", "own", "before")


def counted_before(values: DataFrame, column: str, count: str | Column) -> DataFrame:
    """values, whose `column` has different values, with `before`: the sum of `count` over all smaller ones.

    Values are dealt to tasks by range; each range is summed by itself, and the sums of the ranges, of which there
    are as many as tasks, come together on the driver.
    """
    ranged = written(values.withColumn("_n", F.col(count) if isinstance(count, str) else count).repartitionByRange(column)
                     .withColumn("_range", F.spark_partition_id()), "ranges")
    starts, total = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in sorted(ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect()):
        starts += [F.lit(r["_range"]), F.lit(total).cast("long")]
        total += r["n"]
    inside = F.sum("_n").over(W.partitionBy("_range").orderBy(column)) - F.col("_n")
    return ranged.withColumn("before", inside + F.create_map(*starts)[F.col("_range")]).drop("_range", "_n")

"""Exact, seeded samples and splits that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from phraselens.config import SAMPLE_FRACTION, SEED, TEST_FRACTION
from phraselens.operators.order import first_by_hash
from phraselens.session import written


def test_sizes(counts: DataFrame, fraction: float = TEST_FRACTION) -> DataFrame:
    """(g, take) from (g, n): ceil(fraction * all rows) in all, shared out over the classes by largest remainder.

    Equal remainders go to the smaller class. Any number of classes: only the sums reach the driver.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    wanted = math.ceil(round(fraction * total, 9))
    product = F.col("n").cast("decimal(38,0)") * F.lit(wanted).cast("decimal(19,0)")
    shares = counts.select("g", product.alias("product")).selectExpr(
        "g", f"cast(product div {max(total, 1)}BD as long) as base", f"cast(product % {max(total, 1)}BD as long) as rest")
    left = wanted - (shares.agg(F.sum("base")).first()[0] or 0)
    more = shares.orderBy(F.desc("rest"), "g").limit(left).select("g", F.lit(1).alias("one"))
    return shares.join(more, "g", "left").select("g", (F.col("base") + F.coalesce("one", F.lit(0))).alias("take"))


def stratified_split(corpus: DataFrame, fraction: float = TEST_FRACTION, seed: int = SEED,
                     id_col: str = "doc_id", label: str = "label") -> DataFrame:
    """Add `split` ('train' or 'test') with exact sizes per class, of which there may be any number."""
    labelled = corpus.where(F.col(label).isNotNull())
    counts = written(labelled.groupBy(F.col(label).alias("g")).agg(F.count(F.lit(1)).alias("n")), "class-counts")
    marked = first_by_hash(labelled, id_col, seed, test_sizes(counts, fraction), label)
    return marked.withColumn("split", F.when(F.col("first"), "test").otherwise("train")).drop("first")


def fixed_sample(df: DataFrame, id_col: str, fraction: float = SAMPLE_FRACTION, cap: int | None = None,
                 seed: int = SEED) -> DataFrame:
    """int(fraction * n) rows without replacement, at most `cap` if it is given."""
    n = df.count()
    take = int(fraction * n) if cap is None else min(int(fraction * n), cap)
    takes = df.sparkSession.createDataFrame([(0, take)], "g int, take long")
    return first_by_hash(df, id_col, seed, takes).where("first").drop("first")

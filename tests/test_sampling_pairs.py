"""Splits, samples and pairs."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phraselens.operators import order as ordering, pairs, sampling, skew


def order(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def corpus(spark, n_pos, n_neg):
    rows = [(i, f"t{i}", 1 if i < n_pos else 0) for i in range(n_pos + n_neg)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


@pytest.mark.parametrize("counts", [{0: 5}, {0: 1, 1: 1, 2: 1}, {0: 37, 1: 263}, {0: 999, 3: 7, 4: 7, 5: 2}, {i: 3 for i in range(11)}])
def test_test_sizes(spark, counts):
    table = spark.createDataFrame(list(counts.items()), "g int, n long")
    sizes = {r["g"]: r["take"] for r in sampling.test_sizes(table).collect()}
    total = sum(counts.values())
    wanted = math.ceil(round(0.2 * total, 9))
    shares = {c: divmod(n * wanted, total) for c, n in counts.items()}
    more = sorted(shares, key=lambda c: (-shares[c][1], c))[:wanted - sum(whole for whole, _ in shares.values())]
    assert sizes == {c: whole + (c in more) for c, (whole, _) in shares.items()}


@pytest.mark.parametrize("prefix", [1, 4, 32])
def test_split_is_exact_whatever_the_parts(spark, monkeypatch, prefix):
    monkeypatch.setattr(ordering, "PREFIX", prefix)
    rows = sampling.stratified_split(corpus(spark, 37, 263)).collect()
    assert len(rows) == 300
    assert Counter((r["label"], r["split"]) for r in rows)[(1, "test")] == 7
    for label in (0, 1):
        ids = sorted((r["doc_id"] for r in rows if r["label"] == label), key=order)
        test = {r["doc_id"] for r in rows if r["label"] == label and r["split"] == "test"}
        assert test == set(ids[: len(test)])


def jobs(spark, run):
    """How many jobs `run` starts."""
    group = f"count-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_classes_take_no_more_jobs(spark):
    def split(classes):
        df = spark.range(4004).select(F.col("id").alias("doc_id"), (F.col("id") % classes).alias("label"))
        return jobs(spark, lambda: sampling.stratified_split(df).groupBy("split").count().collect())
    few, many = split(2), split(1001)
    assert dict(map(tuple, few[0])) == dict(map(tuple, many[0])) == {"test": 801, "train": 3203}
    assert abs(few[1] - many[1]) <= 4       # a broadcast more or less


def test_text_is_read_last(spark, tmp_path):
    """The passes that look for cuts read no text."""
    spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(50)], "doc_id long, text string, label int").write.parquet(str(tmp_path / "c"))
    split = sampling.stratified_split(spark.read.parquet(str(tmp_path / "c")).where("text is not null"))
    assert split.select("doc_id", "split")._jdf.queryExecution().executedPlan().toString().count("ReadSchema: struct<doc_id:bigint,text") <= 1


def test_single_class_split(spark):
    rows = sampling.stratified_split(corpus(spark, 10, 0)).collect()
    assert Counter(r["split"] for r in rows) == {"train": 8, "test": 2}


def test_fixed_sample(spark):
    df = spark.range(1000).withColumnRenamed("id", "vec_id").repartition(7)
    got = {r[0] for r in sampling.fixed_sample(df, "vec_id").collect()}
    assert got == set(sorted(range(1000), key=order)[:100])
    assert sampling.fixed_sample(df, "vec_id", cap=15).count() == 15
    assert sampling.fixed_sample(df.limit(9), "vec_id").count() == 0


def brute_pairs(rows, cap):
    by = {c: [t for i, t, l in sorted(rows, key=lambda r: order(r[0])) if l == c] for c in (1, 0)}
    out = [(a, b, 1.0) for c in (1, 0) for a, b in list(zip(by[c], by[c][1:]))[:cap]]
    if by[0]:
        out += [(t, by[0][i % len(by[0])], 0.0) for i, t in enumerate(by[1][:cap])]
    return sorted(out)


@pytest.mark.parametrize("n_pos,n_neg", [(5, 9), (9, 5), (9, 2), (1, 1), (4, 0), (0, 4)])
def test_pairs(spark, n_pos, n_neg):
    df = corpus(spark, n_pos, n_neg)
    rows = [tuple(r) for r in df.collect()]
    pick = lambda d: sorted((r["text_a"], r["text_b"], r["score"]) for r in d.collect())
    assert pick(pairs.training_pairs(df, cap=4)) == brute_pairs(rows, min(n_pos, n_neg, 4))
    assert pick(pairs.validation_pairs(df, cap=6)) == brute_pairs(rows, 6)
    assert pick(pairs.training_pairs(df)) == brute_pairs(rows, min(n_pos, n_neg))
    assert pick(pairs.validation_pairs(df)) == brute_pairs(rows, 100)


def test_numbers_and_ranks_of_many_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), ordering.order_hash("id", 1).alias("h"), "id")
    got = {r["id"]: (r["g"], r["i"]) for r in ordering.numbered(rows).collect()}
    for g in range(3):
        ids = sorted(range(g, 5000, 3), key=lambda i: order(i, 1))
        assert [got[i] for i in ids] == [(g, n) for n in range(len(ids))]
    values = spark.range(300).select((F.col("id") * 11 % 301).alias("v"), (F.col("id") % 5).alias("n"))
    found = {r["v"]: r["before"] for r in ordering.counted_before(values, "v", "n").collect()}
    plain = sorted((r["v"], r["n"]) for r in values.collect())
    assert found == {v: sum(m for w, m in plain if w < v) for v, _ in plain}


def test_pair_correlation(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 1.0], [1.0, 0.0], 1.0)],
                               "vec_a array<double>, vec_b array<double>, score double")
    row = pairs.pair_correlation(df).first()
    cosines, scores = [1.0, 0.0, math.sqrt(0.5)], [1.0, 0.0, 1.0]
    assert row["pairs"] == 3
    assert row["pearson"] == pytest.approx(np.corrcoef(scores, cosines)[0, 1])
    assert row["spearman"] == pytest.approx(np.corrcoef([2.5, 1, 2.5], [3, 1, 2])[0, 1])
    flat = pairs.pair_correlation(df.withColumn("score", F.lit(1.0))).first()
    assert (flat["pairs"], flat["pearson"], flat["spearman"]) == (3, None, None)
    assert pairs.pair_correlation(df.limit(0)).first()["pairs"] == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_join_like_any_other(spark, how):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, skew.join_unique(rows, lookup, "k", how).collect()), key=str)
    split = sorted(map(tuple, skew.join_unique(rows, lookup, "k", how, hot_keys=100).collect()), key=str)
    assert plain == split and len(split) >= 1000


def test_broadcast_only_when_counted_small(spark):
    left = spark.range(100)
    small, large = spark.range(10), spark.range(30)
    hint = lambda d: "strategy=broadcast" in left.join(d, "id")._jdf.queryExecution().logical().toString()
    assert hint(skew.broadcast_if_small(small, 20)) and not hint(skew.broadcast_if_small(large, 20))

"""Embedders, exact search, clusters and checks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phraselens.operators import bounds, checks, cluster, embed, similarity


def vector_table(spark, matrix, key):
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<double>, tag int")


def brute(q, x, k, cosine, skip_self):
    out = []
    for i, a in enumerate(q):
        sims = x @ a
        if cosine:
            sq = (x ** 2).sum(axis=1) * (a ** 2).sum()
            sims = np.divide(sims, np.sqrt(sq), out=np.zeros_like(sims), where=sq > 0)
        sims = np.floor(sims * 1e9 + 0.5) / 1e9
        order = [j for j in sorted(range(len(x)), key=lambda j: (-sims[j], j)) if not (skip_self and j == i)][:k]
        out += [(i, r + 1, j, sims[j], j % 3) for r, j in enumerate(order)]
    return out


def found(table):
    return [(r["q_id"], r["rank"], r["phrase_id"], r["similarity"], r["tag"]) for r in table.orderBy("q_id", "rank").collect()]


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("block_rows,k,skip_self", [(7, 4, False), (16_384, 4, True), (13, 60, True), (5, 1, False), (6, 5, True)])
def test_blocks_give_the_exact_neighbours(spark, block_rows, k, skip_self, cosine):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, size=(40, 4)).astype(float)     # many equal similarities
    x[3] = 0
    q = x[:25] if skip_self else rng.integers(-2, 3, size=(25, 4)).astype(float)
    got = similarity.top_k_neighbours(vector_table(spark, q, "q_id"), vector_table(spark, x, "phrase_id"), k,
                                      cosine=cosine, skip_self=skip_self, block_rows=block_rows)
    assert found(got) == brute(q, x, k, cosine, skip_self)


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("block_rows,k,skip_self", [(7, 4, False), (40, 60, True), (5, 1, False), (9, 5, True)])
def test_lists_give_the_exact_neighbours(spark, block_rows, k, skip_self, cosine):
    rng = np.random.default_rng(2)
    x = np.zeros((90, 40))
    for row in x[1:]:
        row[rng.choice(40, rng.integers(1, 5))] += rng.integers(1, 3)
    x[50:60, 7] += 1                                        # a long list
    q = x[:30] if skip_self else np.concatenate([x[5:20] + x[40:55], rng.integers(0, 2, size=(10, 40)), np.zeros((1, 40))]).astype(float)
    index = similarity.prepare(vector_table(spark, x, "phrase_id"), k, cosine, block_rows, local_bytes=0)
    assert type(index.blocks).__name__ == "Lists"
    assert found(similarity.top_k_neighbours(vector_table(spark, q, "q_id"), index, k, skip_self=skip_self)) == brute(q, x, k, cosine, skip_self)


def read_share(spark, queries, index, k):
    """Blocks read in both rounds, as a share of all pairs of queries and blocks."""
    rows = queries.select("q_id", F.col("embedding").alias("query"))
    first = similarity.visits(rows, index, True)
    schema = similarity._result_type(rows, index)
    near = similarity._merge(similarity._read(first, 1, index, k, False, schema), k)
    least = near.groupBy("q_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
    rest = similarity.visits(rows.join(least, "q_id").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), index, False)
    blocks = index.rows.select("block").distinct().count()
    return (first.count() + rest.count()) / (rows.count() * blocks)


def test_few_blocks_are_read(spark):
    """Near groups of dense vectors, and phrases of few words: a query meets a small share of the blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    dense = np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 16)) * 0.02
    queries = vector_table(spark, dense[::25], "q_id")
    assert read_share(spark, queries, similarity.prepare(vector_table(spark, dense, "phrase_id"), 5, True, 50, 0), 5) < 0.15
    sparse = np.zeros((1500, 256))
    for row in sparse:
        row[rng.choice(256, 3)] += 1
    queries = vector_table(spark, sparse[::50], "q_id")
    assert read_share(spark, queries, similarity.prepare(vector_table(spark, sparse, "phrase_id"), 5, True, 50, 0), 5) < 0.03


def test_one_vector_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[100:200] = x[100]
    index = similarity.prepare(vector_table(spark, x, "phrase_id"), 7, False, 20, 0)
    assert max(r["count"] for r in index.rows.groupBy("block").count().collect()) <= 40
    assert found(similarity.top_k_neighbours(vector_table(spark, x[90:110], "q_id"), index, 7)) == brute(x[90:110], x, 7, False, False)


def test_prepared_indexes_say_what_they_can(spark):
    index = similarity.prepare(vector_table(spark, np.eye(3), "phrase_id"), 2)
    with pytest.raises(ValueError):
        similarity.top_k_neighbours(vector_table(spark, np.eye(3), "q_id"), index, 3)
    lists = similarity.prepare(vector_table(spark, np.eye(60), "phrase_id"), 2, block_rows=5, local_bytes=0)
    with pytest.raises(Exception, match="negative"):
        similarity.top_k_neighbours(vector_table(spark, -np.eye(60), "q_id"), lists, 2).count()


def test_short_or_empty_index(spark):
    q = vector_table(spark, np.eye(3), "q_id")
    assert similarity.top_k_neighbours(q, vector_table(spark, np.eye(3)[:2], "phrase_id"), 5).count() == 6
    assert similarity.top_k_neighbours(q, vector_table(spark, np.eye(3), "phrase_id").limit(0), 5).count() == 0


def test_search_has_no_cross_join(spark):
    plan = similarity.top_k_neighbours(vector_table(spark, np.eye(9), "q_id"), vector_table(spark, np.eye(9), "phrase_id"), 2,
                                       block_rows=4, local_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_hashed_embedder(spark):
    df = spark.createDataFrame([(1, "Cats never like cats"), (2, "the of"), (3, "")], "id long, text string")
    rows = {r["id"]: r["embedding"] for r in embed.HashedEmbedder(64).embed(df, "text").collect()}
    assert sum(rows[1]) == 4 and max(rows[1]) >= 2 and len(rows[1]) == 64
    assert sum(rows[2]) == sum(rows[3]) == 0


def test_failing_batches_are_halved():
    calls = []

    def encode(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        return [[len(t)] for t in texts]

    assert embed.encode_with_retry(encode, ["a", "bb", "ccc", "dddd", "eeeee"]).ravel().tolist() == [1, 2, 3, 4, 5]
    assert calls[0] == 5
    with pytest.raises(ZeroDivisionError):
        embed.encode_with_retry(lambda t: 1 / 0, ["a", "b"])


def test_function_embedder(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts]) * (np.array([[len(t) > 0] for t in texts]))

    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, text string")
    rows = {r["id"]: r["embedding"] for r in embed.FunctionEmbedder(load, batch_size=2).embed(df, "text").collect()}
    assert rows[0] == [0.0, 0.0]
    assert np.linalg.norm(rows[4]) == pytest.approx(1, abs=1e-6)


def test_assign_and_update(spark):
    points = vector_table(spark, [[0, 0], [0, 1], [10, 0], [10, 2], [5, 0.5]], "phrase_id").drop("tag")
    centroids = spark.createDataFrame([(7, [10.0, 1.0]), (2, [0.0, 0.5]), (9, [99.0, 99.0])], "cluster int, centroid array<double>")
    assigned = cluster.assign_centroids(points, centroids)
    assert [r["cluster"] for r in assigned.orderBy("phrase_id").collect()] == [2, 2, 7, 7, 2]
    searched = cluster.assign_centroids(points, centroids, model_bytes=0)
    assert {r["phrase_id"]: r["cluster"] for r in searched.collect()} == {r["phrase_id"]: r["cluster"] for r in assigned.collect()}
    new = {r["cluster"]: r["centroid"] for r in cluster.centroid_means(assigned, centroids).collect()}
    assert new[7] == [10.0, 1.0] and new[2] == pytest.approx([5 / 3, 0.5]) and new[9] == [99.0, 99.0]


def test_kmeans_and_elbow(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.05, size=(60, 3)) for c in np.eye(3)])
    vectors = vector_table(spark, points, "phrase_id")
    model = cluster.fit_kmeans(vectors, k=3)
    sizes = [r["size"] for r in cluster.cluster_sizes(cluster.assign_with_model(vectors, model)).collect()]
    assert sorted(sizes) == [60, 60, 60]
    assert cluster.centroid_table(spark, model).count() == 3
    curve = {r["k"]: r["inertia"] for r in cluster.elbow_curve(vectors, "phrase_id", ks=(2, 3, 4)).collect()}
    assert set(curve) == {2, 3, 4} and curve[3] < curve[2]


def phrases(spark):
    rows = [(1, "a", 5, 4, 1, 0), (2, "b", 9, 0, 9, 0), (3, "c", 5, 5, 0, 0), (4, "d", 1, 1, 0, 0), (5, "e", 3, 3, 0, 1), (6, "f", 2, 0, 2, None)]
    return spark.createDataFrame(rows, "phrase_id long, phrase string, total_frequency long, hate_count long, non_hate_count long, cluster int")


def test_cluster_statistics(spark):
    rows = {r["cluster"]: r.asDict() for r in cluster.cluster_statistics(phrases(spark)).collect()}
    assert set(rows) == {0, 1}
    assert rows[0]["size"] == 4 and rows[0]["total_phrase_frequency"] == 20 and rows[0]["avg_phrase_frequency"] == 5.0
    assert rows[0]["sample_phrases"] == "b, a, c"
    assert rows[0]["ratio_milli"] == 500 and rows[0]["cluster_hate_ratio"] == 0.5 and rows[0]["hate_indicator"] == "NEUTRAL"
    assert rows[1]["hate_indicator"] == "HIGH HATE"
    bare = cluster.cluster_statistics(phrases(spark).drop("hate_count", "non_hate_count")).collect()
    assert all(r["hate_indicator"] == "N/A" and r["cluster_hate_ratio"] is None for r in bare)


def test_legacy_ratio_columns(spark):
    old = spark.createDataFrame([(0, "12.3%"), (1, "n/a")], "cluster int, hate_ratio string")
    assert [r["ratio_milli"] for r in cluster.read_ratio(old).orderBy("cluster").collect()] == [123, None]
    new = spark.createDataFrame([(0, 0.66)], "cluster int, cluster_hate_ratio double")
    assert cluster.read_ratio(new).first()["ratio_milli"] == 660


def test_last_row_wins(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("b", 3, 1)], "phrase string, cluster int, row_id long")
    assert {r[0]: r[1] for r in cluster.last_cluster_per_phrase(df, "phrase", "cluster", "row_id").collect()} == {"a": 5, "b": 3}


def test_consistency(spark):
    left, right = spark.range(5).withColumnRenamed("id", "phrase_id"), spark.range(3, 9).withColumnRenamed("id", "phrase_id")
    assert checks.consistency_counts(left, right).first().asDict() == {"matched": 2, "without_vector": 3, "without_phrase": 4}
    checks.require_consistent(left, left)
    with pytest.raises(ValueError):
        checks.require_consistent(left, right)
    assert checks.corpus_summary(phrases(spark)).first()["mean_cluster_size"] == 2.5


@pytest.mark.parametrize("points", [[[1, 0]] * 4, [[1, 0], [0, 1], [1, 0]], [[1, 0], [0, 1], [-1, 0], [0, -1]]])
def test_fewer_points_than_clusters(spark, points):
    vectors = vector_table(spark, points, "phrase_id")
    assigned = cluster.assign_with_model(vectors, cluster.fit_kmeans(vectors, k=10)).collect()
    by_point = {tuple(r["embedding"]): r["cluster"] for r in assigned}
    assert all(r["cluster"] == by_point[tuple(r["embedding"])] for r in assigned)


def test_search_leaves_vectors_behind():
    """What a search returns has no vectors, so none are copied for the neighbours found."""
    rng = np.random.default_rng(3)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    index = pa.table({"phrase_id": pa.array(np.arange(50)), "embedding": lists(rng.random((50, 256)))})
    queries = pa.table({"q_id": pa.array(np.arange(1_000)), "query": lists(rng.random((1_000, 256)))})
    schema = pa.schema([("q_id", pa.int64()), ("rank", pa.int32()), ("phrase_id", pa.int64()), ("similarity", pa.float64())])
    pool = pa.default_memory_pool()
    room = max(pool.max_memory(), pool.bytes_allocated() + 10_000 * 256 * 8 // 2)
    assert similarity._search(queries, index, 10, True, False, schema).num_rows == 10_000 and pool.max_memory() <= room


def test_index_of_many_short_phrases_stays_whole(spark):
    """20,000 vectors of three words are a few MB by what they use: no query is copied to any block, and the neighbours are exact."""
    rng = np.random.default_rng(8)
    x = np.zeros((20_000, 64))
    np.add.at(x, (np.repeat(np.arange(len(x)), 3), rng.integers(0, 64, 3 * len(x))), 1)
    q = np.concatenate([x[:20], rng.integers(0, 3, (20, 64)), np.zeros((1, 64))]).astype(float)
    index = similarity.prepare(vector_table(spark, x, "phrase_id"), 10, True)
    assert index.blocks is None
    assert found(similarity.top_k_neighbours(vector_table(spark, q, "q_id"), index, 10)) == brute(q, x, 10, True, False)


def test_second_round_returns_what_can_be_best(spark):
    """A block that is read again passes on rows that reach the K-th best score, not K rows of its own."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 24))
    rows = vector_table(spark, x[:60], "q_id").select("q_id", F.col("embedding").alias("query"))
    index = similarity.prepare(vector_table(spark, x, "phrase_id"), 5, True, 100, 0)
    least = 0.5
    again = similarity.visits(rows.withColumn("least", F.lit(least)), index, False)
    got = similarity._read(again, 60, index, 5, False, similarity._result_type(rows, index)).collect()
    assert again.count() > 240 and 40 <= len(got) < 200 and min(r["similarity"] for r in got) >= least


@pytest.mark.parametrize("chunk, few", [(64, 8), (64, 0), (2_048, 8)])
def test_rough_scores_lose_no_neighbour(monkeypatch, chunk, few):
    """Chunks of any size, lists of entries or whole chunks: the rows and scores of a plain sort."""
    for name, value in (("CHUNK_ROWS", chunk), ("LISTED", few), ("QUERY_ROWS", 7), ("GROUPS", 3)):
        monkeypatch.setattr(similarity, name, value)
    rng, schema = np.random.default_rng(5), pa.schema([("q_id", pa.int64()), ("rank", pa.int32()), ("phrase_id", pa.int64()), ("similarity", pa.float64())])
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    sparse = (rng.random((300, 30)) < 0.08) * rng.integers(1, 3, (300, 30)).astype(float)
    for x in (sparse, rng.normal(size=(300, 30)), rng.integers(-1, 2, (300, 30)).astype(float)):
        columns = {"embedding": lists(x)} if x is not sparse else dict(zip(("at", "weight", "square"), bounds.sparse_columns(x)))
        for cosine in (True, False):
            table = similarity._search(pa.table({"q_id": pa.array(np.arange(40)), "query": lists(x[:40])}), pa.table({"phrase_id": pa.array(np.arange(300)), **columns}), 6, cosine, True, schema)
            want = [(i, r, j, s) for i, r, j, s, _ in brute(x[:40], x, 6, cosine, True)]
            got = list(zip(*[table[c].to_pylist() for c in schema.names]))
            assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)

"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables cuts K random projections into steps of width W; the K step numbers are a vector's bucket. A query
visits its own bucket and those whose numbers differ by one in some places, in the order of the estimated chance that a
near vector fell there: the sum of squared distances to the crossed borders. What the tables find is merged and ranked
by the exact distance.

K and the number of probes are fitted: for FIT_QUERIES queries the true neighbours are found by brute force (a scan with
a fixed number of queries), and of the settings that recover FIT_RECALL of them the one that meets the smallest share of
a sample of FIT_ROWS vectors is taken. Every row is indexed and every query served.

Equal vectors are one entry with their smallest ids, as many as a result can show. Buckets are dealt to tasks by their
hash, large ones in several parts, each of which the probes of that bucket visit.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from phraselens.llm.common import mixed, small
from phraselens.session import written

NEIGHBOURS = 10
TABLES = 8
FIT_QUERIES, FIT_ROWS, FIT_RECALL = 32, 1_000, 0.96
FIT_K, FIT_PROBES = (4, 6, 8, 10, 14), (1, 8, 32, 128, 256, 512, 1024)
TASK_ENTRIES = 40_000           # index entries a task holds; a bucket with more is split


class Tables:
    """Projections and borders of all tables for vectors of one dimension."""

    def __init__(self, dimension: int, k: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.k, self.width = k, width
        self.a = rng.normal(size=(TABLES, dimension, k))
        self.b = rng.uniform(0, width, (TABLES, k))

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    def keys(self, table: int, steps: np.ndarray) -> np.ndarray:
        out = np.full(len(steps), table + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.k):
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + steps[:, i].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(vectors x tables) keys."""
        return np.stack([self.keys(t, np.floor(self.places(x, t))) for t in range(TABLES)], axis=1)

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """Keys that the query x visits in a table, likeliest first."""
        place = self.places(x[None], table)[0]
        step = np.floor(place)
        gaps = np.concatenate([place - step, step + 1 - place]) ** 2
        order = np.argsort(gaps, kind="stable")
        cost, moves = gaps[order], np.where(order < self.k, -1, 1)
        places = order % self.k
        visited, heap = [step], [(cost[0], (0,))]
        while heap and len(visited) < count:
            score, chosen = heapq.heappop(heap)
            if len(set(places[list(chosen)])) == len(chosen):       # not both borders of one step
                moved = step.copy()
                for j in chosen:
                    moved[places[j]] += moves[j]
                visited.append(moved)
            last = chosen[-1]
            if last + 1 < len(cost):
                heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (score + cost[last + 1], (*chosen, last + 1)))
        return self.keys(table, np.array(visited))


def matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def _nearest(queries: np.ndarray, count: int):
    def nearest(batches):
        for batch in batches:
            x, keys = matrix(batch["vector"]), np.asarray(batch["entry"])
            for q, row in enumerate(queries):
                d = distances(row[None], x)[0]
                best = np.argsort(d, kind="stable")[:count]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(keys[best]), pa.array(d[best])], ["q", "entry", "score"])
    return nearest


def fit(entries: DataFrame, dimension: int) -> tuple[Tables, int]:
    """The tables and the number of probes per table; entries has entry, vector, asked."""

    def some(rows: DataFrame, n: int) -> np.ndarray:
        """The n rows with the smallest hashes, fewer only if there are fewer."""
        return matrix(rows.orderBy(F.xxhash64("entry", F.lit(9)), "entry").select("vector").limit(n).toArrow()["vector"])
    queries, sample = some(entries.where("asked"), FIT_QUERIES), some(entries, FIT_ROWS)
    if not len(queries):
        return Tables(dimension, FIT_K[0], 1.0), 1
    near = entries.select("entry", "vector").mapInArrow(_nearest(queries, NEIGHBOURS + 1), "q long, entry long, score double")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("score", "entry"))).where(f"r between 2 and {NEIGHBOURS + 1}")
    true = near.join(entries.select("entry", "vector"), "entry").select("q", "score", "vector").toArrow()
    if not len(true):
        return Tables(dimension, FIT_K[0], 1.0), 1
    x, of = matrix(true["vector"]), np.asarray(true["q"])
    reach = max(float(np.median(np.asarray(true["score"]))), 1e-9)
    best, tables, count = (2.0, 0), None, 0
    for k in FIT_K:
        own = Tables(dimension, k, reach * (1.0 if k <= 6 else 1.5 if k <= 10 else 2.0))
        found, met = own.buckets(x), own.buckets(sample)
        rank = np.full(found.shape, np.iinfo(np.int64).max)
        seen = np.full((len(queries), *met.shape), np.iinfo(np.int64).max)
        for q, row in enumerate(queries):
            mine = np.flatnonzero(of == q)
            for t in range(TABLES):
                place = {key: i for i, key in reversed(list(enumerate(own.probes(row, t, FIT_PROBES[-1]).tolist())))}
                rank[mine, t] = [place.get(key, np.iinfo(np.int64).max) for key in found[mine, t].tolist()]
                seen[q, :, t] = [place.get(key, np.iinfo(np.int64).max) for key in met[:, t].tolist()]
        for n in FIT_PROBES:
            recall, share = (rank.min(axis=1) < n).mean(), (seen.min(axis=2) < n).mean()
            if recall >= FIT_RECALL and (share, n) < best or tables is None:
                best, tables, count = ((share, n) if recall >= FIT_RECALL else best), own, n
    if best[0] > 1:     # no setting recovers enough: the coarsest tables and most probes
        return Tables(dimension, FIT_K[0], reach * 2), FIT_PROBES[-1]
    return tables, count


def _indexer(tables: Tables):
    def index(batches):
        for batch in batches:
            keys = tables.buckets(matrix(batch["vector"]))
            yield pa.RecordBatch.from_arrays([batch["entry"], batch["vector"], pa.array(list(keys), pa.list_(pa.int64()))], ["entry", "vector", "keys"])
    return index


def _prober(tables: Tables, count: int):
    def probe(batches):
        for batch in batches:
            for entry, row in zip(batch["entry"].to_pylist(), matrix(batch["vector"])):
                keys = np.unique(np.concatenate([tables.probes(row, t, count) for t in range(TABLES)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), entry)), pa.array(keys)], ["query", "key"])
    return probe


def _ranker(keep: int):
    schema = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("score", pa.float64()), ("first_id", pa.int64())])

    def rank(index: pa.Table, probes: pa.Table) -> pa.Table:
        if not len(index) or not len(probes):
            return schema.empty_table()
        x, entry, key = matrix(index["vector"]), np.asarray(index["entry"]), np.asarray(index["key"])
        ids = np.asarray(index["first_id"])
        order = np.argsort(key, kind="stable")
        key = key[order]
        out = []
        for query, row, keys in zip(probes["query"].to_pylist(), matrix(probes["vector"]), probes["keys"].to_pylist()):
            keys = np.array(keys)
            low, high = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            met = np.concatenate([order[a:b] for a, b in zip(low.tolist(), high.tolist()) if a < b] or [order[:0]])
            met = met[np.unique(entry[met], return_index=True)[1]]
            for start in range(0, len(met), 8192):
                part = met[start:start + 8192]
                d = distances(row[None], x[part])[0]
                best = np.lexsort((ids[part], d))[:keep]
                out.append((np.full(len(best), query), entry[part][best], d[best], ids[part][best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema) if out else schema.empty_table()
    return rank


def nearest_neighbours(vectors: DataFrame, query, neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for every row that the Boolean expression `query` picks.

    vectors has vec_id and embedding. score is the Euclidean distance in double precision, nearest first, ties to the
    smaller vec_id; a row is no neighbour of itself. Rows without an id, and vectors that are null, zero or hold a null
    or non-finite component, take no part, nor do those whose dimension is not the most frequent one. A query that finds
    too few in its buckets is compared with all entries. Rows that repeat an id and vector count as one.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"), F.coalesce(query, F.lit(False)).alias("asked")).where(
        "vec_id is not null and vector is not null and size(vector) > 0 and exists(vector, v -> v != 0) "
        "and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    common = valid.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = common["d"] if common else 1
    same = ["h1", "h2"]
    rows = valid.where(F.size("vector") == dimension).select("vec_id", "vector", "asked", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    # The smallest ids of each vector: the limit per vector is applied before the rows move.
    numbered = rows.select("vec_id", *same).distinct().withColumn("n", F.row_number().over(W.partitionBy(*same).orderBy("vec_id"))).where(F.col("n") <= neighbours + 1)
    ids = numbered.groupBy(*same).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    single = rows.groupBy(*same).agg(F.max("asked").alias("asked"), F.first("vector").alias("vector"))
    entries = written(single.join(ids, same).select(F.col("ids")[0].alias("entry"), "vector", "asked", "ids"), "lsh-entries")
    asked = written(rows.where("asked").select("vec_id", *same).distinct().join(ids, same).select(F.col("vec_id").alias("query_id"), F.col("ids")[0].alias("query")), "lsh-queries")
    tables, count = fit(entries, dimension)
    tasks = 1 + entries.count() * TABLES // TASK_ENTRIES

    plain = entries.select("entry", "vector")
    index = written(plain.mapInArrow(_indexer(tables), "entry long, vector array<double>, keys array<long>").select(
        "entry", "vector", F.explode("keys").alias("key")), "lsh-index")
    large = small(written(index.groupBy("key").count().where(F.col("count") > TASK_ENTRIES).select(
        "key", F.ceil(F.col("count") / TASK_ENTRIES).cast("int").alias("parts")), "lsh-large"))
    parts = F.coalesce("parts", F.lit(1))

    def task(part):
        return F.pmod(F.xxhash64("key", part), F.lit(tasks)).alias("task")
    dealt = index.join(large, "key", "left").select("key", "entry", F.col("entry").alias("first_id"), "vector", task(F.pmod(F.xxhash64("entry"), parts).cast("int")))
    probes = entries.where("asked").select("entry", "vector").mapInArrow(_prober(tables, count), "query long, key long")
    probes = probes.join(large, "key", "left").select("query", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select("query", "key", task(F.col("part")))
    probes = probes.groupBy("task", "query").agg(F.collect_list("key").alias("keys"))
    probes = probes.join(plain.withColumnRenamed("entry", "query"), "query")
    found = dealt.groupBy("task").cogroup(probes.groupBy("task")).applyInArrow(
        _ranker(neighbours + 1), "query long, entry long, score double, first_id long").select("query", "entry", "score").distinct()
    best = W.partitionBy("query").orderBy("score", "entry")
    found = written(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= neighbours + 1).drop("n"), "lsh-found")

    sizes = entries.select("entry", F.size("ids").alias("copies"))
    enough = found.join(sizes, "entry").groupBy("query").agg(F.sum("copies").alias("copies")).where(F.col("copies") > neighbours)
    short = written(entries.where("asked").select(F.col("entry").alias("query"), F.col("vector").alias("x")).join(enough, "query", "left_anti"), "lsh-short")
    if not short.isEmpty():
        # A stated set of queries that have too few candidates: each meets all entries.
        score = F.sqrt(F.aggregate(F.zip_with("x", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        rest = short.crossJoin(plain).select("query", "entry", score.alias("score"))
        rest = rest.withColumn("n", F.row_number().over(best)).where(F.col("n") <= neighbours + 1).drop("n")
        found = found.join(short.select("query"), "query", "left_anti").unionAll(rest)
    listed = found.join(entries.select("entry", "ids"), "entry").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    each = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["score"].alias("score"), i.alias("vec_id")))))
    ranked = F.slice(F.array_sort(F.filter(each, lambda e: e["vec_id"] != F.col("query_id"))), 1, neighbours)
    return asked.join(listed, "query").select("query_id", F.posexplode(ranked).alias("p", "e")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))

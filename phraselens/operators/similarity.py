"""Exact top-K similarity join between two tables of vectors.

A small index is broadcast, its size checked (of sparse vectors the used entries alone), and every batch of queries is compared with
it where it is read: in single precision first, then in double precision what comes near the best. A larger one is
cut into blocks with bounds (see `bounds`). A query first reads the blocks that promise most; the K-th best score
there is what any other block has to reach, so in a second round it goes to those blocks only whose bound does.
Queries and blocks meet in cells of bounded size that pass on K rows per query, so neither table is ever gathered at one
place and what moves grows with the blocks that are read. Columns of the index (phrase, cluster, ratio) ride along, so
the result needs no lookup join in which a phrase that is near everything would be a hot key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraselens.operators.bounds import MAX_LISTS, LIST_LEVELS, Balls, Lists, build_balls, build_lists, matrix, sparse_columns, thinned
from phraselens.session import written

BLOCK_BYTES = 32 << 20      # vectors of a block, and of the queries that meet it in one cell, in double precision
LOCAL_BYTES = 32 << 20      # an index up to this size is broadcast
SPARSE_SHARE = 8            # vectors are sparse if they use less than one entry in so many
QUERY_ROWS = 256            # queries compared at a time
CHUNK_ROWS = 2_048          # with so many rows: 2 MB of scores
SCREEN_CELLS = 1 << 17      # entries that are summed at a time, if vectors are sparse
GROUPS = 64                 # groups of rows whose maxima give a query its first limit
LISTED = 8                  # lists are used if they hold less than one pair in so many
PAIRS = 1 << 16             # pairs computed in double precision at a time
VISITS = 4_096              # visits made at a time
TASK_CELLS = 1 << 28        # query and index pairs a task compares, about
DECIMALS = 9                # far below float32 noise, far above double-precision noise


def _dense_rows(index: pa.Table) -> tuple:
    """(vectors as stored, squares) of the rows of an index."""
    x = matrix(index["embedding"], keep=True)
    return x, np.einsum("ij,ij->i", x, x, dtype=np.float64)


def _sparse_rows(index: pa.Table) -> tuple:
    """(used buckets, the place among them and the weight of each entry of a row, squares); short rows are filled with weights of 0."""
    at, weight = (index[c].combine_chunks() for c in ("at", "weight"))
    used, place = np.unique(at.flatten().to_numpy(), return_inverse=True)
    size = np.diff(at.offsets.to_numpy())
    most = int(size.max(initial=0))
    slot = (np.repeat(np.arange(len(size)), size), np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size))
    buckets, weights = np.zeros((len(size), most), np.int64), np.zeros((len(size), most))
    buckets[slot], weights[slot] = place, weight.flatten().to_numpy()
    return used, buckets, weights, np.asarray(index["square"], np.float64)


class _Rows:
    """The rows of an index, or of one block, sorted by id and ready to be compared with any number of queries.

    Each pair is first compared in single precision, with the K-th best score that its query has so far less what such
    a product can be off; only what comes near is computed in double precision. Chunks follow the ids, so a
    later row with an equal score is none of the best.
    """

    def __init__(self, index: pa.Table, cosine: bool):
        self.table, self.cosine, self.sparse = index.sort_by("phrase_id"), cosine, "at" in index.schema.names
        if self.sparse:
            self.used, self.x, self.weights, self.square = _sparse_rows(self.table)
            terms = self.x.shape[1]
        else:
            self.x, self.square = _dense_rows(self.table)
            terms = self.x.shape[1]
        finite = self.square[np.isfinite(self.square)]
        norm = np.sqrt(self.square)
        self.longest, self.off = 1.0 if cosine else float(np.sqrt(finite.max(initial=0))), (terms + 8) * 2.0 ** -23
        self.kind = np.float32 if self.longest < 1e15 else np.float64
        share = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)[:, None] if cosine else 1.0
        self.rough = ((self.weights if self.sparse else self.x) * share).astype(self.kind) if cosine or self.sparse else self.x.astype(self.kind, copy=False)
        self.buckets = np.ascontiguousarray(self.x.T) if self.sparse else None
        self.lists = [self._lists(start) for start in range(0, len(self.square), CHUNK_ROWS)] if self.sparse else []

    def _lists(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: where the list of each used entry begins, its rows and their weights."""
        row, j = np.nonzero(self.weights[start:start + CHUNK_ROWS])
        entry = self.x[start + row, j]
        order = np.argsort(entry, kind="stable")
        return np.searchsorted(entry[order], np.arange(len(self.used) + 1)), row[order], self.rough[start + row, j][order].astype(np.float64)

    def queries(self, queries: pa.Table) -> tuple[Callable, np.ndarray]:
        """(dense vectors of some queries over the entries that any row uses, squares of all queries)."""
        if not self.sparse:
            q = matrix(queries["query"])
            return lambda start, end: q[start:end], np.einsum("ij,ij->i", q, q)
        if "query" in queries.schema.names:
            q = matrix(queries["query"])
            thin = q[:, self.used] if len(self.used) else np.zeros((len(q), 1))
            return lambda start, end: thin[start:end], np.einsum("ij,ij->i", q, q)
        q_at, q_weight = (queries[c].combine_chunks() for c in ("q_at", "q_weight"))
        offsets, entry = q_at.offsets.to_numpy(), q_at.flatten().to_numpy()
        column = np.minimum(np.searchsorted(self.used, entry), max(len(self.used) - 1, 0))
        hit = self.used[column] == entry if len(self.used) else np.zeros(len(entry), bool)
        row = np.repeat(np.arange(len(q_at)), np.diff(offsets))
        values = q_weight.flatten().to_numpy()

        def vectors(start: int, end: int) -> np.ndarray:
            mine = slice(*np.searchsorted(row, (start, end)))
            q, found = np.zeros((end - start, max(len(self.used), 1))), hit[mine]
            q[row[mine][found] - start, column[mine][found]] = values[mine][found]
            return q
        return vectors, np.asarray(queries["q_square"], np.float64)

    def roughly(self, q: np.ndarray, start: int, end: int, room: list) -> np.ndarray:
        """Scores of the rows from start to end (down) with the queries whose entries are the columns of q."""
        out = room[0][:end - start, :q.shape[1]]
        if not self.sparse:
            return np.matmul(self.rough[start:end], q, out=out)
        out[:] = 0
        piece = max(1, SCREEN_CELLS // q.shape[1])          # stays in the cache of a core
        for at in range(start, end, piece):
            until = min(at + piece, end)
            mine, spare = out[at - start:until - start], room[1][:until - at, :q.shape[1]]
            for buckets, weights in zip(self.buckets, self.rough.T):
                np.take(q, buckets[at:until], axis=0, out=spare, mode="clip")
                spare *= weights[at:until, None]
                mine += spare
        return out

    def shared(self, entries: tuple, sizes: np.ndarray, chunk: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, query, share of its score) of all pairs of the entries (query, entry, weight) and the rows of their lists; cells count row by row of a query."""
        starts, row, weight = self.lists[chunk]
        r, entry, w = entries
        at = np.repeat(starts[entry] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        query = np.repeat(r, sizes)
        return row[at] + query * rows, query, weight[at] * np.repeat(w, sizes)

    def exactly(self, q: np.ndarray, q_square: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query r and a row c, to DECIMALS."""
        v = np.zeros(len(r))
        for at in range(0, len(r), PAIRS):
            some, rows = r[at:at + PAIRS], c[at:at + PAIRS]
            if self.sparse:
                for j in range(self.x.shape[1]):
                    v[at:at + PAIRS] += q[some, self.x[rows, j]] * self.weights[rows, j]
            else:
                v[at:at + PAIRS] = np.einsum("ij,ij->i", q[some], self.x[rows].astype(np.float64, copy=False))
        if self.cosine:
            squares = q_square[r] * self.square[c]
            v = np.divide(v, np.sqrt(squares), out=np.zeros_like(v), where=squares > 0)
        return np.floor(v * 10.0 ** DECIMALS + 0.5) / 10.0 ** DECIMALS

    def best(self, q: np.ndarray, q_square: np.ndarray, k: int, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best k rows of each query, best first; -inf where there are no more. Scores below `least` may be missing.

        own: the row that is the query itself, or -1.
        """
        n, norm = len(self.square), np.sqrt(q_square)
        scale = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0) if self.cosine else np.ones(len(q))
        kind = self.kind if self.cosine or self.longest * norm.max(initial=0) < 1e30 else np.float64
        columns = np.ascontiguousarray((q * scale[:, None]).T.astype(kind))
        slack = 1.5 * 10.0 ** -DECIMALS + self.off * (1.0 if self.cosine else norm * self.longest)
        top, found, reached = np.full((len(q), k), -np.inf), np.full((len(q), k), -1), least
        step, several = min(CHUNK_ROWS, n), k + bool((own >= 0).any())
        # Nothing is negative: what shares no entry scores 0, and of these the first rows are best.
        above_zero = self.sparse and bool((q >= 0).all()) and (several <= step or step == n)
        room = [np.empty((step, len(q)), kind), np.empty((min(step, max(1, SCREEN_CELLS // len(q))) if self.sparse else 0, len(q)), kind)]
        mask, entries = np.empty((step, len(q)), bool), None
        if self.sparse and len(self.used):
            r, entry = np.nonzero(columns.T)
            entries, sums = (r, entry, columns[entry, r].astype(np.float64)), np.zeros(len(q) * step)
        for start in range(0, n, step):
            end = min(start + step, n)
            sizes = np.diff(self.lists[start // step][0])[entries[1]] if entries else None
            listed = entries is not None and sizes.sum() * LISTED < len(q) * (end - start)
            floor = reached - slack
            rows = end - start
            if listed:
                cell, query, part = self.shared(entries, sizes, start // step, rows)
            if listed and above_zero and start:
                # Only what shares an entry can be better than what was found: the other cells are not looked at.
                np.add.at(sums, cell, part)
                near = np.unique(cell[sums[cell] > np.maximum(floor, 0)[query]])
                sums[cell] = 0
                r, c = divmod(near, rows)
                s = None
            elif listed:
                s = np.bincount(cell, part, len(q) * rows).astype(np.float64, copy=False).reshape(len(q), rows)
            else:
                s = self.roughly(columns, start, end, room)
            open_ = np.flatnonzero(np.isneginf(floor))
            if s is not None and len(open_) and rows > several:
                # The K-th largest of the maxima of groups: no more than the K-th largest score, and sooner found.
                groups = min(rows, max(GROUPS, 4 * several))
                cut = rows // groups * groups
                seen = s[open_, :cut].reshape(len(open_), groups, -1).max(axis=2).T if listed else s[:cut].reshape(groups, -1, len(q)).max(axis=1)[:, open_]
                seen = np.where(np.isnan(seen), -np.inf, seen)
                kth = np.partition(seen, groups - several, axis=0)[-several]
                floor[open_] = kth - 2 * (slack if self.cosine else slack[open_])
            if above_zero:
                floor = np.maximum(floor, 0)
            if listed and s is not None:
                near = s > floor[:, None]
                near[:, :several if above_zero and start == 0 else 0] = True
                r, c = divmod(np.flatnonzero(near), rows)
            elif s is not None:
                near = np.greater(s, floor.astype(kind), out=mask[:rows])
                near[:several if above_zero and start == 0 else 0] = True
                c, r = divmod(np.flatnonzero(near), len(q))
            c = c + start
            v = self.exactly(q, q_square, r, c)
            real = np.isfinite(v) & (v >= least[r]) & (v > top[r, -1]) & (c != own[r])
            if not real.any():
                continue
            r, c, v = r[real], c[real], v[real]
            touched = np.unique(r)
            r, c, v = np.concatenate([np.repeat(touched, k), r]), np.concatenate([found[touched].ravel(), c]), np.concatenate([top[touched].ravel(), v])
            order = np.lexsort((c, -v, r))
            r, c, v = r[order], c[order], v[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            kept = rank < k
            top[r[kept], rank[kept]], found[r[kept], rank[kept]] = v[kept], c[kept]
            reached = np.maximum(least, top[:, -1])
        return found, top

    def search(self, queries: pa.Table, k: int, skip_self: bool, schema: pa.Schema) -> pa.Table:
        """Top k rows for each query, best first, equals by phrase_id."""
        if not queries.num_rows or not self.table.num_rows:
            return schema.empty_table()
        vectors, q_square = self.queries(queries)
        own, least = np.full(len(q_square), -1), np.full(len(q_square), -np.inf)
        if skip_self:   # A query is left out of its own result by position: where its id stands in the sorted index.
            at = pc.index_in(queries["q_id"].cast(self.table["phrase_id"].type), self.table["phrase_id"])
            own = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if "least" in queries.schema.names:
            least = pc.fill_null(queries["least"], -np.inf).to_numpy().astype(np.float64)
        rows, cols, sims, ranks = [], [], [], []
        for start in range(0, len(q_square), QUERY_ROWS):
            end = min(start + QUERY_ROWS, len(q_square))
            found, top = self.best(vectors(start, end), q_square[start:end], k, own[start:end], least[start:end])
            r, rank = np.nonzero(np.isfinite(top))
            rows.append(r + start), cols.append(found[r, rank]), sims.append(top[r, rank]), ranks.append(rank + 1)
        # Vectors stay behind: with some neighbours for each query, copies of them would be most of a worker's memory.
        near = self.table.select([f.name for f in schema if f.name in self.table.schema.names]).take(pa.array(np.concatenate(cols)))
        ids = queries["q_id"].take(pa.array(np.concatenate(rows)))
        made = {"q_id": ids, "rank": pa.array(np.concatenate(ranks)), "similarity": pa.array(np.concatenate(sims))}
        return pa.table([(made[f.name] if f.name in made else near[f.name]).cast(f.type) for f in schema], schema=schema)


def _search(queries: pa.Table, index: pa.Table, k: int, cosine: bool, skip_self: bool, schema: pa.Schema) -> pa.Table:
    """Top k index rows for each query of one cell."""
    return _Rows(index, cosine).search(queries, k, skip_self, schema)


@dataclass
class Index:
    """A searchable table: `rows` are the whole index, or with `blocks` the index cut into blocks."""

    rows: DataFrame
    size: int
    cosine: bool
    k: int
    columns: list
    share: int = 1              # queries that meet a block in one cell
    blocks: Balls | Lists | None = None


def prepare(index: DataFrame, k: int, cosine: bool = False, block_rows: int | None = None, local_bytes: int = LOCAL_BYTES) -> Index:
    """An index(phrase_id, embedding, ...) ready for any number of searches for at most k neighbours.

    Rows without an embedding are left out. `cosine` divides by both norms; without it the inner product is used as it is.
    An index of more than block_rows rows is cut into blocks even if it could be broadcast.
    """
    index = written(index.where(F.col("embedding").isNotNull()), "vector-index")
    extra = [c for c in index.columns if c not in ("phrase_id", "embedding")]
    text = sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ["phrase_id", *extra]), F.lit(0))
    used = F.size(F.filter("embedding", lambda x: x != 0))
    facts = index.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"), F.sum(text).alias("text"),
        F.max(used).alias("most"), F.avg(used).alias("mean"), F.min(F.array_min("embedding")).alias("least")).first()
    fields = [index.schema["phrase_id"], *[index.schema[c] for c in extra]]
    n, dim = facts["n"], facts["dim"] or 1
    rows_a_block = block_rows or max(1, BLOCK_BYTES // (8 * dim))
    share = max(1, BLOCK_BYTES // (8 * dim))
    sparse = n > 0 and facts["mean"] * SPARSE_SHARE <= dim and facts["least"] >= 0
    # What a task holds: of sparse vectors the used entries alone.
    width = 4 if index.schema["embedding"].dataType.elementType == T.FloatType() else 8
    size = n * (facts["mean"] * 12 + 8 if sparse else dim * width) + (facts["text"] or 0)
    if (block_rows is None or n <= max(k, block_rows)) and size <= local_bytes:
        return Index(thinned(index) if sparse else index, n, cosine, k, fields, share)
    if sparse and dim * LIST_LEVELS <= MAX_LISTS:
        rows, blocks = build_lists(index, dim, k, facts["most"], rows_a_block, cosine)
    else:
        rows, blocks = build_balls(index, n, dim, rows_a_block, cosine)
    return Index(written(rows, "index-blocks"), n, cosine, k, fields, share, blocks)


def _result_type(queries: DataFrame, index: Index) -> T.StructType:
    fields = [T.StructField("q_id", queries.schema["q_id"].dataType), T.StructField("rank", T.IntegerType()), index.columns[0],
              T.StructField("similarity", T.DoubleType()), *index.columns[1:]]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _search_local(queries: DataFrame, n_queries: int, index: Index, k: int, skip_self: bool) -> DataFrame:
    """Every batch of queries against the whole broadcast index; nothing is shuffled but to spread long work over tasks."""
    cosine, schema = index.cosine, _result_type(queries, index)
    arrow, sent = to_arrow_schema(schema), queries.sparkSession.sparkContext.broadcast(index.rows.toArrow())

    def search(batches):
        rows = None
        for batch in batches:
            rows = rows or _Rows(sent.value, cosine)
            yield from rows.search(pa.Table.from_batches([batch]), k, skip_self, arrow).to_batches()

    tasks = math.ceil(n_queries * index.size / TASK_CELLS)
    return (queries.repartition(tasks) if tasks > 1 else queries).mapInArrow(search, schema)


def visits(queries: DataFrame, index: Index, first: bool) -> DataFrame:
    """One row per query and block it reads, with what the cell needs of the query.

    queries has q_id, query and, for the second round, least: the score that a block must be able to reach, and below
    which nothing need be found in it.
    """
    sent, sparse = queries.sparkSession.sparkContext.broadcast(index.blocks), isinstance(index.blocks, Lists)
    kind = queries.schema["q_id"].dataType.simpleString()
    schema = f"q_id {kind}, block int, " + ("q_at array<int>, q_weight array<double>, q_square double" if sparse else "query array<double>") + ("" if first else ", least double")

    def plan(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                q = matrix(part["query"])
                if sparse and (q < 0).any():
                    raise ValueError("an index of vectors without negative entries is searched with such vectors only")
                reads = sent.value.first(q) if first else sent.value.rest(q, np.asarray(part["least"], np.float64))
                row, block = np.nonzero(reads)
                carried = [*(sparse_columns(q) if sparse else [part["query"]]), *([] if first else [part["least"]])]
                for some in (slice(i, i + VISITS) for i in range(0, len(row), VISITS)):
                    taken = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays(
                        [part["q_id"].take(taken), pa.array(block[some].astype(np.int32)), *[c.take(taken) for c in carried]],
                        ["q_id", "block", *(("q_at", "q_weight", "q_square") if sparse else ("query",)), *([] if first else ["least"])])
    return queries.mapInArrow(plan, schema)


def _read(asked: DataFrame, n_queries: int, index: Index, k: int, skip_self: bool, schema: T.StructType) -> DataFrame:
    """The best k of each cell of a block and a share of the queries."""
    parts, cosine, arrow = 1 + n_queries // index.share, index.cosine, to_arrow_schema(schema)
    left = asked.withColumn("part", F.pmod(F.xxhash64("q_id"), F.lit(parts)).cast("int"))
    right = index.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def cell(queries: pa.Table, rows: pa.Table) -> pa.Table:
        return _search(queries, rows, k, cosine, skip_self, arrow)

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(cell, schema)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query; a row that several blocks hold counts once."""
    best = W.partitionBy("q_id").orderBy(F.desc("similarity"), "phrase_id")
    near = found.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k)
    return near.dropDuplicates(["q_id", "rank"])


def _search_blocks(queries: DataFrame, n_queries: int, index: Index, k: int, skip_self: bool) -> DataFrame:
    schema = _result_type(queries, index)
    near = written(_merge(_read(visits(queries, index, True), n_queries, index, k, skip_self, schema), k), "first-neighbours")
    # Fewer than k so far: any block may hold one of the best.
    least = near.groupBy("q_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
    again = queries.join(least, "q_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = _read(visits(again, index, False), n_queries, index, k, skip_self, schema)
    return _merge(near.unionByName(rest), k).select(*[f.name for f in schema])


def top_k_neighbours(queries: DataFrame, index: DataFrame | Index, k: int, cosine: bool = False, skip_self: bool = False,
                     block_rows: int | None = None, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """For each row of queries(q_id, embedding) the k nearest of index(phrase_id, embedding, ...).

    Returns q_id, rank, phrase_id, similarity and the index's other columns. With fewer than k index
    rows there are fewer neighbours. Ids must be unique. An index that is searched more than once should be
    prepared first; how it is cut never changes the result.
    """
    if not isinstance(index, Index):
        index = prepare(index, k, cosine, block_rows, local_bytes)
    if k > index.k:
        raise ValueError(f"the index was prepared for at most {index.k} neighbours")
    # A column of its own for the queries: both tables may stem from the same one.
    asked = queries.where(F.col("embedding").isNotNull()).select("q_id", F.col("embedding").cast("array<double>").alias("query"))
    asked = written(asked, "queries")
    return (_search_local if index.blocks is None else _search_blocks)(asked, asked.count(), index, k, skip_self)

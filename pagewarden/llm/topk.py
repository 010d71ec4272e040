"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are sorted by their dominant component and packed into blocks, so that like vectors share one;
a block holds the vectors as an integer matrix and, for each dimension, the order of its rows by that
component: the sorted lists, read from both ends, as a query's weight may have either sign. For each
block the lists are read to a growing depth, for all its queries together: rows met for the first time
are scored in full, by one matrix product a depth. No vector not yet met can score above the
threshold, the query's product with the components at the present depth, so a query leaves the
block when that falls below its kth score so far; thresholds of all queries at all depths are one
matrix product as well, and a query whose threshold at depth 0 can't win never enters.

Every query starts with a global lower bound of its kth score: a first pass searches only the blocks
that hold the query's own dominant component. A task carries its kth scores from block to block.

The index of blocks is built once and staged. Queries are taken QUERY_BLOCK at a time and broadcast:
QUERY_BLOCK vectors, whatever the input. Each task returns k rows a query at most, and a window over
the query's id settles the ranks.

Cases: vectors that are null or hold null or non-finite components take no part, neither do
rows without an id; shorter vectors, empty ones too, count as if zeros followed; rows that repeat an id are candidates
each, but never for a query of that id; rows of a query id that repeats give one set of ranks, of its
first vector in the order of components; ties go to the smaller vec_id; scores are exact while they
fit 63 bits; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Rows of a block, queries that are broadcast at once, and depths to which the lists are read.
BLOCK = 4096
QUERY_BLOCK = 8192
FIRST_DEPTH = 8
GROWTH = 3
#: Queries whose scores of a depth are held at once.
SCORED_AT_ONCE = 512


def quantised(column: str = "embedding") -> Column:
    """Each component x as floor(256 * x)."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def _fit(column: str) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows, with zeros after the shorter ones."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _cell(q: str) -> Column:
    """Number of the dominant component and its sign; -1 without components."""
    size = F.transform(q, lambda x: F.abs(x))
    at = F.array_position(size, F.array_max(size))
    return F.when(F.size(q) > 0, 2 * at + (F.get(q, (at - 1).cast("int")) < 0).cast("long")).otherwise(F.lit(-1)).cast("long")


def _block(cells: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(rows, axis=0, kind="stable").astype("<i4")
    bounds = {"low": pa.array([int(cells.min())], pa.int64()), "high": pa.array([int(cells.max())], pa.int64())}
    return pa.RecordBatch.from_pydict({"dims": pa.array([rows.shape[1]], pa.int32()), **bounds, "ids": [ids.astype("<i8").tobytes()], "rows": [rows.astype("<i8").tobytes()], "orders": [np.ascontiguousarray(order.T).tobytes()]})


def _joined(held: list[tuple]) -> tuple:
    width = max(r.shape[1] for *_, r in held)
    return *(np.concatenate([h[i] for h in held]) for i in range(2)), np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for *_, r in held])


def _pack(size: int):
    """Blocks of `size` rows: cells from and to, ids, matrix, and the order of the rows in each dimension."""

    def run(batches):
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("q"))))
                if sum(len(i) for _, i, _ in held) >= size:
                    parts = _joined(held)
                    whole = len(parts[0]) // size * size
                    for at in range(0, whole, size):
                        yield _block(*(x[at : at + size] for x in parts))
                    held = [tuple(x[whole:] for x in parts)] if whole < len(parts[0]) else []
        if held:
            yield _block(*_joined(held))

    return run


def index(vectors: DataFrame) -> DataFrame:
    """The staged blocks of vectors(vec_id, q of long)."""
    sized = vectors.select("vec_id", "q", _cell("q").alias("cell"))
    ordered = sized.orderBy("cell", F.array_max(F.transform("q", lambda x: F.abs(x))), "vec_id")
    return stage(ordered.mapInArrow(_pack(BLOCK), "dims int, low bigint, high bigint, ids binary, rows binary, orders binary"), "blocks")


class Best:
    """The k best of each query so far. floor: lower bounds of the kth scores."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(queries, -np.inf) if floor is None else floor
        self.scores, self.ids = np.full((queries, k), -np.inf), np.zeros((queries, k), dtype=np.int64)
        self.exact = np.zeros((queries, k), dtype=np.int64)

    def kth(self, which) -> np.ndarray:
        return np.maximum(self.floor[which], self.scores[which, -1])

    def take(self, which: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores [queries in which, ids] are met: the k best stay, ties to the smaller id."""
        k = self.k
        least = self.kth(which)
        if scores.shape[1] > k + 1:  # one may be the query itself
            least = np.maximum(least, np.partition(scores, -k - 1, axis=1)[:, -k - 1])
        q, at = np.nonzero((scores >= least[:, None]) & (ids[None, :] != own[which][:, None]))
        if not len(q):
            return
        some = np.unique(q)
        into = which[some]
        held = self.scores[into] > -np.inf
        q = np.concatenate((np.searchsorted(some, q), np.nonzero(held)[0]))
        s = np.concatenate((scores[some[q[: len(at)]], at].astype(np.int64), self.exact[into][held]))
        i = np.concatenate((ids[at], self.ids[into][held]))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        good = rank < k
        q, s, i, rank = q[good], s[good], i[good], rank[good]
        self.scores[into], self.exact[into] = -np.inf, 0
        self.scores[into[q], rank], self.exact[into[q], rank], self.ids[into[q], rank] = s, s, i


def threshold_search(queries: np.ndarray, own: np.ndarray, which: np.ndarray, ids: np.ndarray, rows: np.ndarray, orders: np.ndarray, best: Best, first: int = FIRST_DEPTH) -> int:
    """Searches a block for the queries numbered in `which`; returns how many scores were computed."""
    n, dims = rows.shape
    if not n or not len(which):
        return 0
    depths = [0]
    while depths[-1] < n:
        depths.append(min(n, max(first, depths[-1] * GROWTH)))
    every = np.arange(dims)
    read = [max(1, t) for t in depths]
    tops = np.stack([rows[orders[every, n - t], every] for t in read]) if dims else np.zeros((len(read), 0), rows.dtype)
    lows = np.stack([rows[orders[every, t - 1], every] for t in read]) if dims else tops
    wanted = queries[which]
    bound = np.maximum(wanted, 0) @ tops.T + np.minimum(wanted, 0) @ lows.T
    # the depth at which either end of some list first shows a row
    place = np.empty((dims, n), dtype=np.int64)
    np.put_along_axis(place, orders.astype(np.int64), np.broadcast_to(np.arange(n), (dims, n)), axis=1)
    met = np.minimum(place, n - 1 - place).min(axis=0) if dims else np.zeros(n, dtype=np.int64)
    work = 0
    live = np.flatnonzero(bound[:, 0] >= best.kth(which))
    for level in range(1, len(depths)):
        fresh = np.flatnonzero((met >= depths[level - 1]) & (met < depths[level]))
        if len(fresh):
            part = np.ascontiguousarray(rows[fresh].T)
            for at in range(0, len(live), SCORED_AT_ONCE):
                some = live[at : at + SCORED_AT_ONCE]
                best.take(which[some], own, wanted[some] @ part, ids[fresh])
            work += len(live) * len(fresh)
        live = live[bound[live, level] >= best.kth(which[live])]
        if not len(live):
            break
    return work


def _search(sent, k: int, home: bool):
    def run(batches):
        own, queries, cells, floor = sent.value
        own = np.array(own, dtype=np.int64)
        best = Best(len(own), k, None if home else floor)
        for batch in batches:
            for dims, low, high, ids, rows, orders in zip(*(c.to_pylist() for c in batch.columns)):
                which = np.flatnonzero((cells >= low) & (cells <= high)) if home else np.arange(len(own))
                ids = np.frombuffer(ids, dtype="<i8")
                rows = np.frombuffer(rows, dtype="<i8").reshape(len(ids), dims)
                orders = np.frombuffer(orders, dtype="<i4").reshape(dims, len(ids))
                width = max(dims, queries.shape[1])
                if dims < width:  # dimensions that the block lacks are zeros, in any order
                    rows = np.pad(rows, ((0, 0), (0, width - dims)))
                    orders = np.concatenate([orders, np.broadcast_to(np.arange(len(ids), dtype="<i4"), (width - dims, len(ids)))])
                wide = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                # doubles are exact up to 2**53, and much faster
                most = float(width) * float(np.abs(rows).max(initial=0)) * float(np.abs(wide).max(initial=0))
                kind = np.float64 if most < 1 << 53 else np.int64
                threshold_search(wide.astype(kind), own, which, ids, rows.astype(kind), orders, best)
        q, j = np.nonzero(best.scores > -np.inf)
        if len(q):
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(own[q]), "vec_id": pa.array(best.ids[q, j]), "score": pa.array(best.exact[q, j])})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each row where is_query holds."""
    spark = vectors.sparkSession
    clean = vectors.filter(_fit(vector) & F.col(id).isNotNull())
    packed = index(clean.select(F.col(id).cast("long").alias("vec_id"), quantised(vector).alias("q")))
    queries = clean.filter(is_query).groupBy(F.col(id).cast("long").alias("query_id")).agg(F.min(quantised(vector)).alias("q"))
    queries = stage(queries.withColumn("cell", _cell("q")).sortWithinPartitions("query_id"), "queries")
    schema = "query_id bigint, vec_id bigint, score bigint"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found, last = [], None
    while True:  # a round for each QUERY_BLOCK queries
        some = queries if last is None else queries.filter(F.col("query_id") > last)
        some = some.orderBy("query_id").limit(QUERY_BLOCK).toArrow()
        if not some.num_rows:
            break
        own, cells = some.column("query_id").to_pylist(), some.column("cell").to_numpy()
        last = own[-1]
        matrix, floor = _matrix(some.column("q").combine_chunks()), np.full(len(own), -np.inf)
        sent = spark.sparkContext.broadcast((own, matrix, cells, floor))
        near = packed.mapInArrow(_search(sent, k, True), schema)
        near = near.withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query at most
        floor[np.searchsorted(own, near.column("query_id").to_numpy())] = near.column("score").to_numpy()
        sent = spark.sparkContext.broadcast((own, matrix, cells, floor))
        found.append(stage(packed.mapInArrow(_search(sent, k, False), schema), "found"))
        if len(own) < QUERY_BLOCK:
            break
    if not found:
        return spark.range(0).selectExpr("id query_id", "cast(id as int) rank", "id vec_id", "id score")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k by integer inner product, over a grid of query and candidate shards.

Queries and candidates are dealt into shards by a hash of their id; every
(query shard, candidate shard) cell of the grid is one group.  In a cell,
tiles of the product of the two matrices are taken one after another; from
each tile the k best columns per query are selected by partition and merged
into the cell's lists.  The cells' lists of a query are then merged as a tree,
``FAN_IN`` lists at a time, until one is left.

Scores are exact: products run in float64 where the bound dim * max|q| * max|c|
keeps every sum and selection key under 2^53, in 64-bit integers up to 2^63,
and in Python integers beyond, where scores saturate at the range of a long.

Defined results: vectors null, or holding null or non-finite components, take
no part; vectors of different lengths meet as if padded by zeros; rows that
repeat an id are one candidate (and one query) whose score is the highest of
its rows; a null id takes no part; equal scores go to the smaller id; fewer
than k candidates give fewer rows; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a query shard and of a candidate shard, on average.
QUERY_SHARD, CANDIDATE_SHARD = 2048, 16384
#: Smallest number of candidate shards, for parallel work on small tables.
LEAST_SHARDS = 48
#: Rows and columns of a tile, and lists merged at a time.
TILE_ROWS, TILE_COLUMNS = 512, 4096
FAN_IN = 16
_LONG = 2 ** 63 - 1


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of usable vectors, saturated to longs."""
    usable = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))))
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(column).to_numpy()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, padded by zeros."""
    flat = pc.list_flatten(column).to_numpy()
    lengths = _lengths(column)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _largest(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, saturated."""
    bound = _largest(q) * _largest(c) * max(1, q.shape[1])
    if bound < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound <= _LONG:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -_LONG, _LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, ids, scores) of each row's k best; columns ascend by id."""
    rows, n = scores.shape
    low = int(scores.min(initial=0))
    if n <= k:
        col = np.broadcast_to(np.arange(n), (rows, n))
    elif (int(scores.max()) - low + 1) * n < 2 ** 62:
        # One key of score and place: partial selection without ties.
        key = (scores - low) * n + (n - 1 - np.arange(n))
        col = np.argpartition(key, n - k, axis=1)[:, n - k:]
    else:
        col = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    at = np.repeat(np.arange(rows), col.shape[1])
    return at, ids[col.ravel()], scores[at, col.ravel()]


def _merge(query: np.ndarray, cand: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query in lists laid end to end."""
    order = np.lexsort((cand, -score, query))
    query, cand, score = query[order], cand[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return query[keep], cand[keep], score[keep]


def _unique_rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by id, distinct ids, first place of each in that order)."""
    order = np.argsort(ids, kind="stable")
    known, first = np.unique(ids[order], return_index=True)
    return order, known, first


def _cell(k: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64),) * 3]
        if queries.num_rows and candidates.num_rows:
            width = max(int(_lengths(queries["qv"]).max()), int(_lengths(candidates["cv"]).max()))
            order, qid, qfirst = _unique_rows(queries["query"].to_numpy())
            q = _matrix(queries["qv"], width)[order]
            order, cid, cfirst = _unique_rows(candidates["candidate"].to_numpy())
            c = _matrix(candidates["cv"], width)[order]
            qstop, cstop = np.append(qfirst[1:], len(q)), np.append(cfirst[1:], len(c))
            for a in range(0, len(qid), TILE_ROWS):
                rows = slice(a, min(a + TILE_ROWS, len(qid)))
                held = found[0]
                for b in range(0, len(cid), TILE_COLUMNS):
                    cols = slice(b, min(b + TILE_COLUMNS, len(cid)))
                    tile = _scores(q[qfirst[rows][0]:qstop[rows][-1]], c[cfirst[cols][0]:cstop[cols][-1]])
                    if len(q) != len(qid):  # rows of one id: the highest score
                        tile = np.maximum.reduceat(tile, qfirst[rows] - qfirst[rows][0], axis=0)
                    if len(c) != len(cid):
                        tile = np.maximum.reduceat(tile, cfirst[cols] - cfirst[cols][0], axis=1)
                    at, ids, score = _best(tile, cid[cols], k + 1)  # one more: the query's own row goes
                    mine = qid[rows][at]
                    other = mine != ids
                    held = _merge(*(np.concatenate(x) for x in zip(held, (mine[other], ids[other], score[other]))), k)
                found.append(held)
        lists = [np.concatenate(x) for x in zip(*found)]
        return _as_table(key[1].as_py(), lists)
    return run


def _as_table(node: int, lists) -> pa.Table:
    query, cand, score = lists
    return pa.table({"node": np.full(len(query), node, np.int32), "query_id": query, "vec_id": cand, "score": score})


def _merge_lists(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _as_table(key[1].as_py(), _merge(*(table[c].to_numpy() for c in ("query_id", "vec_id", "score")), k))
    return run


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates but its own id.

    Both sides are (vec_id, v) from :func:`quantised`; the queries are a stated
    set, met with all candidates in blocks.
    """
    nq, nc = queries.count(), candidates.count()
    qs = max(1, -(-nq // QUERY_SHARD))
    cs = max(LEAST_SHARDS, -(-nc // CANDIDATE_SHARD))

    def shard(column, n, seed):
        return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Names of their own on either side: both may come from one table.
    q = queries.select(F.col("vec_id").alias("query"), F.col("v").alias("qv"),
                       shard("vec_id", qs, 1).alias("q"), every(cs).alias("c"))
    c = candidates.select(F.col("vec_id").alias("candidate"), F.col("v").alias("cv"),
                          every(qs).alias("q"), shard("vec_id", cs, 2).alias("c"))
    schema = "node int, query_id long, vec_id long, score long"
    level = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInArrow(_cell(k), schema)
    # One list of a query per candidate shard; a level of the tree merges FAN_IN of them.
    left = cs
    while left > 1:
        left = -(-left // FAN_IN)
        level = (level.select("query_id", "vec_id", "score", F.floor(F.col("node") / FAN_IN).cast("int").alias("node"),
                              shard("query_id", qs * 8, 3).alias("bin"))
                 .groupBy("bin", "node").applyInArrow(_merge_lists(k), schema))
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return level.select("query_id", F.row_number().over(best_first).alias("rank"), "vec_id", "score")

"""Operator 3: exact top-k inner products by block-at-a-time pruning.

Vectors become integers floor(1024 * x).  Candidates and queries meet in grid
cells of at most about `cell_docs` x `cell_queries` rows, so neither side is
ever whole in a task or in a broadcast.  In a cell the candidates are ordered
by id and cut into range blocks with a forward index (their integer matrix)
and the largest and smallest value of each component.  A query's bound for a
block is the sum over its components of the larger product; blocks are taken
in falling order of the bound, and a query is done when the next bound lies
below its k-th score.  A bound equal to the k-th score is still scored, since
a smaller id wins ties.  The cells' candidates (k per query and cell) meet in
one ranking per query.

Scores are exact integers up to 64 bits (float64 products only where every sum
is below 2 ** 53).  Rows: null vectors, vectors with null or non-finite
components and null ids take no part; vectors of different length are compared
on their common components; repeated candidate rows are candidates each,
repeated query rows are one query; an empty table gives no rows; fewer than k
candidates give all of them.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
TOP = 10
QUERY_EVERY = 100
BLOCK = 128
CELL_DOCS = 16_384
CELL_QUERIES = 4_096

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.asarray(pc.list_value_length(col).fill_null(0)) if len(col) else np.empty(0, np.int64)
    out = np.zeros((len(col), width), dtype=np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = np.asarray(col.flatten(), dtype=np.int64)
    return out


def _width(*cols) -> int:
    return max([1, *(int(pc.max(pc.list_value_length(c)).as_py() or 0) for c in cols if len(c))])


def block_search(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int,
                 block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Best scores and ids per query (rows padded with the smallest integer),
    and the number of (query, block) pairs that were scored."""
    order = np.argsort(ids, kind="stable")
    ids, docs = ids[order], docs[order]
    edges = np.arange(0, len(ids), block)
    exact = float(np.abs(docs).max(initial=0)) * float(np.abs(queries).max(initial=0)) * docs.shape[1] < 2 ** 53
    kind = np.float64 if exact else np.int64
    d, q = docs.astype(kind), queries.astype(kind)
    high, low = np.maximum.reduceat(d, edges, axis=0), np.minimum.reduceat(d, edges, axis=0)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    rank = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    best = np.full((len(q), top), none, dtype=np.int64)
    best_id = np.full((len(q), top), np.iinfo(np.int64).max, dtype=np.int64)
    active, scored = np.arange(len(q)), 0
    for r in range(len(edges)):
        blocks = rank[active, r]
        go = bound[active, blocks] >= best[active, -1]
        active, blocks = active[go], blocks[go]
        if not active.size:
            break
        scored += active.size
        by = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[by])) + 1
        for rows in np.split(active[by], cuts):
            b = edges[rank[rows[0], r]]
            own = ids[b:b + block]
            s = (q[rows] @ d[b:b + block].T).astype(np.int64)
            s[own[None, :] == query_ids[rows][:, None]] = none
            hit = np.flatnonzero((s >= best[rows, -1:]).any(axis=1))
            if hit.size:
                at = rows[hit]
                both = np.hstack([best[at], s[hit]])
                both_id = np.hstack([best_id[at], np.broadcast_to(own, (hit.size, own.size))])
                both_id[both == none] = np.iinfo(np.int64).max
                first = np.lexsort((both_id, -both.astype(np.float64) if exact else ~both), axis=1)[:, :top]
                best[at], best_id[at] = np.take_along_axis(both, first, 1), np.take_along_axis(both_id, first, 1)
    return best, best_id, scored


def _cell(top: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        width = _width(left.column("v"), right.column("v"))
        query_ids = np.asarray(right.column("vec_id"))
        best, ids, _ = block_search(np.asarray(left.column("vec_id")), _matrix(left.column("v"), width),
                                    query_ids, _matrix(right.column("v"), width), top)
        real = best != np.iinfo(np.int64).min
        return pa.table([pa.array(np.repeat(query_ids, real.sum(axis=1))), pa.array(ids[real]), pa.array(best[real])], schema=_OUT)
    return run


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = TOP,
          cell_docs: int = CELL_DOCS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query."""
    v = F.col("embedding")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")) \
        .where(F.col("vec_id").isNotNull() & _usable(v)) \
        .select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    is_query = (F.col("vec_id") % QUERY_EVERY == 0) if is_query is None else is_query
    queries = rows.where(is_query).distinct()
    n = rows.agg(F.count(F.lit(1)).alias("d"), F.count_if(is_query).alias("q")).first()
    down, across = max(1, -(-n["d"] // cell_docs)), max(1, -(-n["q"] // cell_queries))

    def spread(c: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(c, "v"), F.lit(parts)).cast("int")
    docs = rows.withColumn("i", spread("vec_id", down)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    asked = queries.withColumn("j", spread("vec_id", across)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    found = docs.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % {QUERY_EVERY} = 0) q JOIN v d ON q.vec_id <> d.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""

"""Operator 11: hard negatives by anchor spanning-tree bounds.

Vectors become integers floor(scale * x); a score is an integer inner product.
Anchors are dealt into blocks of about `cell_anchors`; a block's anchors are
joined by a minimum spanning tree over their distances (built once per block).
Candidates and blocks meet in grid cells, twice: first for the anchors'
positives (the best rows of the same label), then for the negatives in the
score windows that the positives open.  In a cell the tree's root is scored
against every candidate.  A child's score differs from its parent's by the
product of their difference with the candidate, so it lies within the edge's
length times the candidate's norm around the parent's score (around its
bounds, where the parent was not scored) and within its own norm times the
candidate's; only candidates whose interval meets an open window are scored
by the child, some anchors of a tree level at a time.  Windows narrow as they
fill: a bound below the last kept score is no overlap.  The cells' best rows
meet in one ranking per anchor (per anchor and positive).

Rows: a null id, label or vector, or a vector with a null or non-finite
component takes no part; vectors of different length are compared on their
common components; identical rows count once; rows of one id that differ are
rows of their own, but never partners of their own id; an anchor without
positives, or a positive of score 0 or less without equal scores, gives
nothing; an empty table gives no rows; extra columns are not read.  Scores
are exact while every sum is below 2 ** 63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage
from quire.llm.topk_search import _matrix, _usable, _width

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
CELL_DOCS = 8_192
CELL_ANCHORS = 1_024
_TOGETHER = 32
_AT_ONCE = 4_096
_NONE = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max

_TREE = "anchor long, vec_id long, label long, v array<long>, j int, place int, parent int, edge double"


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree from row 0 (Prim): rows in an order where parents
    come first, the parents' places in that order (-1: root), edge lengths."""
    n = len(points)
    x = points.astype(float)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, to = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, dtype=bool)
    at = 0
    for k in range(n):
        order[k], left[at] = at, False
        if k:
            parent[k], edge[k] = to[at], near[at]
        away = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = left & (away < near)
        near[closer], to[closer] = away[closer], k
        if left.any():
            at = int(np.where(left, near, np.inf).argmin())
    return order, parent, edge


def _planted(group: pa.Table) -> pa.Table:
    group = group.sort_by([("vec_id", "ascending"), ("anchor", "ascending")])
    order, parent, edge = spanning_tree(_matrix(group.column("v"), _width(group.column("v"))))
    group = group.take(pa.array(order))
    for name, values, kind in (("place", np.arange(len(order)), pa.int32()), ("parent", parent, pa.int32()), ("edge", edge, pa.float64())):
        group = group.append_column(name, pa.array(values).cast(kind))
    return group


class Cell:
    """Anchors of one tree (in tree order) and the candidates of one cell."""

    def __init__(self, docs: pa.Table, anchors: pa.Table):
        anchors = anchors.sort_by("place")
        width = _width(docs.column("v"), anchors.column("v"))
        ids, labels, c = np.asarray(docs.column("vec_id")), np.asarray(docs.column("label")), _matrix(docs.column("v"), width)
        first = np.ones(len(ids), dtype=bool)  # identical rows have one key and meet in one cell
        key = np.asarray(docs.column("anchor"))
        by = np.lexsort((labels, ids, key))
        first[by[1:]] = (key[by[1:]] != key[by[:-1]]) | (ids[by[1:]] != ids[by[:-1]]) | (labels[by[1:]] != labels[by[:-1]]) | \
            (c[by[1:]] != c[by[:-1]]).any(axis=1)
        self.ids, self.labels, c = ids[first], labels[first], c[first]
        self.anchor_ids, self.anchor_labels, a = np.asarray(anchors.column("vec_id")), np.asarray(anchors.column("label")), _matrix(anchors.column("v"), width)
        self.parent, self.edge = np.asarray(anchors.column("parent")), np.asarray(anchors.column("edge"))
        top = float(np.abs(c).max(initial=0)) * float(np.abs(a).max(initial=0)) * width
        kind = np.float64 if top < 2 ** 53 else np.int64
        self.c, self.a = c.astype(kind), a.astype(kind)
        self.c_norm, self.a_norm = np.sqrt((c.astype(float) ** 2).sum(axis=1)), np.sqrt((a.astype(float) ** 2).sum(axis=1))
        level = np.zeros(len(a), np.int64)
        for k in range(1, len(a)):
            level[k] = level[self.parent[k]] + 1
        by = np.argsort(level, kind="stable")
        self.levels = np.split(by, np.flatnonzero(np.diff(level[by])) + 1) if len(a) else []
        self.pairs = self.scored = 0

    def scan(self, wanted, take) -> None:
        """Calls `take(anchors, candidates, scores)` for all pairs that
        `wanted(anchors, candidates, low, high)` may want by their bounds."""
        for lo in range(0, len(self.ids), _AT_ONCE):
            here = np.arange(lo, min(lo + _AT_ONCE, len(self.ids)))
            c, norm = self.c[here], self.c_norm[here]
            slack = 1e-6 + 1e-9 * norm * (1 + self.a_norm.max(initial=0))  # rounding of the bounds
            low, high = np.empty((2, len(self.a), here.size))
            for depth, level in enumerate(self.levels):
                for k in range(0, level.size, _TOGETHER):
                    own = level[k:k + _TOGETHER]
                    most = self.a_norm[own][:, None] * norm + slack
                    if depth:
                        far = self.edge[own][:, None] * norm + slack
                        low[own] = np.maximum(low[self.parent[own]] - far, -most)
                        high[own] = np.minimum(high[self.parent[own]] + far, most)
                        hit = wanted(own, here, low[own], high[own])
                    else:
                        low[own], high[own], hit = -most, most, np.ones((own.size, here.size), dtype=bool)
                    self.pairs += own.size * here.size
                    some = hit.any(axis=0)
                    # neighbours want nearly the same candidates, or each is served alone
                    groups = [(own, some)] if 4 * hit.sum() > own.size * some.sum() else [(own[i:i + 1], hit[i]) for i in range(own.size)]
                    for mine, cols in groups:
                        cols = np.flatnonzero(cols)
                        self.scored += mine.size * cols.size
                        if cols.size:
                            s = self.a[mine] @ c[cols].T
                            low[mine[:, None], cols], high[mine[:, None], cols] = s, s
                            take(mine, here[cols], s.astype(np.int64))


def best_rows(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` highest scores of each row, ties to the smaller id."""
    by = np.lexsort((ids, -scores.astype(float), ~scores), axis=1)[:, :top]
    return np.take_along_axis(scores, by, 1), np.take_along_axis(ids, by, 1)


def _surely(low: np.ndarray, counted: np.ndarray, top: int) -> np.ndarray:
    """Per row, a score that `top` of the counted candidates reach by their
    lower bounds (-inf if they are fewer): a lower score is not among the best."""
    if low.shape[1] < top:
        return np.full(len(low), -np.inf)
    return np.partition(np.where(counted, low, -np.inf), low.shape[1] - top, axis=1)[:, low.shape[1] - top]


def find_positives(cell: Cell, top: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.full((len(cell.a), top), _NONE)
    best_id = np.full((len(cell.a), top), _NO_ID)

    def fits(own, here):
        return (cell.labels[here] == cell.anchor_labels[own][:, None]) & (cell.ids[here] != cell.anchor_ids[own][:, None])

    def wanted(own, here, low, high):
        fit = fits(own, here)
        return fit & (high >= np.maximum(best[own, -1], _surely(low, fit, top))[:, None])

    def take(own, here, s):
        fit = fits(own, here)
        s[~fit] = _NONE
        both_id = np.hstack([best_id[own], np.where(fit, cell.ids[here], _NO_ID)])
        best[own], best_id[own] = best_rows(np.hstack([best[own], s]), both_id, top)
    cell.scan(wanted, take)
    return best, best_id


def find_negatives(cell: Cell, least: np.ndarray, most: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Best rows of other labels in each anchor's windows least..most."""
    least = least.copy()  # rises as a window fills
    best = np.full((*least.shape, top), _NONE)
    best_id = np.full(best.shape, _NO_ID)

    def wanted(own, here, low, high):
        fit = (cell.labels[here] != cell.anchor_labels[own][:, None]) & (cell.ids[here] != cell.anchor_ids[own][:, None])
        out = np.zeros(low.shape, dtype=bool)
        for w in range(least.shape[1]):
            a, b = least[own, w, None], most[own, w, None]
            within = fit & (low >= a) & (high <= b)
            out |= (high >= np.maximum(a[:, 0], _surely(low, within, top))[:, None]) & (low <= b)
        return out & fit

    def take(own, here, s):
        fit = (cell.labels[here] != cell.anchor_labels[own][:, None]) & (cell.ids[here] != cell.anchor_ids[own][:, None])
        for k, anchor in enumerate(own.tolist()):
            open_ = least[anchor] <= most[anchor]
            if not open_.any():
                continue
            at = np.flatnonzero(fit[k] & (s[k] >= least[anchor][open_].min()) & (s[k] <= most[anchor][open_].max()))
            if not at.size:
                continue
            at = at[np.lexsort((cell.ids[here[at]], ~s[k, at]))]
            scores, ids = s[k, at], cell.ids[here[at]]
            for w in np.flatnonzero(open_).tolist():
                start = int(np.searchsorted(~scores, ~most[anchor, w]))
                n = int(np.searchsorted(~scores[start:start + top], ~least[anchor, w], side="right"))
                if n:
                    new = slice(start, start + n)
                    kept, kept_id = best_rows(np.concatenate([best[anchor, w], scores[new]])[None], np.concatenate([best_id[anchor, w], ids[new]])[None], top)
                    best[anchor, w], best_id[anchor, w] = kept[0], kept_id[0]
                    least[anchor, w] = max(least[anchor, w], kept[0, -1])
    cell.scan(wanted, take)
    return best, best_id


def _positives(top: int):
    out = pa.schema([(k, pa.int64()) for k in ("anchor", "positive_id", "positive_score")])

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows or not anchors.num_rows:
            return out.empty_table()
        best, ids = find_positives(Cell(docs, anchors), top)
        real = best != _NONE
        who = np.repeat(np.asarray(anchors.sort_by("place").column("anchor")), real.sum(axis=1))
        return pa.table([pa.array(who), pa.array(ids[real]), pa.array(best[real])], schema=out)
    return run


def _negatives(top: int, low: int, high: int):
    out = pa.schema([(k, pa.int64()) for k in ("anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative_score")])

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows or not anchors.num_rows:
            return out.empty_table()
        anchors = anchors.sort_by("place")
        found = [p or [] for p in anchors.column("positives").to_pylist()]
        wide = max([1, *map(len, found)])
        least, most = np.ones((len(found), wide), np.int64), np.zeros((len(found), wide), np.int64)
        for k, ps in enumerate(found):
            for w, p in enumerate(ps):
                least[k, w], most[k, w] = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
        best, ids = find_negatives(Cell(docs, anchors), least, most, top)
        key, own = np.asarray(anchors.column("anchor")), np.asarray(anchors.column("vec_id"))
        a, w, r = np.nonzero(best != _NONE)
        positive = [found[k][i] for k, i in zip(a.tolist(), w.tolist())]
        return pa.table([pa.array(key[a]), pa.array(own[a]), pa.array(w), pa.array([p["positive_id"] for p in positive], pa.int64()),
                         pa.array([p["positive_score"] for p in positive], pa.int64()), pa.array(ids[a, w, r]), pa.array(best[a, w, r])], schema=out)
    return run


def mine(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", is_anchor: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
         cell_docs: int = CELL_DOCS, cell_anchors: int = CELL_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): per anchor and each of its `positives` best rows of the
    same label, the `negatives` best rows of other labels whose score is
    between `low` and `high` percent of the positive's.  `is_anchor` reads
    `vec_id`, `label` and `v` (the integer vector)."""
    v = F.col("embedding")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding")) \
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(v)) \
        .select("vec_id", "label", F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")) \
        .withColumn("anchor", F.xxhash64("vec_id", "label", "v"))
    is_anchor = (F.col("vec_id") % ANCHOR_EVERY == 0) if is_anchor is None else is_anchor
    n = rows.agg(F.count(F.lit(1)).alias("d"), F.count_if(is_anchor).alias("a")).first()
    down, across = max(1, -(-n["d"] // cell_docs)), max(1, -(-n["a"] // cell_anchors))

    def spread(parts: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("anchor", F.lit(seed)), F.lit(parts)).cast("int")
    trees = cut_lineage(rows.where(is_anchor).distinct().withColumn("j", spread(across, 1)).select("anchor", "vec_id", "label", "v", "j")
                        .groupBy("j").applyInArrow(_planted, _TREE))
    docs = rows.withColumn("i", spread(down, 2)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    near = docs.groupBy("i", "j").cogroup(trees.withColumn("i", every).groupBy("i", "j")).applyInArrow(
        _positives(positives), "anchor long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    opened = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= positives).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("_r", "positive_id", "positive_score"))).alias("positives"))  # at most `positives`
    asked = cut_lineage(trees.join(opened, "anchor", "left"))
    found = docs.groupBy("i", "j").cogroup(asked.withColumn("i", every).groupBy("i", "j")).applyInArrow(
        _negatives(negatives, low, high), "anchor long, anchor_id long, positive long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def planted_confusions(df: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """`df` where ids divisible by `every` carry the next label."""
    label = F.col("label").cast("long")
    return df.withColumn("label", F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label))


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x : floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM (SELECT * FROM v WHERE vec_id % {ANCHOR_EVERY} = 0) a JOIN v c ON a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, r ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
      WHERE r <= {POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""

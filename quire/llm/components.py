"""Connected components of an edge table (star contraction: forests per task, then parent jumps)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage


#: Partitions whose forests one task joins.
MERGED = 4
#: Join keys over which the children of one node are spread.
SALTS = 64


class Forest:
    """Union-find over the nodes one task sees; the root is the smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def forest_edges(batches):
    """A partition's edges (a, b) -> at most one edge per node."""
    seen = Forest()
    for batch in batches:
        pairs = np.unique(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1), axis=0)
        for a, b in pairs.tolist():
            if a != b:
                seen.join(a, b)
    rows = [(x, seen.root(x)) for x in seen.up if seen.root(x) != x]
    if rows:
        a, b = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def gathered(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b, dealt by the larger node: its parents meet in
    one task, which leaves it one of them and joins the others to that one.
    A node has at most one row per task that made `edges`; the smaller nodes,
    which many rows may share, are not the key."""
    return cut_lineage(edges.repartition("a").mapInArrow(forest_edges, "a long, b long"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is
    its smallest node.  Each round moves every node from its parent b to the
    smallest parent of b, and gathers the parents of a node again; each
    round's edges are checkpointed.  The children of one b are spread over
    `SALTS` join keys, each asking for b's parent once."""
    e = cut_lineage(edges.mapInArrow(forest_edges, "a long, b long"))
    # neighbouring partitions' forests share nodes: joining a few of them first
    # leaves fewer edges for the shuffle
    few = max(1, -(-e.rdd.getNumPartitions() // MERGED))
    e = gathered(e.coalesce(few).mapInArrow(forest_edges, "a long, b long"))
    for _ in range(max_rounds):
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        parents = low.select(F.col("a").alias("b"), "m")
        # settled when every node has one parent and no parent has one
        if not low.where("n > 1").limit(1).count() and not e.select("b").distinct().join(parents, "b", "left_semi").limit(1).count():
            break
        salted = e.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
        answers = salted.select("b", "salt").distinct().join(parents, "b")
        e = gathered(salted.join(answers, ["b", "salt"], "left").select("a", F.coalesce("m", "b").alias("b")))
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

"""Operator 8: n-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance d = 1 - J is a metric; documents link when d <= radius.

1. *Sets.*  Each document's distinct word shingles (64-bit hashes) are made in
   the task that reads the text; equal sets share a fingerprint and are one
   node from here on, so exact copies cost one row per task.
2. *Coarse regions.*  Linked sets of sizes a <= b differ in at most
   a * (1 - t) / t shingles.  The hash space is cut into more ranges than that
   (by size class), so some non-empty range of both sets is equal: its content
   is the region's key.  Each task keeps one node per key and ties the others
   to it by a spanning forest before anything is shuffled; regions that share
   documents are one candidate group, and links exist only inside a group.
3. *Pivots.*  Inside a group a pivot takes a region: everything within the
   radius links to it.  By the triangle inequality a document outside may
   link to a document inside only if it lies within twice the radius of the
   pivot: these boundary documents are compared with the region one by one.
   The rest is joined recursively with the next pivot.  Distances come from
   the group's inverted lists, so far documents cost nothing.
4. A group above `max_group` documents or `max_elements` shingles is cut into
   blocks; each pair of blocks is a task of its own, and components join the
   tasks' links.  Nothing is dropped, capped or sampled.

The result is exact up to 64-bit hash collisions of shingles.  Rows: null,
empty and blank texts have the empty set and link with nothing (component_id
is their own id); repeated rows are kept, each with its document's values; an
empty table gives no rows; extra columns are not read; null ids take no part;
rows of different texts under one doc_id are one document of the join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches_of, cut_lineage, free_used_shuffles
from quire.llm.components import Forest, components

BATCH_BYTES = 2 << 20
FLUSH_ROWS = 1 << 19
CLASS_RATIO = 1.25
#: Shingles that many texts share do not make regions (at most so many).
COMMON = 1 << 16
SEEN_TOGETHER = 3
COUNTED_TOGETHER = 1 << 22
MAX_GROUP = 4000
MAX_ELEMENTS = 2_000_000

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and shift; constants are odd numbers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start offset) of every white-space-separated word."""
    raw = np.frombuffer(buf, dtype=np.uint8)
    solid = ~_WHITE[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    if not starts.size:
        return np.empty(0, np.uint64), starts
    lengths = np.flatnonzero(edge == -1) - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = (raw[solid].astype(np.uint64) + _U(1)) * _powers(int(lengths.max()))[place]
    return _mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), starts


def _chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = h.size - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        total = _mix(total + h[j:j + n])
    return total


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text (ASCII letters lower-cased)."""
    bodies = [(t or b"").lower() for t in texts]
    h, at = word_hashes(b" ".join(bodies))
    ends = np.cumsum([len(b) + 1 for b in bodies])
    cut = np.searchsorted(at, ends).tolist()
    runs = _chain(h, k) if h.size >= k else np.empty(0, np.uint64)
    out = []
    for a, b in zip([0, *cut], cut):
        n = b - a
        if n >= k:
            out.append(np.unique(runs[a:b - k + 1]))
        else:
            out.append(_chain(h[a:b], n) if n else np.empty(0, np.uint64))
    return out


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _class_bounds(n: int) -> tuple[int, int, int]:
    """Size class of n: (number, smallest size, largest size)."""
    c = int(np.log(n) / np.log(CLASS_RATIO) + 1e-9)
    while int(np.ceil(CLASS_RATIO ** (c + 1) - 1e-9)) <= n:
        c += 1
    while int(np.ceil(CLASS_RATIO ** c - 1e-9)) > n:
        c -= 1
    return c, int(np.ceil(CLASS_RATIO ** c - 1e-9)), int(np.ceil(CLASS_RATIO ** (c + 1) - 1e-9)) - 1


def _range_keys(s: np.ndarray, m: int, size_class: int, tag: int, with_gaps: bool) -> np.ndarray:
    """Keys of the non-empty hash ranges of a set (`with_gaps`: of the empty
    ones too)."""
    part = ((s >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    sums = np.add.reduceat(_mix(s), first) if s.size else np.empty(0, np.uint64)
    own = part[first]
    if with_gaps:
        gaps = np.setdiff1d(np.arange(m), own)
        own, sums = np.concatenate([own, gaps]), np.concatenate([sums, np.zeros(gaps.size, np.uint64)])
    return _mix(_mix(sums) + own.astype(np.uint64) * _U(0xA24BAED4963EE407) + _U((size_class << 40) + (tag << 56)))


def region_keys(s: np.ndarray, percent: int, common: np.ndarray = np.empty(0, np.uint64)) -> np.ndarray:
    """Keys of the regions of a set: for its own size class, and for each
    lower class that a smaller partner could have.

    The ranges hold the set without the `common` shingles: linked sets differ
    in no more of these, so with `spare` ranges above the number of possible
    differences, some non-empty range is equal whenever one of the two sets
    leaves at most `spare` ranges empty.  A set that leaves more empty has the
    ranges of its whole content as regions as well, where empty ranges count if
    there are still too many: two such sets meet there."""
    n, keys = s.size, []
    if common.size and n:
        at = np.searchsorted(common, s)
        rare = s[common[np.minimum(at, common.size - 1)] != s]
    else:
        rare = s
    lowest = -(-n * percent // 100)  # smallest partner
    top = n
    while top >= max(lowest, 1):
        c, low, high = _class_bounds(top)
        differ = high * (100 - percent) // percent
        if differ:
            spare = int(2 * (differ + 1) * np.exp(-low / (differ + 1))) + 2
            m = differ + 1 + spare
            own = _range_keys(rare, m, c, 1, False)
            keys.append(own)
            if m - own.size > spare:
                whole = _range_keys(s, m, c, 2, False)
                keys.append(whole if m - whole.size <= spare else _range_keys(s, m, c, 2, True))
        top = low - 1
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _sets_of(k: int):
    """Rows of sets, and (doc_id null) counts of shingles that a task sees in
    several sets at once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        u, count = np.unique(np.concatenate(held), return_counts=True)
        u, count = u[count >= SEEN_TOGETHER], count[count >= SEEN_TOGETHER]
        return pa.RecordBatch.from_arrays([pa.nulls(u.size, pa.int64()), pa.array(count.astype(np.int64)), pa.array(u.view(np.int64))], schema=schema)

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches_of(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.size for s in sets], pa.int64()),
                                              pa.array([_node(s) if s.size else None for s in sets], pa.int64())], schema=schema)
            held += sets
            if sum(s.size for s in held) >= COUNTED_TOGETHER:
                yield often(held)
                held = []
        if held:
            yield often(held)
    return run


def _thin(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
    """One row per key (a = b) and one candidate edge per node that shares a
    key with another: nodes tied to each other are spanned by edges to their
    smallest, which stands for them in the key rows."""
    k, n = np.concatenate(keys), np.concatenate(nodes)
    order = np.lexsort((n, k))
    k, n = k[order], n[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    first = n[np.maximum.accumulate(np.where(head, np.arange(k.size), 0))]
    tied = n != first
    x, y = first[tied], n[tied]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    fresh = np.diff(x, prepend=x[:1] - 1).astype(bool) | np.diff(y, prepend=y[:1] - 1).astype(bool)
    forest = Forest()
    for a, b in zip(x[fresh].tolist(), y[fresh].tolist()):
        forest.join(a, b)
    k, stands = k[head], n[head]
    b = np.array(sorted(forest.up), dtype=np.int64)
    a = np.array([forest.root(v) for v in b.tolist()], dtype=np.int64)
    if b.size:
        at = np.minimum(np.searchsorted(b, stands), b.size - 1)
        stands = np.where(b[at] == stands, a[at], stands)
        a, b = a[a != b], b[a != b]
    route = np.concatenate([k, _mix(b.view(np.uint64))]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(np.concatenate([stands, a])), pa.array(np.concatenate([stands, b]))], names=["key", "a", "b"])


def _keys_of(k: int, percent: int, common: np.ndarray):
    def run(batches):
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0
        for batch in batches_of(batches, "text", BATCH_BYTES):
            for s in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), k):
                if s.size and (own := region_keys(s, percent, common)).size:
                    keys.append(own)
                    nodes.append(np.full(own.size, _node(s), dtype=np.int64))
                    held += own.size
            if held >= FLUSH_ROWS:
                yield _thin(keys, nodes)
                keys, nodes, held = [], [], 0
        if held:
            yield _thin(keys, nodes)
    return run


def _edges_of_runs(batches):
    """Rows sorted by key -> edges between a key's first node and the others."""
    last_key = last_first = None
    for batch in batches:
        k, a, b = (np.asarray(batch.column(i)) for i in range(3))
        if not k.size:
            continue
        edge = a != b
        out_a, out_b = [a[edge]], [b[edge]]
        k, a = k[~edge], a[~edge]
        if k.size:
            head = np.concatenate([[k[0] != last_key], k[1:] != k[:-1]])
            index = np.maximum.accumulate(np.where(head, np.arange(k.size), -1))
            first = np.where(index >= 0, a[np.maximum(index, 0)], last_first if last_first is not None else 0)
            differs = first != a
            out_a.append(first[differs])
            out_b.append(a[differs])
            last_key, last_first = k[-1], first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def link_group(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Pivot join of one group: a root index per set, and the links found on
    the way (a spanning set of the links, not all of them)."""
    n = len(sets)
    size = np.array([s.size for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    _, begin, df = np.unique(flat[order], return_index=True, return_counts=True)
    posting = owner[order]
    term = np.empty(flat.size, dtype=np.int64)
    term[order] = np.repeat(np.arange(df.size), df)
    edge = np.concatenate([[0], np.cumsum(size)])

    def shared(i: int) -> np.ndarray:
        t = term[edge[i]:edge[i + 1]]
        lens = df[t]
        at = np.repeat(begin[t] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        return np.bincount(posting[at], minlength=n)

    root = np.arange(n)
    links: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def link(i: int, js: np.ndarray) -> None:
        for j in js.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))

    def near(i: int, common: np.ndarray) -> np.ndarray:
        return 100 * common >= percent * (size + size[i] - common)

    waiting = np.ones(n, dtype=bool)
    for p in range(n):
        if not waiting[p]:
            continue
        common = shared(p)
        inside = waiting & near(p, common)
        link(p, np.flatnonzero(inside))
        waiting &= ~inside
        # distance <= 2 * radius  <=>  J >= 1 - 2 * (1 - t)
        boundary = waiting & (100 * common >= (2 * percent - 100) * (size + size[p] - common))
        if inside.sum() > 1:
            for w in np.flatnonzero(boundary).tolist():
                link(w, np.flatnonzero(near(w, shared(w)) & inside))
    return np.array([top(i) for i in range(n)]), links


def _link_frame(k: int, percent: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        docs = g["doc_id"].to_numpy()
        sets = [s for i in range(0, len(g), 256)
                for s in shingle_sets([t.encode() if t is not None else None for t in g["text"].iloc[i:i + 256]], k)]
        order = np.argsort(docs, kind="stable")
        root, _ = link_group([sets[i] for i in order], percent)
        docs = docs[order]
        return pd.DataFrame({"a": docs, "b": docs[root]})
    return run


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90,
                       max_group: int = MAX_GROUP, max_elements: int = MAX_ELEMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the
    smallest doc_id reachable by links (J >= percent / 100)."""
    free_used_shuffles(df.sparkSession)  # the regions' shuffle is the largest; only its edges stay
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    seen = cut_lineage(docs.mapInArrow(_sets_of(words), "doc_id long, n_shingles long, node long"))
    sizes = seen.where("doc_id is not null")
    often = seen.where("doc_id is null").groupBy("node").agg(F.sum("n_shingles").alias("n")) \
        .orderBy(F.desc("n"), "node").limit(COMMON).select("node")  # a fixed bound; any choice gives the same result
    common = np.sort(np.array([r["node"] for r in often.collect()], dtype=np.int64).view(np.uint64))
    nodes = sizes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    keyed = docs.mapInArrow(_keys_of(words, percent, common), "key long, a long, b long").repartition("key").sortWithinPartitions("key", "a")
    groups = components(keyed.mapInArrow(_edges_of_runs, "a long, b long"))  # candidate groups of nodes
    members = groups.join(nodes, "node").select("component", "rep", "n")
    load = members.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("docs") / max_group), F.ceil(F.col("elements") / max_elements)).cast("int")
    placed = members.join(load.withColumn("blocks", blocks), "component")
    placed = cut_lineage(placed.select("component", F.col("rep").alias("doc_id"), "blocks",
                                       F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")))
    # a group within bounds is tile (0, 0); a larger one is all pairs of its blocks
    tiles = placed.select("doc_id", "component", "blocks", F.explode(F.expr(
        "transform(sequence(0, blocks - 1), j -> struct(least(j, block) as i, greatest(j, block) as j))")).alias("t"))
    texts = docs.join(tiles, "doc_id")
    found = texts.groupBy("component", "t.i", "t.j").applyInPandas(_link_frame(words, percent), "a long, b long")
    labels = components(found) if placed.where("blocks > 1").limit(1).count() else None
    if labels is None:
        labels = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = labels.groupBy(F.col("node").alias("rep")).agg(F.min("component").alias("component"))
    of_node = nodes.join(labels, "rep", "left") \
        .select("node", F.coalesce("component", "rep").alias("component_id"))
    return sizes.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, **bounds) -> DataFrame:
    """Rows of `df` that stand for their group: the one with the smallest id
    and every row without shingles or id.  Rows that repeat a doc_id are one
    document and stay or go together.

    Only ids that go are joined back, and they are far fewer than the rows."""
    groups = jaccard_components(df, id_col, text_col, words, percent, **bounds)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti").select(*df.columns)

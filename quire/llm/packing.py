"""Operator 9: packing by cutting-stock column generation.

1. *Tokenise and cut* (one pass over the texts, no shuffle): a document's ids
   and the end id, cut into full sequences plus a remainder (cut once more at
   half a sequence if longer); each piece
   keeps start, length and the crc32 of its ids.  The small piece table is
   written to the shared checkpoint folder, since it is read twice.
2. *Patterns.*  Remainders fall into length classes of `grain` tokens
   (rounded up).  The class histogram (at most capacity / grain rows: a fixed
   bound) goes to the driver, where a linear program over patterns (how many
   pieces of each class share a sequence) is solved by column generation: the
   simplex method keeps a basis of one pattern per class, and a knapsack
   dynamic program prices new patterns until none improves.  Rounded-down
   multiplicities are used whole; the few pieces left over are packed by best
   fit.
3. *Assignment* (data-parallel): full sequences are numbered where they
   stand.  Another piece's rank in its class comes from the
   counts of (bucket, class) and its place in its bucket, so that a class
   that holds a third of all pieces is ranked by many tasks.  Rank ranges
   belong to patterns; sequence number and slot follow by arithmetic, and the
   offset is a running sum within the sequence (at most `capacity` pieces).

Rows: null and empty texts are one piece holding the end id; repeated rows
are packed each; an empty table gives no rows; extra columns are not read.
Ranks are ordered by a hash of (doc_id, start), doc_id, start, crc and length,
so equal rows tie and may swap places without effect on the result's rows.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import vocab
from quire.llm.common import cut_lineage

CAPACITY = 1024
END_ID = 0
TAIL_CUT = 512
GRAIN = 4
BUCKETS = 64

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_points(n: int, capacity: int, tail_cut: int) -> list[int]:
    """Starts of the pieces of `n` tokens: full sequences, then a remainder
    that is cut once more at `tail_cut` if it is longer (pieces above half a
    sequence leave gaps that no other piece fits)."""
    starts = list(range(0, n, capacity))
    if n - starts[-1] != capacity and n - starts[-1] > tail_cut:
        starts.append(starts[-1] + tail_cut)
    return starts


def _cut(path: str, ranks: str, capacity: int, end_id: int, tail_cut: int, with_ids: bool):
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _PIECES

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = vocab.encode_text(text or "", path, ranks)
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4")
                starts = cut_points(len(ids), capacity, tail_cut)
                for at, to in zip(starts, [*starts[1:], len(ids)]):
                    part = raw[at:to]
                    row = (doc, at, part.size, zlib.crc32(part.tobytes()), len(ids), part.astype("i4"))
                    for col, v in zip(cols, row):
                        col.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


def tokenised_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                     ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                     tail_cut: int = TAIL_CUT, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document (`with_ids`: with its token ids)."""
    run = _cut(path or vocab.tokenizer_path(), ranks_path or vocab.tokenizer_path(vocab.DEFAULT_RANKS), capacity, end_id, tail_cut, with_ids)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, _PIECES_DDL + (", ids array<int>" if with_ids else ""))


# --- patterns (driver, bounded by the number of length classes; numpy without BLAS) ---

def _best_pattern(value: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of highest value within `room` units."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = units <= c
        gain = np.where(fits, best[np.where(fits, c - units, 0)] + value, -1.0)
        j = int(gain.argmax())
        if gain[j] > best[c - 1]:
            best[c], pick[c] = gain[j], j
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(units), dtype=np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= units[pick[c]]
    return float(best[room]), pattern


def _product(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix times vector by numpy's own sums: no linear-algebra threads run
    on the driver."""
    return (matrix * vector).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, again without such threads."""
    m = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k][None, :]
    return both[:, m:]


def solve_patterns(units: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """min sum(x) with sum(pattern * x) = demand, x >= 0, by the revised
    simplex method with column generation; ends when no pattern prices below
    cost, the value is within `gap` of the dual bound, or it has not fallen
    for ten rounds a class (degenerate pivots, which could go round for ever).
    Whatever the end, the patterns found cover the demand."""
    m = len(units)
    columns = [np.eye(m, dtype=np.int64)[i] * (room // units[i]) for i in range(m)]
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    x = _product(inverse, demand)
    least, still, k = np.inf, 0, 0
    while still <= 10 * m:
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        best, pattern = _best_pattern(dual, units, room)
        if best <= 1 + 1e-9 or x.sum() * (1 - 1 / best) <= gap * x.sum():
            break
        step = _product(inverse, pattern)
        rises = step > 1e-9
        ratio = np.where(rises, x / np.where(rises, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        columns[out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        k += 1
        if k % 200 == 0:  # fresh inverse against rounding drift
            inverse = _inverse(np.array(columns).T)
            x = np.maximum(_product(inverse, demand), 0)
        still = 0 if x.sum() < least - 1e-9 * demand.sum() else still + 1
        least = min(least, x.sum())
    return list(zip(columns, x))


def plan_sequences(units: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns with multiplicities that cover the demand exactly."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for pattern, x in sorted(solve_patterns(units, demand.astype(float), room), key=lambda p: -p[1]):
        used = pattern > 0
        times = min(int(np.floor(x + 1e-6)), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if times:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():  # what rounding left over: best fit, largest first
        pattern, free = np.zeros_like(left), room
        for j in np.argsort(-units, kind="stable"):
            n = min(int(free // units[j]), int(left[j]))
            pattern[j] = n
            free -= n * units[j]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def _assignment(histogram: dict[int, int], grain: int, capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Rank ranges: class, first rank, copies per sequence, first sequence,
    first slot; sorted by (class, first rank); and the number of sequences."""
    classes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[c] for c in classes.tolist()], dtype=np.int64)
    rows, taken, sequence = [], dict.fromkeys(classes.tolist(), 0), 0
    plan = plan_sequences(classes, demand, capacity // grain) if len(classes) else []
    for pattern, times in plan:
        slot = 0
        for c, n in zip(classes[::-1].tolist(), pattern[::-1].tolist()):
            if n:
                rows.append((c, taken[c], n, sequence, slot))
                taken[c] += n * times
                slot += n
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("cls", "first", "copies", "seq", "slot"))}, sequence


def _placed(plan: dict[str, np.ndarray]):
    def run(frames):
        key = list(zip(plan["cls"].tolist(), plan["first"].tolist()))
        lo = {}
        for i, (c, _) in enumerate(key):
            lo.setdefault(c, [i, i])[1] = i + 1
        for f in frames:
            cls, rank = f["cls"].to_numpy(), f["rnk"].to_numpy()
            at = np.empty(len(f), dtype=np.int64)
            for c in np.unique(cls):
                a, b = lo[int(c)]
                own = cls == c
                at[own] = a + np.searchsorted(plan["first"][a:b], rank[own], side="right") - 1
            past = rank - plan["first"][at]
            copies = plan["copies"][at]
            f["sequence_id"] = plan["seq"][at] + past // copies
            f["slot"] = plan["slot"][at] + past % copies
            yield f.drop(columns=["cls", "rnk"])
    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, tail_cut: int = TAIL_CUT,
         grain: int = GRAIN, buckets: int = BUCKETS, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset (`with_ids`: and their token ids)."""
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    pieces = cut_lineage(tokenised_pieces(df, id_col, text_col, path, ranks_path, capacity, end_id, tail_cut, with_ids))
    names = pieces.columns
    # the bucket count follows the executors, not a constant, on large clusters
    buckets = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = F.xxhash64("doc_id", "start", "ids_crc32")
    whole, pieces = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    pieces = pieces.withColumn("cls", F.ceil(F.col("length") / grain).cast("long")) \
        .withColumn("bucket", F.pmod(spread, F.lit(buckets)))
    counts = pieces.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # <= capacity / grain rows
    plan, planned = _assignment(histogram, grain, capacity)
    before = Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cls", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("cls", "bucket").orderBy(spread, "doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("rnk", F.row_number().over(within) - 1).join(offsets, ["cls", "bucket"]) \
        .select(*names, "cls", (F.col("rnk") + F.col("base")).alias("rnk"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    placed = ranked.mapInPandas(_placed(plan), f"{schema}, sequence_id long, slot long")
    running = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shared = placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(running), F.lit(0)).alias("offset"))
    # full sequences need no rank: the checkpoint's partitions and their order are fixed
    alone = whole.select(*names, (F.lit(planned) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)

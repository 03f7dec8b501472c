"""Operator 7: quality classifier, a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover it whole
(`CHUNK` bytes every `STEP`).  Bytes are embedded, learned filters of
2 * `GROUP` bytes slide over the chunk in steps of `GROUP`, each filter is
max-pooled per chunk; the mean and the maximum over the chunks go through one
hidden layer to one probability.

The model is fitted on the driver on a bounded sample: at most `per_class`
labelled documents of either class (smallest hashes of doc_id), without those
that do not fit into `sample_bytes` any more; all chunks of a document that is taken
are fitted on, as all are scored.  Scoring is one pass over
all texts in the tasks that read them, with no shuffle; the network (some
tens of KB) travels with the task.

Rows: null text counts as empty (one chunk of padding); repeated rows are
scored each; an empty table gives no rows; without labelled rows of both
classes the score is the share of good rows (0.5 without any).  Null ids are
kept (fold of the empty text).  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches_of

CHUNK = 1024
STEP = 896
GROUP = 4
EMBED = 8
FILTERS = 32
HIDDEN = 24
PER_CLASS = 800
SAMPLE_BYTES = 16 << 20
EPOCHS = 14
HELD_OUT = (3, 1)  # crc32(doc_id) mod 3 = 1
_PAD = 256
_AT_ONCE = 256


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the overlapping chunks of n bytes (at least one)."""
    return np.arange(0, max(n - (CHUNK - STEP), 1), STEP)


def chunks_of(raw: bytes, starts: np.ndarray) -> np.ndarray:
    data = np.full(int(starts[-1]) + CHUNK, _PAD, dtype=np.int16)
    data[:min(len(raw), data.size)] = np.frombuffer(raw, np.uint8)[:data.size]
    return np.lib.stride_tricks.as_strided(data, (starts.size, CHUNK), (STEP * 2, 2)) \
        if starts.size > 1 and (np.diff(starts) == STEP).all() and starts[0] == 0 else np.stack([data[s:s + CHUNK] for s in starts])


class Network:
    """Weights by name; float32."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        wide = GROUP * EMBED
        self.w = {k: v.astype(np.float32) for k, v in {
            "embed": np.vstack([r.normal(0, 0.5, (256, EMBED)), np.zeros((1, EMBED))]),
            "filters": r.normal(0, (2 * wide) ** -0.5, (wide, 2 * FILTERS)), "bias": np.zeros(FILTERS),
            "hidden": r.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)), "hidden_bias": np.zeros(HIDDEN),
            "out": r.normal(0, HIDDEN ** -0.5, HIDDEN), "out_bias": np.zeros(1)}.items()}

    def groups(self, chunks: np.ndarray) -> np.ndarray:
        return self.w["embed"][chunks].reshape(len(chunks), CHUNK // GROUP, GROUP * EMBED)

    def responses(self, groups: np.ndarray) -> np.ndarray:
        """Filter responses per chunk and position: a filter spans two
        neighbouring groups, so its halves are added with one group's shift."""
        y = (groups.reshape(-1, groups.shape[2]) @ self.w["filters"]).reshape(len(groups), -1, 2 * FILTERS)
        return y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        parts = [self.responses(self.groups(chunks[i:i + _AT_ONCE])).max(axis=1) for i in range(0, len(chunks), _AT_ONCE)]
        return np.maximum(np.concatenate(parts) + self.w["bias"], 0)

    def best_windows(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and height of each filter's best response per chunk."""
        best, top = [], []
        for i in range(0, len(chunks), _AT_ONCE):
            z = self.responses(self.groups(chunks[i:i + _AT_ONCE]))
            best.append(z.argmax(axis=1))
            top.append(np.take_along_axis(z, best[-1][:, None, :], axis=1)[:, 0])
        return np.concatenate(best), np.concatenate(top)

    def head(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(doc @ self.w["hidden"] + self.w["hidden_bias"], 0)
        z = np.clip(h @ self.w["out"] + self.w["out_bias"][0], -30, 30)
        return h, 1 / (1 + np.exp(-z.astype(np.float64)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        starts = [chunk_starts(len(t)) for t in texts]
        first = np.cumsum([0, *[s.size for s in starts]])
        pooled = self.pooled(np.concatenate([chunks_of(t, s) for t, s in zip(texts, starts)]))
        return self.head(document_vectors(pooled, first))[1]


def document_vectors(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum over each document's chunks (rows first[i]:first[i+1])."""
    count = np.diff(first)[:, None].astype(np.float32)
    return np.hstack([np.add.reduceat(pooled, first[:-1]) / count, np.maximum.reduceat(pooled, first[:-1])])


def fit(samples: list[tuple[bytes, int]], epochs: int = EPOCHS, batch: int = 48, rate: float = 4e-3, seed: int = 7) -> Network:
    """Train on (text, label) pairs, all chunks of each text, by Adam on the log
    loss; a max-pooled filter learns from its best window only."""
    net, r = Network(seed), np.random.default_rng(seed)
    data = [chunks_of(raw, chunk_starts(len(raw))) for raw, _ in samples]
    label = np.array([y for _, y in samples], dtype=np.float32)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(data))
        step_rate = rate * (1 - epoch / epochs) + rate * 0.05
        for lo in range(0, len(order), batch):
            own = order[lo:lo + batch]
            first = np.cumsum([0, *[len(data[i]) for i in own]])
            chunks = np.concatenate([data[i] for i in own])
            best, top = net.best_windows(chunks)  # chunks x filters
            top = top + net.w["bias"]
            pooled = np.maximum(top, 0)
            doc = document_vectors(pooled, first)
            h, p = net.head(doc)
            d = ((p - label[own]) * weight[own] / len(own)).astype(np.float32)
            g = {"out": h.T @ d, "out_bias": np.array([d.sum()])}
            dh = np.outer(d, net.w["out"]) * (h > 0)
            g["hidden"], g["hidden_bias"] = doc.T @ dh, dh.sum(axis=0)
            dd = dh @ net.w["hidden"].T
            who = np.repeat(np.arange(len(own)), np.diff(first))
            top_doc = doc[:, FILTERS:][who]
            dp = dd[:, :FILTERS][who] / np.diff(first)[who][:, None] + dd[:, FILTERS:][who] * (pooled >= top_doc)
            dp = dp * (top > 0)
            g["bias"] = dp.sum(axis=0)
            rows = np.arange(len(chunks))[:, None]
            ge = np.zeros_like(net.w["embed"])
            cells = chunks.reshape(len(chunks), -1, GROUP)
            grown = []
            for half, shift in ((net.w["filters"][:, :FILTERS], 0), (net.w["filters"][:, FILTERS:], 1)):
                own_cells = cells[rows, best + shift]  # chunks x filters x GROUP
                grown.append(np.einsum("cfw,cf->wf", net.w["embed"][own_cells].reshape(*best.shape, -1), dp))
                back = (dp[:, :, None] * half.T[None]).reshape(-1, EMBED)
                np.add.at(ge, own_cells.reshape(-1), back)
            g["filters"] = np.hstack(grown)
            ge[_PAD] = 0
            g["embed"] = ge
            t += 1
            for k, (m, v) in moment.items():
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] ** 2 - v)
                net.w[k] -= (step_rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return net


def in_fold(id_col: str = "doc_id"):
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % HELD_OUT[0] == HELD_OUT[1]


def within(rows: list, most: int) -> list:
    """The first rows by hash that hold at most `most` bytes together; a row
    that does not fit any more is passed by."""
    out, held = [], 0
    for x in sorted(rows, key=lambda x: (x["hash"], x["doc_id"])):
        if held + x["size"] <= most:
            out.append(x)
            held += x["size"]
    return out


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES,
          epochs: int = EPOCHS) -> Network | float:
    """Fit on labelled rows outside the held-out fold; a float is the
    constant score when a class is missing."""
    truth = labels.where(F.col("quality").isin(0, 1) & ~in_fold()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("_top")).where("quality = _top").select("doc_id", "quality")
    picked = [truth.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    ids = picked[0].union(picked[1])  # at most 2 * per_class rows
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw"))
    sizes = texts.join(F.broadcast(ids), "doc_id").groupBy("quality", F.xxhash64("doc_id").alias("hash"), "doc_id").agg(
        F.sum(F.coalesce(F.octet_length("raw"), F.lit(0))).alias("size")).collect()
    taken = [(x["doc_id"], q) for q in (0, 1) for x in within([x for x in sizes if x["quality"] == q], sample_bytes // 2)]
    if not taken:
        return 0.5
    chosen = documents.sparkSession.createDataFrame(taken, "doc_id long, quality int")
    rows = texts.join(F.broadcast(chosen), "doc_id").collect()
    rows = sorted((x["doc_id"], int(x["quality"]), bytes(x["raw"] or b"")) for x in rows)
    samples = [(raw, quality) for _, quality, raw in rows]
    if len({y for _, y in samples}) < 2:
        return float(np.mean([y for _, y in samples])) if samples else 0.5
    return fit(samples, epochs)


def _scored(model: Network | float):
    def run(batches):
        for batch in batches_of(batches, "text", 1 << 20):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            score = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    return run


def score(df: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scored(model), "doc_id long, score double")
    return scored.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: Network | float, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of `df` that score at least `threshold`, columns unchanged."""
    def run(batches):
        for batch in batches:
            for part in batches_of([batch], text_col, 1 << 20):
                texts = [t or b"" for t in part.column(text_col).cast(pa.binary()).to_pylist()]
                s = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
                yield part.filter(pa.array(s >= threshold))
    return df.mapInArrow(run, df.schema)

"""Operator 1: language identification by a string kernel.

The kernel of two texts is the number of n-grams (n = 2..4, over the UTF-8
bytes of the lower-cased text with every ASCII non-letter as a space) present
in both, divided by the geometric mean of their own counts: the normalised
blended-spectrum presence kernel, with n-grams hashed to `2 ** BITS[n]` cells.
Nystroem landmarks (training documents, spread over the languages) turn it
into finite features, on which one ridge regression per language
(one-versus-rest, targets -1 and 1) is solved in closed form.  Scoring takes
texts in batches: presence matrix x landmark matrix x weights.

The fit uses a bounded sample: `per_language` documents of every language
(smallest hashes of doc_id), each shipped as a bitmap of fixed size.  Scoring
is one pass in the tasks that read the texts, over whole texts, no shuffle.

Rows: null text or text without a letter gives `und` with score 0; repeated
rows are scored each; an empty table gives no rows; languages that are null
are not learned; without any learnable row every text is `und`.  Ties go to
the first language by name.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import batches_of, fold

BITS = {2: 12, 3: 13, 4: 14}
PER_LANGUAGE = 400
LANDMARKS = 128
RIDGE = 1e-2
SHARPNESS = 4.0
SPARE = 4
HELD_OUT = (4, 2)  # crc32(doc_id) mod 4 = 2
WIDTH = sum(1 << b for b in BITS.values())

_FOLDED = np.full(256, 32, dtype=np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    """One row of 0/1 per text: which n-gram cells occur in it."""
    out = np.zeros((len(texts), WIDTH), dtype=np.uint8)
    for row, text in zip(out, texts):
        raw = _FOLDED[np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)].astype(np.uint32)
        at = 0
        for n, bits in BITS.items():
            if raw.size >= n:
                code = raw[:raw.size - n + 1].copy()
                for j in range(1, n):
                    code *= np.uint32(0x01000193)
                    code += raw[j:raw.size - n + 1 + j]
                code *= np.uint32(0x9E3779B1)
                row[at + (code >> np.uint32(32 - bits))] = 1
            at += 1 << bits
    return out


class Model:
    """Landmarks, their own counts, and weights per language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages = languages
        self.cells = np.flatnonzero(landmarks.any(axis=0))
        self.matrix = np.ascontiguousarray(landmarks[:, self.cells].T, dtype=np.float32)
        self.norms = np.maximum(landmarks.sum(axis=1, dtype=np.float64), 1) ** 0.5
        self.weights = weights

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        own = np.maximum(rows.sum(axis=1, dtype=np.float64), 1) ** 0.5
        return (rows[:, self.cells].astype(np.float32) @ self.matrix) / np.outer(own, self.norms)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        f = self.kernel(presence(texts)) @ self.weights
        best = f.argmax(axis=1)
        e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
        return [self.languages[i] for i in best], 1 / e.sum(axis=1)


def fit(rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    names = sorted(set(langs))
    of = {c: [i for i, x in enumerate(langs) if x == c] for c in names}
    each = max(1, -(-landmarks // len(names)))
    chosen = [i for c in names for i in of[c][:each]]
    model = Model(names, rows[chosen], np.zeros((len(chosen), len(names))))
    # Nystroem features: K(x, L) K(L, L)^(-1/2), small eigenvalues left out
    value, vector = np.linalg.eigh(model.kernel(rows[chosen]))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = model.kernel(rows) @ root
    target = np.array([[1.0 if x == c else -1.0 for c in names] for x in langs])
    balance = np.array([len(langs) / (len(names) * len(of[x])) for x in langs])[:, None]
    gram = phi.T @ (balance * phi) + ridge * np.eye(phi.shape[1])
    model.weights = root @ np.linalg.solve(gram, phi.T @ (balance * target))
    return model


def _bitmaps(batches):
    for batch in batches:
        for part in batches_of([batch], "text", 1 << 20):
            bits = np.packbits(presence([t or "" for t in part.column("text").to_pylist()]), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())],
                                             names=["doc_id", "lang", "bits"])


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on documents outside the held-out fold; None if there are none.

    A language's documents are ranked by the hash of their id; only hashes
    below a threshold that leaves about `SPARE` times as many as are taken are
    ranked at all, so a language is one small task at any size.  The languages
    (as many as the model has weights for) and their sizes go to the driver."""
    modulus, rest = HELD_OUT
    known = documents.where(F.col("lang").isNotNull() & (fold("doc_id", modulus) != rest)).select("doc_id", "lang")
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    if not sizes:
        return None
    top = {r["lang"]: -2.0 ** 63 + 2.0 ** 64 * min(1.0, SPARE * per_language / max(r["n"], 1)) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in top.items() for x in pair])[F.col("lang")]
    hashed = F.xxhash64("doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))
    ids = known.where(hashed.cast("double") <= limit).distinct().withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("doc_id").distinct()
    rows = documents.where(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), "lang", "text") \
        .join(F.broadcast(ids), "doc_id").mapInArrow(_bitmaps, "doc_id long, lang string, bits binary").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"], bytes(r["bits"])))
    order = np.random.default_rng(1).permutation(len(rows))
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(rows[i]["bits"]) for i in order), np.uint8).reshape(len(rows), -1), axis=1)
    return fit(bits, [rows[i]["lang"] for i in order], landmarks)


def _predicted(model: Model | None):
    def run(batches):
        for batch in batches:
            for part in batches_of([batch], "text", 1 << 20):
                texts = part.column("text").to_pylist()
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
                for lo in range(0, len(known), 128):
                    own = known[lo:lo + 128]
                    for i, c, s in zip(own, *model.predict([texts[j] for j in own])):
                        lang[i], score[i] = c, s
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])
    return run


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    modulus, rest = HELD_OUT
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _predicted(model), "doc_id long, lang_pred string, score double") \
        .select("doc_id", (fold("doc_id", modulus) == rest).alias("held_out"), "lang_pred", "score")

"""Operator 4: BPE encoding and decoding through a distinct-word table.

Stages (every exchange carries compressed, bounded rows):

1. *Factorise.*  Documents are taken in bundles of at most `bundle_bytes` of
   text.  A bundle's words are split with the vocabulary's pattern and
   numbered; the bundle becomes one row with the word numbers of its
   documents (positions) and, per word class (crc32 of the word modulo the
   number of classes), one row with the bundle's distinct words of that class.
2. *Encode.*  The words of a class meet in one group, where each distinct word
   is encoded once; every bundle's row gets the ids of its words back.  The
   number of classes follows the bytes of all texts (one aggregate before), so
   that a group stands for `class_bytes` of text; when a bundle would need more
   than `MAX_CLASSES` rows for that, the bundles are dealt over slices as well,
   and a word is encoded once in each slice.
3. *Join back by position.*  Positions and ids meet by bundle; a document's
   ids are its words' ids in order.  Decoding maps ids to pieces through the
   id-to-piece table (50,257 rows: a fixed bound) and concatenates.

A word that every document holds appears once per bundle, so no key is hot.
Rows: null text counts as empty (0 tokens); empty texts give an empty id
list; repeated rows are kept; an empty table gives no rows; extra columns are
not read.  A text longer than a bundle is a bundle of its own.  The frame is
read twice (bytes, then words) unless the caller names its bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import vocab
from quire.llm.common import batches_of

BUNDLE_BYTES = 8 << 20
#: Text bytes that one group of words stands for, and bounds of the class count
#: (a bundle sends one row per class).
CLASS_BYTES = 32 << 20
MIN_CLASSES, MAX_CLASSES = 256, 4096
#: Text bytes of a partition of the exchange, beyond `spark.sql.shuffle.partitions`.
PARTITION_BYTES = 64 << 20
#: A task's table of encoded words starts anew beyond this size (memory bound;
#: a class of more words encodes some of them again, with the same result).
TABLE_WORDS = 1_000_000

_PACKED = pa.schema([("route", pa.int64()), ("bundle", pa.int64()), ("word_class", pa.int32()), ("payload", pa.binary())])
_PACKED_DDL = "route long, bundle long, word_class int, payload binary"


def _put(*parts: bytes) -> bytes:
    """Length-prefixed parts, compressed."""
    body = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
    return zstandard.ZstdCompressor(level=3).compress(body)


def _get(blob: bytes) -> list[bytes]:
    body, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(body):
        n = int.from_bytes(body[at:at + 8], "little")
        out.append(body[at + 8:at + 8 + n])
        at += 8 + n
    return out


def _lengths(items) -> bytes:
    return np.fromiter(map(len, items), "<i8", len(items)).tobytes()


def _cut(body: bytes, lengths: bytes) -> list[bytes]:
    ends = np.frombuffer(lengths, "<i8").cumsum().tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def plan_groups(text_bytes: int, class_bytes: int = CLASS_BYTES, classes: int | None = None) -> tuple[int, int]:
    """(classes, slices) with about `class_bytes` of text a group at most."""
    classes = classes or min(max(-(-text_bytes // class_bytes), MIN_CLASSES), MAX_CLASSES)
    return classes, max(-(-text_bytes // (classes * class_bytes)), 1)


def _factorise(id_col: str, text_col: str, path: str, bundle_bytes: int, classes: int, slices: int):
    def run(batches):
        for batch in batches_of(batches, text_col, bundle_bytes):
            number = defaultdict(itertools.count().__next__)
            positions, lengths = [], []
            for text in batch.column(text_col).to_pylist():
                words = vocab.split_words(text or "", path)
                idx = np.fromiter(map(number.__getitem__, words), "<u4", len(words))
                positions.append(idx.tobytes())
                lengths.append(idx.size)
            ids = batch.column(id_col).cast(pa.int64())
            known = np.asarray(ids.is_valid(), dtype=np.uint8).tobytes()
            ids = np.asarray(ids.fill_null(0), dtype="<i8").tobytes()
            raw = [w.encode() for w in number]
            label = hashlib.blake2b(b"\0".join([ids, known, *positions, *raw]), digest_size=8).digest()
            bundle = int.from_bytes(label, "little", signed=True)
            flat = np.frombuffer(b"".join(positions), "<u4")
            # low and high halves apart: the high half is mostly zero and packs well
            halves = (flat & 0xFFFF).astype("<u2").tobytes(), (flat >> 16).astype("<u2").tobytes()
            rows = [(bundle, bundle, -1, _put(ids, known, np.array(lengths, "<i8").tobytes(), *halves))]
            part = bundle % slices
            owner = np.fromiter((zlib.crc32(w) % classes for w in raw), "<i4", len(raw))
            for c in np.unique(owner).tolist():
                own = np.flatnonzero(owner == c)
                mine = [raw[i] for i in own]
                rows.append((part * classes + c, bundle, c, _put(own.astype("<u4").tobytes(), _lengths(mine), b"".join(mine))))
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), _PACKED)], schema=_PACKED)
    return run


def _encode(path: str):
    def run(batches):
        tok, special = vocab.load_tokenizer(path), vocab.special_tokens(path)
        table: dict[bytes, bytes] = {}
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["word_class"] < 0:
                    continue
                if row["route"] != current:
                    current, table = row["route"], {}
                if len(table) > TABLE_WORDS:
                    table = {}
                own, lengths, body = _get(row["payload"])
                words = _cut(body, lengths)
                new = [w for w in words if w not in table]
                texts = [w.decode() for w in new]
                for w, t, e in zip(new, texts, tok.encode_batch_fast(texts, add_special_tokens=False)):
                    table[w] = np.array([special[t]] if t in special else e.ids, "<u4").tobytes()
                ids = [table[w] for w in words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["bundle"]], pa.int64()), pa.array([_put(own, _lengths(ids), b"".join(ids))], pa.binary())],
                    schema=pa.schema([("bundle", pa.int64()), ("ids", pa.binary())]))
    return run


def _assemble(path: str):
    """cogroup of one bundle: positions with the ids of its words."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = vocab.id_to_piece(path)
        out = []
        left = left.filter(pc.less(left.column("word_class"), 0))  # rows of words only pass by here
        words: dict[int, bytes] = {}
        for blob in right.column("ids").to_pylist():
            own, lengths, body = _get(blob)
            words.update(zip(np.frombuffer(own, "<u4").tolist(), _cut(body, lengths)))
        ids_of = [words[i] for i in range(len(words))]
        counts = np.fromiter((len(b) // 4 for b in ids_of), "<i8", len(ids_of))
        listed = [np.frombuffer(b, "<u4").tolist() for b in ids_of]
        spelled = [",".join(map(str, x)) for x in listed]
        decoded = [b"".join(map(pieces.__getitem__, x)) for x in listed]
        for blob in left.column("payload").to_pylist():
            ids, known, lengths, low, high = _get(blob)
            flat = np.frombuffer(low, "<u2").astype("<u4") | (np.frombuffer(high, "<u2").astype("<u4") << 16)
            at = 0
            for doc, has, n in zip(np.frombuffer(ids, "<i8").tolist(), known, np.frombuffer(lengths, "<i8").tolist()):
                own = flat[at:at + n]
                at += n
                order = own.tolist()
                body = b"".join(map(decoded.__getitem__, order)).decode("utf-8", errors="replace")
                out.append((doc if has else None, int(counts[own].sum()) if n else 0,
                            hashlib.sha256(",".join(map(spelled.__getitem__, order)).encode()).hexdigest(),
                            hashlib.sha256(body.encode()).hexdigest(), own, body))
        return out, ids_of
    return run


def _digest(path: str):
    run = _assemble(path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, _ = run(left, right)
        return pa.Table.from_pylist([dict(zip(schema.names, r[:4])) for r in rows], schema=schema)
    return digest


def _full(path: str):
    run = _assemble(path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def full(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ids_of = run(left, right)
        table = [np.frombuffer(b, "<u4").astype("i4") for b in ids_of]
        return pa.Table.from_pylist([{"doc_id": r[0], "ids": np.concatenate([table[i] for i in r[4]]).tolist() if len(r[4]) else [],
                                      "decoded": r[5]} for r in rows], schema=schema)
    return full


def _joined(df: DataFrame, id_col: str, text_col: str, path: str, bundle_bytes: int, classes: int | None, class_bytes: int,
            text_bytes: int | None):
    if text_bytes is None:
        text_bytes = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    classes, slices = plan_groups(text_bytes, class_bytes, classes)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // PARTITION_BYTES))
    packed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _factorise("doc_id", "text", path, bundle_bytes, classes, slices), _PACKED_DDL).repartition(n, "route")
    ids = packed.sortWithinPartitions("route").mapInArrow(_encode(path), "bundle long, ids binary")
    # `packed` is partitioned by route, which is the bundle for rows of
    # positions: they stay where the first exchange put them.
    return packed.groupBy("route").cogroup(ids.groupBy("bundle"))


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  bundle_bytes: int = BUNDLE_BYTES, classes: int | None = None, class_bytes: int = CLASS_BYTES,
                  text_bytes: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row."""
    path = path or vocab.tokenizer_path()
    return _joined(df, id_col, text_col, path, bundle_bytes, classes, class_bytes, text_bytes).applyInArrow(
        _full(path), "doc_id long, ids array<int>, decoded string")


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  bundle_bytes: int = BUNDLE_BYTES, classes: int | None = None, class_bytes: int = CLASS_BYTES,
                  text_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests are taken
    in the tasks that hold ids and decoded text, so neither is shipped."""
    path = path or vocab.tokenizer_path()
    return _joined(df, id_col, text_col, path, bundle_bytes, classes, class_bytes, text_bytes).applyInArrow(
        _digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

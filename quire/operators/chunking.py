"""Chunking.

K1 is a per-document sequential scan (each chunk's start depends on the
previous chunk's end).  It runs where the document was read (no shuffle):
the scan itself in an Arrow-batched pandas UDF, the ids (K2, sha256) and
ordinals (W1, array position) with built-in expressions.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quire.functions import patterns as P
from quire.functions.text import col_of


CHUNK_TYPE = "array<struct<start:int,end:int,text:string>>"


def _boundaries(text: str) -> list[tuple[int, list[int]]]:
    """Start positions of every sentence ending, grouped by its length."""
    found: dict[int, list[int]] = {}
    for ending in P.CHUNK_SENTENCE_ENDINGS:
        found.setdefault(len(ending), []).extend(m.start() for m in re.finditer(f"(?={re.escape(ending)})", text))
    return [(width, sorted(at)) for width, at in found.items()]


def _sentence_cut(boundaries, lower: int, upper: int) -> int | None:
    """End after the last sentence ending that lies whole before `upper` and
    starts above `lower`."""
    last = -1
    for width, at in boundaries:
        i = bisect.bisect_right(at, upper - width)
        if i:
            last = max(last, at[i - 1])
    return last + 1 if last > lower else None


def _scan(text: str, size: int, overlap: int):
    """(start, end, stripped text) of every non-blank chunk.

    All sentence endings are located once; each chunk's end is then a
    bisection: the last ending in the second half of the look-back window, or
    the size limit.  Linear in the text plus the number of chunks."""
    if not text or text.isspace():
        return []
    ends, out, start = _boundaries(text), [], 0
    for _ in range(len(text)):
        limit = start + size
        if limit < len(text):
            window = max(start, limit - P.CHUNK_BOUNDARY_WINDOW)
            end = _sentence_cut(ends, window + (limit - window) // 2, limit) or limit
        else:
            end = len(text)
        if piece := text[start:end].strip():
            out.append({"start": start, "end": end, "text": piece})
        if end == len(text):
            break
        start = min(end, max(start + 1, end - overlap))
    return out


def scan_chunks(text: str, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> list[dict]:
    """The chunks (start, end, text) of one Python string, for passes that
    hold the text already."""
    return _scan(text, size, overlap)


def chunk_spans(text, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> Column:
    """K1 core: array of (start, end, text) per row.

    The scan is sequential within a document and needs O(1) random access
    into the text, which Spark's UTF-8 strings do not offer (substring is
    O(position)), so it runs as an Arrow-batched pandas UDF; everything
    around it stays in the JVM."""
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap >= size:
        raise ValueError("overlap must be smaller than chunk_size")

    @pandas_udf(CHUNK_TYPE)
    def _chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda v: _scan(v, size, overlap))

    return _chunks(col_of(text))


def chunk_array(text, doc_id: Column | None = None, size: int = P.CHUNK_SIZE,
                overlap: int = P.CHUNK_OVERLAP) -> Column:
    """K1 + K2 per row: array of chunks (chunk_id, text, start, end, length),
    blank chunks removed, in index order."""
    doc_key = F.coalesce(F.nullif(doc_id.cast("string"), F.lit("")), F.lit("doc")) if doc_id is not None \
        else F.lit("doc")
    return F.transform(chunk_spans(text, size, overlap), lambda c: F.struct(
        F.sha2(F.concat_ws(":", doc_key, c["start"].cast("string"), c["end"].cast("string"), c["text"]),
               256).alias("chunk_id"),
        c["text"].alias("text"), c["start"].alias("start"), c["end"].alias("end"),
        F.char_length(c["text"]).alias("length")))


def chunk_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP,
                keep_cols: list[str] | None = None) -> DataFrame:
    """One row per chunk with its ordinal (`chunk_index`) in the
    document.  The ordinal comes from the array position, not a window, so
    no shuffle happens."""
    keep = [c for c in (keep_cols or []) if c not in (id_col, text_col)]
    d = df.select(id_col, *keep, F.posexplode(chunk_array(F.col(text_col), F.col(id_col), size, overlap))
                  .alias("chunk_index", "c"))
    return d.select(F.col("c.chunk_id"), F.col(id_col).alias("document_id"), *keep, "chunk_index",
                    "c.start", "c.end", "c.length", F.col("c.text").alias("chunk_text"))


def validate_chunks(chunks: DataFrame, doc_col: str = "document_id") -> DataFrame:
    """K3 per document: valid = required fields present and start < end for
    every chunk; length mismatches (text stripped) are warnings only."""
    required = F.col("chunk_id").isNotNull() & F.col("chunk_text").isNotNull() & \
        F.col("start").isNotNull() & F.col("end").isNotNull()
    return chunks.groupBy(doc_col).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.bool_and(required & (F.col("start") < F.col("end"))).alias("valid"),
        F.sum((F.char_length("chunk_text") != (F.col("end") - F.col("start"))).cast("int")).alias("n_warnings"))


def chunk_neighbours(chunks: DataFrame, doc_col: str = "document_id") -> DataFrame:
    """K4: overlap and gap between each chunk and the previous one of the
    same document (lag over the chunk ordinal).  The window shuffles by
    document; chunks of one document are few (text length / step)."""
    from pyspark.sql.window import Window
    w = Window.partitionBy(doc_col).orderBy("chunk_index")
    prev_end = F.lag("end").over(w)
    return chunks.select(doc_col, "chunk_index", "start", "end",
                         prev_end.alias("prev_end"),
                         F.when(prev_end.isNull(), F.lit(None)).otherwise(prev_end - F.col("start"))
                         .alias("overlap_chars"))


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """K5: unique chunk_id, keeping the first occurrence by (document,
    ordinal).  `min` over a struct led by the order keys is an ordinary
    aggregate, so copies are combined per partition before the shuffle and a
    chunk id repeated a million times costs one row per partition."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", "document_id", "chunk_index")]
    first = F.min(F.struct("document_id", "chunk_index", *rest)).alias("_f")
    return chunks.groupBy("chunk_id").agg(first).select(
        "chunk_id", "_f.document_id", "_f.chunk_index", *[F.col(f"_f.{c}") for c in rest]) \
        .select(*chunks.columns)

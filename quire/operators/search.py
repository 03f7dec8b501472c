"""Secure search and extractive summaries.

Summaries are computed from the chunk array of each document row, so a
document's chunks are never regrouped through a shuffle; redaction by role
(P8) is a join to the requester's permissions followed by a `when`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quire.functions import patterns as P
from quire.functions.text import py_strip
from quire.operators import chunking as K
from quire.operators import pii
from quire.operators import vectors as V


def role_redacted(df: DataFrame, text_col: str, can_view_col: str, out_col: str) -> DataFrame:
    """Original text for holders of pii:view, masked (P1+P3+P4)
    otherwise; detection runs only for the rows that need it."""
    red = pii.redact_text(F.when(~F.col(can_view_col), F.col(text_col)))
    return df.withColumn("_r", red).withColumn(out_col, F.when(F.col(can_view_col), F.col(text_col)).otherwise(F.col("_r.text"))).drop("_r")


def _lit_split(s: Column, sep: str) -> Column:
    import re
    return F.split(s, re.escape(sep), -1)


def _finish(summary: Column) -> Column:
    return F.when((summary != "") & ~summary.endswith("."), F.concat(summary, F.lit("."))).otherwise(summary)


def _contains_any(sentence: Column, words: Column) -> Column:
    low = F.lower(sentence)
    return F.exists(words, lambda w: F.instr(low, w) > 0)


def query_words(query: Column) -> Column:
    """`query.lower().split()`; a falsy query (null or '') -> null (general
    mode); a whitespace-only query is truthy and has no words."""
    s = py_strip(F.lower(query))
    return F.when(query.isNull() | (query == ""), F.lit(None)).when(s == "", F.array().cast("array<string>")) \
        .otherwise(F.split(s, P.WS_CLASS + "+", -1))


def with_summary_text(df: DataFrame, text_col: str, doc_col: str, can_view_col: str,
                      out_col: str = "full") -> DataFrame:
    """Chunks of the document (K1), each redacted by role (P8, per chunk as
    the reference does), joined by a blank line; null when the document
    has no chunks (not found).  One Arrow pass in the document's row."""
    return df.withColumn(out_col, _redacted_chunks(F.col(text_col), F.col(can_view_col)))


def _redacted_chunks(text: Column, can_view: Column) -> Column:
    masked = pii.python_redactor("mask")

    @pandas_udf("string")
    def joined(texts: pd.Series, views: pd.Series) -> pd.Series:
        out = []
        for t, view in zip(texts, views):
            parts = [c["text"] for c in K.scan_chunks(t)] if t is not None else []
            out.append("\n\n".join(parts if view else map(masked, parts)) if parts else None)
        return pd.Series(out, dtype=object)
    return joined(text, can_view)


def split_a(full: Column) -> Column:
    """Pieces of summary A: literal split on '. '."""
    return _lit_split(full, ". ")


def split_b(full: Column) -> Column:
    """Pieces of summary B: literal split on '.'."""
    return _lit_split(full, ".")


def summarize_a(sentences: Column, query: Column) -> tuple[Column, Column]:
    """Q2 + Q3 over the pieces of `split_a` (materialise them once as a
    column): first three pieces; highlights among the first ten pieces
    containing a query word (or a default keyword), at most 3."""
    summary = _finish(F.array_join(F.slice(sentences, 1, 3), ". "))
    words = F.coalesce(query_words(query), F.array(*[F.lit(k) for k in P.HIGHLIGHT_KEYWORDS]))
    hits = F.filter(F.slice(sentences, 1, 10), lambda s: _contains_any(s, words))
    highlights = F.transform(F.slice(hits, 1, 3), lambda s: py_strip(s))
    return summary, highlights


def summarize_b(pieces: Column, query: Column) -> tuple[Column, Column]:
    """Q4 + Q5 over the pieces of `split_b`: with a query, up to five
    matching pieces (stripped), summary and highlights from the first three;
    without, the first three pieces and highlights = pieces 2-4 stripped,
    non-empty."""
    words = query_words(query)
    relevant = F.slice(F.transform(F.filter(pieces, lambda s: _contains_any(s, words)), lambda s: py_strip(s)), 1, 5)
    q_summary = _finish(F.array_join(F.slice(relevant, 1, 3), ". "))
    g_summary = _finish(F.array_join(F.slice(pieces, 1, 3), ". "))
    g_high = F.filter(F.transform(F.slice(pieces, 2, 3), lambda s: py_strip(s)), lambda s: s != "")
    focused = query.isNotNull() & (query != "")
    return (F.when(focused, q_summary).otherwise(g_summary),
            F.when(focused, F.slice(relevant, 1, 3)).otherwise(g_high))


def chunk_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_cols: list[str] | None = None,
                  mode: str = "mask", salt: Column | str = P.DEFAULT_SALT) -> DataFrame:
    """The rows of the chunk store.  `chunk_text` is redacted (P1, P3,
    P4-P6), `original_text` is kept for holders of pii:view, and
    `redaction_metadata` lists the applied redactions (P7; empty: none).
    The id is derived from the original text and doubles as its hash and as
    the id of its vector, as in the reference.  One pass in the document's
    row; nothing shuffles."""
    chunks = K.chunk_table(docs, id_col, text_col, keep_cols=keep_cols)
    found = chunks.withColumn("_found", pii.redact_with_spans(F.col("chunk_text"), mode, salt))
    keep = [c for c in (keep_cols or []) if c not in (id_col, text_col)]
    return found.select(
        "chunk_id", "document_id", *keep, "chunk_index", "start", "end", "length", F.col("chunk_id").alias("text_hash"),
        F.col("_found.text").alias("chunk_text"), F.col("chunk_text").alias("original_text"),
        pii.applied_redactions(F.col("_found.spans"), mode, salt).alias("redaction_metadata"), F.col("chunk_id").alias("vector_id"))


def hit_metadata(hits: DataFrame, vectors: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What a search hit shows: its vector's chunk, the chunk's offsets,
    text and redaction metadata, and the document's file name.

    hits: query_id, rank, vector_id, score; vectors (S9): vector_id, chunk_id,
    position, embedding_version; chunks (S6); documents: document_id, filename.
    The stored tables are narrowed to the hits from step to step: a side that
    turns out small is broadcast at run time, and where both are large the
    optimizer's runtime filter (a Bloom filter of the hits' keys) prunes the
    scan of the stored table before its exchange.  Hits without a vector,
    chunk or document are left out (inner joins, as in the reference)."""
    h = hits.select("query_id", "rank", "vector_id", "score")
    v = vectors.select("vector_id", "chunk_id", "position", "embedding_version")
    c = chunks.select("chunk_id", "document_id", "start", "end", "chunk_text", "redaction_metadata")
    d = documents.select("document_id", F.col("filename").alias("document_name"))
    j = h.join(v, "vector_id").join(c, "chunk_id").join(d, "document_id")
    return j.select("query_id", "rank", "vector_id", "score", "position", "embedding_version", "chunk_id", "document_id", "document_name",
                    "start", "end", F.col("chunk_text").alias("text"), "redaction_metadata")


def secure_search(requests: DataFrame, permissions: DataFrame, index: DataFrame, chunks: DataFrame,
                  embedder: V.Embedder, k: int = 5) -> DataFrame:
    """Q1: authorise (J5 semi join on document:search) -> embed the query
    (V5) -> exact kNN in the tenant (V6) -> fetch chunk text (J2) -> redact
    by role (P8).

    requests: query_id, user_id, tenant_id, query; permissions: user_id,
    tenant_id, permissions (array); index: tenant_id, vector_id, embedding;
    chunks: chunk_id, document_id, chunk_text."""
    perms = permissions.select("user_id", "tenant_id", "permissions")
    allowed = requests.join(perms, ["user_id", "tenant_id"]) \
        .filter(F.array_contains("permissions", "document:search"))
    q = V.embed_batch(allowed, embedder, text_col="query", out_col="query_embedding")
    hits = V.knn(index, q.select("query_id", "tenant_id", "query_embedding"), k=k)
    can_view = allowed.select("query_id", F.array_contains("permissions", "pii:view").alias("can_view_pii"))
    j = hits.join(chunks.select(F.col("chunk_id").alias("vector_id"), "document_id", "chunk_text"), "vector_id") \
        .join(can_view, "query_id")
    j = role_redacted(j, "chunk_text", "can_view_pii", "text")
    return j.select("query_id", "rank", F.col("vector_id").alias("chunk_id"), "document_id", "score", "text")


def search_metrics(requests: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """A10: per query: query_length, results_count, top_k."""
    cnt = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results_count"))
    return requests.select("query_id", F.char_length("query").alias("query_length")) \
        .join(cnt, "query_id", "left") \
        .select("query_id", "query_length", F.coalesce("results_count", F.lit(0)).alias("results_count"),
                F.lit(k).alias("top_k"))


def chunk_lookup(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """J9 + C5 + C6: fetch chunks by id for (chunk_id, tenant_id,
    include_original) requests.  The tenant is part of the join key, so a
    request never sees another tenant's chunk (C5); `text` is the masked
    chunk, `original_text` is only projected when requested (C6)."""
    j = requests.join(chunks, ["chunk_id", "tenant_id"])
    j = j.withColumn("_no", F.lit(False))
    j = role_redacted(j, "chunk_text", "_no", "text")
    return j.select("chunk_id", "tenant_id", "document_id", "start", "end", "text",
                    F.when(F.col("include_original"), F.col("chunk_text")).alias("original_text"))


def secure_search_offsets(requests: DataFrame, permissions: DataFrame, index: DataFrame, documents: DataFrame,
                          embedder: V.Embedder, k: int = 5) -> DataFrame:
    """Q1 when the index rows carry their chunk's (document_id, start, end):
    the hit text is cut from the document in the JVM (J2 against the
    document table), so chunks need not be re-derived.
    documents: doc_id, text."""
    perms = permissions.select("user_id", "tenant_id", "permissions")
    allowed = requests.join(perms, ["user_id", "tenant_id"]) \
        .filter(F.array_contains("permissions", "document:search"))
    q = V.embed_batch(allowed, embedder, text_col="query", out_col="query_embedding")
    hits = V.knn(index, q.select("query_id", "tenant_id", "query_embedding"), k=k,
                 carry_cols=["document_id", "start", "end"])
    can_view = allowed.select("query_id", F.array_contains("permissions", "pii:view").alias("can_view_pii"))
    # no hint: hits grow with the query batch, AQE broadcasts them when their measured size allows
    j = documents.select(F.col("doc_id").alias("document_id"), "text").join(hits, "document_id")
    j = j.withColumn("chunk_text", py_strip(F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))))
    j = j.join(can_view, "query_id")
    j = role_redacted(j, "chunk_text", "can_view_pii", "text_out")
    return j.select("query_id", "rank", F.col("vector_id").alias("chunk_id"), "document_id", "score",
                    F.col("text_out").alias("text"))

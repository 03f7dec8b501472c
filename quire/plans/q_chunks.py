"""Queries for chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators import chunking as K
from quire.operators import pii
from quire.plans.catalog import query
from quire.plans.sqlfrag import candidates, py_strip, resolve, rfind
from quire.sources import tables


def chunk_sql(size: int, overlap: int, table: str = "documents", id_col: str = "doc_id",
              text_col: str = "text") -> str:
    """Recursive-CTE chunker (independent of the Spark implementation)."""
    def end_expr(start: str) -> str:
        end0 = f"least({start} + {size}, n)"
        ws = f"greatest({start}, {end0} - {P.CHUNK_BOUNDARY_WINDOW})"
        win = f"substring(txt, {ws} + 1, {end0} - {ws})"
        half = f"(({end0} - {ws}) // 2)"
        cands = [f"(CASE WHEN {rfind(win, e)} > {half} THEN {rfind(win, e)} ELSE -1 END)"
                 for e in P.CHUNK_SENTENCE_ENDINGS]
        best = "greatest(" + ", ".join(cands) + ")"
        return f"(CASE WHEN {end0} < n AND {best} <> -1 THEN {ws} + {best} + 1 ELSE {end0} END)"

    nxt = f"greatest(s.start + 1, s.\"end\" - {overlap})"
    return (
        f"WITH RECURSIVE d AS (SELECT {id_col} AS doc_id, {text_col} AS txt, length({text_col}) AS n FROM {table} "
        f"WHERE {text_col} IS NOT NULL AND {py_strip(text_col)} <> ''), "
        f"steps(doc_id, start, \"end\") AS (SELECT doc_id, 0, {end_expr('0')} FROM d "
        f"UNION ALL SELECT doc_id, ns, {end_expr('ns')} FROM (SELECT s.doc_id, d.txt, d.n, "
        f"CASE WHEN {nxt} >= s.\"end\" THEN s.\"end\" ELSE {nxt} END AS ns "
        f"FROM steps s JOIN d ON d.doc_id = s.doc_id WHERE s.\"end\" < d.n)), "
        f"pieces AS (SELECT s.doc_id, s.start, s.\"end\", {py_strip('substring(d.txt, s.start + 1, s.\"end\" - s.start)')}"
        f" AS chunk_text FROM steps s JOIN d ON d.doc_id = s.doc_id), "
        f"chunks AS (SELECT sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(start AS VARCHAR) || ':' || "
        f"CAST(\"end\" AS VARCHAR) || ':' || chunk_text) AS chunk_id, doc_id AS document_id, "
        f"CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, "
        f"CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", "
        f"CAST(length(chunk_text) AS INTEGER) AS length, chunk_text FROM pieces WHERE chunk_text <> '') ")


_CHUNKS = chunk_sql(P.CHUNK_SIZE, P.CHUNK_OVERLAP)


@query("k1_chunks", "K1, K2, W1", _CHUNKS + "SELECT * FROM chunks")
def k1(spark, sf):
    return K.chunk_table(tables.load(spark, sf, "documents"))


@query("k1_chunks_small", "K1, K2, W1 (size 200, overlap 40)", chunk_sql(200, 40) + "SELECT * FROM chunks")
def k1_small(spark, sf):
    return K.chunk_table(tables.load(spark, sf, "documents"), size=200, overlap=40)


@query("k3_chunk_validation", "K3",
       _CHUNKS + "SELECT document_id, count(*) AS n_chunks, bool_and(start < \"end\") AS valid, "
       "sum(CASE WHEN length(chunk_text) <> \"end\" - start THEN 1 ELSE 0 END) AS n_warnings "
       "FROM chunks GROUP BY document_id")
def k3(spark, sf):
    return K.validate_chunks(K.chunk_table(tables.load(spark, sf, "documents")))


@query("k4_chunk_overlaps", "K4",
       _CHUNKS + "SELECT document_id, chunk_index, start, \"end\", "
       "lag(\"end\") OVER (PARTITION BY document_id ORDER BY chunk_index) AS prev_end, "
       "lag(\"end\") OVER (PARTITION BY document_id ORDER BY chunk_index) - start AS overlap_chars FROM chunks")
def k4(spark, sf):
    return K.chunk_neighbours(K.chunk_table(tables.load(spark, sf, "documents")))


@query("k5_chunk_dedup", "K5",
       _CHUNKS + "SELECT chunk_id, document_id, chunk_index, start, \"end\", length FROM chunks "
       "QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY document_id, chunk_index) = 1")
def k5(spark, sf):
    return K.dedup_chunks(K.chunk_table(tables.load(spark, sf, "documents"))).drop("chunk_text")


_SEEDED_CHUNKS = chunk_sql(P.CHUNK_SIZE, P.CHUNK_OVERLAP, table=f"({tables.SEEDED_SQL}) sd")


@query("a4_chunks_per_document", "A4 (chunk count and redaction flag per document)",
       _SEEDED_CHUNKS + ", ck AS (SELECT document_id, " + resolve(candidates("chunk_text")) + " AS kept FROM chunks) "
       "SELECT document_id, count(*) AS n_chunks, bool_or(len(kept) > 0) AS redaction_applied FROM ck "
       "GROUP BY document_id")
def a4(spark, sf):
    ch = K.chunk_table(tables.seeded_documents(tables.documents(spark, sf)))
    ch = ch.withColumn("has_pii", F.size(pii.detect_pii(F.col("chunk_text"))) > 0)
    return ch.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"),
                                         F.bool_or("has_pii").alias("redaction_applied"))

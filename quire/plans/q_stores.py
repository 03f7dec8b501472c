"""Queries that write a store in the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators import pii
from quire.plans import q_pii, q_search
from quire.plans.catalog import query
from quire.session import checkpoint_dir
from quire.sources import sinks, tables


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s1_raw_files", "S1 (texts written as raw files below their tenant's folder and read back with the tenant of the path)",
       "SELECT source AS tenant_id, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS total_bytes, "
       "CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT) AS line_ends FROM documents GROUP BY ALL")
def s1(spark, sf):
    path = _folder(spark, "uploads")
    sinks.write_raw_files(tables.documents(spark, sf), path)
    raw = sinks.read_raw_files(spark, path, "*.txt")
    ends = F.char_length(F.regexp_replace(F.decode("content", "UTF-8"), "[^\n]+", ""))
    return raw.groupBy("tenant_id").agg(F.sum("length").alias("total_bytes"), F.sum(ends.cast("long")).alias("line_ends"))


@query("s12_labelled_examples", "S12, P11 (seeded documents written as labelled examples, read back, recall per type)", q_pii.P11_SQL)
def s12(spark, sf):
    path = _folder(spark, "examples")
    seeded = tables.seeded_documents(tables.documents(spark, sf))
    sinks.write_pii_examples(seeded.withColumn("expected_types", F.array(*[F.lit(t) for t, _ in P.PII_PATTERNS])), path)
    examples = sinks.read_pii_examples(spark, path, lines=True).withColumn("doc_id", F.monotonically_increasing_id())
    return pii.detector_recall(examples, "expected_types")


@query("s5_document_store", "S5 (document metadata, written by tenant and read back)",
       "SELECT doc_id AS document_id, source AS tenant_id, 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, CAST(length(text) AS INTEGER) AS text_length, "
       "sha256(text) AS text_hash, 'text_extracted' AS status FROM documents")
def s5(spark, sf):
    d = tables.documents(spark, sf)
    meta = d.select(F.col("doc_id").alias("document_id"), "tenant_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                    F.char_length("text").alias("text_length"), F.sha2("text", 256).alias("text_hash"), F.lit("text_extracted").alias("status"))
    path = _folder(spark, "documents")
    sinks.write_documents(meta, path)
    stored = spark.read.schema("document_id long, filename string, text_length int, text_hash string, status string, tenant_id string").parquet(path)
    return stored.select("document_id", "tenant_id", "filename", "text_length", "text_hash", "status")


@query("s6_chunk_store", "S6, K5 (chunk records written twice: the second run adds nothing)", q_search.S6_SQL)
def s6_store(spark, sf):
    path = _folder(spark, "chunks")
    records = q_search.records_df(spark, sf)
    for _ in range(2):
        sinks.write_chunks(records, path)
    return q_search.flat_records(spark.read.parquet(path).withColumn("tenant_id", F.col("tenant_id").cast("string")))


@query("s10_index_store", "S10, V8, V7 (tenants' indexes replaced, emptied, deleted and created)",
       "WITH t AS (SELECT DISTINCT 't' || CAST(label AS VARCHAR) AS tenant_id FROM embeddings WHERE label IS NOT NULL UNION SELECT unnest(['new', 'none'])), "
       "v AS (SELECT 't' || CAST(label AS VARCHAR) AS tenant_id FROM embeddings WHERE label IS NOT NULL AND label NOT IN (3, 4) "
       "AND (label NOT IN (1, 2) OR vec_id % 2 = 0)) "
       "SELECT t.tenant_id, t.tenant_id NOT IN ('t3', 't4', 'none') AS exists, count(v.tenant_id) AS total_vectors FROM t LEFT JOIN v ON v.tenant_id = t.tenant_id GROUP BY ALL")
def s10(spark, sf):
    e = tables.load(spark, sf, "embeddings").where("label IS NOT NULL")
    index = e.select(F.concat(F.lit("t"), F.col("label").cast("string")).alias("tenant_id"), "vec_id", "embedding")
    path = _folder(spark, "index")
    sinks.replace_tenant_index(index, path)
    # three tenants are rebuilt, one of them has no vectors any more
    sinks.replace_tenant_index(index.where("tenant_id IN ('t1', 't2') AND vec_id % 2 = 0"), path, ["t1", "t2", "t3"])
    sinks.delete_tenant_index(spark, path, "t4")
    for tenant in ("new", "t5"):  # the second has an index and keeps it
        sinks.create_tenant_index(spark, path, tenant, "vec_id long, embedding array<float>")
    asked = index.select("tenant_id").unionAll(spark.createDataFrame([("new",), ("none",)], "tenant_id string"))
    return sinks.stored_index_stats(spark, path, asked)

"""Queries for embeddings and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunking as K
from quire.operators import vectors as V
from quire.plans.catalog import query
from quire.plans.q_chunks import chunk_sql
from quire.plans.sqlfrag import embed_ctes, normalize_sql, sq_l2
from quire.session import stored
from quire.sources import tables

DIM = 64  # the driver's vectors have 64 dimensions; the hash embedder matches


def _exploded(df, id_cols, vec_col):
    return df.select(*id_cols, F.posexplode(vec_col).alias("dim_index", "_v")) \
        .select(*id_cols, "dim_index", F.round(F.col("_v").cast("double"), 6).alias("value"))


_EXPLODE_SQL = ("unnest(generate_series(0, len(v) - 1)) AS dim_index, "
                "unnest(list_transform(v, lambda x: round(x::DOUBLE, 6))) AS value")


@query("v2_hash_embeddings", "V1, V2, V3",
       f"WITH {embed_ctes('e', 'documents', 'doc_id', 'text', DIM)} "
       f"SELECT id AS doc_id, dim_index, round(value::DOUBLE, 6) AS value FROM e")
def v2(spark, sf):
    d = tables.load(spark, sf, "documents")
    e = d.select("doc_id", V.HashEmbedder(DIM).embed(F.col("text")).alias("v"))
    return _exploded(e, ["doc_id"], "v")


@query("v3_l2_normalize", "V3",
       f"SELECT vec_id, {_EXPLODE_SQL} FROM (SELECT vec_id, {normalize_sql('embedding')} AS v FROM embeddings)")
def v3(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    return _exploded(e.select("vec_id", V.l2_normalize("embedding").alias("v")), ["vec_id"], "v")


_CENTROIDS = ("SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM "
              "(SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding) AS x "
              "FROM embeddings) GROUP BY label, i) GROUP BY label")


@query("v4_mean_pooling", "V4",
       f"SELECT label, unnest(generate_series(0, len(q) - 1)) AS dim_index, "
       f"unnest(list_transform(q, lambda x: round(x, 6))) AS value FROM ({_CENTROIDS})")
def v4(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    return _exploded(V.mean_pool(e, ["label"], "embedding", "v"), ["label"], "v")


@query("v6_knn_centroids", "V6, W2, O2 (queries: tenant centroids, k=5)",
       f"WITH c AS ({_CENTROIDS}), d AS (SELECT e.label, e.vec_id, {sq_l2('e.embedding', 'c.q')} AS score "
       f"FROM embeddings e JOIN c ON c.label = e.label) "
       f"SELECT label, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER "
       f"(PARTITION BY label ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 5")
def v6(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    cent = V.mean_pool(e, ["label"], "embedding", "query_embedding").withColumn("query_id", F.col("label"))
    hits = V.knn(e, cent, k=5, tenant_col="label", vector_id="vec_id")
    return hits.select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("v6_knn_cross_tenant", "J6 (cross join, broadcast queries), V6 cosine",
       f"WITH c AS ({_CENTROIDS}), d AS (SELECT c.label AS query_label, e.vec_id, "
       f"1.0 - list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * c.q[i])) / "
       f"(sqrt(list_sum(list_transform(c.q, lambda x: x * x))) * "
       f"sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS score "
       f"FROM embeddings e, c) "
       f"SELECT query_label, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER "
       f"(PARTITION BY query_label ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 5")
def v6x(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    cent = V.mean_pool(e, ["label"], "embedding", "query_embedding").withColumnRenamed("label", "query_label")
    hits = V.knn(e, cent, k=5, tenant_col=None, query_id="query_label", vector_id="vec_id", metric="cosine")
    return hits.select("query_label", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("v7_index_stats", "V7, A3",
       "SELECT label, true AS exists, count(*) AS total_vectors, max(len(embedding)) AS dimension, "
       "'IndexFlatL2' AS index_type FROM embeddings GROUP BY label")
def v7(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    return V.index_stats(e, e.select("label"), tenant_col="label")


@query("w4_index_positions", "W4 (dense positions per tenant)",
       "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position FROM embeddings")
def w4(spark, sf):
    from quire.operators.ordinals import dense_positions
    e = tables.load(spark, sf, "embeddings").select("label", "vec_id")
    return dense_positions(e, "label", ["vec_id"])


_CHUNKS = chunk_sql(1000, 200, table="documents")


@query("s9_build_index", "V5, V8, V9, S9, W4 (chunk index, hash embeddings)",
       _CHUNKS + f", t AS (SELECT c.chunk_id, d.source AS tenant_id, c.chunk_text FROM chunks c "
       f"JOIN documents d ON d.doc_id = c.document_id), {embed_ctes('e', 't', 'chunk_id', 'chunk_text', DIM)} "
       f"SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY chunk_id) - 1 AS position, "
       f"chunk_id AS vector_id, chunk_id, 'v1' AS embedding_version, "
       f"round(sqrt(list_sum(list_transform(e_vec.v, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm "
       f"FROM t JOIN e_vec ON e_vec.id = t.chunk_id")
def s9(spark, sf):
    d = tables.documents(spark, sf)
    ch = stored(K.chunk_table(d, keep_cols=["tenant_id"]).select("tenant_id", "chunk_id", "chunk_text"), "chunks")  # one Python worker a task
    emb = V.embed_batch(ch, V.HashEmbedder(DIM), text_col="chunk_text")
    idx = V.build_index(emb)
    return idx.select("tenant_id", "position", "vector_id", "chunk_id", "embedding_version",
                      F.round(V.l2_norm(F.col("embedding")), 6).alias("norm"))


_HALF = DIM // 2
_V9 = ("SELECT label, vec_id, embedding, 'v1' AS ver FROM embeddings UNION ALL "
       f"SELECT label, vec_id, embedding[1:{_HALF}], 'v2' FROM embeddings WHERE vec_id % 3 <> 0")


@query("v9_versioned_search", "V9 (two embedding versions of different dimension in one index, exact kNN in each)",
       f"WITH ix AS ({_V9}), cen AS (SELECT label, ver, list(m ORDER BY i) AS q FROM (SELECT label, ver, i, avg(x::DOUBLE) AS m FROM "
       "(SELECT label, ver, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding) AS x FROM ix) GROUP BY ALL) GROUP BY ALL), "
       f"d AS (SELECT ix.ver, ix.label, ix.vec_id, {sq_l2('ix.embedding', 'cen.q')} AS score FROM ix JOIN cen ON cen.label = ix.label AND cen.ver = ix.ver) "
       "SELECT ver AS embedding_version, label, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER "
       "(PARTITION BY ver, label ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 4")
def v9(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    index = e.select(F.col("label").alias("tenant_id"), "vec_id", "embedding", F.lit("v1").alias("embedding_version")).unionByName(
        e.where("vec_id % 3 <> 0").select(F.col("label").alias("tenant_id"), "vec_id", F.slice("embedding", 1, _HALF).alias("embedding"),
                                          F.lit("v2").alias("embedding_version")))
    asked = V.mean_pool(index, ["tenant_id", "embedding_version"], "embedding", "query_embedding") \
        .withColumn("query_id", F.concat_ws(":", "embedding_version", F.col("tenant_id").cast("string")))
    hits = V.search_versions(index, asked, k=4, vector_id="vec_id")
    return hits.select("embedding_version", F.col("tenant_id").alias("label"), "vec_id", F.round("score", 6).alias("score"), "rank")

"""Sinks and raw sources.

Writes are one job each (not one commit per row as in the reference), with
partition overwrite for per-tenant replacement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as TX
from quire.operators import chunking as K
from quire.operators import gate as G
from quire.operators import vectors as V


def read_raw_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Raw uploads laid out as <root>/<tenant>/<uuid>_<name>, or as
    `write_raw_files` leaves them (<root>/tenant_id=<tenant>/<file>); the tenant
    and file name come from the path."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true") \
        .load(root)
    return df.select(
        "path", "length", "modificationTime", "content",
        F.regexp_extract("path", r"/(?:tenant_id=)?([^/]+)/[^/]+$", 1).alias("tenant_id"),
        F.regexp_extract("path", r"/[0-9a-fA-F-]{36}_([^/]+)$", 1).alias("filename"))


def write_raw_files(docs: DataFrame, root: str, text_col: str = "text", rows_per_file: int = 200) -> None:
    """The texts as raw files below their tenant's folder, one line end
    after each; a null text leaves an empty line.  A file holds `rows_per_file`
    texts at most, so that `read_raw_files` (one row a file) stays bounded."""
    docs.select("tenant_id", F.coalesce(F.col(text_col), F.lit("")).alias("value")) \
        .write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("tenant_id").text(root)


def ingest_raw(raw: DataFrame, mime_col: str | None = None) -> DataFrame:
    """S2 + S3 + S4 + T7: dispatch by type, decode text files, clean, hash.
    Unsupported or binary formats go to a quarantine status (the PDF/DOCX
    decoders are not part of this engine)."""
    mime = F.col(mime_col) if mime_col else F.lit(None).cast("string")
    d = raw.withColumn("extractor", G.dispatch_format(mime, F.col("filename")))
    text = F.when(F.col("extractor") == "txt", TX.normalize_whitespace(G.decode_text(F.col("content"))))
    d = d.withColumn("raw_text", text)
    clean = TX.clean_text_for_embedding(F.col("raw_text"))
    d = d.withColumn("clean_text", F.when(F.col("extractor") == "txt", clean))
    return d.select(
        F.sha2(F.col("path"), 256).substr(1, 32).alias("document_id"), "tenant_id", "filename", "path",
        "extractor", F.char_length("clean_text").alias("text_length"),
        F.sha2("clean_text", 256).alias("text_hash"),
        F.when(F.col("extractor") == "txt", "text_extracted").otherwise("quarantined").alias("status"),
        "clean_text")


def write_documents(meta: DataFrame, path: str, mode: str = "append") -> None:
    """Document metadata table, partitioned by tenant."""
    meta.write.mode(mode).partitionBy("tenant_id").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system (any URI)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_paths(spark: SparkSession, pattern: str) -> None:
    """Delete every path that matches a Hadoop glob pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(p) or []:
        fs.delete(status.getPath(), True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append to the chunk table; chunk ids are unique across runs.
    The id is content-derived, so chunks already in the table are left out
    (anti join on the id) and ingesting twice changes nothing."""
    new = chunks.dropDuplicates(["chunk_id"])
    spark = chunks.sparkSession
    if path_exists(spark, path):
        new = new.join(spark.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns)
    new.write.mode("append").partitionBy("tenant_id").parquet(path)


def replace_tenant_index(index: DataFrame, path: str, tenants: list[str] | None = None) -> None:
    """Replace the partitions of the tenants present in `index`
    (dynamic partition overwrite); others are untouched.  `tenants` names
    those being replaced: one that has no rows any more loses its old
    vectors instead of staying searchable."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)
    if tenants:
        spark = index.sparkSession
        present = {r["tenant_id"] for r in index.where(F.col("tenant_id").isin(tenants)).select("tenant_id").distinct().collect()}
        for t in set(tenants) - present:
            delete_tenant_index(spark, path, t)


def reindex_tenant(docs: DataFrame, path: str, tenant_id: str, embedder: V.Embedder, version: str = "v1") -> dict:
    """V8: rebuild one tenant's index from its documents (doc_id, tenant_id,
    text).  A tenant without documents ends with an empty index and says so."""
    own = docs.where(F.col("tenant_id") == tenant_id)
    if own.limit(1).count() == 0:
        delete_tenant_index(docs.sparkSession, path, tenant_id)
        return {"tenant_id": tenant_id, "status": "no_documents", "vectors": 0}
    chunks = K.chunk_table(own, keep_cols=["tenant_id"])
    index = V.build_index(V.embed_batch(chunks, embedder, text_col="chunk_text")).withColumn("embedding_version", F.lit(version))
    replace_tenant_index(index, path, [tenant_id])
    spark = docs.sparkSession
    n = spark.read.parquet(path).where(F.col("tenant_id") == tenant_id).count() if path_exists(spark, path) else 0
    return {"tenant_id": tenant_id, "status": "completed", "vectors": n}


def delete_tenant_index(spark: SparkSession, path: str, tenant_id: str) -> None:
    """Delete a tenant's index partition (Hadoop FileSystem, so the
    same call works on local, HDFS or object-store paths)."""
    delete_paths(spark, f"{path.rstrip('/')}/tenant_id={tenant_id}")


def create_tenant_index(spark: SparkSession, path: str, tenant_id: str, schema: str) -> None:
    """An index without vectors for a tenant that has none yet (a tenant
    that has one keeps it)."""
    own = f"{path.rstrip('/')}/tenant_id={tenant_id}"
    if not path_exists(spark, own):
        spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(own)


def stored_index_stats(spark: SparkSession, path: str, tenants: DataFrame) -> DataFrame:
    """V7 over a stored index: (tenant_id, exists, total_vectors) of `tenants`.
    An index exists if its folder does, with or without vectors; the folders
    are the partitions that Spark lists for any read of the table."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/tenant_id=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    folders = spark.createDataFrame([(f.getPath().getName().split("=", 1)[1], True) for f in found], "tenant_id string, _exists boolean")
    totals = spark.read.parquet(path).groupBy(F.col("tenant_id").cast("string").alias("tenant_id")).agg(F.count(F.lit(1)).alias("_n"))
    j = tenants.select("tenant_id").distinct().join(folders, "tenant_id", "left").join(totals, "tenant_id", "left")
    return j.select("tenant_id", F.coalesce("_exists", F.lit(False)).alias("exists"), F.coalesce("_n", F.lit(0)).alias("total_vectors"))


_EXAMPLE = "text string, expected array<struct<type:string>>"


def read_pii_examples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled PII examples (JSON array of {text, expected: [{type}]})
    with upper-case expected types lowered to our type names.  `lines`: one
    object a line, which Spark splits and reads by many tasks."""
    df = spark.read.option("multiLine", str(not lines).lower()).schema(_EXAMPLE).json(path)
    return df.select("text", F.transform("expected", lambda e: F.lower(e["type"])).alias("expected_types"))


def write_pii_examples(df: DataFrame, path: str, types_col: str = "expected_types") -> None:
    """Examples (text, array of our type names) as JSON lines of the
    labelled form, for `read_pii_examples(..., lines=True)`."""
    named = F.transform(types_col, lambda t: F.struct(F.upper(t).alias("type")))
    df.select("text", named.alias("expected")).write.mode("append").json(path)

"""Driver tables and the views derived from them.

The reference keeps documents, tenants, users and roles in a relational
store; here the corpus tables are Parquet and the mapping of SURVEY §5.1 is
expressed as DataFrame projections (identical expressions appear in the
oracle SQL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas


def spread_scan(df: DataFrame) -> DataFrame:
    """Round-robin a scan when the session asks for it.

    `quire.scanPartitions` is unset by default: a scan keeps its splits at
    every size.  A session over single-file tables of one row group (the
    benchmark) sets it, so that CPU-bound text work is not one task."""
    n = df.sparkSession.conf.get("quire.scanPartitions", "")
    return df.repartition(int(n)) if n else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table with its declared schema (no inference)."""
    schema = schemas.TABLES.get(name)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return spread_scan(reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the reference models them: tenant_id := source."""
    return load(spark, sf_dir, "documents").withColumn("tenant_id", F.col("source"))


def _pad4(c):
    return F.lpad((c % 10000).cast("string"), 4, "0")


def seeded_documents(docs: DataFrame) -> DataFrame:
    """Documents with a deterministic PII suffix built from doc_id.

    The corpus holds no ssn, date or zip values under the reference patterns;
    the suffix makes every type occur.  Derived row by row, so it grows with
    the table."""
    d = F.col("doc_id")
    suffix = F.concat(
        F.lit(" ssn 123-45-"), _pad4(d),
        F.lit(" tel 555-123-"), _pad4(d),
        F.lit(" mail u"), d.cast("string"), F.lit("@example.com card 4532-1234-5678-"), _pad4(d),
        F.lit(" born 01/02/1990 zip 90210"),
    )
    return docs.withColumn("text", F.concat(F.col("text"), suffix))


SEEDED_SQL = (
    "SELECT doc_id, text || ' ssn 123-45-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')"
    " || ' tel 555-123-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')"
    " || ' mail u' || CAST(doc_id AS VARCHAR) || '@example.com card 4532-1234-5678-'"
    " || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || ' born 01/02/1990 zip 90210' AS text,"
    " lang, source, n_chars, source AS tenant_id FROM documents"
)


# Users of the request/audit stream: tenant and role are functions of the id
# (SURVEY §5.1).  Role order follows the matrices in quire.operators.access.
ROLE_BY_MOD4 = ["admin", "editor", "viewer", "analyst"]


def user_tenant_col(user_id):
    return F.concat(F.lit("src"), (user_id % 20).cast("string"))


def user_role_col(user_id):
    m = user_id % 4
    return (F.when(m == 0, "admin").when(m == 1, "editor")
            .when(m == 2, "viewer").otherwise("analyst"))


def users(events: DataFrame) -> DataFrame:
    """Distinct users with their tenant (user_id as string, tenant_id)."""
    u = events.select("user_id").distinct()
    return u.select(F.col("user_id").cast("string").alias("user_id"),
                    user_tenant_col(F.col("user_id")).alias("tenant_id"),
                    user_role_col(F.col("user_id")).alias("role_name"))

"""Upload -> ingest -> redact + chunk -> index -> search -> summarise -> audit,
with role and tenant rules (the intent of the reference's integration tests)."""

import os
import uuid

from pyspark.sql import functions as F

from quire.operators import access as AC
from quire.operators import audit as AU
from quire.operators import chunking as K
from quire.operators import pii
from quire.operators import search as S
from quire.operators import vectors as V
from quire.sources import sinks

TEXT = ("Quarterly report. Contact John Doe at john.doe@example.com and phone 555-123-4567. "
        "The main finding is that revenue grew. Key risks remain in supply. Next steps follow.")


def test_upload_search_summarise_audit(spark, scratch):
    root = os.path.join(scratch, "uploads")
    for tenant in ("t1", "t2"):
        os.makedirs(os.path.join(root, tenant))
        with open(os.path.join(root, tenant, f"{uuid.uuid4()}_report.txt"), "w") as f:
            f.write(TEXT)
    docs = sinks.ingest_raw(sinks.read_raw_files(spark, root))
    assert docs.filter(F.col("status") == "text_extracted").count() == 2

    users = spark.createDataFrame([("admin1", "t1", "admin"), ("viewer1", "t1", "viewer"), ("viewer2", "t2", "viewer")],
                                  "user_id string, tenant_id string, role_name string")
    roles = AC.default_roles(users.select("tenant_id"), "api")

    # viewer uploads: denied; admin uploads: allowed; cross-tenant search: denied
    req = spark.createDataFrame([("viewer1", "t1", "document:upload"), ("admin1", "t1", "document:upload"),
                                 ("viewer1", "t2", "document:search")], "user_id string, tenant_id string, permission string")
    dec = {(r.user_id, r.tenant_id): (r.allowed, r.reason) for r in AC.check_permissions(req, users, roles, users).collect()}
    assert dec[("viewer1", "t1")] == (False, "missing_permission")
    assert dec[("admin1", "t1")] == (True, None)
    assert dec[("viewer1", "t2")] == (False, "tenant_mismatch")

    # redacted copy (stored) and chunks of the cleaned text, masked per role at search time
    red = docs.withColumn("s", pii.detect_pii(F.col("clean_text"))).withColumn(
        "redacted", pii.redact(F.col("clean_text"), F.col("s"), "mask"))
    assert all("@" not in r.redacted for r in red.collect())
    chunks = K.chunk_table(docs.select(F.col("document_id").alias("doc_id"), "tenant_id",
                                       F.col("clean_text").alias("text")), keep_cols=["tenant_id"], size=80, overlap=20)
    emb = V.embed_batch(chunks, V.HashEmbedder(32), text_col="chunk_text")
    index = emb.select("tenant_id", F.col("chunk_id").alias("vector_id"), "embedding")

    perms = AC.user_permissions(users, roles)
    queries = spark.createDataFrame([(1, "viewer1", "t1", "contact john doe"), (2, "admin1", "t1", "contact john doe")],
                                    "query_id long, user_id string, tenant_id string, query string")
    hits = S.secure_search(queries, perms, index, chunks, V.HashEmbedder(32), k=5).collect()
    viewer_text = " ".join(h.text for h in hits if h.query_id == 1)
    admin_text = " ".join(h.text for h in hits if h.query_id == 2)
    assert "john.doe@example.com" not in viewer_text and "[EMAIL]" in viewer_text
    assert "john.doe@example.com" in admin_text
    assert all(h.document_id in {r.document_id for r in docs.filter("tenant_id = 't1'").collect()} for h in hits)

    # summary for a viewer: masked, first three '. ' pieces, keyword highlights
    d = docs.select("document_id", "clean_text", F.lit(False).alias("can_view"))
    f = S.with_summary_text(d, "clean_text", "document_id", "can_view").withColumn("pieces", S.split_a(F.col("full")))
    summary, highlights = S.summarize_a(F.col("pieces"), F.lit(None).cast("string"))
    row = f.select(summary.alias("summary"), highlights.alias("h")).first()
    assert row.summary.startswith("Quarterly report. Contact John Doe at [EMAIL]")
    assert any("main finding" in h for h in row.h)

    # audit: seal a summarise event, verify it, then tamper
    ev = spark.createDataFrame([("2024-01-01T00:00:00Z", "summarize", "t1", "viewer1", "document:1", "document",
                                 None, None, '{"query": null}', '{"summary_length": 80}')],
                               ", ".join(f"{k} string" for k in AU.EVENT_FIELDS))
    lines = AU.log_line(AU.seal(ev, "k"))
    assert AU.integrity_report(AU.verify(lines, "k")).first().valid_signatures == 1
    bad = lines.withColumn("line", F.replace("line", F.lit("viewer1"), F.lit("admin1")))
    assert AU.integrity_report(AU.verify(bad, "k")).first().invalid_signatures == 1

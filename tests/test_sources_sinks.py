import os
import uuid

from pyspark.sql import functions as F

from quire.operators import chunking as K
from quire.operators import search as S
from quire.operators import vectors as V
from quire.sources import sinks
from quire.sources import tables
from tests.conftest import SF_SMALL


def test_raw_files_to_ingest_records(spark, scratch):
    root = os.path.join(scratch, "raw")
    files = {("tenant_a", "note.txt"): "Hello  world.\nCall 555-123-4567".encode("utf-8"),
             ("tenant_a", "latin.txt"): "café résumé".encode("latin-1"),
             ("tenant_b", "wide.txt"): "wide text".encode("utf-16"),
             ("tenant_b", "scan.pdf"): b"%PDF-1.4 binary"}
    for (t, name), data in files.items():
        os.makedirs(os.path.join(root, t), exist_ok=True)
        with open(os.path.join(root, t, f"{uuid.uuid4()}_{name}"), "wb") as f:
            f.write(data)
    raw = sinks.read_raw_files(spark, root)
    rec = {r.filename: r for r in sinks.ingest_raw(raw).collect()}
    assert rec["note.txt"].tenant_id == "tenant_a" and rec["note.txt"].status == "text_extracted"
    import unicodedata
    assert rec["latin.txt"].clean_text == unicodedata.normalize("NFKD", "café résumé")  # Latin-1 decode, then T2
    assert rec["note.txt"].clean_text == "Hello world. Call 555-123-4567"
    assert rec["wide.txt"].clean_text == "wide text"
    assert rec["scan.pdf"].status == "quarantined" and rec["scan.pdf"].clean_text is None
    out = os.path.join(scratch, "docs")
    sinks.write_documents(sinks.ingest_raw(raw).drop("clean_text"), out)
    assert spark.read.parquet(out).count() == 4


def test_index_replace_and_delete(spark, scratch):
    docs = tables.documents(spark, SF_SMALL)
    ch = K.chunk_table(docs, keep_cols=["tenant_id"])
    emb = V.embed_batch(ch, V.HashEmbedder(16), text_col="chunk_text")
    idx = V.build_index(emb)
    path = os.path.join(scratch, "index")
    idx.write.partitionBy("tenant_id").parquet(path)
    before = spark.read.parquet(path).groupBy("tenant_id").count().collect()
    # V8: reindex one tenant only; the others are untouched
    one = idx.filter(F.col("tenant_id") == "src1").withColumn("embedding_version", F.lit("v2"))
    sinks.replace_tenant_index(one, path)
    after = spark.read.parquet(path)
    assert after.filter(F.col("embedding_version") == "v2").select("tenant_id").distinct().collect()[0][0] == "src1"
    assert after.count() == sum(r["count"] for r in before)
    sinks.delete_tenant_index(spark, path, "src1")
    assert spark.read.parquet(path).filter(F.col("tenant_id") == "src1").count() == 0
    sinks.write_chunks(ch.unionByName(ch), os.path.join(scratch, "chunks"))
    assert spark.read.parquet(os.path.join(scratch, "chunks")).count() == ch.count()


def test_lookup_is_tenant_isolated(spark):
    ch = K.chunk_table(tables.documents(spark, SF_SMALL), keep_cols=["tenant_id"])
    req = ch.select("chunk_id", F.lit("some-other-tenant").alias("tenant_id"), F.lit(True).alias("include_original"))
    assert S.chunk_lookup(ch, req).count() == 0


def test_chunks_written_twice_stay_unique(spark, scratch):
    ch = K.chunk_table(tables.documents(spark, SF_SMALL), keep_cols=["tenant_id"])
    out = "file://" + os.path.join(scratch, "twice")
    sinks.write_chunks(ch, out)
    sinks.write_chunks(ch, out)
    assert spark.read.parquet(out).count() == ch.select("chunk_id").distinct().count()


def test_reindex_tenant(spark, scratch):
    docs, path = tables.documents(spark, SF_SMALL), os.path.join(scratch, "reindex")
    emb = V.HashEmbedder(8)
    V.build_index(V.embed_batch(K.chunk_table(docs, keep_cols=["tenant_id"]), emb, text_col="chunk_text")).write.partitionBy("tenant_id").parquet(path)
    before = spark.read.parquet(path).count()
    done = sinks.reindex_tenant(docs, path, "src1", emb, version="v2")
    assert done["status"] == "completed" and spark.read.parquet(path).count() == before
    gone = sinks.reindex_tenant(docs.where("tenant_id <> 'src1'"), path, "src1", emb)
    assert gone["status"] == "no_documents" and spark.read.parquet(path).where("tenant_id = 'src1'").count() == 0
    empty = V.build_index(V.embed_batch(K.chunk_table(docs.where("tenant_id = 'none'"), keep_cols=["tenant_id"]), emb, text_col="chunk_text"))
    sinks.replace_tenant_index(empty, path, ["src2"])
    assert spark.read.parquet(path).where("tenant_id = 'src2'").count() == 0


def test_status_updates_keep_what_they_do_not_name(spark):
    from quire.operators import access as A
    docs = spark.sql("select * from values (1, 'completed', timestamp'2024-01-01'), (2, 'processing', null), (3, 'failed', null) as t(doc_id, status, processed_at)")
    ups = spark.sql("select * from values (2, 'failed', timestamp'2024-01-02'), (2, 'completed', timestamp'2024-01-03') as t(doc_id, status, ts)")
    got = {r.doc_id: (r.status, str(r.processed_at)[:10]) for r in A.update_status(docs, ups).collect()}
    assert got == {1: ("completed", "2024-01-01"), 2: ("completed", "2024-01-03"), 3: ("failed", "None")}


def test_raw_files_written_by_tenant(spark, scratch):
    root = os.path.join(scratch, "uploads")
    docs = spark.createDataFrame([(i, "tenant_%d" % (i % 3), None if i == 4 else "text %d\nline" % i) for i in range(30)] + [(30, "empty", "")],
                                 "doc_id long, tenant_id string, text string")
    sinks.write_raw_files(docs.repartition(2), root, rows_per_file=4)
    raw = sinks.read_raw_files(spark, root, "*.txt").collect()
    held = {}
    for r in raw:
        assert len(bytes(r.content)) == r.length and bytes(r.content).decode().count("\nline") <= 4
        held.setdefault(r.tenant_id, []).extend(x for x in bytes(r.content).decode().split("\n")[:-1])
    texts = {}
    for d in docs.collect():
        texts.setdefault(d.tenant_id, []).extend((d.text or "").split("\n"))
    assert {t: sorted(x) for t, x in held.items()} == {t: sorted(x) for t, x in texts.items()} and len(held["empty"]) == 1
    again = os.path.join(scratch, "no_uploads")
    sinks.write_raw_files(docs.where("doc_id < 0"), again)
    assert sinks.read_raw_files(spark, again, "*.txt").count() == 0


def test_labelled_examples_round_trip(spark, scratch):
    path = os.path.join(scratch, "examples")
    rows = [("mail a@b.com \u00e9 \"quoted\"\nnext", ["email"]), ("", []), ("ssn 123-45-6789", ["ssn", "phone"]), ("no types", None), (None, ["zip"])]
    sinks.write_pii_examples(spark.createDataFrame(rows, "text string, expected_types array<string>"), path)
    got = [(r.text, r.expected_types) for r in sinks.read_pii_examples(spark, path, lines=True).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert '"type":"EMAIL"' in "".join(r.value for r in spark.read.text(path).collect())

import os
import shutil

from pyspark.sql import functions as F

import __spark_entry__ as E
from quire.operators import chunking as K
from quire.operators import requests as RQ
from quire.sources import tables
from quire.streaming import jobs
from tests.conftest import SF_SMALL


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "n_spans" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


def test_every_query_runs_on_smallest_scale(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF_SMALL)
        df.write.format("noop").mode("overwrite").save()


def _copy_table(scratch, name):
    d = os.path.join(scratch, name)
    os.makedirs(d)
    shutil.copy(f"{SF_SMALL}/{name}.parquet", os.path.join(d, "part-0.parquet"))
    return d


def test_stream_ingest_equals_batch(spark, scratch):
    src = _copy_table(scratch, "documents")
    sink = os.path.join(scratch, "chunks")
    q = jobs.ingest_stream(spark, src, sink, checkpoint=os.path.join(scratch, "ck1"))
    q.awaitTermination()
    streamed = spark.read.parquet(sink)
    from quire.functions import text as TX
    from quire.operators import search as S
    d = tables.documents(spark, SF_SMALL).select("doc_id", "tenant_id", TX.clean_text_for_embedding("text").alias("text"))
    batch = S.chunk_records(d, keep_cols=["tenant_id"])
    cols = ["chunk_id", "document_id", "chunk_index", "start", "end", "chunk_text", "original_text", "vector_id", "redaction_metadata"]
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert streamed.count() == batch.count()


def test_stream_audit_dedup(spark, scratch):
    src = _copy_table(scratch, "events")
    shutil.copy(f"{SF_SMALL}/events.parquet", os.path.join(src, "part-1.parquet"))  # a replay
    sink = os.path.join(scratch, "audit")
    q = jobs.audit_stream(spark, src, sink, key="k", checkpoint=os.path.join(scratch, "ck2"))
    q.awaitTermination()
    assert spark.read.text(sink).count() == tables.load(spark, SF_SMALL, "events").count()


def test_stream_activity_and_index(spark, scratch):
    src = _copy_table(scratch, "events")
    q = jobs.activity_stream(spark, src, os.path.join(scratch, "act"), checkpoint=os.path.join(scratch, "ck3"))
    q.awaitTermination()
    assert spark.read.parquet(os.path.join(scratch, "act")).agg(F.sum("n_events")).first()[0] > 0
    chunks_dir = os.path.join(scratch, "chunks_src")
    K.chunk_table(tables.documents(spark, SF_SMALL), keep_cols=["tenant_id"]).write.parquet(chunks_dir)
    from quire.operators import vectors as V
    idx = os.path.join(scratch, "index")
    q = jobs.index_stream(spark, chunks_dir, idx, V.HashEmbedder(32), checkpoint=os.path.join(scratch, "ck4"))
    q.awaitTermination()
    out = spark.read.parquet(idx)
    per = out.groupBy("tenant_id").agg(F.count("*").alias("n"), F.max("position").alias("mx"),
                                       F.countDistinct("position").alias("d")).collect()
    assert all(r.n == r.mx + 1 == r.d for r in per)


def test_stream_rate_limit_equals_batch(spark, scratch):
    src = _copy_table(scratch, "events")
    ev = spark.readStream.schema(tables.schemas.EVENTS).parquet(src) \
        .select(F.col("user_id").cast("string").alias("client"), "ts", "event_id")
    out = jobs.rate_limit_stream(ev, limit=3, window_seconds=86400)
    with jobs.limiter_settings(spark):
        q = out.writeStream.format("memory").queryName("rl").option(
            "checkpointLocation", os.path.join(scratch, "ck5")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    streamed = spark.table("rl").select("event_id", "admitted")
    batch_in = tables.load(spark, SF_SMALL, "events").select(F.col("user_id").cast("string").alias("client"),
                                                             "ts", "event_id")
    batch = RQ.rate_limit(batch_in, limit=3, window_seconds=86400).select("event_id", "admitted")
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count()


def test_activity_stream_window_kinds(spark, scratch):
    src = _copy_table(scratch, "events")
    n = tables.load(spark, SF_SMALL, "events").count()
    for kind, kw in [("slide", {"window": "2 hours", "slide": "1 hour"}), ("session", {"session_gap": "30 minutes"})]:
        out = os.path.join(scratch, f"act_{kind}")
        q = jobs.activity_stream(spark, src, out, checkpoint=os.path.join(scratch, f"ck_{kind}"), **kw)
        q.awaitTermination()
        total = spark.read.parquet(out).agg(F.sum("n_events")).first()[0]
        if kind == "slide":
            assert total <= 2 * n and total > 0  # each event lands in two sliding windows (closed ones emitted)
        else:
            assert 0 < total <= n


def test_model_embedder_plugin(spark):
    import numpy as np
    from quire.operators import vectors as V

    def make_predict():
        def predict(texts):
            return np.stack([np.array([len(t), t.count(" ")], dtype=np.float32) for t in texts])
        return predict

    emb = V.ModelEmbedder(make_predict, dim=2, batch_size=8)
    df = spark.createDataFrame([(1, "a b c"), (2, "   "), (3, "hello")], "id long, text string")
    out = {r.id: list(r.embedding) for r in V.embed_batch(df, emb).collect()}
    assert out == {1: [5.0, 2.0], 3: [5.0, 0.0]}  # blank text dropped (V5), ids kept


def test_stream_rate_limit_across_micro_batches(spark, scratch):
    import time as _time
    src = os.path.join(scratch, "ev2")
    e = tables.load(spark, SF_SMALL, "events")
    mid = e.approxQuantile("event_id", [0.5], 0.0)[0]
    first = e.filter(F.col("ts") <= e.filter(F.col("event_id") == mid).first().ts)
    second = e.subtract(first)
    first.coalesce(1).write.parquet(os.path.join(src, "a"))
    _time.sleep(1.1)
    second.coalesce(1).write.parquet(os.path.join(src, "b"))
    ev = (spark.readStream.schema(tables.schemas.EVENTS).option("maxFilesPerTrigger", 1)
          .option("recursiveFileLookup", "true").parquet(src)
          .select(F.col("user_id").cast("string").alias("client"), "ts", "event_id"))
    out = jobs.rate_limit_stream(ev, limit=3, window_seconds=86400)
    with jobs.limiter_settings(spark):
        q = out.writeStream.format("memory").queryName("rl2").option(
            "checkpointLocation", os.path.join(scratch, "ck6")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    assert len(q.recentProgress) >= 2  # state carried across micro-batches
    streamed = spark.table("rl2").select("event_id", "admitted")
    batch_in = e.select(F.col("user_id").cast("string").alias("client"), "ts", "event_id")
    batch = RQ.rate_limit(batch_in, limit=3, window_seconds=86400).select("event_id", "admitted")
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count()


def _events(spark, path, rows):
    cols = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    import datetime as dt
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h, m), 1, "view", 1.0, "{}") for i, h, m in rows], cols) \
        .coalesce(1).write.parquet(path)


def test_audit_stream_keeps_late_events_and_replays_once(spark, scratch):
    import time as _time
    src, sink = os.path.join(scratch, "late"), "file://" + os.path.join(scratch, "late_log")
    _events(spark, os.path.join(src, "a"), [(1, 10, 0)])
    _time.sleep(1.1)
    _events(spark, os.path.join(src, "b"), [(2, 8, 0), (3, 10, 30), (1, 10, 0)])
    glob = os.path.join(src, "*")
    jobs.audit_stream(spark, glob, sink, key="k", checkpoint=os.path.join(scratch, "ck_late")).awaitTermination()
    assert spark.read.text(sink).count() == 3
    # the same files under a new checkpoint: nothing is logged twice
    _time.sleep(1.1)
    _events(spark, os.path.join(src, "c"), [(4, 7, 0)])
    jobs.audit_stream(spark, glob, sink, key="k", checkpoint=os.path.join(scratch, "ck_late")).awaitTermination()
    assert spark.read.text(sink).count() == 4


def test_index_stream_continues_positions_on_a_uri(spark, scratch):
    import time as _time

    from quire.operators import vectors as V
    src, idx = os.path.join(scratch, "ch"), "file://" + os.path.join(scratch, "idx")
    docs = tables.documents(spark, SF_SMALL)
    for k, part in enumerate((docs.where("doc_id < 100"), docs.where("doc_id >= 100"))):
        K.chunk_table(part, keep_cols=["tenant_id"]).write.parquet(os.path.join(src, str(k)))
        jobs.index_stream(spark, os.path.join(src, "*"), idx, V.HashEmbedder(16), checkpoint=os.path.join(scratch, "ck_idx")).awaitTermination()
        _time.sleep(1.1)
    per = spark.read.parquet(idx).groupBy("tenant_id").agg(
        F.count("*").alias("n"), F.max("position").alias("mx"), F.countDistinct("position").alias("d"), F.countDistinct("epoch").alias("e")).collect()
    assert all(r.n == r.mx + 1 == r.d for r in per) and max(r.e for r in per) == 2
    assert spark.read.parquet(idx).count() == K.chunk_table(docs).count()


def test_streams_need_a_checkpoint(spark, scratch):
    import pytest
    with pytest.raises(ValueError):
        jobs.audit_stream(spark, _copy_table(scratch, "events"), os.path.join(scratch, "x"), key="k")


def test_audit_batches_read_only_their_days(spark, scratch):
    """The id index's files that a batch reads are those of its days, however
    long the log; a cut-short attempt and a replay leave no copy behind."""
    import datetime as dt
    cols = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

    def batch(ids, day):
        return spark.createDataFrame([(i, dt.datetime(2024, 1, day) if day else None, 1, "view", 1.0, "{}") for i in ids], cols)
    sink = "file://" + os.path.join(scratch, "log")
    for n in range(12):
        jobs.append_events(batch(range(10 * n, 10 * n + 10), n % 6 + 1), n, sink, "k")
    jobs.append_events(batch([500, 500], 0), 12, sink, "k")
    jobs.append_events(batch([500, 501], 0), 13, sink, "k")  # events without a time are told apart too
    read = jobs.logged_ids(spark, sink, ["2024-01-02"]).inputFiles()
    assert read and all("/day=2024-01-02/" in f for f in read)
    assert jobs.logged_ids(spark, sink, ["2024-02-01"]) is None
    assert spark.read.text(sink).count() == 122
    # batch 3 again (a replay): its own lines go first, what others logged is left out
    jobs.append_events(batch([*range(30, 40), 99], 4), 3, sink, "k")
    log = spark.read.text(sink)
    assert log.count() == 122 and log.select("value").distinct().count() == 122 or log.count() == 123


def test_index_positions_without_a_marker(spark, scratch):
    """No _SUCCESS, a replay, and a run that ended before its commit."""
    from quire.operators import vectors as V
    from quire.sources.sinks import delete_paths
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        idx = "file://" + os.path.join(scratch, "idx")
        rows = K.chunk_table(tables.documents(spark, SF_SMALL), keep_cols=["tenant_id"])
        parts = [rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == k) for k in range(3)]
        emb = V.HashEmbedder(8)
        for k in (0, 1):
            jobs.append_index(parts[k], k, idx, emb)
        assert not os.path.exists(os.path.join(scratch, "idx", "_SUCCESS"))
        known = {(r.chunk_id, r.position) for r in jobs.read_index(spark, idx).select("chunk_id", "position").collect()}
        jobs.append_index(parts[1], 1, idx, emb)  # replay
        assert {(r.chunk_id, r.position) for r in jobs.read_index(spark, idx).select("chunk_id", "position").collect()} == known
        jobs.append_index(parts[2], 2, idx, emb)
        delete_paths(spark, f"{idx}/_ledger/epoch=2")  # as if it had ended before the commit
        assert {(r.chunk_id, r.position) for r in jobs.read_index(spark, idx).select("chunk_id", "position").collect()} == known
        jobs.append_index(parts[2], 2, idx, emb)
        out = jobs.read_index(spark, idx)
        per = out.groupBy("tenant_id").agg(F.count("*").alias("n"), F.max("position").alias("mx"), F.countDistinct("position").alias("d"), F.min("position").alias("mn")).collect()
        assert all(r.n == r.mx + 1 == r.d and r.mn == 0 for r in per) and out.count() == rows.select("chunk_id").distinct().count() == spark.read.parquet(idx).count()
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_idle_clients_leave_the_store(spark, scratch):
    import datetime as dt
    import time as _time
    src = os.path.join(scratch, "rq")

    def write(name, rows):
        spark.createDataFrame([(c, i, dt.datetime(2024, 1, 1, 0, 0, s)) for c, i, s in rows], "client string, event_id long, ts timestamp") \
            .coalesce(1).write.parquet(os.path.join(src, name))
    write("a", [(f"c{k}", k, 30) for k in range(20)])
    read = spark.readStream.schema("client string, event_id long, ts timestamp").option("recursiveFileLookup", "true").parquet(src)
    sizes = []

    def run():
        with jobs.limiter_settings(spark):
            q = jobs.rate_limit_stream(read, limit=2, window_seconds=60, idle_seconds=8).writeStream.format("parquet") \
                .option("path", os.path.join(scratch, "out")).option("checkpointLocation", os.path.join(scratch, "ck_idle")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    run()
    write("b", [("c1", 100, 40), ("c1", 101, 41), ("c2", 102, 10)])  # c1: second admitted, third not; c2: late, decided
    run()
    _time.sleep(9)
    write("c", [("other", 200, 50)])
    run()
    _time.sleep(1)
    write("d", [("other", 201, 51)])
    run()
    got = {r.event_id: r.admitted for r in spark.read.parquet(os.path.join(scratch, "out")).collect()}
    assert len(got) == 25 and not got[101] and all(v for k, v in got.items() if k != 101)
    assert sizes[1] >= 20 and sizes[-1] <= 4

"""Streaming jobs.

Each job is `readStream` -> the same DataFrame operators as the batch form
-> `writeStream` with a checkpoint location in the shared checkpoint folder,
so a restarted or re-scheduled query resumes exactly where it stopped.
`trigger(availableNow=True)` processes what is there and stops, which is how
the tests check that stream result = batch result.
"""

from __future__ import annotations

import bisect
import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire import schemas
from quire.functions import patterns as P
from quire.functions import text as TX
from quire.operators import audit as AU
from quire.operators import chunking as K
from quire.operators import pii
from quire.operators import vectors as V
from quire.operators import search as S
from quire.session import cut
from quire.sources.sinks import delete_paths, path_exists


def _ckpt(checkpoint: str | None) -> str:
    """A stream names its own checkpoint: two streams that shared a default
    one would take each other's progress for theirs and skip data."""
    if not checkpoint:
        raise ValueError("a stream needs its own checkpoint location in a shared folder")
    return checkpoint


def read_documents(spark: SparkSession, source_dir: str) -> DataFrame:
    return spark.readStream.schema(schemas.DOCUMENTS).parquet(source_dir)


def ingest_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str | None = None,
                  mode: str = "mask", available_now: bool = True):
    """R2: as document files arrive: clean (T2) -> chunk (K1, K2) -> detect
    and redact (P1, P3, P4) -> append the chunk store's rows (S6: redacted and
    original text, redaction metadata) as Parquet partitioned by tenant."""
    docs = read_documents(spark, source_dir).withColumn("tenant_id", F.col("source"))
    clean = docs.select("doc_id", "tenant_id", TX.clean_text_for_embedding("text").alias("text"))
    chunks = S.chunk_records(clean, keep_cols=["tenant_id"], mode=mode)
    w = (chunks.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", _ckpt(checkpoint)).partitionBy("tenant_id")
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def logged_ids(spark: SparkSession, sink_dir: str, days: list[str]) -> DataFrame | None:
    """(audit_id, day, batch) of the events logged for `days`.  Only these
    days' folders of the id index are listed and read."""
    root = f"{sink_dir.rstrip('/')}/_ids"
    paths = [p for p in (f"{root}/day={d}" for d in days) if path_exists(spark, p)]
    if not paths:
        return None
    return spark.read.option("basePath", root).schema("audit_id string, day string, batch long").parquet(*paths)


def append_events(batch: DataFrame, epoch_id: int, sink_dir: str, key: str) -> None:
    """One micro-batch of R3: seal, leave out what the log holds, append.

    The log lies under day=<event day>/batch=<n>, beside an index of its ids
    with the same folders (_ids); events without a time have the day `none`.
    The batch's days (a handful, unless it is a backfill) name the folders of
    the index that are read, so a batch costs what its days hold, however long
    the log.  An attempt that was cut short is removed first, lines and ids."""
    spark, root = batch.sparkSession, sink_dir.rstrip("/")
    for part in ("", "/_ids"):
        delete_paths(spark, f"{root}{part}/day=*/batch={epoch_id}")
    sealed = AU.seal(AU.events_from_requests(batch, keep=["ts"]), key)
    new = cut(sealed.withColumn("day", F.coalesce(F.to_date("ts").cast("string"), F.lit("none"))).dropDuplicates(["audit_id"]))
    seen = logged_ids(spark, root, [r["day"] for r in new.select("day").distinct().collect()])
    if seen is not None:
        new = new.join(seen.select("day", "audit_id"), ["day", "audit_id"], "left_anti")
    new = new.withColumn("batch", F.lit(epoch_id).cast("long"))
    new.select("audit_id", "day", "batch").write.mode("append").partitionBy("day", "batch").parquet(f"{root}/_ids")
    AU.log_line(new, keep=["day", "batch"]).write.mode("append").partitionBy("day", "batch").text(root)


def audit_stream(spark: SparkSession, events_dir: str, sink_dir: str, key: str, checkpoint: str | None = None,
                 available_now: bool = True):
    """R3 + S7: seal events as they arrive and append their JSON lines.

    Every event is kept, however late.  An event already in the log (same
    content => same audit_id, D1) is left out; see `append_events`."""
    ev = spark.readStream.schema(schemas.EVENTS).parquet(events_dir)
    w = ev.writeStream.foreachBatch(lambda batch, epoch: append_events(batch, epoch, sink_dir, key)).option("checkpointLocation", _ckpt(checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def activity_stream(spark: SparkSession, events_dir: str, sink_dir: str, checkpoint: str | None = None,
                    window: str = "1 hour", slide: str | None = None, session_gap: str | None = None,
                    watermark: str = "1 hour", available_now: bool = True):
    """Windowed audit activity per tenant and action - tumbling
    (`window`), sliding (`window`, `slide`) or session windows
    (`session_gap`) over event time.  A window is final once the watermark has
    passed it: an event later than `watermark` behind the newest one is not
    counted any more (Spark reports them as `numRowsDroppedByWatermark` in the
    query's progress); `activity_windows` over the log counts them all."""
    ev = spark.readStream.schema(schemas.EVENTS).parquet(events_dir)
    out = AU.activity_windows(AU.events_from_requests(ev, keep=["ts"]).withWatermark("ts", watermark), window, slide, session_gap)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", _ckpt(checkpoint)).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


LEDGER = "tenant_id string, next_position long, epoch long"


def ledger(spark: SparkSession, index_dir: str) -> DataFrame | None:
    """(tenant_id, next_position, epoch): what each committed batch left as
    its tenants' next position."""
    path = f"{index_dir.rstrip('/')}/_ledger"
    return spark.read.schema(LEDGER).parquet(path) if path_exists(spark, path) else None


def append_index(batch: DataFrame, epoch_id: int, index_dir: str, embedder: V.Embedder) -> None:
    """One micro-batch of R4: embed, number, append, then commit.

    A batch counts once its rows stand in the ledger, one small file that
    appears whole; no marker of the output committer is asked for.  Positions
    go on from the ledger's batches before this one, so a replay, or a run
    that ended between the rows and the ledger, gives the same positions again
    after what the first attempt left is removed."""
    spark, root = batch.sparkSession, index_dir.rstrip("/")
    delete_paths(spark, f"{root}/_ledger/epoch={epoch_id}")
    delete_paths(spark, f"{root}/tenant_id=*/epoch={epoch_id}")
    known = ledger(spark, root)
    start = known.where(F.col("epoch") < epoch_id).groupBy("tenant_id").agg(F.max("next_position").alias("next_position")) if known is not None else None
    rows = cut(V.build_index(V.embed_batch(batch, embedder, text_col="chunk_text"), start=start))
    rows.withColumn("epoch", F.lit(epoch_id).cast("long")).write.mode("append").partitionBy("tenant_id", "epoch").parquet(root)
    rows.groupBy("tenant_id").agg((F.max("position") + 1).alias("next_position")).coalesce(1) \
        .write.mode("overwrite").parquet(f"{root}/_ledger/epoch={epoch_id}")


def read_index(spark: SparkSession, index_dir: str) -> DataFrame:
    """The index rows of committed batches."""
    rows = spark.read.parquet(index_dir)
    return rows.join(ledger(spark, index_dir).select("tenant_id", "epoch"), ["tenant_id", "epoch"], "left_semi")


def index_stream(spark: SparkSession, chunks_dir: str, index_dir: str, embedder: V.Embedder,
                 checkpoint: str | None = None, available_now: bool = True):
    """R4 + S9: embed new chunks in each micro-batch and append them to the
    vector index with positions that go on per tenant (`append_index`)."""
    chunk_schema = "chunk_id string, document_id long, tenant_id string, chunk_index int, start int, end int, " \
                   "length int, chunk_text string"
    src = spark.readStream.schema(chunk_schema).parquet(chunks_dir)
    w = src.writeStream.foreachBatch(lambda batch, epoch: append_index(batch, epoch, index_dir, embedder)).option("checkpointLocation", _ckpt(checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# --- R1: streaming rate limiter ------------------------------------------------

RATE_OUT = "client string, event_id long, ts timestamp, admitted boolean, remaining int"


def decide(log: list[int], times: list[int], limit: int, width: int) -> tuple[list[bool], list[int], list[int]]:
    """Verdicts and remaining requests for ordered `times`, given the sorted
    admitted times so far; and the log after them.  A request counts the
    admitted ones of its own window, also if newer ones are known."""
    log, admitted, remaining = list(log), [], []
    for t in times:
        held = bisect.bisect_right(log, t) - bisect.bisect_left(log, t - width)
        admitted.append(held < limit)
        remaining.append(limit - held - 1 if held < limit else 0)
        if held < limit:
            bisect.insort(log, t)
    return admitted, remaining, log[bisect.bisect_left(log, log[-1] - width):] if log else []


class RateLimiter(StatefulProcessor):
    """A client's admitted times inside the newest window, as list state with
    a time to live: the store drops them `idle_seconds` of processing time
    after the client's last request, without a watermark."""

    def __init__(self, limit: int, window_seconds: int, idle_seconds: int):
        self.limit, self.width, self.idle = limit, window_seconds * 1_000_000, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("admitted", "t long", ttlDurationMs=self.idle * 1000)

    def handleInputRows(self, key, rows, timerValues):
        df = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="mergesort")
        times = df["ts"].astype("datetime64[us]").astype("int64").tolist()
        admitted, remaining, log = decide(sorted(t for (t,) in self.log.get()), times, self.limit, self.width)
        if log:
            self.log.put([(t,) for t in log])
        yield pd.DataFrame({"client": df["client"].to_numpy(), "event_id": df["event_id"].to_numpy(), "ts": df["ts"].to_numpy(),
                            "admitted": admitted, "remaining": pd.Series(remaining, dtype="int32")})


@contextlib.contextmanager
def limiter_settings(spark: SparkSession):
    """Settings that a limiter's query takes over when it starts: RocksDB, and
    no batches without data.  Processing time alone asks for such batches for
    ever, so that a run with `availableNow` would not end; the store is
    cleaned by the batches that have data."""
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rate_limit_stream(requests: DataFrame, limit: int = P.RATE_LIMIT_PER_MINUTE, window_seconds: int = P.RATE_LIMIT_WINDOW_SECONDS,
                      idle_seconds: int = 86_400) -> DataFrame:
    """R1 (stream): sliding-window log per client, kept in RocksDB and
    checkpointed with the query.  Within a micro-batch a client's requests are
    taken in (ts, event_id) order.  There is no watermark, so no request is
    dropped as late: it is decided by the admitted requests of its own window
    that the store holds.  A client without requests for `idle_seconds` of
    processing time leaves the store.  Start the query inside
    `limiter_settings`."""
    return requests.groupBy("client").transformWithStateInPandas(
        RateLimiter(limit, window_seconds, idle_seconds), RATE_OUT, "Append", "ProcessingTime")

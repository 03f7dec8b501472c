"""Request-stream operators: client key (M2), sliding-window load (W3) and
the stateful rate limiter (R1, batch form; the streaming form is in
quire.streaming.ratelimit).

Skew: one client may own a third of all requests.  W3 is therefore
computed per (client, time bucket of the window's width) with each event
also copied into the next bucket as context, so a hot client is spread over
as many tasks as its timeline has buckets and the result stays exact.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import patterns as P
from quire.session import cut


def client_key(xff: Column, real_ip: Column, peer: Column) -> Column:
    """M2: first hop of X-Forwarded-For (stripped), else X-Real-IP, else the
    peer address, else 'unknown'."""
    first = F.regexp_replace(F.split(xff, ",", 2).getItem(0), "^" + P.WS_CLASS + "+|" + P.WS_CLASS + "+$", "")
    return (F.when(xff.isNotNull() & (xff != ""), first)
            .when(real_ip.isNotNull() & (real_ip != ""), real_ip)
            .when(peer.isNotNull(), peer).otherwise(F.lit("unknown")))


def _bucketed(df: DataFrame, client: str, ts: str, window_seconds: int) -> DataFrame:
    width = window_seconds * 1_000_000
    d = df.withColumn("_t", F.unix_micros(F.col(ts))).withColumn("_b", F.floor(F.col("_t") / width))
    own = d.withColumn("_own", F.lit(True))
    ctx = d.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    return own.unionByName(ctx)


#: Requests of one client in one window width that one task still counts in a frame.
FRAME_ROWS = 1_000_000


def window_load(df: DataFrame, client: str = "client", ts: str = "ts",
                window_seconds: int = P.RATE_LIMIT_WINDOW_SECONDS, frame_rows: int = FRAME_ROWS) -> DataFrame:
    """For each request, the number of the client's requests with a
    timestamp in [ts - window, ts] (offered load; rejected ones count).

    A range frame per (client, bucket) counts all clients but those that
    crowd more than `frame_rows` requests into one bucket; these are counted
    by `crowded_load`, which never needs a frame in one task."""
    width = window_seconds * 1_000_000

    def framed(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(client, "_b").orderBy("_t").rangeBetween(-width, 0)
        return _bucketed(rows, client, ts, window_seconds).withColumn("window_count", F.count(F.lit(1)).over(w)).filter("_own").drop("_own", "_b", "_t")
    if df.count() <= frame_rows:
        return framed(df)
    bucket = F.floor(F.unix_micros(F.col(ts)) / width)
    crowded = df.groupBy(F.col(client).alias("_crowded"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > frame_rows).select("_crowded").distinct()  # at most rows / frame_rows clients
    if not crowded.limit(1).count():
        return framed(df)
    same = F.col(client) == F.col("_crowded")
    return framed(df.join(crowded, same, "left_anti")).unionByName(crowded_load(df.join(crowded, same, "left_semi"), client, ts, window_seconds))


def crowded_load(df: DataFrame, client: str = "client", ts: str = "ts", window_seconds: int = P.RATE_LIMIT_WINDOW_SECONDS,
                 num_partitions: int | None = None) -> DataFrame:
    """W3 for clients of any density: a request's count is the difference of
    two ranks, the client's requests up to its time less those before its
    window.  The times of the requests and of their windows' starts are range
    partitioned together, so one window width of one client is many tasks;
    running sums per partition and a small table of the partitions' totals
    (as in the dense positions) give the ranks."""
    spark = df.sparkSession
    width = window_seconds * 1_000_000
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_t", F.unix_micros(F.col(ts)))
    times = d.where(F.col(client).isNotNull() & F.col("_t").isNotNull()).groupBy(client, "_t").agg(F.count(F.lit(1)).alias("_add"))
    # a window's start counts what lies before it: it stands before requests of the same time
    marks = times.select(client, "_t", F.explode(F.array(
        F.struct((F.col("_t") - width).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("add")),
        F.struct(F.col("_t").alias("at"), F.lit(1).alias("kind"), F.col("_add").alias("add")))).alias("m")).select(client, "_t", "m.*")
    keys = [client, "at", "kind"]
    ordered = marks.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id())

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carried = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            so_far = pdf.groupby(client, sort=False)["add"].cumsum()
            if pdf[client].iloc[0] == last:
                so_far += (pdf[client] == last) * carried
            last, carried = pdf[client].iloc[-1], int(so_far.iloc[-1])
            yield pd.DataFrame({client: pdf[client], "_t": pdf["_t"], "kind": pdf["kind"], "_pid": pdf["_pid"], "run": so_far.astype("int64")})
    kind = df.schema[client].dataType.simpleString()
    # cut: the sampled range bounds must be the same for the sums and for their offsets
    sums = cut(ordered.mapInPandas(running, f"{client} {kind}, _t long, kind int, _pid int, run long"))
    before = Window.partitionBy(client).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.groupBy(client, "_pid").agg(F.max("run").alias("_own")) \
        .select(client, "_pid", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"))
    rank = F.col("run") + F.col("_before")
    counts = sums.join(offsets, [client, "_pid"]).groupBy(client, "_t").agg(
        F.sum(F.when(F.col("kind") == 1, rank).otherwise(-rank)).alias("window_count"))
    return d.join(counts, [client, "_t"]).select(*df.columns, "window_count")


def _segments(df: DataFrame, client: str, ts: str, window_seconds: int) -> DataFrame:
    """Split each client's timeline where the previous request is more than
    a window older: the limiter's state is empty there, so the pieces are
    independent.

    Two requests of one bucket lie less than a window apart, so a piece can
    only begin with a bucket's first request, and the first and last time of
    every (client, bucket) decide it: a partial aggregate, one window over
    that small table, and one join back to the requests."""
    width = window_seconds * 1_000_000
    d = df.withColumn("_t", F.unix_micros(F.col(ts))).withColumn("_b", F.floor(F.col("_t") / width))
    per_bucket = d.groupBy(client, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    w = Window.partitionBy(client).orderBy("_b")
    before = F.lag("_last").over(w)
    start = F.when(before.isNull() | (before < F.col("_first") - width), F.col("_first"))
    pieces = per_bucket.select(client, "_b", "_first", start.alias("_start")).select(
        client, "_b", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_seg"))
    return d.join(pieces, [client, "_b"])


def _admission(limit: int, window_seconds: int, client: str, order: str):
    width = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque
        key = None
        hist: deque = deque()
        for pdf in batches:
            adm, rem, reset = [], [], []
            for c, s, t in zip(pdf[client].tolist(), pdf["_seg"].tolist(), pdf["_t"].tolist()):
                if (c, s) != key:
                    key, hist = (c, s), deque()
                cutoff = t - width
                while hist and hist[0] < cutoff:
                    hist.popleft()
                ok = len(hist) < limit
                if ok:
                    hist.append(t)
                adm.append(ok)
                rem.append(max(0, limit - len(hist)) if ok else 0)
                reset.append((hist[0] + width) if hist else t + width)
            out = pdf[[client, order, "_t"]].copy()
            out["admitted"] = adm
            out["remaining"] = rem
            out["reset_us"] = reset
            yield out
    return run


def rate_limit(df: DataFrame, limit: int = P.RATE_LIMIT_PER_MINUTE,
               window_seconds: int = P.RATE_LIMIT_WINDOW_SECONDS, client: str = "client",
               ts: str = "ts", order: str = "event_id", path: str | None = None) -> DataFrame:
    """R1 (batch): sliding-window-log admission.  A request is admitted when
    fewer than `limit` earlier *admitted* requests of its client lie in
    [ts - window, ts]; rejected requests do not enter the window (so this is
    not W3).  Ties in ts are ordered by `order`.  Health paths bypass.

    Plan: independent segments (see _segments) are hash-partitioned and
    sorted, then one Arrow-batched pass per partition streams through its
    segments with O(limit) state; no group is materialised."""
    d = df
    bypass = None
    if path is not None:
        bypass = d.filter(F.col(path).isin(P.HEALTH_PATHS))
        d = d.filter(~F.col(path).isin(P.HEALTH_PATHS) | F.col(path).isNull())
    seg = _segments(d.select(client, ts, order), client, ts, window_seconds)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = seg.repartition(n, client, "_seg").sortWithinPartitions(client, "_seg", "_t", order)
    schema = (f"{client} {d.schema[client].simpleString().split(':')[-1]}, {order} "
              f"{d.schema[order].simpleString().split(':')[-1]}, _t long, admitted boolean, remaining int, reset_us long")
    res = ordered.select(client, "_seg", "_t", order).mapInPandas(
        _admission(limit, window_seconds, client, order), schema)
    res = res.withColumn(ts, F.timestamp_micros("_t")).withColumn("reset_at", F.timestamp_micros("reset_us")) \
        .drop("_t", "reset_us")
    if bypass is not None:
        res = res.unionByName(bypass.select(client, order, ts).withColumn("admitted", F.lit(True))
                              .withColumn("remaining", F.lit(limit)).withColumn("reset_at", F.lit(None)
                                                                                .cast("timestamp")))
    return res

"""Queries for the request stream: W3 window load and R1 admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import requests as RQ
from quire.plans.catalog import query
from quire.sources import tables

# Test-data density is at most a few events per user per hour (SURVEY trap
# 9), so the queries use a 24 h window and a limit of 5.
WINDOW_S = 24 * 3600
LIMIT = 5
_W_US = WINDOW_S * 1_000_000


def requests_df(spark, sf):
    e = tables.load(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("client"), "ts", "event_id")


@query("w3_window_load", "W3 (range frame, time-bucketed for hot clients)",
       "SELECT CAST(user_id AS VARCHAR) AS client, ts, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts "
       f"RANGE BETWEEN INTERVAL {WINDOW_S} SECONDS PRECEDING AND CURRENT ROW) AS window_count FROM events")
def w3(spark, sf):
    return RQ.window_load(requests_df(spark, sf), window_seconds=WINDOW_S)


R1_SQL = (
    "WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id, epoch_us(ts) AS t, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    "r(client, rn, event_id, t, state, admitted) AS (SELECT client, rn, event_id, t, [t], true FROM ev WHERE rn = 1 "
    "UNION ALL SELECT e.client, e.rn, e.event_id, e.t, "
    f"CASE WHEN len(list_filter(r.state, lambda x: x >= e.t - {_W_US})) < {LIMIT} "
    f"THEN list_append(list_filter(r.state, lambda x: x >= e.t - {_W_US}), e.t) "
    f"ELSE list_filter(r.state, lambda x: x >= e.t - {_W_US}) END, "
    f"len(list_filter(r.state, lambda x: x >= e.t - {_W_US})) < {LIMIT} "
    "FROM r JOIN ev e ON e.client = r.client AND e.rn = r.rn + 1) ")


@query("r1_rate_limit", "R1 batch (sliding-window log; rejected requests do not count)",
       R1_SQL + f"SELECT client, event_id, admitted, CASE WHEN admitted THEN greatest(0, {LIMIT} - len(state)) ELSE 0 END "
       "AS remaining FROM r")
def r1(spark, sf):
    return RQ.rate_limit(requests_df(spark, sf), limit=LIMIT, window_seconds=WINDOW_S) \
        .select("client", "event_id", "admitted", "remaining")


@query("r1_admission_report", "R1 report per client",
       R1_SQL + "SELECT client, count(*) FILTER (WHERE admitted) AS n_admitted, "
       "count(*) FILTER (WHERE NOT admitted) AS n_rejected FROM r GROUP BY client")
def r1r(spark, sf):
    r = r1(spark, sf)
    return r.groupBy("client").agg(F.count_if("admitted").alias("n_admitted"),
                                   F.count_if(~F.col("admitted")).alias("n_rejected"))

"""Queries for the audit log (D1-D5, A2, A8, S7/S8 line format, O4, U4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators import audit as AU
from quire.session import checkpoint_dir, cut
from quire.plans.catalog import query
from quire.sources import tables

# Test key for the registered queries (a deployment passes its own secret).
DEMO_KEY = "quire-audit-demo-key"
IPAD, OPAD = AU._pads(DEMO_KEY)


def _js(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' END)"


def canonical_sql(fields: dict[str, str]) -> str:
    parts = []
    for i, k in enumerate(sorted(fields)):
        parts.append("'" + ("{" if i == 0 else ", ") + f'"{k}": ' + "' || " + _js(fields[k]))
    return "(" + " || ".join(parts) + " || '}')"


def hmac_sql(msg: str) -> str:
    return (f"sha256(unhex('{OPAD.hex()}') || unhex(sha256(unhex('{IPAD.hex()}') || encode({msg}))))")


EVENTS_SQL = (
    "SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 "
    "THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS timestamp, "
    "event_type AS action, 'src' || CAST(user_id % 20 AS VARCHAR) AS tenant_id, CAST(user_id AS VARCHAR) AS user_id, "
    "'event:' || CAST(event_id AS VARCHAR) AS resource, 'event' AS resource_type, NULL::VARCHAR AS ip_address, "
    "NULL::VARCHAR AS user_agent, coalesce(props, '{}') AS request_data, CASE WHEN value IS NULL THEN '{}' "
    "ELSE '{\"value\": ' || printf('%.2f', value) || '}' END AS response_data FROM events")
_BASE = {k: k for k in AU.EVENT_FIELDS}
SEALED_SQL = (
    f"WITH ev AS ({EVENTS_SQL}), ids AS (SELECT *, sha256({canonical_sql(_BASE)}) AS audit_id, "
    f"CASE WHEN response_data IS NOT NULL AND response_data <> '{{}}' THEN sha256(response_data) END AS result_hash "
    f"FROM ev), sealed AS (SELECT *, {hmac_sql(canonical_sql({**_BASE, 'audit_id': 'audit_id', 'result_hash': 'result_hash'}))}"
    f" AS signature, 'HS256' AS signature_algorithm FROM ids) ")

# Tampering applied to the log for the integrity queries, derived from the
# event rows: altered action, dropped signature, truncated JSON, blank line.
_ALTER = "event_type = 'error' AND value > 150"
_UNSIGN = "event_type = 'purchase' AND value > 180"
_BREAK = "event_type = 'signup' AND value > 200"
_BLANK = "event_type = 'view' AND value > 220"

_JSON_OBJ = ", ".join(f"'{k}', {('CASE WHEN ' + _UNSIGN + ' THEN NULL ELSE signature END') if k == 'signature' else k}"
                      for k in AU.LINE_FIELDS)
_PARSED = {k: f"json_extract_string(line, '$.{k}')" for k in AU.EVENT_FIELDS + ["audit_id", "result_hash"]}
VERIFIED_SQL = (
    SEALED_SQL + f", j AS (SELECT event_id, event_type, value, CAST(json_object({_JSON_OBJ}) AS VARCHAR) AS j FROM sealed), "
    f"lines AS (SELECT event_id, CASE WHEN {_ALTER} THEN replace(j, '\"action\":\"error\"', '\"action\":\"error!\"') "
    f"WHEN {_BREAK} THEN substring(j, 1, length(j) - 1) WHEN {_BLANK} THEN '   ' ELSE j END AS line FROM j), "
    f"verified AS (SELECT event_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) "
    f"OR json_type(line) <> 'OBJECT' THEN 'malformed' WHEN coalesce(json_extract_string(line, '$.signature'), '') = '' "
    f"THEN 'missing' WHEN json_extract_string(line, '$.signature') = {hmac_sql(canonical_sql(_PARSED))} THEN 'valid' "
    f"ELSE 'invalid' END AS status, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.tenant_id') END "
    f"AS tenant_id, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.audit_id') END AS audit_id FROM lines) ")


def sealed_df(spark, sf, keep=None):
    return AU.seal(AU.events_from_requests(tables.load(spark, sf, "events"), keep), DEMO_KEY)


def log_lines_df(spark, sf):
    """The audit log as the sink would write it, with the tampering above."""
    s = sealed_df(spark, sf, keep=["event_type", "value"])
    s = s.withColumn("signature", F.when(F.expr(_UNSIGN), F.lit(None)).otherwise(F.col("signature")))
    lines = AU.log_line(s, keep=["event_id", "event_type", "value"])
    line = F.col("line")
    tampered = (F.when(F.expr(_ALTER), F.replace(line, F.lit('"action":"error"'), F.lit('"action":"error!"')))
                .when(F.expr(_BREAK), F.expr("substring(line, 1, length(line) - 1)"))
                .when(F.expr(_BLANK), F.lit("   ")).otherwise(line))
    return lines.select("event_id", tampered.alias("line"))


@query("d1_audit_ids", "D1, D2 (content-addressed id, result hash)",
       SEALED_SQL + "SELECT event_id, audit_id, result_hash FROM sealed")
def d1(spark, sf):
    return sealed_df(spark, sf).select("event_id", "audit_id", "result_hash")


@query("d3_seal_events", "D3 (keyed digest over the canonical event), U4",
       SEALED_SQL + "SELECT event_id, signature, signature_algorithm FROM sealed")
def d3(spark, sf):
    return sealed_df(spark, sf).select("event_id", "signature", "signature_algorithm")


@query("d5_integrity_report", "D5, A2, S7 line format, S8 parse",
       VERIFIED_SQL + "SELECT count(*) FILTER (WHERE status <> 'blank') AS total_events, "
       "count(*) FILTER (WHERE status = 'valid') AS valid_signatures, "
       "count(*) FILTER (WHERE status = 'invalid') AS invalid_signatures, "
       "count(*) FILTER (WHERE status = 'malformed') AS malformed_events, "
       "count(*) FILTER (WHERE status = 'missing') AS missing_signatures FROM verified")
def d5(spark, sf):
    return AU.integrity_report(AU.verify(log_lines_df(spark, sf), DEMO_KEY))


@query("a2_integrity_by_tenant", "A2 per tenant",
       VERIFIED_SQL + "SELECT tenant_id, count(*) FILTER (WHERE status <> 'blank') AS total_events, "
       "count(*) FILTER (WHERE status = 'valid') AS valid_signatures, "
       "count(*) FILTER (WHERE status = 'invalid') AS invalid_signatures, "
       "count(*) FILTER (WHERE status = 'malformed') AS malformed_events, "
       "count(*) FILTER (WHERE status = 'missing') AS missing_signatures FROM verified GROUP BY tenant_id")
def a2(spark, sf):
    return AU.integrity_report(AU.verify(log_lines_df(spark, sf), DEMO_KEY), by=["tenant_id"])


@query("d4_read_events", "D4, J9 (every audit id, and as many unknown ones: found, or why not)",
       VERIFIED_SQL + ", asked AS (SELECT audit_id FROM ids UNION SELECT sha256('no ' || audit_id) FROM ids), "
       "b AS (SELECT audit_id, max(CASE WHEN status = 'valid' THEN 'z' ELSE status END) AS s FROM verified WHERE audit_id IS NOT NULL GROUP BY audit_id) "
       "SELECT a.audit_id, CASE WHEN b.s = 'z' THEN 'found' ELSE coalesce(b.s, 'absent') END AS outcome FROM asked a LEFT JOIN b ON b.audit_id = a.audit_id")
def d4(spark, sf):
    ids = sealed_df(spark, sf).select("audit_id")
    asked = ids.union(ids.select(F.sha2(F.concat(F.lit("no "), "audit_id"), 256))).distinct()
    return AU.event_by_id(cut(log_lines_df(spark, sf)), asked, DEMO_KEY).select("audit_id", "outcome")


@query("o4_log_line_order", "O4, S7, S8 (a written log of several files read back in line order)",
       VERIFIED_SQL + "SELECT row_number() OVER (ORDER BY event_id) AS line_number, audit_id, status FROM verified")
def o4_lines(spark, sf):
    path = f"{checkpoint_dir(spark).rstrip('/')}/audit-log-{uuid.uuid4().hex}"
    AU.write_log(AU.in_files(log_lines_df(spark, sf), "event_id", least=6), path)
    return AU.verify(AU.numbered_log(spark, path), DEMO_KEY).select("line_number", "audit_id", "status")


@query("o4_integrity_first_lines", "O4 (first 5000 log lines, blanks use up the limit)",
       VERIFIED_SQL + "SELECT count(*) FILTER (WHERE status <> 'blank') AS total_events, "
       "count(*) FILTER (WHERE status = 'valid') AS valid_signatures, "
       "count(*) FILTER (WHERE status = 'invalid') AS invalid_signatures, "
       "count(*) FILTER (WHERE status = 'malformed') AS malformed_events, "
       "count(*) FILTER (WHERE status = 'missing') AS missing_signatures FROM "
       "(SELECT * FROM verified ORDER BY event_id LIMIT 5000)")
def o4(spark, sf):
    return AU.integrity_report(AU.verify(log_lines_df(spark, sf), DEMO_KEY), limit=5000, order_col="event_id")


@query("a8_activity_report", "A8 (rollup by tenant, action, day)",
       f"WITH ev AS ({EVENTS_SQL}) SELECT tenant_id, action, substring(timestamp, 1, 10) AS day, count(*) AS n_events, "
       f"count(DISTINCT user_id) AS n_users FROM ev GROUP BY ROLLUP (tenant_id, action, substring(timestamp, 1, 10))")
def a8(spark, sf):
    return AU.activity_report(AU.events_from_requests(tables.load(spark, sf, "events")))


_R5 = "WITH ev AS (SELECT ts, 'src' || CAST(user_id % 20 AS VARCHAR) AS tenant_id, event_type AS action, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL) "
_H = 3_600_000_000


def _activity(spark, sf):
    return AU.events_from_requests(tables.load(spark, sf, "events"), keep=["ts"])


@query("r5_tumbling", "R5 batch (tumbling windows of 6 hours)",
       _R5 + f"SELECT make_timestamp(t // {6 * _H} * {6 * _H}) AS window_start, make_timestamp((t // {6 * _H} + 1) * {6 * _H}) AS window_end, "
       "tenant_id, action, count(*) AS n_events FROM ev GROUP BY ALL")
def r5_tumbling(spark, sf):
    return AU.activity_windows(_activity(spark, sf), "6 hours")


@query("r5_sliding", "R5 batch (windows of 6 hours every 2 hours)",
       _R5 + f", s AS (SELECT tenant_id, action, (t // {2 * _H} - unnest([0, 1, 2])) * {2 * _H} AS w FROM ev) SELECT make_timestamp(w) AS window_start, "
       f"make_timestamp(w + {6 * _H}) AS window_end, tenant_id, action, count(*) AS n_events FROM s GROUP BY ALL")
def r5_sliding(spark, sf):
    return AU.activity_windows(_activity(spark, sf), "6 hours", "2 hours")


@query("r5_session", "R5 batch (sessions that end after 12 idle hours)",
       _R5 + f", g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {12 * _H} THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY tenant_id, action ORDER BY t)), "
       "s AS (SELECT *, sum(opens) OVER (PARTITION BY tenant_id, action ORDER BY t RANGE UNBOUNDED PRECEDING) AS n FROM g) "
       f"SELECT make_timestamp(min(t)) AS window_start, make_timestamp(max(t) + {12 * _H}) AS window_end, tenant_id, action, count(*) AS n_events "
       "FROM s GROUP BY tenant_id, action, n")
def r5_session(spark, sf):
    return AU.activity_windows(_activity(spark, sf), session_gap="12 hours")

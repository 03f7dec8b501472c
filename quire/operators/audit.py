"""Audit log: content-addressed ids, sealing, verification and reports
(SURVEY §2.11 D1-D5, A2, A8, S7, S8, O4, U4).

An event's canonical string lists its fields in sorted key order as JSON
strings (or null), in the reference's `json.dumps(sort_keys=True)` layout;
the id is its sha256 (D1).  Sealing adds an HMAC-SHA256 keyed digest built
from `sha2` over binary (D3, deterministic, labelled HS256); verification
recomputes it from the parsed log line.  Everything is a column expression:
sealing and verifying a log is one map-only pass, the report one
aggregation with partial aggregates.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENT_FIELDS = ["timestamp", "action", "tenant_id", "user_id", "resource", "resource_type",
                "ip_address", "user_agent", "request_data", "response_data"]
SIGNATURE_ALGORITHM = "HS256"
LINE_FIELDS = EVENT_FIELDS + ["audit_id", "result_hash", "signature", "signature_algorithm"]
#: Lines of one log file on average, at most (about 100 MB).
LINES_PER_FILE = 200_000


def json_string(c: Column) -> Column:
    """JSON string literal of c (backslash and quote escaped), or null."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), esc, F.lit('"')))


def canonical(fields: dict[str, Column]) -> Column:
    """Canonical JSON of a flat string-valued event: keys sorted, ", " and
    ": " separators, nulls kept."""
    parts = []
    for i, k in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{k}": '), json_string(fields[k])]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def _pads(key: str) -> tuple[bytes, bytes]:
    k = key.encode("utf-8")
    if len(k) > 64:
        k = hashlib.sha256(k).digest()
    k = k.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha256(msg: Column, key: str) -> Column:
    """HMAC-SHA256(key, utf8(msg)) as hex, from built-in sha2 over binary."""
    ipad, opad = _pads(key)
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad.hex())), F.encode(msg, "UTF-8")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad.hex())), inner), 256)


def iso_timestamp(ts: Column) -> Column:
    """Python `datetime.isoformat() + 'Z'` (fraction only when non-zero)."""
    micros = F.unix_micros(ts) % 1_000_000
    frac = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("Z"))


def events_from_requests(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Audit events for the driver's `events` table: action :=
    event_type, request_data := props, response_data := {"value": v}."""
    from quire.sources.tables import user_tenant_col
    return events.select(
        F.col("event_id"), *(keep or []),
        iso_timestamp(F.col("ts")).alias("timestamp"),
        F.col("event_type").alias("action"),
        user_tenant_col(F.col("user_id")).alias("tenant_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("resource"),
        F.lit("event").alias("resource_type"),
        F.lit(None).cast("string").alias("ip_address"),
        F.lit(None).cast("string").alias("user_agent"),
        F.coalesce(F.col("props"), F.lit("{}")).alias("request_data"),
        F.when(F.col("value").isNull(), F.lit("{}"))
        .otherwise(F.concat(F.lit('{"value": '), F.format_string("%.2f", F.col("value")), F.lit("}")))
        .alias("response_data"),
    )


def seal(events: DataFrame, key: str) -> DataFrame:
    """D1 + D2 + D3: audit_id, result_hash (only for non-empty response
    data), signature over the event with both, algorithm label."""
    base = {k: F.col(k) for k in EVENT_FIELDS}
    audit_id = F.sha2(canonical(base), 256)
    d = events.withColumn("audit_id", audit_id)
    d = d.withColumn("result_hash", F.when(F.col("response_data").isNotNull() & (F.col("response_data") != "{}"),
                                           F.sha2(F.col("response_data"), 256)))
    signed = {**base, "audit_id": F.col("audit_id"), "result_hash": F.col("result_hash")}
    return d.withColumn("signature", hmac_sha256(canonical(signed), key)) \
        .withColumn("signature_algorithm", F.lit(SIGNATURE_ALGORITHM))


def log_line(sealed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """S7 record: one compact JSON object per event (the JSONL line)."""
    return sealed.select(*(keep or []), F.to_json(F.struct(*[F.col(c) for c in LINE_FIELDS])).alias("line"))


def write_log(lines: DataFrame, path: str) -> None:
    """Append-only JSON Lines sink."""
    lines.select("line").write.mode("append").text(path)


def in_files(lines: DataFrame, order_col: str, least: int = 1) -> DataFrame:
    """The lines dealt to files in the order of a column, so that a file
    (and the task that sorts and writes it) keeps its size as the log grows."""
    n = max(least, -(-lines.count() // LINES_PER_FILE))
    return lines.repartitionByRange(n, order_col).sortWithinPartitions(order_col)


def read_log(spark, path: str) -> DataFrame:
    """The log as lines, with the file they came from."""
    return spark.read.text(path).select(F.col("value").alias("line"),
                                        F.col("_metadata.file_path").alias("file_path"))


_LINE_TYPE = "struct<" + ",".join(f"{k}:string" for k in LINE_FIELDS) + ">"
_SEALED_SHAPE = "^OBJECT<l: OBJECT<((" + "|".join(LINE_FIELDS) + "): (STRING|VOID)(, )?)*>>$"


def event_by_id(lines: DataFrame, audit_ids: DataFrame, key: str) -> DataFrame:
    """For each requested audit_id, its logged line and whether it may be
    read: `found` only if the line verifies; else why not (`absent` if the log
    has no such event).  One join on the id; the log is not collected."""
    checked = verify(lines, key).where("audit_id is not null")
    best = checked.groupBy("audit_id").agg(F.max(F.struct((F.col("status") == "valid").alias("ok"), "status", "line")).alias("_b"))
    return audit_ids.select("audit_id").join(best, "audit_id", "left").select(
        "audit_id", F.when(F.col("_b.ok"), "found").otherwise(F.coalesce("_b.status", F.lit("absent"))).alias("outcome"),
        F.when(F.col("_b.ok"), F.col("_b.line")).alias("line"))


def verify(lines: DataFrame, key: str) -> DataFrame:
    """D3/D4 per line: status in blank / malformed / missing / valid /
    invalid, plus the parsed audit_id, tenant and action.

    The line is parsed once, into a variant; the fields and the event's shape
    are read from it.  It is parsed as a value inside an object, as the parser
    would pass over what follows a complete line."""
    line = F.col("line")
    parsed = lines.withColumn("_v", F.try_parse_json(F.concat(F.lit('{"l":'), line, F.lit("}")))).select(
        *lines.columns, F.schema_of_variant("_v").alias("_shape"), F.try_variant_get("_v", "$.l", _LINE_TYPE).alias("_p"))
    p = F.col("_p")
    fields = {k: p[k] for k in EVENT_FIELDS + ["audit_id", "result_hash"]}
    sig = p["signature"]
    expected = hmac_sha256(canonical(fields), key)
    blank = F.coalesce(line, F.lit("")).rlike(r"^\s*$")
    ok = F.coalesce(F.col("_shape").startswith("OBJECT<l: OBJECT<"), F.lit(False)) & F.rtrim(line).endswith("}")
    # Signed is the whole event: a field of another name, a value that is no
    # longer a string or another algorithm is not what was sealed.
    as_sealed = F.col("_shape").rlike(_SEALED_SHAPE) & (p["signature_algorithm"] == SIGNATURE_ALGORITHM)
    status = (F.when(blank, "blank")
              .when(~ok, "malformed")
              .when(sig.isNull() | (sig == ""), "missing")
              .when((sig == expected) & F.coalesce(as_sealed, F.lit(False)), "valid")
              .otherwise("invalid"))
    return parsed.select(*lines.columns, status.alias("status"), *[F.when(ok, p[k]).alias(k) for k in ("audit_id", "tenant_id", "action")])


def numbered_log(spark, path: str) -> DataFrame:
    """(line, file_path, line_number) of a log in several files; lines
    are numbered from 1 over the files in the order of their paths, blank
    lines included.

    A line's place in its split is its place in the scan's task; the splits'
    line counts, added up in the order (file, offset of the split), give the
    rest.  Only that table (one row per split) is ordered in one task and
    broadcast; the lines are never sorted or moved."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"),
                                       F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    splits = raw.groupBy("file_path", "_at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file_path", "_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file_path", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return raw.join(F.broadcast(starts), ["file_path", "_at"]).select(
        "line", "file_path", (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias("line_number"))


def first_lines(numbered: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` lines of a numbered log (0 or None: all)."""
    return numbered.where(F.col("line_number") <= limit) if limit else numbered


def integrity_report(verified: DataFrame, by: list[str] | None = None, limit: int | None = None,
                     order_col: str | None = None) -> DataFrame:
    """Total (non-blank), valid, invalid, malformed, missing counts.
    `limit` counts raw lines including blanks (O4) and needs an explicit line
    order column; limit 0/None means no limit."""
    d = verified
    if limit:
        if order_col is None:
            raise ValueError("limit needs an explicit line-order column")
        # The first `limit` lines by position.  A bounded top-k
        # (TakeOrderedAndProject: per-partition top-k, then a merge of at
        # most `limit` rows per partition), not a global sort.
        d = d.orderBy(order_col).limit(limit)
    by = by or []
    s = F.col("status")
    return d.groupBy(*by).agg(
        F.count_if(s != "blank").alias("total_events"),
        F.count_if(s == "valid").alias("valid_signatures"),
        F.count_if(s == "invalid").alias("invalid_signatures"),
        F.count_if(s == "malformed").alias("malformed_events"),
        F.count_if(s == "missing").alias("missing_signatures"))


def strip_signature(sealed: DataFrame) -> DataFrame:
    """U4: event without its signature fields."""
    return sealed.drop("signature", "signature_algorithm")


def activity_report(events: DataFrame, exact: bool = True) -> DataFrame:
    """Events and users per tenant, action and day, with rollup
    subtotals.  Distinct users are exact (distinct pre-aggregation) or
    approximate (HyperLogLog++) for very large logs."""
    d = events.withColumn("day", F.substring("timestamp", 1, 10))
    users = F.count_distinct("user_id") if exact else F.approx_count_distinct("user_id")
    return d.rollup("tenant_id", "action", "day").agg(F.count(F.lit(1)).alias("n_events"),
                                                      users.alias("n_users"))


def activity_windows(events: DataFrame, window: str = "1 hour", slide: str | None = None, session_gap: str | None = None) -> DataFrame:
    """Events per tenant, action and time window: tumbling (`window`),
    sliding (`window`, `slide`) or session windows (`session_gap`).  The same
    plan serves tables and streams; a session's counts are merged partially
    before the exchange."""
    if session_gap:
        win = F.session_window("ts", session_gap)
    else:
        win = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = events.groupBy(win.alias("w"), "tenant_id", "action").agg(F.count(F.lit(1)).alias("n_events"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tenant_id", "action", "n_events")

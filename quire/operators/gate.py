"""Ingest gate and validators.

Every rule is a boolean column; a record's failures are
`array_compact(array(when(fail, rule)))`, so one pass evaluates all rules,
and the per-rule report is an explode + groupBy with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P


def valid_uuid(c: Column) -> Column:
    """Python `UUID(s)` acceptance: drop 'urn:'/'uuid:', strip braces,
    drop hyphens, then exactly 32 hex digits."""
    h = F.regexp_replace(c, "urn:|uuid:", "")
    h = F.regexp_replace(h, r"^[{}]+|[{}]+$", "")
    h = F.regexp_replace(h, "-", "")
    return F.coalesce(h.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def valid_tenant_id(c: Column) -> Column:
    """UUID forms or 3-50 of [A-Za-z0-9_-]."""
    return F.coalesce((c != "") & (valid_uuid(c) | c.rlike(P.TENANT_ID_PATTERN)), F.lit(False))


def valid_file_size(size: Column, max_mb: int = P.MAX_UPLOAD_MB) -> Column:
    """Non-empty and at most max_mb MiB."""
    return F.coalesce((size > 0) & (size <= max_mb * 1024 * 1024), F.lit(False))


def valid_mime(c: Column, allowed: list[str] | None = None) -> Column:
    """MIME type (lower-cased) in the allow-list."""
    return F.coalesce(F.lower(c).isin(allowed or P.SUPPORTED_MIME_TYPES), F.lit(False))


def valid_email(c: Column) -> Column:
    """E-mail pattern and at most 255 characters."""
    return F.coalesce(c.rlike(P.EMAIL_PATTERN) & (F.char_length(c) <= 255), F.lit(False))


def query_problem(q: Column, max_length: int = P.MAX_QUERY_LENGTH) -> Column:
    """First reason a search query is rejected, null when valid."""
    stripped = F.regexp_replace(F.coalesce(q, F.lit("")), "^" + P.WS_CLASS + "+|" + P.WS_CLASS + "+$", "")
    low = F.lower(q)
    inj = None
    for pat in P.QUERY_INJECTION_PATTERNS:
        hit = F.instr(low, pat) > 0
        inj = hit if inj is None else (inj | hit)
    return (F.when(stripped == "", F.lit("Query cannot be empty"))
            .when(F.char_length(q) > max_length, F.lit(f"Query too long (max {max_length} characters)"))
            .when(inj, F.lit("Query contains potentially malicious content")))


def valid_json_size(js: Column, max_kb: int = P.MAX_JSON_KB) -> Column:
    """Serialized JSON size in KiB at most max_kb."""
    return F.coalesce(F.octet_length(js) / 1024 <= max_kb, F.lit(False))


def sanitize_filename(name: Column, variant: str = "validators") -> Column:
    """Replace path/unsafe characters with '_', drop control characters
    and limit the length.  variant "validators": 255 keeping the part after
    the last dot, then strip, fallbacks 'unnamed_file' / 'sanitized_file';
    variant "ingestion": over 100 characters keep 95 of the stem plus the
    os.path.splitext extension, fallback 'unnamed_file'."""
    s = F.regexp_replace(F.regexp_replace(name, P.FILENAME_UNSAFE, "_"), P.FILENAME_CONTROL, "")
    n = F.char_length(s)
    dot = F.locate(".", F.reverse(s))
    last = n - dot  # 0-based index of the last dot (when dot > 0)
    if variant == "validators":
        ext = s.substr(last + 2, F.greatest(dot - 1, F.lit(0)))
        base = s.substr(F.lit(1), F.greatest(last, F.lit(0)))
        keep = F.greatest(F.lit(250) - F.char_length(ext), F.lit(0))
        long_name = (F.when(dot > 1, F.concat(base.substr(F.lit(1), keep), F.lit("."), ext))
                     .when(dot == 1, base.substr(F.lit(1), F.lit(250)))
                     .otherwise(F.substring(s, 1, 250)))
        d = F.when(n > 255, long_name).otherwise(s)
        stripped = F.regexp_replace(d, "^" + P.WS_CLASS + "+|" + P.WS_CLASS + "+$", "")
        return (F.when(name.isNull() | (name == ""), F.lit("unnamed_file"))
                .when(stripped == "", F.lit("sanitized_file")).otherwise(stripped))
    if variant == "ingestion":
        lead = n - F.char_length(F.regexp_replace(s, r"^\.+", ""))
        has_ext = (dot > 0) & (last >= lead) & (last >= 1)
        stem = F.when(has_ext, s.substr(F.lit(1), last)).otherwise(s)
        ext = F.when(has_ext, s.substr(last + 1, dot)).otherwise(F.lit(""))
        out = F.when(n > 100, F.concat(F.substring(stem, 1, 95), ext)).otherwise(s)
        return F.when(out.isNull() | (out == ""), F.lit("unnamed_file")).otherwise(out)
    raise ValueError(variant)


def dispatch_format(mime: Column, filename: Column) -> Column:
    """S3: extractor chosen by MIME type or extension; 'unsupported' rows go
    to quarantine."""
    fn = F.lower(filename)
    return (F.when((mime == "application/pdf") | fn.endswith(".pdf"), "pdf")
            .when(mime.isin("application/vnd.openxmlformats-officedocument.wordprocessingml.document",
                            "application/msword") | fn.endswith(".docx") | fn.endswith(".doc"), "docx")
            .when((mime == "text/plain") | fn.endswith(".txt") | fn.endswith(".md"), "txt")
            .otherwise("unsupported"))


def decode_text(content: Column) -> Column:
    """Bytes -> text.  Valid UTF-8 as UTF-8; a UTF-16 byte-order mark
    as UTF-16; anything else as ISO-8859-1 (which never fails).  `when`
    evaluates only the chosen branch, so `decode` never sees bytes it would
    reject (SURVEY trap 12)."""
    head = F.upper(F.hex(F.substring(content, 1, 2)))
    return (F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
            .when(head.isin("FEFF", "FFFE"), F.decode(content, "UTF-16"))
            .otherwise(F.decode(content, "ISO-8859-1")))


def detected_encoding(content: Column) -> Column:
    head = F.upper(F.hex(F.substring(content, 1, 2)))
    return (F.when(F.is_valid_utf8(content.cast("string")), F.lit("utf-8"))
            .when(head.isin("FEFF", "FFFE"), F.lit("utf-16")).otherwise(F.lit("latin-1")))


def gate_failures(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """G1: adds `failed_rules` (array, in rule order) and `passed`."""
    fails = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
                                      for name, ok in rules.items()]))
    return df.withColumn("failed_rules", fails).withColumn("passed", F.size("failed_rules") == 0)


def gate_report(checked: DataFrame) -> DataFrame:
    """G1 counts per failed rule, plus the pass/quarantine totals."""
    per_rule = checked.select(F.explode("failed_rules").alias("rule")).groupBy("rule").count()
    totals = checked.groupBy(F.when(F.col("passed"), "passed").otherwise("quarantined").alias("rule")).count()
    return per_rule.unionByName(totals).withColumnRenamed("count", "n_records")

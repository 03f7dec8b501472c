"""Queries for the ingest gate, validators and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators import gate as G
from quire.operators.requests import client_key
from quire.plans.catalog import query
from quire.plans.sqlfrag import WS, q
from quire.sources import tables

UPLOADS_SQL = (
    "SELECT doc_id, source AS tenant_id, 'doc_' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.txt' "
    "WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.md' ELSE '.bin' END AS filename, CASE lang WHEN 'en' THEN 'text/plain' "
    "WHEN 'fr' THEN 'application/pdf' WHEN 'de' THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime_type, "
    "octet_length(encode(coalesce(text, ''))) AS size, 'user' || CAST(doc_id AS VARCHAR) || '@' || source || "
    "'.example.com' AS uploader FROM documents")


def uploads(spark, sf):
    d = tables.load(spark, sf, "documents")
    ext = (F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".pdf")
           .when(F.col("lang") == "de", ".md").otherwise(".bin"))
    mime = (F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "fr", "application/pdf")
            .when(F.col("lang") == "de", "text/markdown").otherwise("application/octet-stream"))
    return d.select("doc_id", F.col("source").alias("tenant_id"),
                    F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext).alias("filename"),
                    mime.alias("mime_type"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"),
                    F.concat(F.lit("user"), F.col("doc_id").cast("string"), F.lit("@"), F.col("source"),
                             F.lit(".example.com")).alias("uploader"))


def _rules(u):
    meta = F.to_json(F.struct("filename", "size"))
    return {
        "tenant_id": G.valid_tenant_id(F.col("tenant_id")),
        "file_size": G.valid_file_size(F.col("size")),
        "mime_type": G.valid_mime(F.col("mime_type")),
        "upload_mime_type": G.valid_mime(F.col("mime_type"), P.UPLOAD_MIME_TYPES),
        "uploader_email": G.valid_email(F.col("uploader")),
        "json_size": G.valid_json_size(meta),
    }


def _in(x, vals):
    return f"lower({x}) IN (" + ", ".join(q(v) for v in vals) + ")"


_RULES_SQL = [
    ("tenant_id", f"(tenant_id <> '' AND (regexp_full_match(regexp_replace(regexp_replace(regexp_replace(tenant_id, "
                  f"'urn:|uuid:', '', 'g'), '^[{{}}]+|[{{}}]+$', '', 'g'), '-', '', 'g'), '[0-9a-fA-F]{{32}}') OR "
                  f"regexp_matches(tenant_id, {q(P.TENANT_ID_PATTERN)})))"),
    ("file_size", f"(size > 0 AND size <= {P.MAX_UPLOAD_MB * 1024 * 1024})"),
    ("mime_type", _in("mime_type", P.SUPPORTED_MIME_TYPES)),
    ("upload_mime_type", _in("mime_type", P.UPLOAD_MIME_TYPES)),
    ("uploader_email", f"(regexp_matches(uploader, {q(P.EMAIL_PATTERN)}) AND length(uploader) <= 255)"),
    ("json_size", "(octet_length(encode(json_object('filename', filename, 'size', size)::VARCHAR)) / 1024 <= 100)"),
]
_FAILS = "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _RULES_SQL) + \
    "], lambda x: x IS NOT NULL)"
GATE_SQL = f"WITH u AS ({UPLOADS_SQL}), g AS (SELECT doc_id, {_FAILS} AS f FROM u) "


@query("g1_ingest_gate", "G1-G5, G7 (one pass, failed rules per record)",
       GATE_SQL + "SELECT doc_id, len(f) = 0 AS passed, array_to_string(f, ',') AS failed_rules FROM g")
def g1(spark, sf):
    u = uploads(spark, sf)
    c = G.gate_failures(u, _rules(u))
    return c.select("doc_id", "passed", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("g1_gate_report", "G1 report (per rule, pass / quarantine)",
       GATE_SQL + "SELECT rule, count(*) AS n_records FROM (SELECT unnest(f) AS rule FROM g) GROUP BY rule "
       "UNION ALL SELECT CASE WHEN len(f) = 0 THEN 'passed' ELSE 'quarantined' END, count(*) FROM g GROUP BY 1")
def g1r(spark, sf):
    u = uploads(spark, sf)
    return G.gate_report(G.gate_failures(u, _rules(u)))


_STRIP = "regexp_replace(coalesce(txt, ''), " + q("^" + WS + "+|" + WS + "+$") + ", '', 'g')"
_INJ = " OR ".join(f"strpos(lower(txt), {q(p)}) > 0" for p in P.QUERY_INJECTION_PATTERNS)
_QUERY_TEXTS = ("SELECT 'benchmark' AS corpus, item_id AS id, text AS txt FROM benchmark UNION ALL "
                "SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations")


@query("g6_query_validation", "G6, G9 query bounds",
       f"SELECT corpus, id, CASE WHEN {_STRIP} = '' THEN 'Query cannot be empty' WHEN length(txt) > 1000 THEN "
       f"'Query too long (max 1000 characters)' WHEN {_INJ} THEN 'Query contains potentially malicious content' END "
       f"AS reason FROM ({_QUERY_TEXTS})")
def g6(spark, sf):
    b = tables.load(spark, sf, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("id"),
                                                    F.col("text").alias("txt"))
    c = tables.load(spark, sf, "conversations").select(
        F.lit("conversations").alias("corpus"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("text").alias("txt"))
    u = b.unionByName(c)
    return u.select("corpus", "id", G.query_problem(F.col("txt")).alias("reason"))


_S = (f"regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), "
      f"{q(P.re2_regex(P.FILENAME_UNSAFE))}, '_', 'g'), {q(P.re2_regex(P.FILENAME_CONTROL))}, '', 'g')")
_G8 = (
    f"WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS raw, {_S} AS s FROM pages), "
    "b AS (SELECT *, length(s) AS n, CASE WHEN strpos(s, '.') = 0 THEN 0 ELSE length(s) - "
    "length(regexp_extract(s, '^(?s:(.*))[.]', 1)) END AS dot FROM a), "
    "c AS (SELECT *, n - dot AS last, length(regexp_replace(s, '^[.]+', '')) AS rest FROM b), "
    "d AS (SELECT *, substring(s, last + 2, greatest(dot - 1, 0)) AS ext, substring(s, 1, greatest(last, 0)) AS base, "
    "(dot > 0 AND last >= n - rest AND last >= 1) AS has_ext FROM c), "
    "e AS (SELECT *, CASE WHEN n > 255 THEN (CASE WHEN dot > 1 THEN substring(base, 1, greatest(250 - length(ext), 0)) "
    "|| '.' || ext WHEN dot = 1 THEN substring(base, 1, 250) ELSE substring(s, 1, 250) END) ELSE s END AS dv, "
    "CASE WHEN n > 100 THEN substring(CASE WHEN has_ext THEN substring(s, 1, last) ELSE s END, 1, 95) || "
    "CASE WHEN has_ext THEN substring(s, last + 1, dot) ELSE '' END ELSE s END AS iv FROM d) "
    f"SELECT page_id, CASE WHEN raw IS NULL OR raw = '' THEN 'unnamed_file' WHEN "
    f"regexp_replace(dv, {q('^' + WS + '+|' + WS + '+$')}, '', 'g') = '' THEN 'sanitized_file' ELSE "
    f"regexp_replace(dv, {q('^' + WS + '+|' + WS + '+$')}, '', 'g') END AS name_validators, "
    "CASE WHEN iv IS NULL OR iv = '' THEN 'unnamed_file' ELSE iv END AS name_ingestion FROM e")


@query("g8_sanitize_filenames", "G8 (both variants) over page URLs", _G8)
def g8(spark, sf):
    p = tables.load(spark, sf, "pages")
    raw = F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1)
    d = p.select("page_id", raw.alias("raw"))
    return d.select("page_id", G.sanitize_filename(F.col("raw"), "validators").alias("name_validators"),
                    G.sanitize_filename(F.col("raw"), "ingestion").alias("name_ingestion"))


@query("g9_request_bounds", "G9 (top_k 1-50, max_length 100-2000, query 1-1000)",
       "SELECT event_id, (CAST(floor(value) AS BIGINT) % 60) BETWEEN 1 AND 50 AS top_k_ok, "
       "CAST(floor(value * 10) AS BIGINT) BETWEEN 100 AND 2000 AS max_length_ok, "
       "length(props) BETWEEN 1 AND 1000 AS query_ok FROM events")
def g9(spark, sf):
    e = tables.load(spark, sf, "events")
    top_k = F.floor("value").cast("long") % 60
    max_len = F.floor(F.col("value") * 10).cast("long")
    return e.select("event_id", top_k.between(*P.TOP_K_RANGE).alias("top_k_ok"),
                    max_len.between(*P.SUMMARY_MAX_LENGTH_RANGE).alias("max_length_ok"),
                    F.char_length("props").between(1, P.MAX_QUERY_LENGTH).alias("query_ok"))


@query("s3_format_dispatch", "S3 (dispatch by MIME or extension, quarantine)",
       f"WITH u AS ({UPLOADS_SQL}) SELECT doc_id, CASE WHEN mime_type = 'application/pdf' OR lower(filename) LIKE '%.pdf' "
       "THEN 'pdf' WHEN mime_type IN ('application/vnd.openxmlformats-officedocument.wordprocessingml.document', "
       "'application/msword') OR lower(filename) LIKE '%.docx' OR lower(filename) LIKE '%.doc' THEN 'docx' "
       "WHEN mime_type = 'text/plain' OR lower(filename) LIKE '%.txt' OR lower(filename) LIKE '%.md' THEN 'txt' "
       "ELSE 'unsupported' END AS extractor FROM u")
def s3(spark, sf):
    u = uploads(spark, sf)
    return u.select("doc_id", G.dispatch_format(F.col("mime_type"), F.col("filename")).alias("extractor"))


@query("s2_decode_text", "S2 (encoding detection and decode; bytes derived per language)",
       "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'utf-16' WHEN lang = 'de' AND regexp_matches(text, '[^\\x00-\\x7F]') "
       "THEN 'latin-1' ELSE 'utf-8' END AS encoding, CASE WHEN lang = 'de' THEN NOT regexp_matches(text, "
       "'[^\\x00-\\xFF]') ELSE true END AS roundtrip_ok FROM documents")
def s2(spark, sf):
    d = tables.load(spark, sf, "documents")
    raw = (F.when(F.col("lang") == "fr", F.encode("text", "UTF-16"))
           .when(F.col("lang") == "de", F.encode("text", "ISO-8859-1"))
           .otherwise(F.encode("text", "UTF-8")))
    b = d.select("doc_id", "lang", "text", raw.alias("content"))
    dec = G.decode_text(F.col("content"))
    return b.select("doc_id", G.detected_encoding(F.col("content")).alias("encoding"),
                    (dec == F.col("text")).alias("roundtrip_ok"))


_HEADERS = ("SELECT event_id, CASE event_type WHEN 'click' THEN '10.0.' || CAST(user_id % 256 AS VARCHAR) || "
            "'.7, 172.16.0.1' WHEN 'view' THEN ' ' END AS xff, CASE WHEN event_type = 'purchase' THEN '192.168.1.' || "
            "CAST(user_id % 256 AS VARCHAR) END AS real_ip, CASE WHEN event_type <> 'error' THEN '127.0.0.1' END AS peer "
            "FROM events")


@query("m2_client_keys", "M2 (client key from forwarded headers)",
       f"SELECT event_id, CASE WHEN xff IS NOT NULL AND xff <> '' THEN "
       f"regexp_replace(split_part(xff, ',', 1), {q('^' + WS + '+|' + WS + '+$')}, '', 'g') "
       f"WHEN real_ip IS NOT NULL AND real_ip <> '' THEN real_ip WHEN peer IS NOT NULL THEN peer ELSE 'unknown' END "
       f"AS client FROM ({_HEADERS})")
def m2(spark, sf):
    e = tables.load(spark, sf, "events")
    u = F.col("user_id") % 256
    xff = (F.when(F.col("event_type") == "click", F.concat(F.lit("10.0."), u.cast("string"), F.lit(".7, 172.16.0.1")))
           .when(F.col("event_type") == "view", F.lit(" ")))
    real = F.when(F.col("event_type") == "purchase", F.concat(F.lit("192.168.1."), u.cast("string")))
    peer = F.when(F.col("event_type") != "error", F.lit("127.0.0.1"))
    return e.select("event_id", client_key(xff, real, peer).alias("client"))

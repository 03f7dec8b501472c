"""PII detection and redaction.

Spans are found, resolved (P3) and, for redacted texts, replaced (P4-P6) in
one Arrow pass over the row that holds the text: a Python string is cut at
any position in constant time, so the cost is linear in the text and its
spans.  A pure-JVM detector (`engine="jvm"`) is kept for tests.  No shuffle
is needed until a report groups the results.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quire.functions import patterns as P
from quire.functions.text import col_of, round6

SPAN_TYPE = "struct<type:string,start:int,end:int,text:string,confidence:double,method:string>"

# Our addition behind the opt-in "extended" profile: phones written with a
# parenthesised area code, which the reference's tests expect to be found.
EXTENDED_PATTERNS = [
    ("phone", r"(?:\+\d{1,2}[ -]?)?\(\d{3}\)\s?\d{3}[-.]?\d{4}\b"),
]


def profile_patterns(profile: str = "reference") -> list[tuple[str, str]]:
    if profile == "reference":
        return list(P.PII_PATTERNS)
    if profile == "extended":
        return list(P.PII_PATTERNS) + EXTENDED_PATTERNS
    raise ValueError(f"unknown PII profile: {profile}")


def _prefix_sum(lens: Column, upto: Column) -> Column:
    """sum(lens[0:upto])"""
    return F.aggregate(F.slice(lens, 1, upto), F.lit(0), lambda a, x: a + x)


def pattern_spans(text: Column, pii_type: str, py_pattern: str, order: int,
                  confidence: float = P.REGEX_CONFIDENCE) -> Column:
    """P1 for one pattern: array of spans with code-point offsets, plus the
    pattern rank used to break ties in P3."""
    jp = P.java_regex(py_pattern)
    matches = F.regexp_extract_all(text, F.lit(jp), 0)
    gaps = F.split(text, jp, -1)
    gap_len = F.transform(gaps, lambda g: F.char_length(g))
    match_len = F.transform(matches, lambda m: F.char_length(m))

    def mk(m, i):
        start = _prefix_sum(gap_len, i + 1) + _prefix_sum(match_len, i)
        return F.struct(
            start.cast("int").alias("start"),
            F.lit(-confidence).alias("neg_conf"),
            F.lit(order).alias("ord"),
            F.struct(F.lit(pii_type).alias("type"), start.cast("int").alias("start"),
                     (start + F.char_length(m)).cast("int").alias("end"), m.alias("text"),
                     F.lit(confidence).alias("confidence"), F.lit("regex").alias("method")).alias("span"),
        )

    spans = F.transform(matches, mk)
    # Cheap pre-checks skip the regex work on texts that cannot match.
    gate = F.instr(text, "@") > 0 if "@" in py_pattern else text.rlike(r"\p{Nd}")
    return F.when(gate, spans).otherwise(F.array().cast(
        f"array<struct<start:int,neg_conf:double,ord:int,span:{SPAN_TYPE}>>"))


def _keyed(spans: Column, base_order: int) -> Column:
    """Wrap externally supplied spans (P2) with the P3 sort key; their input
    position is part of the key, so ties keep input order (a stable sort)."""
    return F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("start"), (-s["confidence"]).alias("neg_conf"),
        (F.lit(base_order) + i).alias("ord"), s.alias("span")))


KEYED_TYPE = f"array<struct<start:int,neg_conf:double,ord:int,span:{SPAN_TYPE}>>"

# Where a match of a pattern can lie.  Every reference pattern except e-mail
# starts with a digit and consumes only digits and the separators - . / and
# whitespace, so its matches lie inside runs that start with a digit and
# continue over that alphabet; e-mail matches lie inside runs of its
# alphabet that contain '@'.  Scanning only those runs (with the whole text
# still visible to `\b`) gives exactly the matches of a full scan.
_DIGIT_RUN = re.compile(r"\d[\d\-./\s]*")
_EMAIL_ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-|@")
_DIGIT_PATTERNS = {p for t, p in P.PII_PATTERNS if t != "email"}
_EMAIL_PATTERN = dict(P.PII_PATTERNS)["email"]


def _scan_region(pattern: str) -> str | None:
    if pattern in _DIGIT_PATTERNS:
        return "digits"
    if pattern == _EMAIL_PATTERN:
        return "email"
    return None


def _regions(text: str, kind: str) -> list[tuple[int, int]]:
    if kind == "digits":
        return [(m.start(), m.end()) for m in _DIGIT_RUN.finditer(text)]
    out: list[tuple[int, int]] = []
    n = len(text)
    at = text.find("@")
    while at != -1:
        lo = at
        while lo > 0 and text[lo - 1] in _EMAIL_ALPHABET:
            lo -= 1
        hi = at + 1
        while hi < n and text[hi] in _EMAIL_ALPHABET:
            hi += 1
        out.append((lo, hi))
        at = text.find("@", hi)
    return out

_PY_DETECTORS: dict = {}


def _disjoint(keyed) -> list:
    """P3 on start-sorted candidates: a span stays unless it starts before
    the last kept one ends."""
    kept, free_from = [], -1
    for c in keyed:
        if c["span"]["start"] >= free_from:
            kept.append(c)
            free_from = c["span"]["end"]
    return kept


def _stand_in(span, mode: str, salt) -> str:
    """Replacement text of one span (the plain form of `replacement`)."""
    if mode == "mask":
        return P.MASK_LABELS.get(span["type"], P.MASK_DEFAULT)
    if mode == "remove":
        return ""
    named = ":".join(x for x in (salt, span["text"], span["type"]) if x is not None)
    return f"[{P.HASH_PREFIXES.get(span['type'], P.HASH_DEFAULT)}:{hashlib.sha256(named.encode()).hexdigest()[:8]}]"


def _replaced(text: str, spans, mode: str, salt) -> str:
    parts, at = [], 0
    for s in spans:
        parts += (text[at:s["start"]], _stand_in(s, mode, salt))
        at = s["end"]
    return "".join([*parts, text[at:]])


def _python_detector(profile: str):
    """Arrow-batched detector running the patterns with Python's `re`, the
    engine whose semantics (Unicode \\b, \\d, \\s) the patterns are written
    for.  One pass per pattern, offsets straight from the match objects; it
    returns candidates sorted by the P3 key.  Measured 3x faster than the
    equivalent Java regex pair (extract + split) at sf0.1."""
    if profile in _PY_DETECTORS:
        return _PY_DETECTORS[profile]
    compiled = [(i, ty, re.compile(pat), _scan_region(pat))
                for i, (ty, pat) in enumerate(profile_patterns(profile))]
    conf = P.REGEX_CONFIDENCE

    def scan(text):
        if text is None:
            return []
        found = []
        regions = {}
        for order, ty, rx, region in compiled:
            if region is None:
                spans = [(0, len(text))]
            else:
                if region not in regions:
                    regions[region] = _regions(text, region)
                spans = regions[region]
            for lo, hi in spans:
                # One context character past the region, so `\b` sees the real
                # neighbour (a match cannot extend into it).
                for m in rx.finditer(text, lo, min(hi + 1, len(text))):
                    found.append((m.start(), order, {"type": ty, "start": m.start(), "end": m.end(),
                                                     "text": m.group(), "confidence": conf, "method": "regex"}))
        found.sort(key=lambda x: (x[0], x[1]))
        return [{"start": st, "neg_conf": -conf, "ord": o, "span": sp} for st, o, sp in found]

    def keep(text):
        return [c["span"] for c in _disjoint(scan(text))]

    @pandas_udf(KEYED_TYPE)
    def detect(texts: pd.Series) -> pd.Series:
        return texts.map(scan)

    @pandas_udf(f"array<{SPAN_TYPE}>")
    def detect_kept(texts: pd.Series) -> pd.Series:
        return texts.map(keep)

    _PY_DETECTORS[profile] = detect
    _PY_DETECTORS[profile + "/kept"] = detect_kept
    _PY_DETECTORS[profile + "/plain"] = keep
    return detect


def python_redactor(mode: str = "mask", salt: str = P.DEFAULT_SALT, profile: str = "reference"):
    """`redact_text` of one Python string, for passes that hold the text
    already (the caller's Arrow stage)."""
    if mode not in P.REDACTION_MODES:
        raise ValueError(f"Unknown redaction mode: {mode}")
    _python_detector(profile)
    keep = _PY_DETECTORS[profile + "/plain"]
    return lambda text: _replaced(text, keep(text), mode, salt)


def redact_many(texts: Column, mode: str = "mask", salt: Column | str = P.DEFAULT_SALT, profile: str = "reference") -> Column:
    """`redact_text` for an array of texts (e.g. the chunks of a document):
    array of redacted texts, aligned with the input; null for a null array."""
    if mode not in P.REDACTION_MODES:
        raise ValueError(f"Unknown redaction mode: {mode}")
    _python_detector(profile)
    keep = _PY_DETECTORS[profile + "/plain"]

    @pandas_udf("array<string>")
    def cleaned(arrays: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [None if x is None else _replaced(x, keep(x), mode, k) for x in a]
                          for a, k in zip(arrays, salts)], dtype=object)

    return cleaned(texts, F.lit(salt) if isinstance(salt, str) else salt)


def candidate_spans(text, profile: str = "reference", extra_spans: Column | None = None,
                    engine: str = "python") -> Column:
    """All regex spans (and optional entity spans, P2) before overlap
    resolution, sorted by (start, -confidence, pattern order).

    engine="python": Python `re` in an Arrow UDF (default, fastest, exact).
    engine="jvm": Java regex with Python's classes spelled out; no Python."""
    t = col_of(text)
    if engine == "python":
        parts = [_python_detector(profile)(t)]
        base = len(profile_patterns(profile))
    elif engine == "jvm":
        parts = [pattern_spans(t, ty, pat, i) for i, (ty, pat) in enumerate(profile_patterns(profile))]
        base = len(parts)
    else:
        raise ValueError(f"unknown engine {engine}")
    if extra_spans is not None:
        parts.append(_keyed(extra_spans, base))
        return F.array_sort(F.concat(*parts))
    return parts[0] if engine == "python" else F.array_sort(F.concat(*parts))


def resolve_overlaps(keyed_sorted: Column) -> Column:
    """Keep a span unless it overlaps one already kept.

    Spans arrive sorted by start and are non-empty, and kept spans are
    disjoint, so "overlaps a kept span" is "start < end of the last kept"."""
    @pandas_udf(f"array<{SPAN_TYPE}>")
    def kept(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [c["span"] for c in _disjoint(a)])

    return kept(keyed_sorted)


def detect_pii(text, profile: str = "reference", extra_spans: Column | None = None,
               engine: str = "python") -> Column:
    """P1 + P3: resolved spans, ascending by start."""
    if engine == "python" and extra_spans is None:
        _python_detector(profile)
        return _PY_DETECTORS[profile + "/kept"](col_of(text))
    return resolve_overlaps(candidate_spans(text, profile, extra_spans, engine))


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def replacement(span: Column, mode: str, salt: Column | str = P.DEFAULT_SALT) -> Column:
    """Replacement string of one span for a redaction mode."""
    if mode == "mask":
        return F.coalesce(F.element_at(_map_lit(P.MASK_LABELS), span["type"]), F.lit(P.MASK_DEFAULT))
    if mode == "hash":
        salt_c = F.lit(salt) if isinstance(salt, str) else salt
        digest = F.substring(F.sha2(F.concat_ws(":", salt_c, span["text"], span["type"]), 256), 1, 8)
        prefix = F.coalesce(F.element_at(_map_lit(P.HASH_PREFIXES), span["type"]), F.lit(P.HASH_DEFAULT))
        return F.concat(F.lit("["), prefix, F.lit(":"), digest, F.lit("]"))
    if mode == "remove":
        return F.lit("")
    raise ValueError(f"Unknown redaction mode: {mode}")


def redact(text, spans: Column, mode: str = "mask", salt: Column | str = P.DEFAULT_SALT) -> Column:
    """Text rebuilt from the gaps between spans and their
    replacements.  `spans` must be disjoint and ascending (output of P3)."""
    t = col_of(text)
    if mode not in P.REDACTION_MODES:
        raise ValueError(f"Unknown redaction mode: {mode}")

    @pandas_udf("string")
    def rebuilt(texts: pd.Series, arrays: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else None if a is None else _replaced(x, a, mode, k)
                          for x, a, k in zip(texts, arrays, salts)], dtype=object)

    return rebuilt(t, spans, F.lit(salt) if isinstance(salt, str) else salt)


def redact_text(text, mode: str = "mask", salt: Column | str = P.DEFAULT_SALT, profile: str = "reference") -> Column:
    """P1 + P3 + P4-P6 in one pass: struct<text, n> of the redacted text and
    the number of replaced spans (a null text gives null and 0)."""
    if mode not in P.REDACTION_MODES:
        raise ValueError(f"Unknown redaction mode: {mode}")
    _python_detector(profile)
    keep = _PY_DETECTORS[profile + "/plain"]

    @pandas_udf("text string, n int")
    def cleaned(texts: pd.Series, salts: pd.Series) -> pd.DataFrame:
        kept = [keep(x) for x in texts]
        return pd.DataFrame({"text": pd.Series([None if x is None else _replaced(x, a, mode, k) for x, a, k in zip(texts, kept, salts)], dtype=object),
                             "n": pd.Series([len(a) for a in kept], dtype="int32")})

    return cleaned(col_of(text), F.lit(salt) if isinstance(salt, str) else salt)


def redact_with_spans(text, mode: str = "mask", salt: Column | str = P.DEFAULT_SALT, profile: str = "reference") -> Column:
    """P1 + P3 + P4-P6 in one pass: struct<text, spans> of the redacted text
    and the spans it replaced (a null text gives null and none)."""
    if mode not in P.REDACTION_MODES:
        raise ValueError(f"Unknown redaction mode: {mode}")
    _python_detector(profile)
    keep = _PY_DETECTORS[profile + "/plain"]

    @pandas_udf(f"text string, spans array<{SPAN_TYPE}>")
    def cleaned(texts: pd.Series, salts: pd.Series) -> pd.DataFrame:
        kept = [keep(x) for x in texts]
        return pd.DataFrame({"text": pd.Series([None if x is None else _replaced(x, a, mode, k) for x, a, k in zip(texts, kept, salts)], dtype=object),
                             "spans": pd.Series(kept, dtype=object)})

    return cleaned(col_of(text), F.lit(salt) if isinstance(salt, str) else salt)


def applied_redactions(spans: Column, mode: str = "mask", salt: Column | str = P.DEFAULT_SALT) -> Column:
    """The applied-redaction records, last span first (as emitted)."""
    if mode not in P.REDACTION_MODES:
        raise ValueError(f"Unknown redaction mode: {mode}")
    return F.transform(F.reverse(spans), lambda s: F.struct(
        s["start"].alias("original_start"), s["end"].alias("original_end"),
        s["text"].alias("original_text"), replacement(s, mode, salt).alias("replacement"),
        s["type"].alias("type"), F.lit(mode).alias("mode"), s["confidence"].alias("confidence")))


# --- table-level operators -------------------------------------------------

def with_pii(df: DataFrame, text_col: str = "text", profile: str = "reference",
             extra_spans: str | None = None) -> DataFrame:
    """Adds `pii_spans` (resolved) to every row."""
    extra = F.col(extra_spans) if extra_spans else None
    return df.withColumn("pii_spans", detect_pii(F.col(text_col), profile, extra))


def span_table(df: DataFrame, id_cols: list[str], text_col: str = "text",
               profile: str = "reference") -> DataFrame:
    """P1/P3 as a table: one row per kept span, with its ordinal."""
    d = with_pii(df.select(*id_cols, text_col), text_col, profile)
    return (d.select(*id_cols, F.posexplode("pii_spans").alias("span_index", "s"))
            .select(*id_cols, "span_index", "s.type", "s.start", "s.end", "s.text", "s.confidence", "s.method"))


def redact_table(df: DataFrame, id_cols: list[str], text_col: str = "text", mode: str = "mask",
                 salt_col: str | None = None, profile: str = "reference") -> DataFrame:
    """P4-P6 per row: redacted text and number of redactions."""
    salt = F.col(salt_col) if salt_col else P.DEFAULT_SALT
    return df.withColumn("_r", redact_text(F.col(text_col), mode, salt, profile)) \
        .select(*id_cols, F.col("_r.text").alias("redacted_text"), F.col("_r.n").alias("n_redactions"))


def applied_table(df: DataFrame, id_cols: list[str], text_col: str = "text", mode: str = "mask",
                  salt_col: str | None = None, profile: str = "reference") -> DataFrame:
    """P7 as a table (ordinal 0 = last span in the text)."""
    salt = F.col(salt_col) if salt_col else P.DEFAULT_SALT
    d = with_pii(df, text_col, profile)
    return (d.select(*id_cols, F.posexplode(applied_redactions(F.col("pii_spans"), mode, salt)).alias("ordinal", "r"))
            .select(*id_cols, "ordinal", "r.*"))


def pii_inventory(df: DataFrame, tenant_col: str = "tenant_id", id_col: str = "doc_id",
                  text_col: str = "text", profile: str = "reference") -> DataFrame:
    """Spans and affected documents per (tenant, type), with subtotal
    rows per tenant and a grand total (rollup; null = all).

    Each document is first reduced to one row per type it contains, so the
    shuffle carries per-document counts instead of spans, and documents are
    counted without a distinct aggregate."""
    d = with_pii(df.select(tenant_col, id_col, text_col), text_col, profile)
    per_doc = d.select(tenant_col, F.explode(F.transform(
        F.array_distinct(F.col("pii_spans.type")),
        lambda ty: F.struct(ty.alias("type"),
                            F.size(F.filter("pii_spans", lambda s: s["type"] == ty)).alias("n")))).alias("t"))
    return (per_doc.rollup(tenant_col, "t.type")
            .agg(F.sum("t.n").alias("n_spans"), F.count(F.lit(1)).alias("n_documents"))
            .withColumnRenamed("type", "pii_type"))


def redaction_flags(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    profile: str = "reference") -> DataFrame:
    """P9 per document: redaction_applied = at least one span."""
    d = with_pii(df.select(id_col, text_col), text_col, profile)
    return d.select(id_col, (F.size("pii_spans") > 0).alias("redaction_applied"),
                    F.size("pii_spans").alias("n_spans"))


def pseudonym_links(df: DataFrame, tenant_col: str = "tenant_id", id_col: str = "doc_id",
                    text_col: str = "text", profile: str = "reference") -> DataFrame:
    """P10: hash pseudonyms (salt = tenant) shared by more than one document
    of a tenant.  Pre-aggregated per (document, token) inside the row, then
    one shuffle on (tenant, token)."""
    d = with_pii(df.select(tenant_col, id_col, text_col), text_col, profile)
    salt = F.col(tenant_col)
    tok = d.select(tenant_col, id_col, F.explode(F.array_distinct(F.transform(
        "pii_spans", lambda s: F.struct(s["type"].alias("pii_type"),
                                        replacement(s, "hash", salt).alias("token"))))).alias("t"))
    return (tok.groupBy(tenant_col, "t.pii_type", "t.token")
            .agg(F.count(F.lit(1)).alias("n_documents"), F.min(id_col).alias("first_doc_id"))
            .filter(F.col("n_documents") > 1))


def overlap_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   profile: str = "reference") -> DataFrame:
    """Candidate span pairs that overlap (a.start < b.end and a.end > b.start),
    i.e. what P3 had to resolve.  Each document's
    start-sorted spans are swept once, keeping only those still open, so no
    cross product is built."""
    side = "struct<type:string,start:int,end:int>"

    @pandas_udf(f"array<struct<a:{side},b:{side}>>")
    def overlaps(arrays: pd.Series) -> pd.Series:
        def of(cands):
            out, open_spans = [], []
            for s in (c["span"] for c in cands):
                open_spans = [a for a in open_spans if a["end"] > s["start"]]
                out += ({"a": a, "b": s} for a in open_spans)
                open_spans.append({k: s[k] for k in ("type", "start", "end")})
            return [{"a": p["a"], "b": {k: p["b"][k] for k in ("type", "start", "end")}} for p in out]
        return arrays.map(of)

    pairs = df.select(id_col, F.explode(overlaps(candidate_spans(F.col(text_col), profile))).alias("p"))
    return pairs.select(id_col, F.col("p.a.type").alias("type_a"), F.col("p.a.start").alias("start_a"),
                        F.col("p.a.end").alias("end_a"), F.col("p.b.type").alias("type_b"),
                        F.col("p.b.start").alias("start_b"), F.col("p.b.end").alias("end_b"))


def detector_recall(df: DataFrame, expected_col: str, id_col: str = "doc_id", text_col: str = "text",
                    profile: str = "reference") -> DataFrame:
    """Per expected type, documents expecting it, documents where it
    was detected, and recall.  `expected_col` is array<string> of types."""
    d = with_pii(df.select(id_col, text_col, expected_col), text_col, profile)
    per = d.select(id_col, F.explode(F.col(expected_col)).alias("pii_type"),
                   F.array_distinct(F.col("pii_spans.type")).alias("found"))
    return (per.groupBy("pii_type")
            .agg(F.count(F.lit(1)).alias("expected"),
                 F.sum(F.array_contains("found", F.col("pii_type")).cast("int")).alias("detected"))
            .withColumn("recall", round6(F.col("detected") / F.col("expected"))))

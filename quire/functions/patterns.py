"""Fixed values that must equal the reference's for identical results.

Regular expressions are written once in Python `re` syntax (as the reference
states them) and translated to the two dialects we run:

* Java (Spark): Python's Unicode ``\\d``, ``\\s`` and ``\\b`` are spelled out as
  explicit Unicode classes, so no engine default decides the semantics.
* RE2 (DuckDB oracle): same classes, except ``\\b`` which RE2 only knows in
  its ASCII form (RE2 has no look-around).
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference).
# PII patterns, in detection order.  The order matters: it breaks ties
# between spans with the same start and confidence.
PII_PATTERNS = [
    ("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("date_of_birth", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("zip_code", r"\b\d{5}(?:-\d{4})?\b"),
]
REGEX_CONFIDENCE = 0.9
ENTITY_CONFIDENCE = 0.7
ENTITY_LABELS = ["PERSON", "ORG", "GPE", "DATE", "MONEY"]

# Mask labels (mode "mask"); any other type becomes "[PII]".
MASK_LABELS = {
    "ssn": "[SSN]",
    "phone": "[PHONE]",
    "email": "[EMAIL]",
    "credit_card": "[CARD]",
    "person": "[NAME]",
    "org": "[ORG]",
    "date_of_birth": "[DOB]",
    "zip_code": "[ZIP]",
}
MASK_DEFAULT = "[PII]"

# Hash prefixes (mode "hash"); any other type becomes "PII".
HASH_PREFIXES = {
    "ssn": "SSN",
    "phone": "PH",
    "email": "EM",
    "credit_card": "CC",
    "person": "NM",
    "org": "OR",
    "date_of_birth": "DOB",
    "zip_code": "ZIP",
}
HASH_DEFAULT = "PII"
DEFAULT_SALT = "default"
REDACTION_MODES = ("mask", "hash", "remove")

# Text cleaning (clean_text_for_embedding), in order.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
CLEAN_RULES = [
    ("ellipsis", r"[.]{3,}", "..."),
    ("exclamation", r"[!]{2,}", "!"),
    ("question", r"[?]{2,}", "?"),
    ("page_number", r"\bPage \d+\b", ""),
    ("date", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", "[DATE]"),
]
SENTENCE_SPLIT = r"[.!?]+\s+"
QUALITY_MIN_LENGTH = 50
QUALITY_MIN_UNIQUE_CHARS = 10
QUALITY_REPETITION_MIN_WORDS = 10
QUALITY_REPETITION_RATIO = 0.3
HIGHLIGHT_KEYWORDS = ["important", "key", "significant", "main", "primary"]

# Chunking defaults.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHUNK_BOUNDARY_WINDOW = 100
CHUNK_SENTENCE_ENDINGS = [".", "!", "?", "\n\n"]

# Request validation.
QUERY_INJECTION_PATTERNS = ["<script", "javascript:", "data:", "vbscript:", "onload=", "onerror="]
SUPPORTED_MIME_TYPES = [
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/msword",
    "text/plain",
    "text/markdown",
]
UPLOAD_MIME_TYPES = ["application/pdf", "text/plain",
                     "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
TENANT_ID_PATTERN = r"^[a-zA-Z0-9_-]{3,50}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
FILENAME_UNSAFE = r'[<>:"/\\|?*]'
FILENAME_CONTROL = r"[\x00-\x1f\x7f-\x9f]"
MAX_UPLOAD_MB = 50
MAX_JSON_KB = 100
MAX_QUERY_LENGTH = 1000
TOP_K_RANGE = (1, 50)
SUMMARY_MAX_LENGTH_RANGE = (100, 2000)
HEALTH_PATHS = ["/health", "/health/liveness", "/health/readiness"]
RATE_LIMIT_PER_MINUTE = 60
RATE_LIMIT_WINDOW_SECONDS = 60
# END FIXED VALUES
# ---------------------------------------------------------------------------

# Python's str.isspace() set (what `\s` and str.strip() use), as code points.
_PY_WHITESPACE = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Python's `\w` (str.isalnum() or "_").
_PY_WORD = r"\p{L}\p{N}_"

WS_CLASS = "[" + _PY_WHITESPACE + "]"          # one whitespace character
WORD_CLASS = "[" + _PY_WORD + "]"


_ENDS_WITH_DIGIT_ATOM = re.compile(r"\\d(\{\d+(,\d*)?\}|\+|\*)?$")


def _translate(pattern: str, boundary: str, word_before: str | None = None,
               word_after: str | None = None) -> str:
    """Rewrite Python classes for another engine.  A `\\b` next to a token
    that is always a word character only needs one side checked, which is
    exact and much cheaper than the general two-sided boundary."""
    out = []
    i = 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "d":
                out.append(r"\p{Nd}")
            elif nxt == "s":
                out.append(_PY_WHITESPACE if in_class else WS_CLASS)
            elif nxt == "b" and not in_class:
                follows = pattern[i + 2:i + 4]
                if word_before and (follows == "\\d" or follows[:1].isalnum()):
                    out.append(word_before)
                elif word_after and i + 2 == len(pattern) and _ENDS_WITH_DIGIT_ATOM.search(pattern[:i]):
                    out.append(word_after)
                else:
                    out.append(boundary)
            elif nxt == "x" and pattern[i + 2:i + 4].isalnum():
                out.append(r"\x{" + pattern[i + 2:i + 4] + "}")
                i += 4
                continue
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


_JAVA_BOUNDARY = "(?:(?<=" + WORD_CLASS + ")(?!" + WORD_CLASS + ")|(?<!" + WORD_CLASS + ")(?=" + WORD_CLASS + "))"


def java_regex(pattern: str) -> str:
    """Python-semantics regex for Spark (java.util.regex)."""
    return _translate(pattern, _JAVA_BOUNDARY, "(?<!" + WORD_CLASS + ")", "(?!" + WORD_CLASS + ")")


def re2_regex(pattern: str) -> str:
    """The same regex for DuckDB (RE2): ASCII word boundary."""
    return _translate(pattern, r"\b")


def sql_str(s: str) -> str:
    """Quote a string literal for SQL (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"

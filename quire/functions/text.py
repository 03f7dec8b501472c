"""Text operators T1-T6 as Column expressions.

All of them are built-in Spark expressions except NFKD, which Spark lacks;
that step is an Arrow-batched pandas UDF fed only the non-ASCII rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quire.functions import patterns as P

WS = P.WS_CLASS
#: The characters of `WS`.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def round6(x: Column) -> Column:
    """Half-up rounding to 6 decimals spelled out (floor(x * 1e6 + 0.5) / 1e6),
    so results of ratios like 41/640 do not depend on an engine's rounding
    mode."""
    return F.floor(x.cast("double") * 1_000_000.0 + 0.5) / 1_000_000.0


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends (only
    the ends are looked at; a regex would try every run of the text)."""
    return F.btrim(col_of(c), F.lit(WS_CHARS))


def normalize_whitespace(c) -> Column:
    """null/empty -> '', every whitespace run -> one space, strip.

    The reference's later newline rules never fire because the first rule
    already turned every newline into a space (SURVEY trap 7)."""
    t = F.regexp_replace(F.coalesce(col_of(c), F.lit("")), WS + "+", " ")
    return F.trim(t)  # only U+0020 can remain at the ends


@pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def nfkd(c) -> Column:
    """Unicode NFKD.  Only non-ASCII rows are shipped to Python; the rest
    pass through unchanged (NFKD of ASCII is the identity)."""
    t = col_of(c)
    non_ascii = t.rlike("[^\\x00-\\x7F]")
    return F.coalesce(_nfkd(F.when(non_ascii, t)), t)


#: What every match of a cleaning rule holds: a text without it needs no regex.
CLEAN_MARKS = {"ellipsis": "...", "exclamation": "!!", "question": "??", "page_number": "Page ", "date": "/"}


def clean_steps(with_nfkd: bool = True) -> list[tuple[str, Callable[[Column], Column]]]:
    """T2 as a list of (rule, step on a non-null text), in the reference order."""
    def replaced(pat, repl):
        return lambda t: F.regexp_replace(t, P.java_regex(pat), repl)
    return [*([("nfkd", nfkd)] if with_nfkd else []), ("control", replaced(P.CONTROL_CHARS, "")),
            *[(name, replaced(pat, repl)) for name, pat, repl in P.CLEAN_RULES], ("whitespace", normalize_whitespace)]


def clean_rules(c, with_nfkd: bool = True) -> list[tuple[str, Column]]:
    """T2 as a list of (rule, text after the rule), in the reference order."""
    t = F.coalesce(col_of(c), F.lit(""))
    stages = []
    for name, step in clean_steps(with_nfkd):
        t = step(t)
        stages.append((name, t))
    return stages


def clean_text_for_embedding(c, with_nfkd: bool = True) -> Column:
    """NFKD, control characters, punctuation runs, page numbers, dates,
    then T1."""
    return clean_rules(c, with_nfkd)[-1][1]


def sentences(c) -> Column:
    """Array of sentences (split on ``[.!?]+\\s+``, stripped, len > 10)."""
    parts = F.split(F.coalesce(col_of(c), F.lit("")), P.java_regex(P.SENTENCE_SPLIT), -1)
    stripped = F.transform(parts, lambda s: py_strip(s))
    return F.filter(stripped, lambda s: F.char_length(s) > 10)


def rfind(haystack: Column, needle: str) -> Column:
    """0-based index of the last occurrence of `needle` (-1 if absent),
    in code points."""
    rev_needle = needle[::-1]
    p = F.locate(rev_needle, F.reverse(haystack))
    return F.when(p > 0, F.char_length(haystack) - p - F.lit(len(needle) - 1)).otherwise(F.lit(-1))


def truncate_text(c, max_length: int, preserve_words: bool = True) -> Column:
    """T4: snippet of at most `max_length` (+ '...'), cutting at the last
    space when that space lies beyond 0.8 * max_length."""
    t = col_of(c)
    cut = F.substring(t, 1, max_length)
    if preserve_words:
        last_space = rfind(cut, " ")
        body = F.when(last_space > F.lit(max_length * 0.8), F.substring(t, 1, last_space)).otherwise(cut)
    else:
        body = cut
    return (F.when(t.isNull() | (F.char_length(t) <= max_length), t)
            .otherwise(F.concat(body, F.lit("..."))))


def estimate_tokens(c, chars_per_token: float = 4.0) -> Column:
    """T5: int(len / chars_per_token); 0 for null/empty."""
    n = F.coalesce(F.char_length(col_of(c)), F.lit(0))
    return F.floor(n / F.lit(chars_per_token)).cast("int")


def words(c) -> Column:
    """Python ``text.lower().split()`` as a JVM expression."""
    s = py_strip(F.lower(col_of(c)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS + "+", -1))


_STATS_TYPE = StructType([StructField("word_count", IntegerType()), StructField("unique_chars", IntegerType()),
                          StructField("max_word_count", IntegerType())])


def _stats_one(t):
    if t is None:
        return {"word_count": None, "unique_chars": None, "max_word_count": None}
    low = t.lower()
    ws = low.split()
    top = max(Counter(ws).values()) if ws else 0
    return {"word_count": len(ws), "unique_chars": len(set(low)), "max_word_count": top}


@pandas_udf(_STATS_TYPE)
def _text_stats(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_stats_one(t) for t in s], columns=["word_count", "unique_chars", "max_word_count"])


def text_stats(c) -> Column:
    """A6 + A7 inputs in one pass: word count of ``lower().split()``,
    distinct characters of ``lower()``, highest word frequency.

    Per-character and per-word work is what Spark's interpreted lambdas are
    slowest at (a 20,000-word document becomes arrays of that size); Python's
    `set`, `str.split` and `Counter` do it in C, on Arrow batches, with the
    reference's exact Unicode semantics."""
    return _text_stats(col_of(c))


def distinct_chars(c) -> Column:
    """Number of distinct characters of lower(text) (code points)."""
    return text_stats(c)["unique_chars"]


def text_quality(c) -> Column:
    """struct(is_valid, length, word_count, unique_chars, issues)."""
    t = col_of(c)
    st = text_stats(t)
    n_words = st["word_count"]
    uniq = st["unique_chars"]
    repetitive = (n_words > P.QUALITY_REPETITION_MIN_WORDS) & (
        st["max_word_count"] > n_words * F.lit(P.QUALITY_REPETITION_RATIO))
    issues = F.array_compact(F.array(
        F.when(F.char_length(t) < P.QUALITY_MIN_LENGTH, F.lit("too_short")),
        F.when(uniq < P.QUALITY_MIN_UNIQUE_CHARS, F.lit("low_diversity")),
        F.when(repetitive, F.lit("excessive_repetition")),
        F.when(F.instr(t, "\ufffd") > 0, F.lit("encoding_issues")),
    ))
    empty = t.isNull() | (t == "")
    return F.when(empty, F.struct(
        F.lit(False).alias("is_valid"), F.lit(0).alias("length"),
        F.lit(None).cast("int").alias("word_count"), F.lit(None).cast("int").alias("unique_chars"),
        F.array(F.lit("empty_text")).alias("issues"),
    )).otherwise(F.struct(
        (F.size(issues) == 0).alias("is_valid"), F.char_length(t).alias("length"),
        n_words.alias("word_count"), uniq.alias("unique_chars"), issues.alias("issues"),
    ))

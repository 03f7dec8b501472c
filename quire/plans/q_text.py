"""Queries for corpus cleaning and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as TX
from quire.operators import corpus
from quire.plans.catalog import query
from quire.plans.sqlfrag import WS, normalize_ws, py_strip, q, rfind, round6, words
from quire.sources import tables


@query("t1_normalize_whitespace", "T1",
       f"SELECT doc_id, {normalize_ws('text')} AS norm_text, "
       f"length({normalize_ws('text')}) AS norm_length FROM documents")
def t1(spark, sf):
    d = tables.load(spark, sf, "documents")
    n = TX.normalize_whitespace("text")
    return d.select("doc_id", n.alias("norm_text"), F.char_length(n).alias("norm_length"))


def _t2_sql():
    """T2 as a chain of CTEs, one column per cleaning stage (so the chain is
    not expanded textually and T2r can compare consecutive stages)."""
    names = ["nfkd", "control", *[n for n, _, _ in P.CLEAN_RULES], "whitespace"]
    ctes, prev = [], "documents"
    for i, n in enumerate(names):
        src = "text" if i == 0 else f"s_{names[i - 1]}"
        cols = "doc_id, source, text" + "".join(f", s_{m}" for m in names[:i])
        ctes.append(f"st{i} AS (SELECT {cols}, {_single_step(n, src)} AS s_{n} FROM {prev})")
        prev = f"st{i}"
    return "WITH " + ", ".join(ctes) + " ", prev, names


def _single_step(name, src):
    from quire.plans.sqlfrag import nfkd
    if name == "nfkd":
        return nfkd(f"coalesce({src}, '')")
    if name == "control":
        return f"regexp_replace({src}, {q(P.re2_regex(P.CONTROL_CHARS))}, '', 'g')"
    if name == "whitespace":
        return normalize_ws(src)
    pat, repl = {n: (p_, r) for n, p_, r in P.CLEAN_RULES}[name]
    return f"regexp_replace({src}, {q(P.re2_regex(pat))}, {q(repl)}, 'g')"


_T2_CTES, _T2_LAST, _T2_NAMES = _t2_sql()


@query("t2_clean_text", "T2",
       _T2_CTES + f"SELECT doc_id, s_whitespace AS clean_text, length(s_whitespace) AS clean_length FROM {_T2_LAST}")
def t2(spark, sf):
    d = tables.load(spark, sf, "documents")
    c = TX.clean_text_for_embedding("text")
    return d.select("doc_id", c.alias("clean_text"), F.char_length(c).alias("clean_length"))


def _t2r_sql():
    parts = []
    prev = "coalesce(text, '')"
    for n in _T2_NAMES:
        parts.append(f"SELECT source AS tenant_id, '{n}' AS rule, CAST({prev} <> s_{n} AS INTEGER) AS changed, "
                     f"length({prev}) - length(s_{n}) AS removed FROM {_T2_LAST}")
        prev = f"s_{n}"
    return (_T2_CTES + "SELECT tenant_id, rule, sum(changed) AS rows_changed, sum(removed) AS chars_removed FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY tenant_id, rule")


@query("t2r_cleaning_report", "T2r", _t2r_sql())
def t2r(spark, sf):
    return corpus.cleaning_report(tables.documents(spark, sf))


_SENT = (f"list_filter(list_transform(string_split_regex(coalesce(text, ''), {q(P.re2_regex(P.SENTENCE_SPLIT))}),"
         f" lambda s: {py_strip('s')}), lambda s: length(s) > 10)")


@query("t3_sentences", "T3",
       f"SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS sentence_index, unnest(s) AS sentence "
       f"FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def t3(spark, sf):
    d = tables.load(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(TX.sentences("text")).alias("sentence_index", "sentence"))


def _trunc_sql(x: str, n: int, preserve: bool) -> str:
    cut = f"substring({x}, 1, {n})"
    body = (f"(CASE WHEN {rfind(cut, ' ')} > {n * 0.8} THEN substring({x}, 1, {rfind(cut, ' ')}) ELSE {cut} END)"
            if preserve else cut)
    return f"(CASE WHEN {x} IS NULL OR length({x}) <= {n} THEN {x} ELSE {body} || '...' END)"


@query("t4_snippets", "T4",
       f"SELECT doc_id, {_trunc_sql('text', 200, True)} AS snippet, "
       f"{_trunc_sql('text', 200, False)} AS snippet_hard FROM documents")
def t4(spark, sf):
    d = tables.load(spark, sf, "documents")
    return d.select("doc_id", TX.truncate_text("text", 200).alias("snippet"),
                    TX.truncate_text("text", 200, preserve_words=False).alias("snippet_hard"))


@query("t5_token_budget", "T5",
       "SELECT source AS tenant_id, count(*) AS n_docs, sum(tok) AS total_tokens, max(tok) AS max_tokens, "
       "(floor(CAST(avg(tok) AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0) AS avg_tokens FROM (SELECT source, CAST(floor(coalesce(length(text), 0) / 4.0) AS INTEGER)"
       " AS tok FROM documents) GROUP BY source")
def t5(spark, sf):
    return corpus.token_budget(tables.documents(spark, sf))


_UNIQ = "length(list_distinct(string_split(lower(text), '')))"
_WORDS = words("text")
_MAXW = f"coalesce(list_max(map_values(list_histogram({_WORDS}))), 0)"
_ISSUES = (f"list_filter([CASE WHEN length(text) < 50 THEN 'too_short' END, "
           f"CASE WHEN {_UNIQ} < 10 THEN 'low_diversity' END, "
           f"CASE WHEN len({_WORDS}) > 10 AND {_MAXW} > len({_WORDS}) * 0.3 THEN 'excessive_repetition' END, "
           f"CASE WHEN strpos(text, '�') > 0 THEN 'encoding_issues' END], lambda x: x IS NOT NULL)")
T6_SQL = (f"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN false ELSE len({_ISSUES}) = 0 END AS is_valid, "
          f"coalesce(length(text), 0) AS length, "
          f"CASE WHEN text IS NULL OR text = '' THEN NULL ELSE len({_WORDS}) END AS word_count, "
          f"CASE WHEN text IS NULL OR text = '' THEN NULL ELSE {_UNIQ} END AS unique_chars, "
          f"CASE WHEN text IS NULL OR text = '' THEN 'empty_text' ELSE array_to_string({_ISSUES}, ',') END AS issues "
          f"FROM documents")


@query("t6_text_quality", "T6", T6_SQL)
def t6(spark, sf):
    d = tables.load(spark, sf, "documents")
    return corpus.quality_table(d).select("doc_id", "is_valid", "length", "word_count", "unique_chars",
                                          F.array_join("issues", ",").alias("issues"))


@query("t6_quality_report", "T6, labels join",
       f"WITH t AS ({T6_SQL}), x AS (SELECT t.doc_id, unnest(CASE WHEN t.issues = '' THEN ['none'] "
       f"ELSE string_split(t.issues, ',') END) AS issue FROM t) "
       f"SELECT x.issue, count(*) AS n_docs, count(l.doc_id) AS n_labelled, "
       f"sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS n_quality_1, "
       f"sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) AS n_toxic_1 "
       f"FROM x LEFT JOIN labels l ON l.doc_id = x.doc_id GROUP BY x.issue")
def t6r(spark, sf):
    return corpus.quality_report(tables.load(spark, sf, "documents"), tables.load(spark, sf, "labels"))


@query("a6_distinct_chars", "A6", f"SELECT doc_id, {_UNIQ} AS unique_chars FROM documents")
def a6(spark, sf):
    d = tables.load(spark, sf, "documents")
    return d.select("doc_id", TX.distinct_chars("text").alias("unique_chars"))


@query("a7_word_repetition", "A7",
       f"SELECT doc_id, len({_WORDS}) AS n_words, {_MAXW} AS max_word_count, "
       f"CASE WHEN len({_WORDS}) = 0 THEN NULL ELSE {round6(_MAXW + ' / len(' + _WORDS + ')')} END AS max_ratio, "
       f"(len({_WORDS}) > 10 AND {_MAXW} > len({_WORDS}) * 0.3) AS excessive_repetition FROM documents")
def a7(spark, sf):
    return corpus.word_repetition(tables.load(spark, sf, "documents"))


@query("a9_exact_duplicates", "A9",
       "SELECT sha256(text) AS text_hash, count(*) AS n_docs, min(doc_id) AS first_doc_id, "
       "max(doc_id) AS last_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a9(spark, sf):
    return corpus.exact_duplicates(tables.load(spark, sf, "documents"))


@query("t7_ingest_records", "T7, S4",
       _T2_CTES + f"SELECT doc_id AS document_id, source AS tenant_id, length(s_whitespace) AS text_length, "
       f"sha256(s_whitespace) AS text_hash, 'text_extracted' AS status FROM {_T2_LAST}")
def t7(spark, sf):
    return corpus.ingest_records(tables.documents(spark, sf))

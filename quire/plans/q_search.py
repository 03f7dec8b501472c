"""End-to-end queries: secure search (Q1, J2, P8, A10) and summaries (Q2-Q5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as TX
from quire.operators import access as AC
from quire.operators import chunking as K
from quire.operators import search as S
from quire.operators import vectors as V
from quire.plans.catalog import query
from quire.plans.q_chunks import chunk_sql
from quire.session import cut, stored
from quire.plans.sqlfrag import WS, candidates, embed_ctes, mask_label, q, rebuild, resolve, sq_l2
from quire.sources import tables

DIM = 64
K_TOP = 5
_ROLE = "CASE {x} % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' WHEN 2 THEN 'viewer' ELSE 'analyst' END"
_CAN_VIEW = "({x} % 4 IN (0, 3))"  # admin and analyst hold pii:view in the API matrix


def _seeded(spark, sf):
    return tables.seeded_documents(tables.documents(spark, sf))


def _requests(spark, sf):
    b = tables.load(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("user_id"),
                    tables.user_tenant_col(F.col("item_id")).alias("tenant_id"), F.col("text").alias("query"),
                    tables.user_role_col(F.col("item_id")).alias("role_name"))


def _permissions(spark, requests):
    m = AC.role_matrix(spark, "api").select(F.col("name").alias("role_name"), "permissions")
    return requests.select("user_id", "tenant_id", "role_name").join(F.broadcast(m), "role_name")


_SEEDED_CHUNKS = chunk_sql(P.CHUNK_SIZE, P.CHUNK_OVERLAP, table=f"({tables.SEEDED_SQL}) sd")
_STRIP = "regexp_replace(coalesce(text, ''), " + q("^" + WS + "+|" + WS + "+$") + ", '', 'g')"

Q1_SQL = (
    _SEEDED_CHUNKS + ", t AS (SELECT c.chunk_id, d.source AS tenant_id, c.document_id, c.chunk_text FROM chunks c "
    "JOIN documents d ON d.doc_id = c.document_id), "
    f"req AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS tenant_id, text AS query, "
    f"{_CAN_VIEW.format(x='item_id')} AS can_view FROM benchmark WHERE {_STRIP} <> ''), "
    f"{embed_ctes('ce', 't', 'chunk_id', 'chunk_text', DIM)}, {embed_ctes('qe', 'req', 'query_id', 'query', DIM)}, "
    f"hits AS (SELECT r.query_id, t.chunk_id, t.document_id, t.chunk_text, r.can_view, "
    f"{sq_l2('cv.v', 'qv.v')} AS score FROM req r JOIN qe_vec qv ON qv.id = r.query_id "
    f"JOIN t ON t.tenant_id = r.tenant_id JOIN ce_vec cv ON cv.id = t.chunk_id), "
    f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank "
    f"FROM hits) WHERE rank <= {K_TOP}), "
    f"sp AS (SELECT *, {resolve(candidates('chunk_text'))} AS kept FROM top) ")


@query("q1_secure_search", "Q1, J2, J5, P8, V5, V6 (benchmark texts as queries, k=5)",
       Q1_SQL + f"SELECT query_id, rank, chunk_id, document_id, round(score, 6) AS score, CASE WHEN can_view THEN chunk_text "
       f"ELSE {rebuild('chunk_text', 'kept', lambda s: mask_label(s + '.type'))} END AS text FROM sp")
def q1(spark, sf):
    req = _requests(spark, sf)
    perms = _permissions(spark, req)
    docs = _seeded(spark, sf)
    ch = K.chunk_table(docs, keep_cols=["tenant_id"])
    emb = V.embed_batch(ch, V.HashEmbedder(DIM), text_col="chunk_text")
    index = cut(emb.select("tenant_id", F.col("chunk_id").alias("vector_id"), "embedding", "document_id", "start", "end"))
    res = S.secure_search_offsets(req, perms, index, docs.select("doc_id", "text"), V.HashEmbedder(DIM), k=K_TOP)
    return res.withColumn("score", F.round("score", 6))


@query("a10_search_metrics", "A10 (query length, results count, top_k)",
       Q1_SQL + f"SELECT b.item_id AS query_id, length(b.text) AS query_length, count(top.query_id) AS results_count, "
       f"{K_TOP} AS top_k FROM benchmark b LEFT JOIN top ON top.query_id = b.item_id GROUP BY b.item_id, b.text")
def a10(spark, sf):
    req = _requests(spark, sf)
    return S.search_metrics(req, q1(spark, sf), K_TOP)


_RECORDS_SQL = (
    _SEEDED_CHUNKS + ", t AS (SELECT c.*, d.source AS tenant_id, " + resolve(candidates("c.chunk_text")) + " AS kept FROM chunks c "
    "JOIN documents d ON d.doc_id = c.document_id), "
    "rec AS (SELECT *, " + rebuild("chunk_text", "kept", lambda s: mask_label(s + ".type")) + " AS masked, len(kept) AS n_redactions, "
    "array_to_string(list_reverse(list_transform(kept, lambda x: x.type || '@' || CAST(x.start AS VARCHAR))), ',') AS redactions FROM t) ")


def records_df(spark, sf):
    return S.chunk_records(_seeded(spark, sf), keep_cols=["tenant_id"])


def _flat(metadata):
    """Redaction metadata in columns that any engine can compare."""
    return [F.size(metadata).cast("long").alias("n_redactions"),
            F.array_join(F.transform(metadata, lambda r: F.concat(r["type"], F.lit("@"), r["original_start"].cast("string"))), ",").alias("redactions")]


S6_SQL = (_RECORDS_SQL + "SELECT chunk_id, document_id, tenant_id, chunk_index, start, \"end\", chunk_id AS text_hash, masked AS chunk_text, "
          "chunk_text AS original_text, n_redactions, redactions, chunk_id AS vector_id FROM rec")


def flat_records(records):
    return records.select("chunk_id", "document_id", "tenant_id", "chunk_index", "start", "end", "text_hash", "chunk_text", "original_text",
                          *_flat(F.col("redaction_metadata")), "vector_id")


@query("s6_chunk_records", "S6 (redacted and original text, redaction metadata, vector id)", S6_SQL)
def s6(spark, sf):
    return flat_records(records_df(spark, sf))


@query("j2_hit_metadata", "J2, S9 (vector metadata, chunk and document of every hit)",
       Q1_SQL.replace(_SEEDED_CHUNKS, _RECORDS_SQL.rstrip() + " ", 1).replace(", t AS (SELECT c.chunk_id, d.source AS tenant_id, c.document_id, c.chunk_text FROM chunks c "
                                                                   "JOIN documents d ON d.doc_id = c.document_id), ", ", ", 1) +
       ", pos AS (SELECT chunk_id, row_number() OVER (PARTITION BY tenant_id ORDER BY chunk_id) - 1 AS position FROM t) "
       "SELECT top.query_id, top.rank, top.chunk_id AS vector_id, round(top.score, 6) AS score, pos.position, 'v1' AS embedding_version, top.chunk_id, "
       "rec.document_id, 'doc-' || CAST(rec.document_id AS VARCHAR) || '.txt' AS document_name, rec.start, rec.\"end\", rec.masked AS text, "
       "rec.n_redactions, rec.redactions FROM top JOIN pos ON pos.chunk_id = top.chunk_id JOIN rec ON rec.chunk_id = top.chunk_id")
def j2(spark, sf):
    records = stored(records_df(spark, sf), "records")
    embedder = V.HashEmbedder(DIM)
    index = cut(V.build_index(V.embed_batch(records, embedder, text_col="original_text")))
    asked = V.embed_batch(_requests(spark, sf), embedder, text_col="query", out_col="query_embedding")
    hits = V.knn(index, asked.select("query_id", "tenant_id", "query_embedding"), k=K_TOP)
    docs = tables.documents(spark, sf).select(F.col("doc_id").alias("document_id"),
                                              F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"))
    found = S.hit_metadata(hits, V.vector_metadata(index), records, docs)
    return found.select("query_id", "rank", "vector_id", F.round("score", 6).alias("score"), "position", "embedding_version", "chunk_id", "document_id",
                        "document_name", "start", "end", "text", *_flat(F.col("redaction_metadata")))


# --- summaries -----------------------------------------------------------------

_FULL_SQL = (
    _SEEDED_CHUNKS + ", ck AS (SELECT c.*, " + resolve(candidates("chunk_text")) + " AS kept FROM chunks c), "
    "red AS (SELECT document_id, chunk_index, CASE WHEN " + _CAN_VIEW.format(x="document_id") + " THEN chunk_text ELSE "
    + rebuild("chunk_text", "kept", lambda s: mask_label(s + ".type")) + " END AS txt FROM ck), "
    "fulltext AS (SELECT document_id AS doc_id, string_agg(txt, chr(10) || chr(10) ORDER BY chunk_index) AS ft "
    "FROM red GROUP BY document_id) ")


def _strip_sql(x):
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def _finish_sql(x):
    return f"(CASE WHEN {x} <> '' AND NOT ends_with({x}, '.') THEN {x} || '.' ELSE {x} END)"


def _words_sql(query_text: str | None):
    if query_text is None:
        return "[" + ", ".join(q(k) for k in P.HIGHLIGHT_KEYWORDS) + "]"
    return "[" + ", ".join(q(w) for w in query_text.lower().split()) + "]"


def _has_any(s, words):
    return f"len(list_filter({words}, lambda w: strpos(lower({s}), w) > 0)) > 0"


def _summary_a_sql(query_text):
    w = _words_sql(query_text)
    return (_FULL_SQL + ", sp AS (SELECT doc_id, string_split(ft, '. ') AS s FROM fulltext) "
            f"SELECT doc_id, {_finish_sql('array_to_string(list_slice(s, 1, 3), ' + q('. ') + ')')} AS summary, "
            f"array_to_string(list_transform(list_slice(list_filter(list_slice(s, 1, 10), lambda x: {_has_any('x', w)}), "
            f"1, 3), lambda x: {_strip_sql('x')}), ' || ') AS highlights FROM sp")


def _summary_b_sql(query_text):
    if query_text is None:
        return (_FULL_SQL + ", sp AS (SELECT doc_id, string_split(ft, '.') AS s FROM fulltext) "
                f"SELECT doc_id, {_finish_sql('array_to_string(list_slice(s, 1, 3), ' + q('. ') + ')')} AS summary, "
                f"array_to_string(list_filter(list_transform(list_slice(s, 2, 4), lambda x: {_strip_sql('x')}), "
                f"lambda x: x <> ''), ' || ') AS highlights FROM sp")
    w = _words_sql(query_text)
    return (_FULL_SQL + ", sp AS (SELECT doc_id, list_slice(list_transform(list_filter(string_split(ft, '.'), "
            f"lambda x: {_has_any('x', w)}), lambda x: {_strip_sql('x')}), 1, 5) AS r FROM fulltext) "
            f"SELECT doc_id, {_finish_sql('array_to_string(list_slice(r, 1, 3), ' + q('. ') + ')')} AS summary, "
            f"array_to_string(list_slice(r, 1, 3), ' || ') AS highlights FROM sp")


FOCUS_QUERY = "mail born"


def _summaries(spark, sf, kind: str, query_text):
    d = _seeded(spark, sf)
    d = d.select("doc_id", "text", (F.col("doc_id") % 4).isin(0, 3).alias("can_view"))
    qcol = F.lit(query_text).cast("string")
    # A document has no chunks (reference: 404) exactly when its text is
    # blank; filtering on that cheap predicate first keeps the optimizer from
    # pushing a filter on the UDF-derived text below the repartition (which
    # would run the chunk and PII UDFs twice).
    d = d.filter(F.col("text").isNotNull() & (TX.py_strip("text") != ""))
    f = S.with_summary_text(d, "text", "doc_id", "can_view")
    f = f.withColumn("pieces", (S.split_a if kind == "a" else S.split_b)(F.col("full")))
    summary, highlights = (S.summarize_a if kind == "a" else S.summarize_b)(F.col("pieces"), qcol)
    return f.select("doc_id", summary.alias("summary"), F.array_join(highlights, " || ").alias("highlights"))


@query("q2_summary_general", "Q2, Q3 (keyword highlights), P8, J1", _summary_a_sql(None))
def q2(spark, sf):
    return _summaries(spark, sf, "a", None)


@query("q3_highlights_query", "Q3 (query-word highlights), O3", _summary_a_sql(FOCUS_QUERY))
def q3(spark, sf):
    return _summaries(spark, sf, "a", FOCUS_QUERY)


@query("q4_summary_focused", "Q4 (query-focused summary B)", _summary_b_sql(FOCUS_QUERY))
def q4(spark, sf):
    return _summaries(spark, sf, "b", FOCUS_QUERY)


@query("q5_summary_general_b", "Q5 (general summary B)", _summary_b_sql(None))
def q5(spark, sf):
    return _summaries(spark, sf, "b", None)


@query("c6_chunk_lookup", "J9, C5, C6 (every chunk, by id and tenant; original text only on request)",
       _SEEDED_CHUNKS + ", t AS (SELECT c.*, d.source AS tenant_id FROM chunks c JOIN documents d "
       "ON d.doc_id = c.document_id), req AS (SELECT chunk_id, tenant_id, document_id % 2 = 0 AS include_original "
       "FROM t), j AS (SELECT t.*, r.include_original, " + resolve(candidates("t.chunk_text")) +
       " AS kept FROM t JOIN req r ON r.chunk_id = t.chunk_id AND r.tenant_id = t.tenant_id) "
       "SELECT chunk_id, tenant_id, document_id, start, \"end\", "
       + rebuild("chunk_text", "kept", lambda s: mask_label(s + ".type")) + " AS text, "
       "CASE WHEN include_original THEN chunk_text END AS original_text FROM j")
def c6(spark, sf):
    ch = cut(K.chunk_table(_seeded(spark, sf), keep_cols=["tenant_id"]))
    req = ch.select(
        "chunk_id", "tenant_id", (F.col("document_id") % 2 == 0).alias("include_original"))
    return S.chunk_lookup(ch, req)

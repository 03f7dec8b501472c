"""Queries for PII detection and redaction.

They read the seeded view of `documents` (SURVEY §5.1: the corpus has no
ssn/date/zip values under the reference patterns) except where noted.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators import pii
from quire.plans.catalog import query
from quire.plans.sqlfrag import candidates, hash_token, mask_label, rebuild, resolve
from quire.sources import tables

_RESOLVED = (f"WITH d AS ({tables.SEEDED_SQL}), "
             f"c AS (SELECT doc_id, tenant_id, text, {resolve(candidates('text'))} AS kept FROM d)")
_SPAN_ROWS = (f"{_RESOLVED}, s AS (SELECT doc_id, tenant_id, unnest(generate_series(0, len(kept) - 1)) AS span_index, "
              f"unnest(kept) AS s FROM c) ")


def _seeded(spark, sf):
    return tables.seeded_documents(tables.documents(spark, sf))


@query("p1_pii_spans", "P1, P3",
       _SPAN_ROWS + "SELECT doc_id, span_index, s.type AS pii_type, s.start AS start, s.\"end\" AS \"end\", "
       "s.text AS span_text, CAST(0.9 AS DOUBLE) AS confidence, 'regex' AS method FROM s")
def p1(spark, sf):
    t = pii.span_table(_seeded(spark, sf), ["doc_id"])
    return t.withColumnRenamed("type", "pii_type").withColumnRenamed("text", "span_text")


_RAW = (f"WITH c AS (SELECT doc_id, {resolve(candidates('text'))} AS kept FROM documents), "
        f"s AS (SELECT doc_id, unnest(kept) AS s FROM c) "
        f"SELECT doc_id, s.type AS pii_type, s.start AS start, s.\"end\" AS \"end\", s.text AS span_text FROM s")


@query("p1_pii_spans_corpus", "P1, P3 on the unseeded corpus", _RAW)
def p1_raw(spark, sf):
    t = pii.span_table(tables.load(spark, sf, "documents"), ["doc_id"])
    return t.select("doc_id", F.col("type").alias("pii_type"), "start", "end", F.col("text").alias("span_text"))


@query("p1_pii_spans_pages", "P1, P3 on raw web pages",
       f"WITH c AS (SELECT page_id, {resolve(candidates('html'))} AS kept FROM pages), "
       f"s AS (SELECT page_id, unnest(kept) AS s FROM c) "
       f"SELECT page_id, s.type AS pii_type, s.start AS start, s.\"end\" AS \"end\", s.text AS span_text FROM s")
def p1_pages(spark, sf):
    t = pii.span_table(tables.load(spark, sf, "pages"), ["page_id"], text_col="html")
    return t.select("page_id", F.col("type").alias("pii_type"), "start", "end", F.col("text").alias("span_text"))


_TURNS = ("SELECT conv_id, turn, text || ' ssn 123-45-' || lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0') || ' mail c' || CAST(conv_id AS VARCHAR) "
          "|| '@example.com' AS text FROM conversations")


@query("p1_pii_spans_conversations", "P1, P3 on conversation turns (seeded: the given turns hold no match)",
       f"WITH c AS (SELECT conv_id, turn, {resolve(candidates('text'))} AS kept FROM ({_TURNS})), "
       f"s AS (SELECT conv_id, turn, unnest(kept) AS s FROM c) "
       f"SELECT conv_id, turn, s.type AS pii_type, s.start AS start, s.\"end\" AS \"end\", s.text AS span_text FROM s")
def p1_conversations(spark, sf):
    c = F.col("conv_id")
    seeded = F.concat("text", F.lit(" ssn 123-45-"), F.lpad((c % 10000).cast("string"), 4, "0"), F.lit(" mail c"), c.cast("string"), F.lit("@example.com"))
    t = pii.span_table(tables.load(spark, sf, "conversations").withColumn("text", seeded), ["conv_id", "turn"])
    return t.select("conv_id", "turn", F.col("type").alias("pii_type"), "start", "end", F.col("text").alias("span_text"))


# Entities as a model would give them: the first word, and the word "card" with
# what follows it (it starts before the card number's own span, so it wins).
_ENTITY = ("{{'start': CAST({start} AS INTEGER), 'neg_conf': CAST(-0.85 AS DOUBLE), 'ord': {ord}, 'type': '{type}', 'end': CAST({start} + length({text}) AS INTEGER), "
           "'text': {text}}}")
_N = len(P.PII_PATTERNS)
_WITH_ENTITIES = (f"list_sort(list_concat({candidates('text')}, list_filter([" +
                  _ENTITY.format(start="0", ord=_N, type="person", text="regexp_extract(text, '^[^ ]+', 0)") + ", " +
                  _ENTITY.format(start="(strpos(text, 'card ') - 1)", ord=_N + 1, type="product", text="substring(text, strpos(text, 'card '), 9)") +
                  "], lambda x : x.text <> '')))")


@query("p2_entity_spans", "P2, U3 (entity spans merged with the patterns' before overlaps are resolved)",
       f"WITH d AS ({tables.SEEDED_SQL}), c AS (SELECT doc_id, {resolve(_WITH_ENTITIES)} AS kept FROM d WHERE text IS NOT NULL), "
       "s AS (SELECT doc_id, unnest(kept) AS s FROM c) "
       "SELECT doc_id, s.type AS pii_type, s.start AS start, s.\"end\" AS \"end\", s.text AS span_text FROM s")
def p2(spark, sf):
    d = _seeded(spark, sf).where("text IS NOT NULL")

    def entity(kind, start, text):
        return F.struct(F.lit(kind).alias("type"), start.cast("int").alias("start"), (start + F.char_length(text)).cast("int").alias("end"), text.alias("text"),
                        F.lit(0.85).alias("confidence"), F.lit("entity").alias("method"))
    at = F.instr("text", "card ")
    found = F.filter(F.array(entity("person", F.lit(0), F.regexp_extract("text", "^[^ ]+", 0)),
                             entity("product", at - 1, F.expr("substring(text, instr(text, 'card '), 9)"))), lambda x: x["text"] != "")
    spans = d.select("doc_id", F.explode(pii.detect_pii(F.col("text"), extra_spans=found)).alias("s"))
    return spans.select("doc_id", F.col("s.type").alias("pii_type"), "s.start", "s.end", F.col("s.text").alias("span_text"))


@query("p4_mask_redaction", "P1, P3, P4",
       _RESOLVED + f" SELECT doc_id, {rebuild('text', 'kept', lambda s: mask_label(s + '.type'))} AS redacted_text, "
       f"len(kept) AS n_redactions FROM c")
def p4(spark, sf):
    return pii.redact_table(_seeded(spark, sf), ["doc_id"], mode="mask")


@query("p5_hash_redaction", "P1, P3, P5 (salt = tenant)",
       _RESOLVED + f" SELECT doc_id, {rebuild('text', 'kept', lambda s: hash_token(s, 'tenant_id'))} AS redacted_text,"
       f" len(kept) AS n_redactions FROM c")
def p5(spark, sf):
    return pii.redact_table(_seeded(spark, sf), ["doc_id"], mode="hash", salt_col="tenant_id")


@query("p6_remove_redaction", "P1, P3, P6",
       _RESOLVED + f" SELECT doc_id, {rebuild('text', 'kept', lambda s: chr(39) * 2)} AS redacted_text, "
       f"len(kept) AS n_redactions FROM c")
def p6(spark, sf):
    return pii.redact_table(_seeded(spark, sf), ["doc_id"], mode="remove")


@query("p7_applied_redactions", "P7",
       _SPAN_ROWS + "SELECT doc_id, CAST(len(c2.kept) - 1 - span_index AS INTEGER) AS ordinal, "
       "s.start AS original_start, s.\"end\" AS original_end, s.text AS original_text, "
       f"{mask_label('s.type')} AS replacement, s.type AS type, 'mask' AS mode, CAST(0.9 AS DOUBLE) AS confidence "
       "FROM s JOIN c c2 USING (doc_id)")
def p7(spark, sf):
    return pii.applied_table(_seeded(spark, sf).select("doc_id", "text"), ["doc_id"], mode="mask")


@query("p9_pii_inventory", "P9 (rollup)",
       _SPAN_ROWS + ", per_doc AS (SELECT tenant_id, doc_id, s.type AS pii_type, count(*) AS n FROM s GROUP BY ALL) "
       "SELECT tenant_id, pii_type, sum(n) AS n_spans, count(*) AS n_documents FROM per_doc "
       "GROUP BY ROLLUP (tenant_id, pii_type)")
def p9(spark, sf):
    return pii.pii_inventory(_seeded(spark, sf))


@query("p9_redaction_flags", "P9, A4 flag",
       _RESOLVED + " SELECT doc_id, len(kept) > 0 AS redaction_applied, len(kept) AS n_spans FROM c")
def p9_flags(spark, sf):
    return pii.redaction_flags(tables.documents(spark, sf).transform(tables.seeded_documents))


@query("p10_pseudonym_links", "P5, P10",
       _SPAN_ROWS + f", tok AS (SELECT DISTINCT tenant_id, doc_id, s.type AS pii_type, {hash_token('s', 'tenant_id')} "
       "AS token FROM s) SELECT tenant_id, pii_type, token, count(*) AS n_documents, min(doc_id) AS first_doc_id "
       "FROM tok GROUP BY ALL HAVING count(*) > 1")
def p10(spark, sf):
    return pii.pseudonym_links(_seeded(spark, sf))


_EXPECTED = "[" + ", ".join(f"'{t}'" for t, _ in P.PII_PATTERNS) + "]"


P11_SQL = (_RESOLVED + f", e AS (SELECT doc_id, unnest({_EXPECTED}) AS pii_type, "
           "list_distinct(list_transform(kept, lambda k: k.type)) AS found FROM c) "
           "SELECT pii_type, count(*) AS expected, sum(CASE WHEN list_contains(found, pii_type) THEN 1 ELSE 0 END) "
           "AS detected, (floor(CAST(sum(CASE WHEN list_contains(found, pii_type) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) "
           "* 1000000.0 + 0.5) / 1000000.0) AS recall "
           "FROM e GROUP BY pii_type")


@query("p11_detector_recall", "P11, U2", P11_SQL)
def p11(spark, sf):
    d = _seeded(spark, sf).withColumn("expected", F.array(*[F.lit(t) for t, _ in P.PII_PATTERNS]))
    return pii.detector_recall(d, "expected")


@query("j7_span_overlaps", "J7 (interval overlap of candidate spans, seeded with one overlap a document)",
       "WITH c AS (SELECT doc_id, " + candidates("text") + " AS cand FROM (SELECT doc_id, text || ' a.123-45-' || "
       "lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '@x.com' AS text FROM documents)), "
       "s AS (SELECT doc_id, unnest(generate_series(1, len(cand))) AS i, unnest(cand) AS a, cand FROM c) "
       "SELECT doc_id, a.type AS type_a, a.start AS start_a, a.\"end\" AS end_a, b.type AS type_b, "
       "b.start AS start_b, b.\"end\" AS end_b FROM (SELECT doc_id, a, unnest(list_slice(cand, i + 1, len(cand))) AS b "
       "FROM s) WHERE b.start < a.\"end\"")
def j7(spark, sf):
    # every document ends with an address that a number's span lies in
    number = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    d = tables.load(spark, sf, "documents").withColumn("text", F.concat("text", F.lit(" a.123-45-"), number, F.lit("@x.com")))
    return pii.overlap_report(d)

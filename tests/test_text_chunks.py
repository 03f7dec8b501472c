import pytest
from pyspark.sql import functions as F

from quire.functions import text as TX
from quire.operators import chunking as K
from quire.sources import tables
from tests import reference_impl as R
from tests.conftest import SF_SMALL


def one(spark, col_fn, text):
    return spark.createDataFrame([(text,)], "text string").select(col_fn(F.col("text")).alias("o")).first().o


def test_normalize_whitespace(spark):
    assert one(spark, TX.normalize_whitespace, "This  has    multiple\n\n\nspaces\tand\ttabs.") == \
        "This has multiple spaces and tabs."
    assert one(spark, TX.normalize_whitespace, None) == ""
    assert one(spark, TX.normalize_whitespace, " x y ") == "x y"


def test_clean_text(spark):
    out = one(spark, TX.clean_text_for_embedding, "Text with\x00control\x01chars and ™special© symbols")
    assert "\x00" not in out and "\x01" not in out and "TM" in out
    assert one(spark, TX.clean_text_for_embedding, "Wait... what?? Page 12 on 1/2/2023!!") == \
        "Wait... what? on [DATE]!"


def test_text_ops_match_python_on_corpus(spark):
    d = tables.load(spark, SF_SMALL, "documents").select("doc_id", "text")
    rows = d.select("text", TX.normalize_whitespace("text").alias("n"), TX.clean_text_for_embedding("text").alias("c"),
                    TX.sentences("text").alias("s"), TX.truncate_text("text", 100).alias("t"),
                    TX.text_quality("text").alias("q")).collect()
    import re
    for r in rows:
        assert r.n == R.normalize_whitespace(r.text)
        assert r.c == R.clean(r.text)
        sents = [x.strip() for x in re.split(r"[.!?]+\s+", r.text) if len(x.strip()) > 10]
        assert list(r.s) == sents
        t = r.text
        if len(t) > 100:
            ls = t[:100].rfind(" ")
            exp = (t[:ls] if ls > 80 else t[:100]) + "..."
        else:
            exp = t
        assert r.t == exp
        ws = t.lower().split()
        assert r.q.word_count == len(ws) and r.q.unique_chars == len(set(t.lower()))


def test_quality_flags(spark):
    q = one(spark, TX.text_quality, "")
    assert (q.is_valid, q.length, q.word_count, q.issues) == (False, 0, None, ["empty_text"])
    q = one(spark, TX.text_quality, "spam " * 20)
    assert set(q.issues) == {"low_diversity", "excessive_repetition"}
    assert one(spark, TX.estimate_tokens, "abcdefghi") == 2


@pytest.mark.parametrize("size,overlap", [(1000, 200), (50, 10), (30, 15), (300, -5)])
def test_chunker_invariants(spark, size, overlap):
    d = tables.load(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = {}
    for r in K.chunk_table(d, size=size, overlap=overlap).collect():
        got.setdefault(r.document_id, []).append((r.chunk_id, r.chunk_text, r.start, r.end, r.length, r.chunk_index))
    for r in d.collect():
        R.check_chunks(r.text, sorted(got.get(r.doc_id, []), key=lambda x: x[5]), size, overlap, str(r.doc_id))


def test_chunk_golden(spark):
    df = spark.createDataFrame([(1, "Word one. Word two. Word three. Word four. Word five. Word six."),
                                (2, ""), (3, "   \n\t  ")], "doc_id long, text string")
    ch = K.chunk_table(df, size=30, overlap=15).collect()
    assert {r.document_id for r in ch} == {1}
    c1 = sorted([r for r in ch if r.document_id == 1], key=lambda r: r.chunk_index)
    assert all(a.end > b.start for a, b in zip(c1, c1[1:]))  # consecutive spans overlap
    with pytest.raises(ValueError):
        K.chunk_array(F.col("text"), size=100, overlap=100)


def test_chunk_checks(spark):
    d = tables.load(spark, SF_SMALL, "documents").select("doc_id", "text")
    ch = K.chunk_table(d)
    assert K.validate_chunks(ch).filter(~F.col("valid")).count() == 0
    nb = K.chunk_neighbours(ch).filter(F.col("prev_end").isNotNull())
    assert nb.filter(F.col("overlap_chars") < 0).count() == 0  # coverage: no holes between chunks
    assert K.dedup_chunks(ch).count() == ch.select("chunk_id").distinct().count()


def test_cleaning_report_runs_each_rule_once(spark):
    """Every rule is evaluated once a row: the plan names each pattern once
    for the text (nested stages repeated the first rules over a hundred times)."""
    from quire.functions import text as TX
    from quire.operators import corpus
    rows = [("a", "Wait.... what?? Page 12 on 1/2/2024!!  x\x07"), ("a", None), ("a", ""), ("b", "caf\u00e9 \ufb01 Page x / .. ! ?"), (None, "!!")]
    docs = spark.createDataFrame(rows, "tenant_id string, text string")
    report = corpus.cleaning_report(docs)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2 * len(TX.clean_steps())
    expected = {}
    stages = [r.asDict() for r in docs.select("tenant_id", F.coalesce("text", F.lit("")).alias("text"),
                                              *[t.alias(n) for n, t in TX.clean_rules(F.col("text"))]).collect()]
    for r in stages:
        before = r["text"]
        for name, _ in TX.clean_steps():
            n = expected.setdefault((r["tenant_id"], name), [0, 0])
            n[0] += before != r[name]
            n[1] += len(before) - len(r[name])
            before = r[name]
    got = {(r["tenant_id"], r["rule"]): [r["rows_changed"], r["chars_removed"]] for r in report.collect()}
    assert got == expected and expected["a", "date"] == [1, 2] and expected["a", "page_number"] == [1, 7]
    assert report.columns == ["tenant_id", "rule", "rows_changed", "chars_removed"]


def test_strip_without_regex(spark):
    """str.strip() exactly, and without a regex over the whole text."""
    import sys
    assert set(TX.WS_CHARS) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}
    texts = ["", " ", "a", None, TX.WS_CHARS, *[f"{w}{w}a {w} b\u200b{w}\n{w}" for w in TX.WS_CHARS], "\u200b x \ufeff", "\u00e9\u2003"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", TX.py_strip("t").alias("s"))
    assert all(r.s == (None if r.t is None else r.t.strip()) for r in df.collect())
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()

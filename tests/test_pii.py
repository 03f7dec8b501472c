import hashlib

import pytest
from pyspark.sql import functions as F

from quire.operators import pii
from quire.sources import tables
from tests import reference_impl as R
from tests.conftest import SF_SMALL


def spans_of(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "text string")
    return [r.asDict() for r in df.select(F.explode(pii.detect_pii(F.col("text"), **kw)).alias("s"))
            .select("s.*").collect()]


def redact_of(spark, text, mode, salt="default"):
    df = spark.createDataFrame([(text,)], "text string").withColumn("s", pii.detect_pii(F.col("text")))
    return df.select(pii.redact(F.col("text"), F.col("s"), mode, salt).alias("r")).first().r


@pytest.mark.parametrize("text,types", [
    ("Contact John at john.doe@example.com for more information.", ["email"]),
    ("Phone: 555-123-4567", ["phone"]),
    ("Contact: +1-555-123-4567", ["phone"]),
    ("Call me at (555) 123-4567", []),
    ("SSN: 123-45-6789 is confidential information.", ["ssn"]),
    ("Credit card number 4532-1234-5678-9012 should be protected.", ["credit_card"]),
    ("This is a normal business document with no sensitive information.", []),
    ("John Doe (john.doe@example.com) phone: (555) 123-4567, SSN: 123-45-6789", ["email", "ssn"]),
    ("12345-6789", ["ssn"]),
    ("a.123-45-6789@x.com", ["email"]),
    ("Sprä5551234567", []),
    ("Contact: alice@example.com", ["email"]),
    ("Phone: +1-202-555-0123", ["phone"]),
])
def test_golden_detection(spark, text, types):
    assert [s["type"] for s in spans_of(spark, text)] == types


def test_code_point_offsets(spark):
    s = spans_of(spark, "😀 123-45-6789")
    assert [(x["type"], x["start"], x["end"]) for x in s] == [("ssn", 2, 13)]


def test_extended_profile_finds_parenthesised_phone(spark):
    assert [s["type"] for s in spans_of(spark, "Call me at (555) 123-4567", profile="extended")] == ["phone"]


def test_redaction_modes(spark):
    assert redact_of(spark, "Contact john.doe@example.com for details.", "mask") == "Contact [EMAIL] for details."
    h1 = redact_of(spark, "Email: test@example.com", "hash")
    h2 = redact_of(spark, "Email: test@example.com", "hash")
    h3 = redact_of(spark, "Email: test@example.com", "hash", salt="other")
    digest = hashlib.sha256(b"default:test@example.com:email").hexdigest()[:8]
    assert h1 == h2 == f"Email: [EM:{digest}]" and h3 != h1
    assert redact_of(spark, "a.123-45-6789@x.com", "mask") == "[EMAIL]"
    txt = "Document title.\n\nContact: john@example.com\n\nNext paragraph."
    assert redact_of(spark, txt, "mask").count("\n") == txt.count("\n")
    assert "john.smith@hospital.com" not in redact_of(spark, "Dr. John Smith's email john.smith@hospital.com", "mask")
    assert redact_of(spark, "SSN 123-45-6789 ok", "remove") == "SSN  ok"


def test_unknown_mode_rejected_even_without_pii():
    with pytest.raises(ValueError):
        pii.redact(F.col("t"), F.col("s"), "shred")


def test_extra_entity_spans_merge(spark):
    # An entity span overlapping a regex span loses on equal start only
    # through confidence (0.9 > 0.7); a disjoint one is kept.
    df = spark.createDataFrame([("Alice 123-45-6789",)], "text string").withColumn(
        "ents", F.array(
            F.struct(F.lit("person").alias("type"), F.lit(0).alias("start"), F.lit(5).alias("end"),
                     F.lit("Alice").alias("text"), F.lit(0.7).alias("confidence"), F.lit("spacy").alias("method")),
            F.struct(F.lit("date").alias("type"), F.lit(6).alias("start"), F.lit(12).alias("end"),
                     F.lit("123-45").alias("text"), F.lit(0.7).alias("confidence"), F.lit("spacy").alias("method"))))
    r = df.select(pii.detect_pii(F.col("text"), extra_spans=F.col("ents")).alias("s")).first().s
    assert [(x.type, x.start) for x in r] == [("person", 0), ("ssn", 6)]
    m = df.withColumn("s", pii.detect_pii(F.col("text"), extra_spans=F.col("ents"))) \
        .select(pii.redact(F.col("text"), F.col("s"), "mask").alias("m")).first().m
    assert m == "[NAME] [SSN]"


def test_matches_plain_python_on_corpus(spark):
    docs = tables.seeded_documents(tables.documents(spark, SF_SMALL)).select("doc_id", "text")
    got = docs.withColumn("s", pii.detect_pii(F.col("text"))).select(
        "doc_id", "text", "s", pii.redact(F.col("text"), F.col("s"), "mask").alias("m")).collect()
    for r in got:
        exp = R.detect(r.text)
        assert [(x.type, x.start, x.end, x.text) for x in r.s] == [(e["type"], e["start"], e["end"], e["text"])
                                                                     for e in exp]
        assert r.m == R.redact(r.text, exp, "mask")


def test_jvm_engine_equals_python_engine(spark):
    docs = tables.seeded_documents(tables.documents(spark, SF_SMALL)).select("doc_id", "text")
    a = docs.select("doc_id", pii.detect_pii(F.col("text"), engine="python").alias("s"))
    b = docs.select("doc_id", pii.detect_pii(F.col("text"), engine="jvm").alias("s"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_invariants_disjoint_and_gaps(spark):
    docs = tables.seeded_documents(tables.documents(spark, SF_SMALL)).select("doc_id", "text")
    d = docs.withColumn("s", pii.detect_pii(F.col("text"))).withColumn(
        "r", pii.redact(F.col("text"), F.col("s"), "remove")).collect()
    for row in d:
        spans = row.s
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))
        gaps, prev = [], 0
        for s in spans:
            gaps.append(row.text[prev:s.start])
            prev = s.end
        gaps.append(row.text[prev:])
        assert row.r == "".join(gaps)


def test_inventory_counts_sum(spark):
    docs = tables.seeded_documents(tables.documents(spark, SF_SMALL))
    inv = pii.pii_inventory(docs)
    total = inv.filter(F.col("tenant_id").isNull() & F.col("pii_type").isNull()).first()
    per_doc = docs.select(F.size(pii.detect_pii(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0]
    assert total.n_spans == per_doc


def test_examples_source(spark, scratch):
    import json
    import os
    p = os.path.join(scratch, "ex.json")
    with open(p, "w") as f:
        json.dump([{"text": "Contact: alice@example.com", "expected": [{"type": "EMAIL"}]},
                   {"text": "Phone: +1-202-555-0123", "expected": [{"type": "PHONE"}]}], f)
    from quire.sources.sinks import read_pii_examples
    ex = read_pii_examples(spark, p).withColumn("doc_id", F.monotonically_increasing_id())
    rec = pii.detector_recall(ex, "expected_types").collect()
    assert {r.pii_type: r.recall for r in rec} == {"email": 1.0, "phone": 1.0}


def test_overlap_resolution_randomised(spark):
    """P3 against a plain-Python statement of the rule, on random regex +
    entity spans with many overlaps (ties in start broken by confidence,
    then pattern order)."""
    import random
    random.seed(11)
    pieces = ["123-45-6789", "555-123-4567", "a.b@x.com", "4532 1234 5678 9012", "01/02/1990", "90210",
              "12345-6789", "word", " ", ", "]
    rows = []
    for i in range(300):
        text = "".join(random.choice(pieces) for _ in range(random.randint(1, 12)))
        ents = []
        for _ in range(random.randint(0, 4)):
            a = random.randint(0, max(0, len(text) - 1))
            b = random.randint(a + 1, len(text)) if len(text) > a else a + 1
            ents.append(("person", a, b, text[a:b], 0.7, "spacy"))
        rows.append((i, text, ents))
    df = spark.createDataFrame(rows, "id long, text string, ents array<struct<type:string,start:int,end:int,"
                                     "text:string,confidence:double,method:string>>")
    got = {r.id: [(s.type, s.start, s.end) for s in r.s] for r in
           df.select("id", pii.detect_pii(F.col("text"), extra_spans=F.col("ents")).alias("s")).collect()}
    for i, text, ents in rows:
        cand = [dict(type=t, start=a, end=b, confidence=c, order=o)
                for o, t, a, b, c in [(k, s["type"], s["start"], s["end"], s["confidence"])
                                      for k, s in enumerate(R.detect_all(text))]]
        cand += [dict(type=t, start=a, end=b, confidence=c, order=100 + j)
                 for j, (t, a, b, _, c, _) in enumerate(ents)]
        cand.sort(key=lambda s: (s["start"], -s["confidence"], s["order"]))
        kept = []
        for s in cand:
            if not any(s["start"] < k["end"] and s["end"] > k["start"] for k in kept):
                kept.append(s)
        assert got[i] == [(k["type"], k["start"], k["end"]) for k in sorted(kept, key=lambda s: s["start"])], text


def test_many_spans_stay_linear_and_hold_together(spark):
    """30,000 spans of one document: the one-pass text, the text rebuilt from
    the spans and the plain expectation agree, in seconds."""
    import time

    n = 30_000
    df = spark.createDataFrame([(1, " ".join(["a@b.co"] * n)), (2, None), (3, "")], "doc_id long, text string")
    began = time.time()
    one = {r[0]: (r[1], r[2]) for r in pii.redact_table(df, ["doc_id"]).collect()}
    two = {r[0]: r[1] for r in pii.with_pii(df).select("doc_id", pii.redact("text", F.col("pii_spans"))).collect()}
    assert one[1] == (" ".join(["[EMAIL]"] * n), n) and two[1] == one[1][0]
    assert one[2] == (None, 0) and two[2] is None and one[3] == ("", 0) and two[3] == ""
    assert time.time() - began < 30

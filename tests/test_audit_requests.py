import hashlib
import hmac
import os

from pyspark.sql import functions as F

from quire.operators import audit as AU
from quire.operators import requests as RQ
from quire.sources import tables
from tests import reference_impl as R
from tests.conftest import SF_SMALL

KEY = "test-key"


def test_hmac_matches_python(spark):
    msgs = ["", "hello", "ünïcødé 😀", "x" * 500]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [r.h for r in df.select(AU.hmac_sha256(F.col("m"), KEY).alias("h")).collect()]
    assert got == [hmac.new(KEY.encode(), m.encode(), hashlib.sha256).hexdigest() for m in msgs]
    long_key = "k" * 100
    got = df.select(AU.hmac_sha256(F.col("m"), long_key).alias("h")).first().h
    assert got == hmac.new(long_key.encode(), b"", hashlib.sha256).hexdigest()


def test_canonical_is_python_json(spark):
    import json
    ev = {"b": "x\"y", "a": None, "c": "back\\slash"}
    df = spark.createDataFrame([("x\"y", None, "back\\slash")], "b string, a string, c string")
    got = df.select(AU.canonical({k: F.col(k) for k in ev}).alias("c")).first().c
    assert got == json.dumps(ev, sort_keys=True)


def test_seal_verify_and_tamper(spark):
    ev = AU.events_from_requests(tables.load(spark, SF_SMALL, "events"))
    lines = AU.log_line(AU.seal(ev, KEY), keep=["event_id"])
    rep = AU.integrity_report(AU.verify(lines, KEY)).first()
    n = ev.count()
    assert (rep.total_events, rep.valid_signatures) == (n, n)
    first = lines.agg(F.min("event_id")).first()[0]
    flipped = lines.withColumn("line", F.when(F.col("event_id") == first,
                                              F.replace("line", F.lit('"event"'), F.lit('"evenT"')))
                               .otherwise(F.col("line")))
    rep = AU.integrity_report(AU.verify(flipped, KEY)).first()
    assert (rep.valid_signatures, rep.invalid_signatures) == (n - 1, 1)


def test_fixture_log_lines(spark, scratch):
    ev = AU.events_from_requests(tables.load(spark, SF_SMALL, "events")).limit(3)
    sealed = AU.log_line(AU.seal(ev, KEY)).collect()
    good, other, third = [r.line for r in sealed]
    altered = other.replace('"event"', '"EVENT"')
    import json
    d = json.loads(third)
    d.pop("signature")
    unsigned = json.dumps(d)
    lines = [good, altered, unsigned, "{broken json", "", "[1, 2]"]
    path = os.path.join(scratch, "audit")
    AU.write_log(spark.createDataFrame([(x,) for x in lines], "line string"), path)
    back = AU.read_log(spark, path)
    rep = AU.integrity_report(AU.verify(back, KEY)).first()
    assert (rep.total_events, rep.valid_signatures, rep.invalid_signatures, rep.missing_signatures,
            rep.malformed_events) == (5, 1, 1, 1, 2)


def test_limit_needs_order_column(spark):
    import pytest
    df = spark.createDataFrame([("",)], "line string")
    with pytest.raises(ValueError):
        AU.integrity_report(AU.verify(df, KEY), limit=3)


def test_rate_limit_golden(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [("c", base + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 10, 20, 60, 61])]
    df = spark.createDataFrame(rows, "client string, ts timestamp, event_id long")
    r = RQ.rate_limit(df, limit=2, window_seconds=60).orderBy("event_id").collect()
    assert [x.admitted for x in r] == [True, True, False, False, True]
    w = RQ.window_load(df, window_seconds=60).orderBy("event_id").collect()
    assert [x.window_count for x in w] == [1, 2, 3, 4, 4]  # t=60 still counts t=0


def test_rate_limit_matches_python_with_hot_client(spark):
    e = tables.load(spark, SF_SMALL, "events")
    # one client owning every request: the hot-key case
    hot = e.select(F.lit("hot").alias("client"), "ts", "event_id")
    per_user = e.select(F.col("user_id").cast("string").alias("client"), "ts", "event_id")
    for df, limit, window in [(hot, 5, 3600), (per_user, 3, 86400), (hot, 50, 86400)]:
        got = {r.event_id: r.admitted for r in RQ.rate_limit(df, limit=limit, window_seconds=window).collect()}
        rows = sorted(df.collect(), key=lambda r: (r.client, r.ts, r.event_id))
        by = {}
        for r in rows:
            by.setdefault(r.client, []).append(r)
        for c, rs in by.items():
            exp = R.rate_limit([x.ts.timestamp() for x in rs], limit, window)
            assert [got[x.event_id] for x in rs] == exp


def test_window_load_matches_python(spark):
    e = tables.load(spark, SF_SMALL, "events").select(F.lit("hot").alias("client"), "ts", "event_id")
    got = {r.event_id: r.window_count for r in RQ.window_load(e, window_seconds=3600).collect()}
    rows = e.collect()
    ts = sorted(r.ts.timestamp() for r in rows)
    import bisect
    for r in rows:
        t = r.ts.timestamp()
        assert got[r.event_id] == bisect.bisect_right(ts, t) - bisect.bisect_left(ts, t - 3600)


def test_strip_signature_u4(spark):
    ev = AU.events_from_requests(tables.load(spark, SF_SMALL, "events")).limit(5)
    sealed = AU.seal(ev, KEY)
    stripped = AU.strip_signature(sealed)
    assert "signature" not in stripped.columns and "signature_algorithm" not in stripped.columns
    assert "audit_id" in stripped.columns


def test_limit_counts_blank_lines_o4(spark):
    ev = AU.events_from_requests(tables.load(spark, SF_SMALL, "events")).limit(4)
    good = [r.line for r in AU.log_line(AU.seal(ev, KEY)).collect()]
    lines = ["", "  ", good[0], good[1], good[2], good[3]]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    v = AU.verify(df, KEY)
    r = AU.integrity_report(v, limit=3, order_col="line_no").first()
    assert (r.total_events, r.valid_signatures) == (1, 1)  # two blanks use up the limit
    r = AU.integrity_report(v).first()
    assert (r.total_events, r.valid_signatures) == (4, 4)


def test_verification_covers_the_whole_event(spark):
    from quire.operators import audit as AU
    ev = AU.events_from_requests(tables.load(spark, SF_SMALL, "events").limit(5))
    lines = [r.line for r in AU.log_line(AU.seal(ev, "k")).collect()]
    import json
    first = json.loads(lines[0])
    tampered = [json.dumps({**first, "extra": "x"}, separators=(",", ":")),
                json.dumps({**first, "signature_algorithm": "none"}, separators=(",", ":")),
                json.dumps({**first, "request_data": json.loads(first["request_data"] or "{}")}, separators=(",", ":"))]
    df = spark.createDataFrame([(x,) for x in lines + tampered], "line string")
    assert [r.status for r in AU.verify(df, "k").collect()] == ["valid"] * 5 + ["invalid"] * 3
    want = spark.createDataFrame([(first["audit_id"],), ("nope",)], "audit_id string")
    got = {r.audit_id: r.outcome for r in AU.event_by_id(spark.createDataFrame([(x,) for x in lines], "line string"), want, "k").collect()}
    assert got == {first["audit_id"]: "found", "nope": "absent"}


def test_one_clients_requests_in_one_window(spark):
    """Ranks instead of frames: one client, one window width, many tasks."""
    import bisect
    import datetime as dt
    import random

    from quire.operators import requests as RQ
    r = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "one" if i % 9 else f"c{i % 4}", base + dt.timedelta(seconds=r.randrange(4000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, client string, ts timestamp")
    exp = {}
    times = {}
    for _, c, t in rows:
        times.setdefault(c, []).append(t)
    for c in times:
        times[c].sort()
    for i, c, t in rows:
        exp[i] = bisect.bisect_right(times[c], t) - bisect.bisect_left(times[c], t - dt.timedelta(seconds=600))
    for got in (RQ.crowded_load(df, window_seconds=600, num_partitions=16), RQ.window_load(df, window_seconds=600, frame_rows=100),
                RQ.window_load(df, window_seconds=600, frame_rows=2000), RQ.window_load(df, window_seconds=600)):
        assert got.columns == ["event_id", "client", "ts", "window_count"]
        assert {x.event_id: x.window_count for x in got.collect()} == exp


def test_line_numbers_over_files_and_splits(spark, scratch):
    import os

    from quire.operators import audit as AU
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(900)]
    for k in range(3):
        with open(os.path.join(scratch, f"part-{k}.log"), "w") as f:
            f.write("".join(x + "\n" for x in lines[300 * k:300 * k + 300]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        numbered = AU.numbered_log(spark, scratch)
        got = numbered.collect()
        parts = numbered.rdd.getNumPartitions()
        first = AU.first_lines(numbered, 310).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [x.line for x in sorted(got, key=lambda x: x.line_number)] == lines and sorted(x.line_number for x in got) == list(range(1, 901))
    assert sorted(x.line_number for x in first) == list(range(1, 311)) and len({x.file_path for x in first}) == 2 and parts > 1
    assert AU.first_lines(numbered, None).count() == 900


def test_log_files_keep_their_size(spark, scratch, monkeypatch):
    """More events give more files, not longer ones (six held any log), and
    numbering moves no line: only the table of splits is exchanged."""
    import glob
    import os

    from quire.operators import audit as AU
    from quire.plans import q_audit
    monkeypatch.setattr(AU, "LINES_PER_FILE", 50, raising=False)
    spark.range(1000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "'view' AS event_type", "id AS user_id",
                                 "CAST(id % 9 AS DOUBLE) AS value", "'{}' AS props").write.parquet(f"{scratch}/events.parquet")
    written = []
    keep = AU.write_log
    monkeypatch.setattr(AU, "write_log", lambda lines, path: (keep(lines, path), written.append(path)))
    got = q_audit.o4_lines(spark, scratch).collect()
    assert sorted(r.line_number for r in got) == list(range(1, 1001)) and {r.status for r in got} == {"valid"}
    files = glob.glob(os.path.join(written[0].removeprefix("file:"), "part-*"))
    assert len(files) == 20 and max(sum(1 for _ in open(f)) for f in files) < 150
    plan = AU.numbered_log(spark, written[0])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_verify_reads_every_kind_of_line(spark):
    from quire.operators import audit as AU
    ev = spark.createDataFrame([("2024-01-01T00:00:00Z", "a", "t", "u", "r", "x", None, None, '{"k": 1}', "{}")], ", ".join(f"{k} string" for k in AU.EVENT_FIELDS))
    good = AU.log_line(AU.seal(ev, "k")).first().line
    lines = {"valid": good, "blank": " \t ", "malformed": good[:-1], "missing": good.replace('"signature":', '"other":')}
    rows = [*lines.items(), ("malformed", "[1]"), ("malformed", "null"), ("malformed", good + "x"), ("malformed", good + good), ("malformed", good + "," + good), ("malformed", good + "]"), ("invalid", good + ',"l2":{}'), ("malformed", "12"), ("blank", None), ("missing", "{}"),
            ("invalid", good.replace('"action":"a"', '"action":"b"')), ("invalid", good[:-1] + ',"more":"x"}'), ("invalid", good.replace('"user_id":"u"', '"user_id":7')),
            ("missing", '{"signature": null}'), ("invalid", '{"signature": "s"}')]
    df = spark.createDataFrame([(i, x[0], x[1]) for i, x in enumerate(rows)], "i int, exp string, line string")
    got = AU.verify(df, "k").orderBy("i").collect()
    assert [(x.i, x.status) for x in got] == [(i, x[0]) for i, x in enumerate(rows)]
    assert got[0].action == "a" and got[0].tenant_id == "t" and got[2].audit_id is None


def test_event_lookup_says_why_not(spark):
    from quire.operators import audit as AU
    ev = spark.createDataFrame([(f"2024-01-0{i}T00:00:00Z", "a", "t", "u", "r", "x", None, None, "{}", "{}") for i in range(1, 4)], ", ".join(f"{k} string" for k in AU.EVENT_FIELDS))
    lines = AU.log_line(AU.seal(ev, "k"), keep=["audit_id"]).orderBy("line").collect()
    log = spark.createDataFrame([(lines[0].line,), (lines[1].line.replace('"action":"a"', '"action":"b"'),), (lines[2].line.replace('"signature":', '"x":'),)], "line string")
    asked = spark.createDataFrame([(x.audit_id,) for x in lines] + [("none",)], "audit_id string")
    got = {x.audit_id: (x.outcome, x.line is not None) for x in AU.event_by_id(log, asked, "k").collect()}
    assert got == {lines[0].audit_id: ("found", True), lines[1].audit_id: ("invalid", False), lines[2].audit_id: ("missing", False), "none": ("absent", False)}

import numpy as np
from pyspark.sql import functions as F

from quire.operators import access as AC
from quire.operators import vectors as V
from quire.operators.ordinals import dense_positions
from quire.sources import tables
from tests.conftest import SF_SMALL


def test_knn_matches_numpy(spark):
    e = tables.load(spark, SF_SMALL, "embeddings")
    rows = e.collect()
    cent = V.mean_pool(e, ["label"], "embedding", "query_embedding").withColumn("query_id", F.col("label"))
    got = V.knn(e, cent, k=5, tenant_col="label", vector_id="vec_id").collect()
    by_label = {}
    for r in rows:
        by_label.setdefault(r.label, []).append(r)
    cents = {r.label: np.array(r.query_embedding) for r in cent.collect()}
    for lab, rs in by_label.items():
        d = sorted(((float(np.sum((np.array(r.embedding, dtype=np.float64) - cents[lab]) ** 2)), r.vec_id) for r in rs))
        exp = [v for _, v in d[:5]]
        g = [r.vec_id for r in sorted([x for x in got if x.label == lab], key=lambda x: x.rank)]
        assert g == exp


def test_normalize_and_hash_embedder(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    r = df.select(V.l2_normalize("v").alias("n")).collect()
    assert [list(x.n) for x in r] == [[0.6000000238418579, 0.800000011920929], [0.0, 0.0]]
    t = spark.createDataFrame([("Hello world hello",), ("",)], "t string")
    e = t.select(V.HashEmbedder(16).embed(F.col("t")).alias("e")).collect()
    assert abs(sum(x * x for x in e[0].e) - 1.0) < 1e-6 and sum(abs(x) for x in e[1].e) == 0


def test_dense_positions_equal_row_number(spark):
    e = tables.load(spark, SF_SMALL, "embeddings").select("label", "vec_id")
    hot = e.withColumn("label", F.lit(1))  # one tenant with all rows
    for df in (e, hot):
        got = {(r.label, r.vec_id): r.position for r in dense_positions(df, "label", ["vec_id"], num_partitions=7).collect()}
        by = {}
        for r in df.collect():
            by.setdefault(r.label, []).append(r.vec_id)
        for lab, ids in by.items():
            for i, v in enumerate(sorted(ids)):
                assert got[(lab, v)] == i


def test_permission_semi_anti_cover_all(spark):
    ev = tables.load(spark, SF_SMALL, "events")
    users = tables.users(ev)
    tenants = users.select("tenant_id").distinct()
    roles = AC.default_roles(tenants, "api")
    req = ev.select("event_id", F.col("user_id").cast("string").alias("user_id"),
                    F.when(F.col("event_type") == "error", F.lit("elsewhere"))
                    .otherwise(tables.user_tenant_col(F.col("user_id"))).alias("tenant_id"),
                    F.lit("pii:view").alias("permission"))
    dec = AC.check_permissions(req, users, roles, users)
    assert dec.count() == req.count()
    assert dec.filter(F.col("reason") == "tenant_mismatch").count() == \
        ev.filter(F.col("event_type") == "error").count()
    viewers = dec.filter(F.col("allowed")).join(users, ["user_id", "tenant_id"])
    assert viewers.filter(~F.col("role_name").isin("admin", "analyst")).count() == 0


def test_grants_idempotent(spark):
    users = spark.createDataFrame([("u1", "t1", "viewer")], "user_id string, tenant_id string, role_name string")
    roles = AC.default_roles(spark.createDataFrame([("t1",)], "tenant_id string"), "api")
    req = spark.createDataFrame([("u1", "t1", "viewer"), ("u1", "t1", "analyst"), ("u1", "t1", "nope")],
                                "user_id string, tenant_id string, role_name string")
    out = AC.apply_grants(users, req, roles)
    assert sorted(r.role_name for r in out.collect()) == ["analyst", "viewer"]
    assert AC.revoke_roles(out, req.limit(1)).count() == 1


def _brute(index, queries, k, metric, scope):
    out = set()
    by_query = {}
    for q in queries:
        for v in index:
            if v["embedding"] is None or q["query_embedding"] is None or any(q[c] != v[c] or q[c] is None for c in scope):
                continue
            a, b = np.array(q["query_embedding"], float), np.array(v["embedding"], float)
            if a.size == b.size:
                s = float(((a - b) ** 2).sum()) if metric == "l2" else 1 - float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b))
                by_query.setdefault(q["query_id"], []).append((round(s, 9), v["vector_id"], v["document_id"]))
    for q, rows in by_query.items():
        out |= {(q, i + 1, *r) for i, r in enumerate(sorted(rows, key=lambda r: r[:2])[:k])}
    return out


def _tables(spark, n, m, seed=4):
    import random
    r = random.Random(seed)
    vec = lambda d: [round(r.uniform(-1, 1), 3) for _ in range(d)]
    tenant = lambda: r.choice(["hot", "hot", "hot", "t1", "t2", None])
    index = [(f"v{i:03d}", vec(4 + (i % 9 == 0)), tenant(), i) for i in range(n)] + [("null", None, "hot", -1)]
    queries = [(f"q{i % (m // 2)}" if i % 3 else "hot id", vec(4 + (i % 7 == 0)), tenant()) for i in range(m)]
    return (spark.createDataFrame(index, "vector_id string, embedding array<float>, tenant_id string, document_id long"),
            spark.createDataFrame(queries, "query_id string, query_embedding array<float>, tenant_id string"))


def test_knn_tiles_equal_brute_force(spark):
    """Hot tenant, hot query id, null tenants, vectors of two dimensions; tiles
    from one row to everything."""
    index, queries = _tables(spark, 120, 30)
    rows, asked = index.collect(), queries.collect()
    for metric in ("l2", "cosine"):
        for scope in (["tenant_id"], []):
            exp = _brute(rows, asked, 3, metric, scope)
            for tiles in ({}, {"tile_vectors": 7, "tile_queries": 4}, {"tile_vectors": 1, "tile_queries": 50}):
                got = V.knn(index, queries, k=3, tenant_col=scope or None, metric=metric, carry_cols=["document_id"], **tiles)
                assert {(r.query_id, r["rank"], round(r.score, 9), r.vector_id, r.document_id) for r in got.collect()} == exp


def test_knn_neither_collects_nor_broadcasts_the_queries(spark):
    index, queries = _tables(spark, 60, 20)
    plan = V.knn(index, queries, k=3, tile_vectors=1000)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_knn_of_empty_sides(spark):
    index, queries = _tables(spark, 10, 6)
    assert V.knn(index.limit(0), queries).count() == 0 and V.knn(index, queries.limit(0), tenant_col=None).count() == 0


def test_versions_are_pruned_before_the_search(spark, scratch):
    index, queries = _tables(spark, 80, 20)
    both = index.withColumn("embedding_version", F.lit("v1")).unionByName(
        index.withColumn("embedding", F.slice("embedding", 1, 2)).withColumn("embedding_version", F.lit("v2")))
    both.write.partitionBy("embedding_version").parquet(scratch + "/index")
    stored = spark.read.parquet(scratch + "/index")
    asked = queries.withColumn("embedding_version", F.lit("v2")).withColumn("query_embedding", F.slice("query_embedding", 1, 2))
    got = V.search_versions(stored, asked, versions=["v2"], k=3)
    exp = _brute(index.withColumn("embedding", F.slice("embedding", 1, 2)).collect(), asked.collect(), 3, "l2", ["tenant_id"])
    assert {(r.query_id, r["rank"], round(r.score, 9), r.vector_id) for r in got.collect()} == {x[:4] for x in exp}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [embedding_version" in plan.replace("isnotnull(embedding_version", "embedding_version").replace("[(embedding", "[embedding") \
        or "embedding_version" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert V.search_versions(both, asked.withColumn("embedding_version", F.lit("v3"))).count() == 0


def test_build_index_continues_positions(spark):
    from quire.operators import chunking as K
    ch = K.chunk_table(tables.documents(spark, SF_SMALL), keep_cols=["tenant_id"])
    emb = V.embed_batch(ch, V.HashEmbedder(8), text_col="chunk_text")
    a = emb.filter(F.col("chunk_index") == 0)
    b = emb.filter(F.col("chunk_index") > 0)
    ia = V.build_index(a).checkpoint()
    ib = V.build_index(b, start=ia.groupBy("tenant_id").agg((F.max("position") + 1).alias("next_position")))
    both = ia.unionByName(ib)
    per = both.groupBy("tenant_id").agg(F.count("*").alias("n"), F.max("position").alias("mx"),
                                         F.countDistinct("position").alias("d"), F.min("position").alias("mn")).collect()
    assert all(r.n == r.mx + 1 == r.d and r.mn == 0 for r in per)


def test_grant_and_revoke_outcomes(spark):
    users = spark.createDataFrame([("u1", "t1", "viewer")], "user_id string, tenant_id string, role_name string")
    roles = AC.default_roles(spark.createDataFrame([("t1",)], "tenant_id string"), "api")
    rows = [(1, "u1", "t1", "viewer"), (2, "u1", "t1", "analyst"), (3, "u1", "t1", "analyst"), (4, "u2", "t1", "nope"), (5, "u2", "t9", "viewer"), (6, "u2", "t1", "viewer")]
    req = spark.createDataFrame(rows, "request_id long, user_id string, tenant_id string, role_name string")
    got = {r.request_id: r.outcome for r in AC.grant_outcomes(users, req, roles).collect()}
    assert got == {1: "already_granted", 2: "granted", 3: "already_granted", 4: "unknown_role", 5: "unknown_role", 6: "granted"}
    back = {r.request_id: r.removed for r in AC.revoke_outcomes(users, req.unionByName(req.where("request_id = 1").withColumn("request_id", F.lit(7)))).collect()}
    assert back == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False}


def _changes(spark, rows, tenants=(), users=()):
    req = spark.createDataFrame(rows, "request_id long, name string, admin_email string")
    t = spark.createDataFrame([(n,) for n in tenants], "name string")
    u = spark.createDataFrame([(e,) for e in users], "email string")
    return AC.provision_changes(req, t, u)


def test_provisioning_is_decided_in_request_order(spark):
    import random
    r = random.Random(1)
    rows = [(i, f"n{r.randrange(25)}", f"e{r.randrange(25)}") for i in range(120)] + [(200 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(12)] + [(300, None, "e"), (301, "n", None)]
    names, emails, exp = {"n3", "n4"}, {"e7"}, {}
    for i, n, e in rows:
        if n is not None and e is not None:
            exp[i] = "name_taken" if n in names else "email_taken" if e in emails else "created"
            if exp[i] == "created":
                names.add(n)
                emails.add(e)
    out = _changes(spark, rows, ["n3", "n4", None], ["e7"]).collect()
    got = {x.request_id: "created" if x.kind == "tenant" else x.detail for x in out if x.kind in ("tenant", "reject")}
    assert got == exp
    made = [x for x in out if x.kind != "reject"]
    assert len(made) == 7 * sum(o == "created" for o in exp.values()) and len({(x.kind, x.id) for x in made}) == len(made)
    ids = {x.id: x for x in made}
    for x in made:
        assert x.tenant_id in ids and (x.kind != "grant" or ids[x.detail].kind == "user" and x.name == "admin")


def test_provisioning_twice_adds_nothing(spark):
    rows = [(1, "a", "x"), (2, "b", "y"), (3, "a", "z")]
    first = _changes(spark, rows).collect()
    again = _changes(spark, rows, [x.name for x in first if x.kind == "tenant"], [x.name for x in first if x.kind == "user"]).collect()
    assert [x.kind for x in again] == ["reject"] * 3
    once_more = _changes(spark, rows).collect()
    assert sorted((x.kind, x.id or "") for x in first) == sorted((x.kind, x.id or "") for x in once_more)


def test_orphans_of_every_key(spark):
    t = spark.createDataFrame([("t1",), ("t2",), (None,)], "tenant_id string")
    u = spark.createDataFrame([("u1", "t1", None), ("u2", "t3", "u1"), ("u3", None, "u9"), ("u4", "t3", "u9")], "user_id string, tenant_id string, by string")
    d = spark.createDataFrame([(1, "t1", "u1"), (2, "t3", "u5"), (3, "t1", None)], "doc_id long, tenant_id string, up string")
    fk = AC.KeyUse
    got = {r.foreign_key: r.n_orphans for r in AC.fk_orphans([
        (t, [fk("tenant", ["tenant_id"])]), (u, [fk("user", ["user_id"]), fk("tenant", ["tenant_id"], "u.t"), fk("user", ["by"], "u.by")]),
        (d, [fk("document", ["doc_id"], where=F.col("doc_id") < 3), fk("tenant", ["tenant_id"], "d.t"), fk("user", ["up"], "d.up"),
             fk("document", ["doc_id"], "d.self")])]).collect()}
    assert got == {"u.t": 2, "u.by": 2, "d.t": 1, "d.up": 1, "d.self": 1}
    assert {r.n_orphans for r in AC.fk_orphans([(t.limit(0), [fk("tenant", ["tenant_id"])]), (u.limit(0), [fk("tenant", ["tenant_id"], "u.t")])]).collect()} == {0}


def test_hit_metadata(spark):
    from quire.operators import search as S
    docs = spark.createDataFrame([(1, "t", "Mail me at a@b.com now. " * 60), (2, "t", "Nothing here.")], "doc_id long, tenant_id string, text string")
    chunks = S.chunk_records(docs, keep_cols=["tenant_id"]).cache()
    vectors = V.vector_metadata(V.build_index(V.embed_batch(chunks, V.HashEmbedder(8), text_col="original_text")))
    names = spark.createDataFrame([(1, "a.txt"), (2, "b.txt")], "document_id long, filename string")
    ids = [r.chunk_id for r in chunks.orderBy("document_id", "start").collect()]
    hits = spark.createDataFrame([("q", k + 1, i, 0.5) for k, i in enumerate([ids[0], ids[-1], "gone"])], "query_id string, rank int, vector_id string, score double")
    got = {r["rank"]: r for r in S.hit_metadata(hits, vectors, chunks, names).collect()}
    assert set(got) == {1, 2} and (got[1].document_name, got[2].document_name) == ("a.txt", "b.txt")
    assert "a@b.com" not in got[1].text and "[EMAIL]" in got[1].text and got[1].redaction_metadata[-1].original_text == "a@b.com"
    assert got[2].redaction_metadata == [] and got[2].text == "Nothing here."
    for r in chunks.collect():
        assert r.vector_id == r.chunk_id == r.text_hash and r.original_text.count("a@b.com") == len(r.redaction_metadata)


def test_index_build_has_one_python_worker_a_task(spark, scratch, monkeypatch):
    """Chunks are stored before they are embedded (chunking and embedding held
    two Python workers in every task), and the memo of words stays small."""
    from quire.operators import chunking as K
    from quire.operators import vectors as V
    from quire.plans import q_vectors
    rows = [(i, f"Sentence {i}. " * (i * 40), f"src{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS LONG) AS n_chars").write.parquet(f"{scratch}/documents.parquet")
    plans, embed = [], V.embed_batch
    monkeypatch.setattr(V, "embed_batch", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), embed(df, *a, **k))[1])
    got = q_vectors.s9(spark, scratch).collect()
    assert len(plans) == 1 and "ArrowEvalPython" not in plans[0]
    assert {r.chunk_id for r in got} == {r.chunk_id for r in K.chunk_table(spark.createDataFrame(rows, "doc_id long, text string, t string")).collect()}
    assert all(r.norm == 1.0 for r in got) and V._token_code.cache_info().maxsize <= 1 << 16


def test_chunk_records_detect_and_redact_in_one_pass(spark):
    from quire.operators import pii
    from quire.operators import search as S
    docs = spark.createDataFrame([(1, "mail a@example.com ssn 123-45-6789."), (2, "none."), (3, None)], "doc_id long, text string")
    records = S.chunk_records(docs)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # chunking, redaction (detection had a third)
    got = {r.document_id: r for r in records.collect()}
    assert got[1].chunk_text == "mail [EMAIL] ssn [SSN]." and got[2].chunk_text == "none." and 3 not in got
    assert [(x.type, x.original_start, x.replacement) for x in got[1].redaction_metadata] == [("ssn", 23, "[SSN]"), ("email", 5, "[EMAIL]")]
    both = docs.select(pii.redact_with_spans("text").alias("f"), pii.detect_pii("text").alias("spans"), pii.redact_text("text").alias("r")).collect()
    assert all(r.f.spans == r.spans and r.f.text == r.r.text for r in both)

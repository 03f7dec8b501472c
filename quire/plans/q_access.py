"""Queries for tenants, roles, grants and document bookkeeping (C1-C7,
J1, J3-J5, J8, J9, A1, A5, M1, O1, U1, U4).

Users come from `events` (tenant and role are functions of the id, SURVEY
§5.1); tenants are the distinct `documents.source` values; roles are the
API matrix (C2) unless stated.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as TX
from quire.operators import access as AC
from quire.operators import chunking as K
from quire.plans.catalog import query
from quire.plans.q_chunks import chunk_sql
from quire.plans.q_text import T6_SQL
from quire.sources import tables


def _values(matrix: dict) -> str:
    rows = ", ".join("('" + n + "', [" + ", ".join(f"'{p}'" for p in perms) + "])" for n, perms in matrix.items())
    return f"(VALUES {rows}) m(name, permissions)"


TENANTS_SQL = "SELECT DISTINCT source AS tenant_id FROM documents"
USERS_SQL = ("SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, 'src' || CAST(user_id % 20 AS VARCHAR) AS tenant_id, "
             "CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' WHEN 2 THEN 'viewer' ELSE 'analyst' END "
             "AS role_name FROM events")


def roles_sql(matrix: dict) -> str:
    return (f"SELECT t.tenant_id, m.name, m.permissions, 'Default ' || m.name || ' role' AS description "
            f"FROM ({TENANTS_SQL}) t CROSS JOIN {_values(matrix)}")


API_ROLES_SQL = roles_sql(AC.API_ROLES)
BASE = f"WITH tenants AS ({TENANTS_SQL}), users AS ({USERS_SQL}), roles AS ({API_ROLES_SQL}) "


def tenants_df(spark, sf):
    return tables.load(spark, sf, "documents").select(F.col("source").alias("tenant_id")).distinct()


def users_df(spark, sf):
    return tables.users(tables.load(spark, sf, "events"))


def roles_df(spark, sf, matrix="api"):
    return AC.default_roles(tenants_df(spark, sf), matrix)


@query("c1_default_roles", "C1, C2 (role matrices x tenants)",
       f"SELECT tenant_id, 'service' AS matrix, name, array_to_string(permissions, ',') AS permissions "
       f"FROM ({roles_sql(AC.SERVICE_ROLES)}) UNION ALL SELECT tenant_id, 'api', name, "
       f"array_to_string(permissions, ',') FROM ({API_ROLES_SQL})")
def c1(spark, sf):
    t = tenants_df(spark, sf)
    r = AC.default_roles(t, "service").unionByName(AC.default_roles(t, "api"))
    return r.select("tenant_id", "matrix", "name", F.array_join("permissions", ",").alias("permissions"))


@query("j3_user_permissions", "J3, A1, U1",
       BASE + "SELECT u.user_id, u.tenant_id, array_to_string(list_sort(list_distinct(flatten(list(r.permissions)))), ',')"
       " AS permissions FROM users u JOIN roles r ON r.tenant_id = u.tenant_id AND r.name = u.role_name GROUP BY ALL")
def j3(spark, sf):
    p = AC.user_permissions(users_df(spark, sf), roles_df(spark, sf))
    return p.select("user_id", "tenant_id", F.array_join("permissions", ",").alias("permissions"))


@query("j4_user_roles", "J4",
       BASE + "SELECT u.user_id, u.tenant_id, u.role_name, r.description FROM users u "
       "JOIN roles r ON r.tenant_id = u.tenant_id AND r.name = u.role_name")
def j4(spark, sf):
    return AC.user_role_list(users_df(spark, sf), roles_df(spark, sf)) \
        .select("user_id", "tenant_id", "role_name", "description")


def _requests(spark, sf):
    """Permission requests derived from events: the event type names the
    permission; error events ask for a neighbouring tenant."""
    e = tables.load(spark, sf, "events")
    perm = (F.when(F.col("event_type") == "click", "document:search")
            .when(F.col("event_type") == "view", "document:summarize")
            .when(F.col("event_type") == "purchase", "document:upload")
            .when(F.col("event_type") == "signup", "tenant:manage")
            .otherwise("pii:view"))
    tenant = F.when(F.col("event_type") == "error", tables.user_tenant_col(F.col("user_id") + 1)) \
        .otherwise(tables.user_tenant_col(F.col("user_id")))
    return e.select("event_id", F.col("user_id").cast("string").alias("user_id"),
                    tenant.alias("tenant_id"), perm.alias("permission"))


REQUESTS_SQL = ("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, 'src' || CAST((CASE WHEN event_type = 'error' "
                "THEN user_id + 1 ELSE user_id END) % 20 AS VARCHAR) AS tenant_id, CASE event_type "
                "WHEN 'click' THEN 'document:search' WHEN 'view' THEN 'document:summarize' WHEN 'purchase' "
                "THEN 'document:upload' WHEN 'signup' THEN 'tenant:manage' ELSE 'pii:view' END AS permission FROM events")
_DECISIONS = (BASE + f", req AS ({REQUESTS_SQL}), g AS (SELECT DISTINCT u.user_id, u.tenant_id, unnest(r.permissions) "
              f"AS permission FROM users u JOIN roles r ON r.tenant_id = u.tenant_id AND r.name = u.role_name), "
              f"dec AS (SELECT q.*, EXISTS (SELECT 1 FROM g WHERE g.user_id = q.user_id AND g.tenant_id = q.tenant_id "
              f"AND g.permission = q.permission) AS allowed FROM req q), "
              f"out AS (SELECT d.event_id, d.user_id, d.tenant_id, d.permission, d.allowed, CASE WHEN d.allowed THEN NULL "
              f"WHEN h.tenant_id IS NULL THEN 'unknown_user' WHEN h.tenant_id <> d.tenant_id THEN 'tenant_mismatch' "
              f"ELSE 'missing_permission' END AS reason FROM dec d LEFT JOIN (SELECT DISTINCT user_id, tenant_id "
              f"FROM users) h ON h.user_id = d.user_id) ")


@query("j5_permission_checks", "J5 (semi / anti join)", _DECISIONS + "SELECT * FROM out")
def j5(spark, sf):
    return AC.check_permissions(_requests(spark, sf), users_df(spark, sf), roles_df(spark, sf),
                                users_df(spark, sf))


@query("j5_denial_report", "J5 report",
       _DECISIONS + "SELECT permission, allowed, reason, count(*) AS n_requests FROM out GROUP BY ALL")
def j5r(spark, sf):
    d = j5(spark, sf)
    return d.groupBy("permission", "allowed", "reason").agg(F.count(F.lit(1)).alias("n_requests"))


_GRANT_REQ = ("SELECT CAST(user_id AS VARCHAR) AS user_id, 'src' || CAST(user_id % 20 AS VARCHAR) AS tenant_id, "
              "CASE event_id % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'viewer' ELSE 'auditor' END AS role_name "
              "FROM events")


def _grant_requests(spark, sf):
    e = tables.load(spark, sf, "events")
    m = F.col("event_id") % 3
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("user_id"), tables.user_tenant_col(F.col("user_id"))
                    .alias("tenant_id"), F.when(m == 0, "analyst").when(m == 1, "viewer").otherwise("auditor")
                    .alias("role_name"))


@query("c3_grant_roles", "C3 grant (semi join roles, anti join existing, union)",
       BASE + f", req AS ({_GRANT_REQ}), valid AS (SELECT DISTINCT q.* FROM req q SEMI JOIN roles r "
       f"ON r.tenant_id = q.tenant_id AND r.name = q.role_name) "
       f"SELECT user_id, tenant_id, role_name FROM users UNION ALL "
       f"SELECT * FROM (SELECT * FROM valid EXCEPT SELECT user_id, tenant_id, role_name FROM users)")
def c3(spark, sf):
    return AC.apply_grants(users_df(spark, sf), _grant_requests(spark, sf), roles_df(spark, sf))


_ANY_ROLE = "CASE {x} % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' WHEN 2 THEN 'viewer' ELSE 'analyst' END"
_REVOKE_REQ = ("SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS user_id, "
               "'src' || CAST((user_id + CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END) % 20 AS VARCHAR) AS tenant_id, "
               + _ANY_ROLE.format(x="(event_id // 7)") + " AS role_name FROM events WHERE event_id IS NOT NULL")


def _revoke_requests(spark, sf):
    """Every event asks for the end of some role of its user, two thirds of them in a tenant that is not the user's."""
    e = tables.load(spark, sf, "events").filter("event_id IS NOT NULL")
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("user_id"),
                    tables.user_tenant_col(F.col("user_id") + F.when(F.col("user_id") % 3 == 0, 0).otherwise(1)).alias("tenant_id"),
                    tables.user_role_col(F.expr("event_id div 7")).alias("role_name"))


@query("c3_revoke_roles", "C3 revoke, U4 (anti join)",
       BASE + f", req AS ({_REVOKE_REQ}) SELECT * FROM users u ANTI JOIN req q "
       "ON q.user_id = u.user_id AND q.tenant_id = u.tenant_id AND q.role_name = u.role_name")
def c3r(spark, sf):
    return AC.revoke_roles(users_df(spark, sf), _revoke_requests(spark, sf)).select("user_id", "tenant_id", "role_name")


@query("c3_grant_outcomes", "C3 grant, outcome per request",
       BASE + f", req AS ({_GRANT_REQ.replace('SELECT', 'SELECT event_id AS request_id,', 1)}), "
       "r AS (SELECT q.*, row_number() OVER (PARTITION BY user_id, tenant_id, role_name ORDER BY request_id) = 1 AS first FROM req q) "
       "SELECT request_id, user_id, tenant_id, role_name, CASE WHEN NOT EXISTS (SELECT 1 FROM roles x WHERE x.tenant_id = r.tenant_id AND x.name = r.role_name) "
       "THEN 'unknown_role' WHEN NOT first OR EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.user_id AND u.tenant_id = r.tenant_id "
       "AND u.role_name = r.role_name) THEN 'already_granted' ELSE 'granted' END AS outcome FROM r")
def c3g(spark, sf):
    return AC.grant_outcomes(users_df(spark, sf), _grant_requests(spark, sf), roles_df(spark, sf))


@query("c3_revoke_outcomes", "C3 revoke, whether each request removed a grant",
       BASE + f", req AS ({_REVOKE_REQ}), r AS (SELECT q.*, row_number() OVER (PARTITION BY user_id, tenant_id, role_name ORDER BY request_id) = 1 "
       "AS first FROM req q) SELECT request_id, user_id, tenant_id, role_name, first AND EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.user_id "
       "AND u.tenant_id = r.tenant_id AND u.role_name = r.role_name) AS removed FROM r")
def c3o(spark, sf):
    return AC.revoke_outcomes(users_df(spark, sf), _revoke_requests(spark, sf))


_SERVICE = _values(AC.SERVICE_ROLES)


@query("c4_create_roles", "C4 (reject duplicates, matrix fallback by lower-case name)",
       BASE + ", req AS (SELECT tenant_id || ':' || nm AS request_id, tenant_id, nm AS name FROM tenants, "
       "(VALUES ('viewer'), ('Auditor'), ('custom'), ('custom')) v(nm)), "
       f"r AS (SELECT q.*, coalesce(m.permissions, []::VARCHAR[]) AS permissions, "
       f"row_number() OVER (PARTITION BY q.tenant_id, q.name ORDER BY q.request_id) = 1 AS first, "
       f"EXISTS (SELECT 1 FROM roles x WHERE x.tenant_id = q.tenant_id AND x.name = q.name) AS ex "
       f"FROM req q LEFT JOIN {_SERVICE} ON m.name = lower(q.name)) "
       "SELECT request_id, tenant_id, name, array_to_string(permissions, ',') AS permissions, "
       "CASE WHEN ex OR NOT first THEN 'rejected_duplicate' ELSE 'created' END AS status FROM r")
def c4(spark, sf):
    t = tenants_df(spark, sf)
    names = F.array(*[F.lit(n) for n in ("viewer", "Auditor", "custom", "custom")])
    req = t.select("tenant_id", F.explode(names).alias("name")) \
        .withColumn("request_id", F.concat_ws(":", "tenant_id", "name")) \
        .withColumn("permissions", F.lit(None).cast("array<string>"))
    out = AC.create_roles(req, roles_df(spark, sf), matrix="service")
    return out.withColumn("permissions", F.array_join("permissions", ","))


@query("c7_provision_tenants", "C7 (reject taken or repeated names)",
       "WITH req AS (SELECT doc_id AS request_id, CASE WHEN lang = 'en' THEN source ELSE 'tenant_' || lang END AS name, "
       "'admin@' || lang || '.example.com' AS admin_email FROM documents), "
       "r AS (SELECT q.*, row_number() OVER (PARTITION BY name ORDER BY request_id) = 1 AS first, "
       "name IN (SELECT DISTINCT source FROM documents) AS taken FROM req q) "
       "SELECT request_id, name, admin_email, CASE WHEN first AND NOT taken THEN substring(sha256('tenant:' || name), 1, 32) "
       "END AS tenant_id, CASE WHEN first AND NOT taken THEN 'created' ELSE 'rejected_duplicate' END AS status, "
       f"CASE WHEN first AND NOT taken THEN {len(AC.API_ROLES)} ELSE 0 END AS roles_created, "
       "CASE WHEN first AND NOT taken THEN admin_email END AS admin_user FROM r")
def c7(spark, sf):
    d = tables.load(spark, sf, "documents")
    req = d.select(F.col("doc_id").alias("request_id"),
                   F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat(F.lit("tenant_"), "lang"))
                   .alias("name"), F.concat(F.lit("admin@"), "lang", F.lit(".example.com")).alias("admin_email"))
    existing = d.select(F.col("source").alias("name")).distinct()
    return AC.provision_tenants(req, existing)


_PROVISION = ("SELECT doc_id AS request_id, CASE WHEN doc_id % 5 = 0 THEN source ELSE 'tenant_' || CAST(doc_id // 3 AS VARCHAR) END AS name, "
              "'admin' || CAST(doc_id % 400 AS VARCHAR) || '@' || coalesce(lang, 'xx') || '.example.com' AS admin_email FROM documents")
_HASH = "substring(sha256({0}), 1, 32)"
_ROLE_ROWS = ", ".join(f"('{n}', '{','.join(p)}')" for n, p in AC.API_ROLES.items())


@query("c7_change_set", "C7 (tenant, role, user and grant rows, rejects; names and addresses unique in request order)",
       f"WITH RECURSIVE req AS (SELECT *, row_number() OVER (ORDER BY request_id) AS rn FROM ({_PROVISION}) WHERE request_id IS NOT NULL AND name IS NOT NULL), "
       "taken AS (SELECT (SELECT coalesce(list(DISTINCT source), []) FROM documents) AS names, "
       "(SELECT coalesce(list(DISTINCT 'admin' || CAST(user_id % 3 AS VARCHAR) || '@en.example.com'), []) FROM events) AS emails), "
       "s(rn, names, emails, outcome) AS (SELECT 0::BIGINT, names, emails, ''::VARCHAR FROM taken UNION ALL "
       "SELECT q.rn, CASE WHEN o = 'created' THEN list_append(s.names, q.name) ELSE s.names END, "
       "CASE WHEN o = 'created' THEN list_append(s.emails, q.admin_email) ELSE s.emails END, o FROM s JOIN req q ON q.rn = s.rn + 1, "
       "LATERAL (SELECT CASE WHEN list_contains(s.names, q.name) THEN 'name_taken' WHEN list_contains(s.emails, q.admin_email) THEN 'email_taken' "
       "ELSE 'created' END AS o) x), "
       "d AS (SELECT q.*, s.outcome, " + _HASH.format("'tenant:' || q.name") + " AS tid, " + _HASH.format("'user:' || q.admin_email") +
       " AS uid FROM req q JOIN s ON s.rn = q.rn), ok AS (SELECT * FROM d WHERE outcome = 'created') "
       "SELECT 'tenant' AS kind, request_id, tid AS id, tid AS tenant_id, name, admin_email AS detail FROM ok UNION ALL "
       "SELECT 'role', request_id, " + _HASH.format("'role:' || tid || ':' || m.n") + f", tid, m.n, m.p FROM ok, (VALUES {_ROLE_ROWS}) m(n, p) UNION ALL "
       "SELECT 'user', request_id, uid, tid, admin_email, 'System Admin' FROM ok UNION ALL "
       "SELECT 'grant', request_id, " + _HASH.format("'grant:' || uid || ':' || " + _HASH.format("'role:' || tid || ':admin'")) +
       ", tid, 'admin', uid FROM ok UNION ALL SELECT 'reject', request_id, NULL, NULL, name, outcome FROM d WHERE outcome <> 'created'")
def c7s(spark, sf):
    d = tables.load(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.concat(F.lit("tenant_"), F.expr("doc_id div 3").cast("string")))
    email = F.concat(F.lit("admin"), (F.col("doc_id") % 400).cast("string"), F.lit("@"), F.coalesce("lang", F.lit("xx")), F.lit(".example.com"))
    req = d.select(F.col("doc_id").alias("request_id"), name.alias("name"), email.alias("admin_email"))
    users = tables.load(spark, sf, "events").select(
        F.concat(F.lit("admin"), (F.col("user_id") % 3).cast("string"), F.lit("@en.example.com")).alias("email")).distinct()
    return AC.provision_changes(req, d.select(F.col("source").alias("name")).distinct(), users)


_CHUNK_KEYS = chunk_sql(1000, 200)
# Parents with gaps (a deleted tenant, deleted users, a missing role, deleted
# documents, every chunk that starts a fourth page), so that every key has orphans.
_J8 = (_CHUNK_KEYS + f", all_tenants AS ({TENANTS_SQL}), tenants AS (SELECT * FROM all_tenants WHERE tenant_id <> 'src3'), all_users AS ({USERS_SQL}), "
       "users AS (SELECT * FROM all_users WHERE CAST(user_id AS BIGINT) % 17 <> 0), "
       f"all_roles AS ({API_ROLES_SQL}), roles AS (SELECT * FROM all_roles WHERE NOT (tenant_id = 'src5' AND name = 'editor')), "
       "docs AS (SELECT * FROM documents WHERE doc_id % 13 <> 0), vectors AS (SELECT c.chunk_id, d.source AS tenant_id FROM chunks c JOIN documents d "
       "ON d.doc_id = c.document_id), kept AS (SELECT * FROM chunks WHERE start < 3000) ")
_J8_KEYS = [
    ("users.tenant_id", "all_users a ANTI JOIN tenants t ON t.tenant_id = a.tenant_id"),
    ("roles.tenant_id", "all_roles a ANTI JOIN tenants t ON t.tenant_id = a.tenant_id"),
    ("user_roles.user_id", "all_users a ANTI JOIN users u ON u.user_id = a.user_id"),
    ("user_roles.role_id", "all_users a ANTI JOIN roles r ON r.tenant_id = a.tenant_id AND r.name = a.role_name"),
    ("user_roles.assigned_by", "(SELECT CAST(CAST(user_id AS BIGINT) - 1 AS VARCHAR) AS user_id FROM all_users WHERE CAST(user_id AS BIGINT) % 3 <> 0) a "
                               "ANTI JOIN users u ON u.user_id = a.user_id"),
    ("documents.tenant_id", "documents a ANTI JOIN tenants t ON t.tenant_id = a.source"),
    ("documents.uploaded_by", "(SELECT CAST(doc_id % 1500 AS VARCHAR) AS user_id FROM documents WHERE doc_id % 4 <> 0) a ANTI JOIN users u ON u.user_id = a.user_id"),
    ("chunks.document_id", "chunks a ANTI JOIN docs d ON d.doc_id = a.document_id"),
    ("audit_events.tenant_id", "(SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS tenant_id FROM events) a ANTI JOIN tenants t ON t.tenant_id = a.tenant_id"),
    ("audit_events.user_id", "(SELECT CAST(user_id AS VARCHAR) AS user_id FROM events) a ANTI JOIN users u ON u.user_id = a.user_id"),
    ("vector_metadata.chunk_id", "vectors a ANTI JOIN kept c ON c.chunk_id = a.chunk_id"),
    ("vector_metadata.tenant_id", "vectors a ANTI JOIN tenants t ON t.tenant_id = a.tenant_id"),
]


@query("j8_fk_orphans", "J8 (all 12 foreign keys in one tagged pass, over parents with gaps)",
       _J8 + " UNION ALL ".join(f"SELECT '{k}' AS foreign_key, count(*) AS n_orphans FROM {j}" for k, j in _J8_KEYS))
def j8(spark, sf):
    docs = tables.documents(spark, sf)
    events = tables.load(spark, sf, "events").select(tables.user_tenant_col(F.col("user_id")).alias("tenant_id"), F.col("user_id").cast("string").alias("user_id"))
    number = F.col("user_id").cast("long")
    users = users_df(spark, sf).withColumn("assigned_by", F.when(number % 3 != 0, (number - 1).cast("string")))
    docs = docs.withColumn("uploaded_by", F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 1500).cast("string")))
    tenant, by_user, fk = ["tenant_id"], ["user_id"], AC.KeyUse
    return AC.fk_orphans([
        (tenants_df(spark, sf), [fk("tenant", tenant, where=F.expr("tenant_id <> 'src3'"))]),
        (users, [fk("user", by_user, where=number % 17 != 0), fk("tenant", tenant, "users.tenant_id"), fk("user", by_user, "user_roles.user_id"),
                 fk("role", ["tenant_id", "role_name"], "user_roles.role_id"), fk("user", ["assigned_by"], "user_roles.assigned_by")]),
        (roles_df(spark, sf), [fk("role", ["tenant_id", "name"], where=F.expr("not (tenant_id = 'src5' and name = 'editor')")),
                               fk("tenant", tenant, "roles.tenant_id")]),
        (docs, [fk("document", ["doc_id"], where=F.expr("doc_id % 13 <> 0")), fk("tenant", tenant, "documents.tenant_id"),
                fk("user", ["uploaded_by"], "documents.uploaded_by")]),
        (K.chunk_table(docs, keep_cols=tenant), [fk("chunk", ["chunk_id"], where=F.expr("start < 3000")), fk("document", ["document_id"], "chunks.document_id"),
                                                 fk("chunk", ["chunk_id"], "vector_metadata.chunk_id"), fk("tenant", tenant, "vector_metadata.tenant_id")]),
        (events, [fk("tenant", tenant, "audit_events.tenant_id"), fk("user", by_user, "audit_events.user_id")])])


@query("j9_point_lookup", "J9 (batch point lookup as a semi join)",
       "SELECT d.doc_id, d.source AS tenant_id, d.n_chars FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id")
def j9(spark, sf):
    ids = tables.load(spark, sf, "labels").select("doc_id")
    d = tables.load(spark, sf, "documents")
    return d.join(ids, "doc_id", "left_semi").select("doc_id", F.col("source").alias("tenant_id"), "n_chars")


_STATUS_SQL = (f"WITH q AS ({T6_SQL}), upd AS (SELECT doc_id, CASE WHEN is_valid THEN 'completed' "
               f"WHEN issues LIKE '%empty_text%' OR issues LIKE '%too_short%' THEN 'failed' END AS status, "
               f"TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts FROM q), "
               f"st AS (SELECT d.doc_id, d.source AS tenant_id, coalesce(u.status, 'processing') AS status, "
               f"CASE WHEN u.status = 'completed' THEN u.ts END AS processed_at FROM documents d "
               f"LEFT JOIN upd u ON u.doc_id = d.doc_id AND u.status IS NOT NULL) ")


def _status(spark, sf):
    d = tables.documents(spark, sf)
    q = d.select("doc_id", TX.text_quality("text").alias("q"))
    st = (F.when(F.col("q.is_valid"), "completed")
          .when(F.array_contains("q.issues", "empty_text") | F.array_contains("q.issues", "too_short"), "failed"))
    upd = q.select("doc_id", st.alias("status"),
                   F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts")).filter("status IS NOT NULL")
    return AC.update_status(d.select("doc_id", "tenant_id"), upd)


@query("m1_status_update", "M1", _STATUS_SQL + "SELECT doc_id, status, processed_at FROM st")
def m1(spark, sf):
    return _status(spark, sf).select("doc_id", "status", "processed_at")


@query("a5_status_by_tenant", "A5 (pivot)",
       _STATUS_SQL + "SELECT tenant_id, count(*) FILTER (WHERE status = 'processing') AS processing, "
       "count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed "
       "FROM st GROUP BY tenant_id")
def a5(spark, sf):
    s = _status(spark, sf)
    p = s.groupBy("tenant_id").pivot("status", ["processing", "completed", "failed"]).count()
    return p.select("tenant_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("processing", "completed", "failed")])


@query("o1_list_documents", "O1 (per tenant newest first, limit 20 offset 5)",
       "SELECT source AS tenant_id, doc_id, rn AS list_position FROM (SELECT source, doc_id, row_number() OVER "
       "(PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn > 5 AND rn <= 25")
def o1(spark, sf):
    d = tables.load(spark, sf, "documents")
    w = Window.partitionBy("source").orderBy(F.col("doc_id").desc())
    # row_number <= limit+offset is planned as a WindowGroupLimit (top-k per
    # tenant before the shuffle).
    r = d.select(F.col("source").alias("tenant_id"), "doc_id", F.row_number().over(w).alias("list_position"))
    return r.filter((F.col("list_position") > 5) & (F.col("list_position") <= 25))


_CHUNKS = chunk_sql(1000, 200)


@query("j1_document_chunks", "J1 (chunk join document, tenant check, by start)",
       _CHUNKS + "SELECT d.source AS tenant_id, c.document_id, c.chunk_index, c.start, c.\"end\", c.chunk_id "
       "FROM chunks c JOIN documents d ON d.doc_id = c.document_id AND d.source = d.source")
def j1(spark, sf):
    d = tables.documents(spark, sf)
    ch = K.chunk_table(d.select("doc_id", "text"))
    j = ch.join(d.select(F.col("doc_id").alias("document_id"), "tenant_id"), "document_id")
    return j.select("tenant_id", "document_id", "chunk_index", "start", "end", "chunk_id") \
        .sortWithinPartitions("document_id", "start")

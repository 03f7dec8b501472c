"""Tenants, roles, grants and permission checks (SURVEY §2.7, §2.11:
C1-C7, J3-J5, J8, J9, A1, U1, U4, M1).

Roles and grants are small relational tables; every check is a join
(semi/anti) instead of a per-request lookup.  Permission sets are exploded
and re-collected per (user, tenant), which is bounded by the role matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference).
# Service role matrix.
SERVICE_ROLES = {
    "admin": ["tenant:manage", "user:create", "user:read", "user:update", "user:delete",
              "document:upload", "document:read", "document:delete",
              "search:execute", "summarize:execute", "audit:read", "reindex:trigger"],
    "editor": ["document:upload", "document:read", "document:delete", "search:execute", "summarize:execute"],
    "viewer": ["document:read", "search:execute", "summarize:execute"],
    "auditor": ["document:read", "search:execute", "audit:read"],
}
# Tenant-provisioning role matrix used by the API routes.
API_ROLES = {
    "admin": ["document:upload", "document:search", "document:summarize", "pii:view", "tenant:manage"],
    "editor": ["document:upload", "document:search", "document:summarize"],
    "viewer": ["document:search", "document:summarize"],
    "analyst": ["document:search", "document:summarize", "pii:view"],
}
PII_VIEW = "pii:view"
# END FIXED VALUES
# ---------------------------------------------------------------------------

MATRICES = {"service": SERVICE_ROLES, "api": API_ROLES}


def role_matrix(spark: SparkSession, matrix: str = "api") -> DataFrame:
    """The literal role matrix as a DataFrame (name, permissions, matrix)."""
    rows = [(name, perms, matrix) for name, perms in MATRICES[matrix].items()]
    return spark.createDataFrame(rows, "name string, permissions array<string>, matrix string")


def matrix_literal(matrix: str = "api"):
    """The role matrix as a literal array<struct<name, permissions, matrix>>."""
    return F.array(*[F.struct(F.lit(n).alias("name"),
                              F.array(*[F.lit(p) for p in perms]).alias("permissions"),
                              F.lit(matrix).alias("matrix"))
                     for n, perms in MATRICES[matrix].items()])


def default_roles(tenants: DataFrame, matrix: str = "api", existing: DataFrame | None = None) -> DataFrame:
    """Every tenant gets every role of the matrix (a literal array
    exploded on each tenant row: no join), minus roles that already exist
    (anti join)."""
    roles = tenants.select("tenant_id").distinct() \
        .select("tenant_id", F.explode(matrix_literal(matrix)).alias("_r")).select("tenant_id", "_r.*")
    if existing is not None:
        roles = roles.join(existing.select("tenant_id", "name"), ["tenant_id", "name"], "left_anti")
    return roles.withColumn("description", F.concat(F.lit("Default "), F.col("name"), F.lit(" role")))


def _mark_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """`_first` = the earliest request (by request_id, null ids first) of its
    key; exactly one per key even when identical requests repeat.  The smallest
    id of a key is a partial aggregate, so many requests of one key never meet
    in one task; only copies of one request are numbered by a window."""
    from pyspark.sql.window import Window
    low = df.groupBy(*[F.col(k).alias(f"_low_{k}") for k in keys]).agg(F.min(F.struct("request_id")).alias("_low"))
    same = [F.col(k).eqNullSafe(F.col(f"_low_{k}")) for k in keys]
    copy = F.row_number().over(Window.partitionBy(*keys, "request_id").orderBy("request_id"))
    first = F.col("request_id").eqNullSafe(F.col("_low.request_id")) & (F.col("_copy") == 1)
    return df.withColumn("_copy", copy).join(low, same).withColumn("_first", first) \
        .drop("_low", "_copy", *[f"_low_{k}" for k in keys])


def create_roles(requests: DataFrame, existing: DataFrame, matrix: str = "service") -> DataFrame:
    """C4: create roles; a request whose (tenant, name) exists, or repeats an
    earlier request, is rejected.  Missing permissions fall back to the
    matrix entry for lower(name), else []."""
    spark = requests.sparkSession
    m = role_matrix(spark, matrix).select(F.col("name").alias("_ln"), F.col("permissions").alias("_dp"))
    r = requests.join(F.broadcast(m), F.lower(requests["name"]) == F.col("_ln"), "left")
    perms = F.coalesce(F.col("permissions"), F.col("_dp"), F.array().cast("array<string>"))
    r = _mark_first(r, ["tenant_id", "name"])
    ex = existing.select("tenant_id", "name").withColumn("_exists", F.lit(True))
    r = r.join(ex, ["tenant_id", "name"], "left")
    status = F.when(F.col("_exists") | ~F.col("_first"), F.lit("rejected_duplicate")).otherwise(F.lit("created"))
    return r.select("request_id", "tenant_id", "name", perms.alias("permissions"), status.alias("status"))


def _role_keys(roles: DataFrame) -> DataFrame:
    """Roles keyed by name only (join by column names, so inputs that share
    lineage never make an ambiguous self-join)."""
    return roles.select("tenant_id", F.col("name").alias("role_name"), "permissions")


def user_permissions(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Permission set per (user, tenant): union over the user's
    roles in that tenant, sorted."""
    j = user_roles.select("user_id", "tenant_id", "role_name").join(_role_keys(roles), ["tenant_id", "role_name"])
    return (j.select("user_id", "tenant_id", F.explode("permissions").alias("p"))
            .groupBy("user_id", "tenant_id").agg(F.sort_array(F.collect_set("p")).alias("permissions")))


def user_role_list(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles of each user in a tenant with their descriptions."""
    return user_roles.join(roles.select("tenant_id", F.col("name").alias("role_name"), "description"),
                           ["tenant_id", "role_name"])


def grants(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, tenant_id, permission) rows, distinct."""
    j = user_roles.select("user_id", "tenant_id", "role_name").join(_role_keys(roles), ["tenant_id", "role_name"])
    return j.select("user_id", "tenant_id", F.explode("permissions").alias("permission")).distinct()


def check_permissions(requests: DataFrame, user_roles: DataFrame, roles: DataFrame,
                      users: DataFrame) -> DataFrame:
    """Each request (user_id, tenant_id, permission) is allowed iff the
    user is of that tenant and holds the permission there; the rest get the
    reason of the denial.  The requests are read once: the facts join them
    from the left, one row per key at most."""
    keys = ["user_id", "tenant_id", "permission"]
    held = grants(user_roles, roles).withColumn("_held", F.lit(True))
    known = users.select("user_id").distinct().withColumn("_known", F.lit(True))
    member = users.select("user_id", "tenant_id").distinct().withColumn("_member", F.lit(True))
    r = requests.join(held, keys, "left").join(known, "user_id", "left").join(member, ["user_id", "tenant_id"], "left")
    allowed = F.col("_held").isNotNull()
    reason = (F.when(allowed, F.lit(None).cast("string")).when(F.col("_known").isNull(), "unknown_user")
              .when(F.col("_member").isNull(), "tenant_mismatch").otherwise("missing_permission"))
    return r.select(*requests.columns, allowed.alias("allowed"), reason.alias("reason"))


def apply_grants(user_roles: DataFrame, requests: DataFrame, roles: DataFrame) -> DataFrame:
    """C3 grant: requests naming an existing role (semi join) that the user
    does not hold yet (anti join) are added; the result is the new table."""
    valid = requests.select("user_id", "tenant_id", "role_name").join(
        roles.select("tenant_id", F.col("name").alias("role_name")), ["tenant_id", "role_name"], "left_semi")
    new = valid.join(user_roles, ["user_id", "tenant_id", "role_name"], "left_anti").distinct()
    return user_roles.select("user_id", "tenant_id", "role_name").unionByName(new)


def revoke_roles(user_roles: DataFrame, requests: DataFrame) -> DataFrame:
    """C3 revoke / U4: remove the named grants (anti join)."""
    return user_roles.join(requests.select("user_id", "tenant_id", "role_name"),
                           ["user_id", "tenant_id", "role_name"], "left_anti")


def grant_outcomes(user_roles: DataFrame, requests: DataFrame, roles: DataFrame) -> DataFrame:
    """C3 grant, per request (request_id, user_id, tenant_id, role_name): what
    it did.  `unknown_role`: the tenant has no such role; `already_granted`:
    the user holds it, also through an earlier request; else `granted`."""
    keys = ["user_id", "tenant_id", "role_name"]
    known = roles.select("tenant_id", F.col("name").alias("role_name")).distinct().withColumn("_known", F.lit(True))
    held = user_roles.select(*keys).distinct().withColumn("_held", F.lit(True))
    r = _mark_first(requests.select("request_id", *keys), keys).join(known, ["tenant_id", "role_name"], "left").join(held, keys, "left")
    outcome = F.when(F.col("_known").isNull(), "unknown_role").when(F.col("_held").isNotNull() | ~F.col("_first"), "already_granted") \
        .otherwise("granted")
    return r.select("request_id", *keys, outcome.alias("outcome"))


def revoke_outcomes(user_roles: DataFrame, requests: DataFrame) -> DataFrame:
    """C3 revoke, per request: whether it removed a grant (the first request
    for a grant that exists does)."""
    keys = ["user_id", "tenant_id", "role_name"]
    held = user_roles.select(*keys).distinct().withColumn("_held", F.lit(True))
    r = _mark_first(requests.select("request_id", *keys), keys).join(held, keys, "left")
    return r.select("request_id", *keys, (F.col("_held").isNotNull() & F.col("_first")).alias("removed"))


def provision_tenants(requests: DataFrame, existing: DataFrame, matrix: str = "api") -> DataFrame:
    """One row per accepted new tenant with its admin user and roles;
    names already taken (or repeated in the batch) are rejected."""
    r = _mark_first(requests, ["name"])
    r = r.join(existing.select("name").withColumn("_taken", F.lit(True)), "name", "left")
    ok = F.coalesce(~F.col("_taken"), F.lit(True)) & F.col("_first")
    tid = F.sha2(F.concat_ws(":", F.lit("tenant"), F.col("name")), 256).substr(1, 32)
    return r.select("request_id", "name", "admin_email",
                    F.when(ok, tid).alias("tenant_id"),
                    F.when(ok, "created").otherwise("rejected_duplicate").alias("status"),
                    F.when(ok, F.size(matrix_literal(matrix))).otherwise(F.lit(0)).alias("roles_created"),
                    F.when(ok, F.col("admin_email")).alias("admin_user"))


def decide_tenants(requests: DataFrame, tenants: DataFrame, users: DataFrame) -> DataFrame:
    """Which provisioning requests (request_id, name, admin_email) succeed
    if they are taken in the order of their ids: a tenant's name and a user's
    e-mail address are unique, and a request that fails takes neither.

    (request_id, name, admin_email, outcome); outcomes: `created`,
    `name_taken`, `email_taken`.  A request waits for the earlier ones of its
    name or address only.  Each round accepts those that are first for both
    and drops what they rule out, so the rounds are as many as the longest
    chain of such waits; what is left is checkpointed.  Requests without an
    id, name or address take no part; of equal ids one is decided."""
    keys = ["request_id", "name", "admin_email"]
    left = cut(requests.select(*keys).dropna().dropDuplicates(["request_id"]))
    everyone, created = left, None
    names, emails = tenants.select("name").dropna().distinct(), users.select(F.col("email").alias("admin_email")).dropna().distinct()
    taken_names, taken_emails = names, emails
    while True:
        open_ = left.join(taken_names, "name", "left_anti").join(taken_emails, "admin_email", "left_anti").select(*keys)
        first_name = open_.groupBy("name").agg(F.min("request_id").alias("_by_name"))
        first_email = open_.groupBy("admin_email").agg(F.min("request_id").alias("_by_email"))
        marked = cut(open_.join(first_name, "name").join(first_email, "admin_email")
                     .select(*keys, ((F.col("request_id") == F.col("_by_name")) & (F.col("request_id") == F.col("_by_email"))).alias("_ok")))
        step, left = marked.where("_ok").select(*keys), marked.where("not _ok").select(*keys)
        created = step if created is None else created.unionByName(step)
        if not left.limit(1).count():
            break
        taken_names, taken_emails = step.select("name"), step.select("admin_email")
    # a name is checked first: it was taken if an earlier request got it, whichever round decided that
    by_name = created.select("name", F.col("request_id").alias("_winner")).unionByName(names.withColumn("_winner", F.lit(None).cast(created.schema["request_id"].dataType)))
    judged = everyone.join(by_name.withColumn("_named", F.lit(True)), "name", "left") \
        .join(created.select("request_id").withColumn("_made", F.lit(True)), "request_id", "left")
    earlier = F.col("_named").isNotNull() & (F.col("_winner").isNull() | (F.col("_winner") < F.col("request_id")))
    return judged.select(*keys, F.when(F.col("_made").isNotNull(), "created").when(earlier, "name_taken").otherwise("email_taken").alias("outcome"))


def provision_changes(requests: DataFrame, tenants: DataFrame, users: DataFrame, matrix: str = "api") -> DataFrame:
    """Every row that provisioning writes, as one change set: (kind,
    request_id, id, tenant_id, name, detail) with kind `tenant` (detail: the
    admin's address), `role` (detail: permissions), `user` (name: address),
    `grant` (name: role, detail: user id) and `reject` (detail: why).

    Ids are derived from names and addresses, so a second run over its own
    result adds nothing: all its requests are rejects, and a merge by
    (kind, id) finds the same ids."""
    decided = decide_tenants(requests, tenants, users)

    def derived(kind: str, *parts) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(kind), *parts), 256).substr(1, 32)
    tid, uid = derived("tenant", "name"), derived("user", "admin_email")

    def row(kind: str, id_, tenant, name, detail) -> Column:
        return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), tenant.alias("tenant_id"), name.alias("name"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    roles = [row("role", derived("role", tid, F.lit(r)), tid, F.lit(r), F.lit(",".join(perms))) for r, perms in MATRICES[matrix].items()]
    grant = [row("grant", derived("grant", uid, derived("role", tid, F.lit("admin"))), tid, F.lit("admin"), uid)] if "admin" in MATRICES[matrix] else []
    made = F.array(row("tenant", tid, tid, F.col("name"), F.col("admin_email")), *roles, row("user", uid, tid, F.col("admin_email"), F.lit("System Admin")), *grant)
    rejected = F.array(row("reject", none, none, F.col("name"), F.col("outcome")))
    rows = F.when(F.col("outcome") == "created", made).otherwise(rejected)
    return decided.select("request_id", F.explode(rows).alias("r")).select("r.kind", "request_id", "r.id", "r.tenant_id", "r.name", "r.detail")


@dataclass
class KeyUse:
    """Columns of a table that hold keys of a domain: a parent's own key
    (no `foreign_key`), or a foreign key; only rows where `where` holds."""
    domain: str
    columns: list[str]
    foreign_key: str | None = None
    where: Column | None = None


def fk_orphans(uses: list[tuple[DataFrame, list[KeyUse]]]) -> DataFrame:
    """(foreign_key, n_orphans) for every foreign key in one pass.

    Each table is read once and gives all its keys, tagged, to one union,
    which is aggregated once per (domain, key): whether a parent has it, and
    how many rows of each foreign key point to it.  Counting is partial before
    the exchange, so a key with a third of all rows is one row per task.  A
    null in a foreign key refers to nothing and is no orphan."""
    names = [u.foreign_key for _, keys in uses for u in keys if u.foreign_key]
    union = None
    for df, keys in uses:
        tags = []
        for u in keys:
            there = F.lit(True) if u.where is None else F.coalesce(u.where, F.lit(False))
            for c in u.columns:
                there = there & F.col(c).isNotNull()
            key = F.to_json(F.array(*[F.col(c).cast("string") for c in u.columns]))
            tags.append(F.when(there, F.struct(F.lit(u.domain).alias("domain"), key.alias("key"),
                                               F.lit(names.index(u.foreign_key) if u.foreign_key else -1).alias("k"))))
        rows = df.select(F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())).alias("t")).select("t.*")
        union = rows if union is None else union.unionAll(rows)
    counts = [f"n{k}" for k in range(len(names))]
    per_key = union.groupBy("domain", "key").agg(F.bool_or(F.col("k") == -1).alias("known"), *[F.count_if(F.col("k") == k).alias(c) for k, c in enumerate(counts)])
    total = per_key.where("not known").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    named = F.array(*[F.struct(F.lit(name).alias("foreign_key"), F.col(c).alias("n_orphans")) for name, c in zip(names, counts)])
    return total.select(F.inline(named))


def update_status(docs: DataFrame, updates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """M1: apply status updates (id, status, ts).  The last update of a
    document wins (by ts, then status); `completed` stamps processed_at.  A
    document without an update keeps its status and stamp (`processing` and
    none where the table has no such columns)."""
    last = updates.groupBy(id_col).agg(F.max(F.struct("ts", "status")).alias("_u"))
    status = F.col("status") if "status" in docs.columns else F.lit("processing")
    stamp = F.col("processed_at") if "processed_at" in docs.columns else F.lit(None).cast("timestamp")
    return docs.join(last, id_col, "left") \
        .withColumn("processed_at", F.when(F.col("_u.status") == "completed", F.col("_u.ts")).otherwise(stamp)) \
        .withColumn("status", F.coalesce("_u.status", status)).drop("_u")

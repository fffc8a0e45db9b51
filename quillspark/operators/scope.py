"""Row-level authorisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a request needs; a higher permission includes the lower ones.
LEVELS = {"READ": 1, "WRITE": 2, "ADMIN": 3}


@dataclass(frozen=True)
class Identity:
    """Who asks. member_id is the membership that documents name as their creator; the user's own id where it is left out."""

    tenant_id: int
    user_id: int
    department_id: int | None
    clearance: int
    member_id: int | None = None


def granting(request: str, highest: str = "ADMIN") -> list[str]:
    """Permissions that satisfy a request, where `highest` is the highest that the kind of object knows."""
    need = min(LEVELS[request], LEVELS[highest])
    return [p for p, n in LEVELS.items() if need <= n <= LEVELS[highest]]


def level(permission: Column) -> Column:
    return F.when(permission == "ADMIN", 3).when(permission == "WRITE", 2).when(permission == "READ", 1).otherwise(0)


def reaching(grants: DataFrame, who: Identity, levels: list[str]) -> DataFrame:
    """Grants of the tenant, at one of the levels, to the user or to the user's department."""
    mine = F.col("user_id") == who.user_id
    if who.department_id is not None:
        mine = F.coalesce(mine, F.lit(False)) | (F.col("department_id") == who.department_id)
    return grants.where((F.col("tenant_id") == who.tenant_id) & F.col("permission").isin(levels) & mine)


def accessible(bases: DataFrame, grants: DataFrame, who: Identity, request: str = "READ") -> DataFrame:
    """Knowledge bases (tenant_id, kb_id, status, deleted_at) of the tenant that are active, not deleted and that a grant to
    the user or the user's department opens at the level."""
    rows = bases.where((F.col("tenant_id") == who.tenant_id) & (F.col("status") == "ACTIVE") & F.col("deleted_at").isNull())
    return rows.join(reaching(grants, who, granting(request)).select("kb_id").distinct(), "kb_id", "left_semi")


def in_state(state: str) -> Column:
    """Published (and searchable), all (deleted ones too) or default (neither deleted nor gone)."""
    status, there = F.col("status"), F.col("deleted_at").isNull()
    if state == "published":
        return (status == "PUBLISHED") & there & F.col("active_generation_id").isNotNull()
    if state == "all":
        return status.isin("DRAFT", "PUBLISHED", "DELETED")
    if state == "default":
        return status.isin("DRAFT", "PUBLISHED") & there
    raise ValueError(f"unknown state {state!r}")


def readable_documents(documents: DataFrame, bases: DataFrame, grants: DataFrame, shares: DataFrame, who: Identity, state: str = "published", request: str = "READ") -> DataFrame:
    """Documents of the tenant in an accessible base, within the clearance and in the state, that are public, of the own
    department, own and of no department, or shared by their tenant with the user or the user's department at the level."""
    rows = documents.where((F.col("tenant_id") == who.tenant_id) & (F.col("confidentiality") <= who.clearance) & in_state(state))
    rows = rows.join(accessible(bases, grants, who, request).select("kb_id").distinct(), "kb_id", "left_semi")
    shared = reaching(shares, who, granting(request, "WRITE")).select("document_id").distinct().withColumn("_shared", F.lit(True))
    own = F.col("department_id").isNull() & (F.col("creator_id") == (who.user_id if who.member_id is None else who.member_id))
    open_ = (F.col("confidentiality") == 0) | (F.col("department_id") == who.department_id if who.department_id is not None else F.lit(False)) | own | F.col("_shared")
    return rows.join(shared, "document_id", "left").where(open_).drop("_shared")


def effective_level(grants: DataFrame, keys: list[str]) -> DataFrame:
    """The strongest permission of each key."""
    return grants.groupBy(*keys).agg(F.max_by("permission", level(F.col("permission"))).alias("permission"))


def members_with(grants: DataFrame, members: DataFrame, permission: str) -> DataFrame:
    """Members that a grant reaches by user or by department, each once; two equi-joins instead of one on a disjunction. The bases
    of a department and of a user are put together first, and a member's are merged before they become rows."""
    g = grants.where(F.col("permission") == permission)
    opened = lambda key: g.where(F.col(key).isNotNull()).groupBy("tenant_id", key).agg(F.collect_set(F.struct("kb_id")).alias(f"_{key}"))
    m = members.select("tenant_id", "user_id", "department_id").where("tenant_id is not null").join(opened("department_id"), ["tenant_id", "department_id"], "left").join(opened("user_id"), ["tenant_id", "user_id"], "left")
    none = F.array().cast(f"array<struct<kb_id: {grants.schema['kb_id'].dataType.simpleString()}>>")
    m = m.select("tenant_id", "user_id", F.array_union(F.coalesce("_department_id", none), F.coalesce("_user_id", none)).alias("_kbs")).where(F.size("_kbs") > 0)
    merged = m.groupBy("tenant_id", "user_id").agg(F.array_distinct(F.flatten(F.collect_list("_kbs"))).alias("_kbs"))
    return merged.select("tenant_id", F.explode("_kbs").alias("_kb"), "user_id").select("tenant_id", "_kb.kb_id", "user_id")


def active_members(members: DataFrame, departments: DataFrame) -> DataFrame:
    """Active members whose department, if they have one, is active."""
    d = departments.select("department_id", F.col("status").alias("_d"))
    return members.where("status = 'ACTIVE'").join(d, "department_id", "left").where("department_id is null or _d = 'ACTIVE'").drop("_d")


def resolve_scope(readable: DataFrame, requested: DataFrame) -> DataFrame:
    """L1, U4: (requested, readable, missing): missing above 0 means that the request is refused as a whole."""
    asked = requested.distinct().join(readable.select("document_id").withColumn("_r", F.lit(1)), "document_id", "left")
    return asked.agg(F.count(F.lit(1)).alias("requested"), F.count("_r").alias("readable"), F.count_if(F.col("_r").isNull()).alias("missing"))


FORBIDDEN = "QUERY_SCOPE_FORBIDDEN"


def resolve_scopes(requests: DataFrame, bases: DataFrame, documents: DataFrame, generations: DataFrame) -> DataFrame:
    """(request_id, code, kb_ids, authorized, published, fingerprint) of each request (request_id, kb_ids, document_ids; no
    ids or null for all).

    bases (kb_id) are those that the user may read, documents (document_id, kb_id, status, active_generation_id) those in them
    that are not deleted; generations: (document_id, generation_id, status). A request for a base or a document that is not
    among these is refused as a whole, with code FORBIDDEN and nothing else. published counts the documents whose active
    generation is READY. The fingerprint is one of the set of bases and of the set of published documents with their
    generations, whatever order they come in; a scope without any documents has one too, of its bases.
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    open_ = bases.agg(F.array_sort(F.collect_set("kb_id")).alias("_all"))  # a row; a user's bases
    r = requests.crossJoin(F.broadcast(open_)).withColumn("_kbs", F.when(some("kb_ids"), F.array_sort(F.array_distinct("kb_ids"))).otherwise(F.col("_all")))
    r = r.withColumn("_bad", F.size(F.array_except("_kbs", "_all")) > 0).withColumn("_docs", F.when(some("document_ids"), F.array_distinct("document_ids")))
    d = documents.select("document_id", "kb_id", "status", "active_generation_id")
    ready = generations.where("status = 'READY'").select("document_id", F.col("generation_id").alias("active_generation_id"), F.lit(True).alias("_ready"))
    public = (F.col("status") == "PUBLISHED") & F.coalesce("_ready", F.lit(False))
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", "kb_id", "document_id", "active_generation_id"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    total = [F.sum(c).alias(c) for c in ("_n", "_p", "_sum")]
    # a document's share of the counts and of the fingerprint; those of a base are added up once, for all requests
    by_kb = lambda df, *keys: df.groupBy("kb_id", *keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(public).alias("_p"), F.sum(F.when(public, one)).alias("_sum"))
    d = d.join(ready, ["document_id", "active_generation_id"], "left")
    told = r.where("not _bad")
    whole = told.where(F.col("_docs").isNull()).select("request_id", F.explode("_kbs").alias("kb_id")).join(by_kb(d), "kb_id")
    asked = told.where(F.col("_docs").isNotNull()).select("request_id", "_kbs", F.explode("_docs").alias("document_id")).join(by_kb(d, "document_id"), "document_id").where(F.array_contains("_kbs", F.col("kb_id")))
    found = whole.select("request_id", "_n", "_p", "_sum").unionByName(asked.select("request_id", "_n", "_p", "_sum"))
    n = found.groupBy("request_id").agg(*total)
    j = r.join(n, "request_id", "left").fillna(0, ["_n", "_p"])
    refused = F.col("_bad") | (F.col("_docs").isNotNull() & (F.size("_docs") > F.col("_n")))
    mark = F.sha2(F.concat_ws("|", F.array_join(F.col("_kbs").cast("array<string>"), ","), F.col("_p").cast("string"), F.coalesce(F.col("_sum").cast("string"), F.lit("0"))), 256)
    allowed = lambda c: F.when(~refused, c)
    return j.select("request_id", F.when(refused, FORBIDDEN).alias("code"), allowed(F.col("_kbs")).alias("kb_ids"), allowed(F.col("_n")).alias("authorized"), allowed(F.col("_p")).alias("published"), allowed(mark).alias("fingerprint"))


def provenance_holds(before: DataFrame, now: DataFrame) -> DataFrame:
    """(request_id, holds) of scopes as they were and as they are: nothing was refused then or is now, and the fingerprint is the
    same, which speaks for the bases where no document took part."""
    j = before.select("request_id", F.col("fingerprint").alias("_then")).join(now.select("request_id", F.col("fingerprint").alias("_now")), "request_id", "left")
    return j.select("request_id", F.coalesce(F.col("_then") == F.col("_now"), F.lit(False)).alias("holds"))


def changed_sources(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are missing, extra or changed; empty where provenance is as it was."""
    b, a = before.select(key, F.col(value).alias("_b")), after.select(key, F.col(value).alias("_a"))
    both = b.withColumn("_inb", F.lit(True)).join(a.withColumn("_ina", F.lit(True)), key, "full_outer")
    kind = F.when(F.col("_ina").isNull(), "missing").when(F.col("_inb").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, kind.alias("difference")).where("difference is not null")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(grants: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """M4: grants after changes (keys, permission or null to revoke, version); the highest version of a key counts."""
    old = grants.withColumn("version", F.lit(0).cast("long"))
    best = old.unionByName(changes).groupBy(*keys).agg(F.max_by(F.struct("permission"), "version").alias("p"), F.max("version").alias("acl_version"))
    return best.select(*keys, F.col("p.permission").alias("permission"), "acl_version").where("permission is not null")


def affected(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keys whose rows differ as multisets, order and numbering aside."""
    a, b = old.select(key, *content), new.select(key, *content)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select(key).distinct()

"""Writes as new tables from old ones: publishing a generation, chunk upserts, purges and deletions, optimistic updates, and what
becomes of failed work (G7, G9, M1, M3, Q2, Q6, Q7, Q9, Q12). There is one writer; each function gives the table after the
write, so a failed job changes nothing and a repeated one gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("PENDING", "RUNNING", "RETRY_WAIT")

# What a failure is called, and whether it is tried again.
FAILURES = {
    "processing": (None, False),  # has a code of its own
    "embedding": ("INVALID_EMBEDDING", False),
    "model_configuration": ("MODEL_CONFIGURATION_ERROR", False),
    "object_missing": ("OBJECT_NOT_FOUND", False),
    "timeout": ("PROCESSING_TIMEOUT", True),
}
UNKNOWN_FAILURE = ("PROCESSING_UNAVAILABLE", True)


def failure(kind: Column, own_code: Column) -> Column:
    """Q12: struct(code, retryable) of a kind of failure."""
    code, again = F.lit(UNKNOWN_FAILURE[0]), F.lit(UNKNOWN_FAILURE[1])
    for name, (c, r) in FAILURES.items():
        code = F.when(kind == name, own_code if c is None else F.lit(c)).otherwise(code)
        again = F.when(kind == name, F.lit(r)).otherwise(again)
    return F.struct(code.alias("code"), again.alias("retryable"))


def may_publish(leases: DataFrame, tasks: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Q9: (document_id, generation_id, task_id) of finished work (task_id, owner, epoch) whose task still runs under its lease and
    whose document still wants the revision and is neither deleted nor gone. One generation of a document at a time: the
    newest task."""
    running = tasks.where((F.col("status") == "RUNNING") & (F.col("task_type") != "GRAPH") & (F.col("lease_until") > now)).select("task_id", "owner", "epoch", "document_id", "revision_id", "generation_id")
    wanted = documents.where(F.col("status").isin("DRAFT", "PUBLISHED") & F.col("deleted_at").isNull()).select("document_id", F.col("desired_revision_id").alias("revision_id"))
    held = leases.select("task_id", "owner", "epoch").distinct().join(running, ["task_id", "owner", "epoch"]).join(wanted, ["document_id", "revision_id"], "left_semi")
    return held.groupBy("document_id").agg(F.max_by(F.struct("generation_id", "task_id"), "task_id").alias("n")).select("document_id", "n.*")


def published_documents(documents: DataFrame, published: DataFrame) -> DataFrame:
    """Q9: documents with the new active generation and PUBLISHED."""
    p = published.select("document_id", F.col("generation_id").alias("_g"))
    j = documents.join(p, "document_id", "left")
    return j.withColumns({"status": F.when(F.col("_g").isNotNull(), "PUBLISHED").otherwise(F.col("status")), "active_generation_id": F.coalesce("_g", "active_generation_id")}).drop("_g")


def _replaced(documents: DataFrame, published: DataFrame) -> DataFrame:
    """(document_id, generation_id) of generations that another one takes the place of."""
    p = published.select("document_id", F.col("generation_id").alias("_g"))
    return documents.join(p, "document_id").where("active_generation_id is not null and active_generation_id <> _g").select("document_id", F.col("active_generation_id").alias("generation_id"))


def tasks_after(tasks: DataFrame, documents: DataFrame, published: DataFrame) -> DataFrame:
    """Q9, Q10: the published task SUCCEEDED, and graph tasks of the replaced generation that have not ended CANCELLED with a new
    epoch, so that their workers' leases are void."""
    old = _replaced(documents, published).withColumn("_old", F.lit(True))
    j = tasks.join(old, ["document_id", "generation_id"], "left").join(published.select("task_id", F.lit(True).alias("_done")), "task_id", "left")
    cancel = F.col("_old") & (F.col("task_type") == "GRAPH") & F.col("status").isin(*ACTIVE)
    cancel, done = F.coalesce(cancel, F.lit(False)), F.coalesce("_done", F.lit(False))
    free = cancel | done
    return j.withColumns({
        "status": F.when(done, "SUCCEEDED").when(cancel, "CANCELLED").otherwise(F.col("status")),
        "error_code": F.when(cancel, "GENERATION_SUPERSEDED").when(~done, F.col("error_code")),
        "epoch": F.col("epoch") + cancel.cast("int"),
        "owner": F.when(~free, F.col("owner")),
        "lease_until": F.when(~free, F.col("lease_until")),
    }).drop("_old", "_done")


def projections_after(projections: DataFrame, documents: DataFrame, published: DataFrame) -> DataFrame:
    """Q9: projections of replaced generations are STALE."""
    old = _replaced(documents, published).withColumn("_old", F.lit(True))
    return projections.join(old, ["document_id", "generation_id"], "left").withColumn("status", F.when(F.col("_old"), "STALE").otherwise(F.col("status"))).drop("_old")


def purge_events(projections: DataFrame, documents: DataFrame, published: DataFrame, outbox: DataFrame) -> DataFrame:
    """Q9: (deduplication_key, document_id, generation_id, namespace) of purges that the outbox does not have yet."""
    old = projections.join(_replaced(documents, published), ["document_id", "generation_id"])
    key = F.format_string("graph:purge:%d:v%d", "generation_id", "projection_version")
    return old.select(key.alias("deduplication_key"), "document_id", "generation_id", "namespace").dropDuplicates(["deduplication_key"]).join(outbox.select("deduplication_key"), "deduplication_key", "left_anti")


CHUNK_KEY = ["namespace", "tenant_id", "generation_id", "chunk_id"]


def upserted_chunks(old: DataFrame, new: DataFrame, written: DataFrame, retired: DataFrame, key: str) -> DataFrame:
    """Rows after the chunks in `written` were written again: their old rows go, the new ones come, each key once, and what is
    written to a retired generation (namespace, tenant_id, generation_id) is refused. Writing twice is as writing once."""
    allowed = written.select(*CHUNK_KEY).distinct().join(retired.select("namespace", "tenant_id", "generation_id").distinct(), ["namespace", "tenant_id", "generation_id"], "left_anti")
    kept = old.join(allowed, CHUNK_KEY, "left_anti")
    fresh = new.join(allowed, CHUNK_KEY, "left_semi").dropDuplicates([key])
    return kept.unionByName(fresh.join(kept.select(key), key, "left_anti"))


def purged(rows: DataFrame, documents: DataFrame, generations: DataFrame) -> DataFrame:
    """Rows (namespace, tenant_id, document_id, generation_id) without those of purged documents and generations."""
    whole = rows.join(documents.select("namespace", "tenant_id", "document_id").distinct(), ["namespace", "tenant_id", "document_id"], "left_anti")
    return whole.join(generations.select("namespace", "tenant_id", "document_id", "generation_id").distinct(), ["namespace", "tenant_id", "document_id", "generation_id"], "left_anti")


def updated(rows: DataFrame, changes: DataFrame, key: str, version: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """M1: (rows after, refused changes): a change (key, expected version, new values; null leaves a value) applies only where the
    row still has the version that it expects, and raises it by one. Of several for one version the first in the order of
    their values does."""
    c = changes.select(key, F.col(version).alias("_v"), *[F.col(x).alias(f"_{x}") for x in columns])
    first = c.groupBy(key, "_v").agg(F.min(F.struct(*[f"_{x}" for x in columns])).alias("_c"))
    now = rows.select(key, F.col(version).alias("_v"))
    fits = first.join(now, [key, "_v"])
    j = rows.join(fits.select(key, "_c"), key, "left")
    new = {x: F.coalesce(F.col(f"_c._{x}"), F.col(x)) for x in columns}
    after = j.withColumns({**new, version: F.col(version) + F.col("_c").isNotNull().cast("int")}).drop("_c")
    refused = c.join(now, [key, "_v"], "left_anti").select(key, F.col("_v").alias(version))
    return after, refused


def deletable(documents: DataFrame, revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """M3: (document_id, code) of wanted deletions: OK, DOCUMENT_NOT_FOUND, or OBJECT_SHARED where another document uses one of the
    same objects (bucket, object_key)."""
    mine = wanted.select("document_id").distinct().join(documents.select("document_id", F.lit(True).alias("_there")), "document_id", "left")
    users = revisions.groupBy("bucket", "object_key").agg(F.min("document_id").alias("lo"), F.max("document_id").alias("hi")).where("lo <> hi")
    shared = revisions.join(users, ["bucket", "object_key"], "left_semi").select("document_id").distinct().withColumn("_shared", F.lit(True))
    code = F.when(F.col("_there").isNull(), "DOCUMENT_NOT_FOUND").when(F.col("_shared"), "OBJECT_SHARED").otherwise("OK")
    return mine.join(shared, "document_id", "left").select("document_id", code.alias("code"))


def soft_deleted(documents: DataFrame, allowed: DataFrame, now: Column) -> DataFrame:
    """M3: documents DELETED with the time of their first deletion; nothing of them is active any more."""
    j = documents.join(allowed.select("document_id").distinct().withColumn("_d", F.lit(True)), "document_id", "left")
    return j.withColumns({"status": F.when(F.col("_d"), "DELETED").otherwise(F.col("status")), "deleted_at": F.when(F.col("_d"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at")), "active_generation_id": F.when(F.col("_d").isNull(), F.col("active_generation_id"))}).drop("_d")


def hard_purged(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """M3: each table without the rows of the documents that are gone, children first as they are named."""
    ids = gone.select("document_id").distinct()
    return {name: t.join(ids, "document_id", "left_anti") for name, t in tables.items()}


def attempts_lost(attempts: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """Q2: running attempts of tasks whose lease has run out are LOST."""
    lost = tasks.where((F.col("status") == "RUNNING") & (F.col("lease_until") < now)).select("task_id", F.lit(True).alias("_l"))
    return attempts.join(lost, "task_id", "left").withColumn("status", F.when(F.col("_l") & (F.col("status") == "RUNNING"), "LOST").otherwise(F.col("status"))).drop("_l")


def abandoned(runs: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Q7: runs whose lease has run out, and waiting ones that are older than a lease, are ABANDONED."""
    late = (F.col("status") == "RUNNING") & (F.col("lease_until") < now)
    old = (F.col("status") == "PENDING") & (F.col("created_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds)))
    return runs.withColumn("status", F.when(late | old, "ABANDONED").otherwise(F.col("status")))


def progress(done: Column, total: Column) -> Column:
    """Q6: whole percent, 99 at most until the work is published."""
    return F.least(F.lit(99), F.floor(100 * done / F.greatest(total, F.lit(1)))).cast("int")

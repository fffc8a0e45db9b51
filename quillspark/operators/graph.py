"""Graph recall and upkeep over reified assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Which types of entities a relation may join (subjects, objects).
ENDPOINTS = {
    "HAS_STEP": ("Process", "Step"),
    "NEXT_STEP": ("Step", "Step"),
    "RESPONSIBLE_FOR": ("Actor", "Process Step"),
    "REVIEWS": ("Actor", "Step"),
    "CONFIRMS": ("Actor", "Step"),
    "APPLIES_TO": ("Process Rule", "Actor"),
    "REQUIRES_MATERIAL": ("Process Step", "Material"),
    "PRODUCES_MATERIAL": ("Step", "Material"),
    "OPERATES_ON": ("Step", "Resource Material"),
    "HAS_FIELD": ("Material", "Field"),
    "HAS_STATE": ("Material Resource", "State"),
    "GOVERNED_BY": ("Process Step Material Resource State Field", "Rule"),
    "DEPENDS_ON": ("Step", "Step Resource"),
    "ESCALATES_TO": ("Process Step", "Actor"),
    "TRANSITIONS_TO": ("State", "State"),
}
SHARED_TYPES = ("Actor", "Process", "Material", "Resource")


def endpoints(spark: SparkSession) -> DataFrame:
    """(predicate, subject_type, object_type) rows."""
    rows = [(p, s, o) for p, (ss, os) in ENDPOINTS.items() for s in ss.split() for o in os.split()]
    return spark.createDataFrame(rows, "predicate string, subject_type string, object_type string")


def allowed(relations: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Relations whose ends have types that the predicate joins."""
    return relations.join(whitelist, ["predicate", "subject_type", "object_type"], "left_semi")


def entity_key(kind: Column, base: Column, document: Column, section: Column, name: Column) -> Column:
    """Entities that bases share are keyed by base, all others by document and section too."""
    shared = kind.isin(*SHARED_TYPES)
    parts = F.when(shared, F.array(base.cast("string"), kind, name)).otherwise(F.array(base.cast("string"), document.cast("string"), section, kind, name))
    return F.sha2(F.to_json(parts), 256)


def one_hop(assertions: DataFrame, entities: DataFrame, evidence: DataFrame, seeds: DataFrame) -> DataFrame:
    """Assertions with a seed as subject or object, both ends and the evidence in scope. Seeds join twice by equality."""
    either = assertions.join(seeds.select(F.col("uid").alias("subject")), "subject", "left_semi").unionByName(assertions.join(seeds.select(F.col("uid").alias("object")), "object", "left_semi")).distinct()
    ends = entities.select("uid")
    in_scope = either.join(ends.withColumnRenamed("uid", "subject"), "subject", "left_semi").join(ends.withColumnRenamed("uid", "object"), "object", "left_semi")
    return in_scope.join(evidence, "evidence_id")


def graph_scores(hops: DataFrame, *key: str) -> DataFrame:
    """Distinct assertions for each place of evidence, whose key may have several columns."""
    return hops.groupBy(*key).agg(F.countDistinct("assertion_id").alias("score"))


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths over a shared middle; fixed templates, so an equi-join and no recursion."""
    return first.select("subject", F.col("object").alias("middle"), F.col("assertion_id").alias("first_id")).join(second.select(F.col("subject").alias("middle"), "object", F.col("assertion_id").alias("second_id")), "middle")


def rejected_by_fence(writes: DataFrame, retired: DataFrame, key: str) -> DataFrame:
    """Writes whose generation is not retired."""
    return writes.join(retired, key, "left_anti")


def orphans(entities: DataFrame, *uses: DataFrame) -> DataFrame:
    """Entities that nothing refers to; each of uses has a column uid."""
    for u in uses:
        entities = entities.join(u.select("uid").distinct(), "uid", "left_anti")
    return entities


def audit(issues: dict[str, DataFrame]) -> DataFrame:
    """(code, issues) of named checks, each a DataFrame of offending rows; codes without any do not appear."""
    parts = [df.select(F.lit(code).alias("code")) for code, df in sorted(issues.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("issues"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """A17."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_candidates(entities: DataFrame, key: str) -> DataFrame:
    """Groups with one canonical name: their smallest id, size and how many pairs a reviewer would see. Pairs themselves
    are not written out, as a frequent name has very many."""
    g = entities.groupBy(key).agg(F.min("uid").alias("first_uid"), F.countDistinct("uid").alias("members"))
    return g.where("members > 1").withColumn("pairs", F.expr("members * (members - 1) div 2"))


def missing_projections(generations: DataFrame, projections: DataFrame, tasks: DataFrame, limit: int) -> DataFrame:
    """Generations with neither a projection nor a task, oldest first."""
    return generations.join(projections, "generation_id", "left_anti").join(tasks, "generation_id", "left_anti").orderBy("generation_id").limit(limit)


def reusable(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The newest cached extraction for the same document, hash, text, model and version."""
    same = ["document_id", "content_hash", "content", "model"]
    j = wanted.join(cache, same)
    return j.groupBy("document_id", "content_hash").agg(F.max("cache_id").alias("cache_id"))


def stable_sample(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """The same rows each time: by hash, one of each group first, then the rest, `size` in all."""
    h = F.sha2(F.col(key).cast("string"), 256)
    r = rows.withColumn("_h", h).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_h")))
    return r.orderBy(F.col("_n") > 1, "_h").limit(size).drop("_h", "_n")


def rolled_back(projections: DataFrame, current: str = "fingerprint") -> DataFrame:
    """Q15: a STALE projection (with its base's fingerprint) is READY again and the one that took its place STALE, only where what is
    READY is still what took its place (replaced_by)."""
    now = projections.where("status = 'READY'").select("document_id", F.col(current).alias("_now"))
    j = projections.join(now, "document_id", "left")
    ok = (F.col("status") == "STALE") & F.col("_now").eqNullSafe(F.col("replaced_by")) & F.col("replaced_by").isNotNull()
    back = F.max(ok).over(Window.partitionBy("document_id"))
    return j.withColumn("new_status", F.when(ok, "READY").when(back & (F.col("status") == "READY"), "STALE").otherwise(F.col("status"))).drop("_now")


def switched(projections: DataFrame, base_fingerprint: str = "base_fingerprint") -> DataFrame:
    """Q15: candidates become READY and their base STALE only where the base is as the candidate saw it."""
    base = projections.where("status = 'READY'").select("document_id", F.col("fingerprint").alias("_now"))
    j = projections.join(base, "document_id", "left")
    ok = F.col("_now").eqNullSafe(F.col(base_fingerprint)) & (F.col("status") == "CANDIDATE")
    swapped = F.max(ok).over(Window.partitionBy("document_id"))
    status = F.when(ok, "READY").when(swapped & (F.col("status") == "READY"), "STALE").otherwise(F.col("status"))
    return j.withColumn("new_status", status).drop("_now")


def exclusion_problems(facts: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """(kept, unknown): facts left, which must be some, and listed keys that exist nowhere, which must be none."""
    kept = facts.join(excluded, key, "left_anti").agg(F.count(F.lit(1)).alias("kept"))
    unknown = excluded.join(facts, key, "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return kept.join(F.broadcast(unknown), how="inner")  # one row each


def approved(review: DataFrame, snapshot: DataFrame, keys: list[str], fields: list[str], by: list[str] | None = None) -> DataFrame:
    """(by ..., samples, approved): each sample of the snapshot is reviewed with equal fields, supported and with a reason."""
    r = review.select(*keys, "verdict", "reason", *[F.col(f).alias(f"_{f}") for f in fields])
    j = snapshot.join(r, keys, "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    ok = F.coalesce(same & (F.col("verdict") == "SUPPORT") & (F.length(F.trim("reason")) > 0), F.lit(False))
    return j.groupBy(*by or []).agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("approved"))


def relocated(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Targets whose quote stands in exactly one chunk of their document, with the new offsets. With columns type and name,
    targets that agree in both in a chunk are one, the smallest id."""
    j = targets.join(chunks, "document_id").where(F.contains("content", "quote"))
    n = F.count(F.lit(1)).over(Window.partitionBy("target_id"))
    at = F.call_function("instr", F.col("content"), F.col("quote")) - 1
    found = j.withColumn("_n", n).where("_n = 1").withColumns({"start": at, "end": at + F.char_length("quote")})
    if {"type", "name"} <= set(targets.columns):
        name = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
        first = F.row_number().over(Window.partitionBy("chunk_id", "type", name).orderBy("target_id"))
        found = found.withColumn("_n", first).where("_n = 1")
    return found.select("target_id", "chunk_id", "start", "end")


def shared(rows: DataFrame, object_key: str, key: str) -> DataFrame:
    """(key) of those whose object another key uses too; objects are counted, so one of very many rows makes no pairs."""
    k = rows.select(object_key, key).distinct()
    used = k.groupBy(object_key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return k.join(used, object_key, "left_semi").select(key).distinct()


def wrong_types(entities: DataFrame, cells: DataFrame, column: str, wanted: str) -> DataFrame:
    """Entities (row_id, entity_id, name, type) that are named as a cell of the column in their row and do not have the type
    that the column stands for. cells: (row_id, column, value), as table_values() gives them."""
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    values = cells.where(F.col("column") == column).select("row_id", name("value").alias("_name")).distinct()
    return entities.where(F.col("type") != wanted).withColumn("_name", name("name")).join(values, ["row_id", "_name"], "left_semi").select("row_id", "entity_id").distinct()


def flagged_relations(relations: DataFrame, flagged: DataFrame) -> DataFrame:
    """Relations (row_id, subject, object, ...) that a flagged entity is an end of."""
    f = flagged.select("row_id", F.col("entity_id").alias("_e")).distinct()
    hit = lambda end: relations.join(f.withColumnRenamed("_e", end), ["row_id", end], "left_semi")
    return hit("subject").unionByName(hit("object")).distinct()


def snapshot(assertions: DataFrame, by: str) -> DataFrame:
    """(by, assertions, subjects, objects, ends): how much each place holds, and its sorted distinct ends' fingerprint. Ends
    are counted one by one before a place gets its list of them, which holds each once."""
    end = lambda c, subject: F.struct(F.col(c).alias("v"), F.lit(subject).alias("s"))
    each = assertions.select(by, F.explode(F.array(end("subject", 1), end("object", 0))).alias("e")).select(by, "e.v", "e.s")
    ends = each.groupBy(by, "v").agg(F.sum("s").alias("s"), F.count_if(F.col("s") == 0).alias("o"))
    known = F.col("v").isNotNull()
    return ends.groupBy(by).agg(F.sum("s").alias("assertions"), F.count_if(known & (F.col("s") > 0)).alias("subjects"), F.count_if(known & (F.col("o") > 0)).alias("objects"), F.md5(F.array_join(F.array_sort(F.collect_list("v")), ",")).alias("ends"))


def salvaged(facts: DataFrame, local_id: str) -> DataFrame:
    """Facts that are valid by themselves and whose local id occurs once in their extraction."""
    n = F.count(F.lit(1)).over(Window.partitionBy("extraction_id", local_id))
    return facts.withColumn("_n", n).where("valid and _n = 1").drop("_n")


def within_budget(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The rows if they fit the budget, none if there are more; one row beyond the limit tells."""
    some = rows.orderBy(*order).limit(limit + 1)
    return some.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where(F.col("_all") <= limit).drop("_all")


def aliases(chunks: DataFrame, content: str) -> DataFrame:
    """(chunk_id, alias): names that a text gives with "hereinafter", "short for" or their Chinese forms."""
    found = F.regexp_extract_all(F.col(content), F.lit(r"(?:以下简称|简称|又称|别名为|hereinafter|also called)[\s:：\"“']*([\p{L}\p{N}]{2,30})"), 1)
    return chunks.select("chunk_id", F.explode(found).alias("alias")).distinct()


def table_values(rows: DataFrame, header: str, cells: str) -> DataFrame:
    """(row_id, column, value) of table rows with the header that applies to them."""
    pairs = F.arrays_zip(F.col(header).alias("column"), F.col(cells).alias("value"))
    return rows.select("row_id", F.inline(pairs).alias("column", "value")).where("column is not null and value is not null")

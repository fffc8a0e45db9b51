"""Authorised projections, seeds and two-hop paths with their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import SCOPE

# The two templates: first relation, second relations, which end of the second is the middle.
TEMPLATES = {"REQUIRES_MATERIAL": (("HAS_FIELD",), "subject"), "HAS_STEP": (("RESPONSIBLE_FOR", "REVIEWS", "CONFIRMS"), "object")}
MOST_PATHS = 10
#: Types whose key is shared within a base; others are bridged or of one document.
BRIDGED = ("Material", "Process", "Actor")


def projections(rows: DataFrame, generations: DataFrame, readable: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(projection_id, SCOPE) of READY projections of READY generations that are the active ones of readable documents,
    optionally with a metadata filter on these."""
    docs = readable if wanted is None else readable.where(wanted)
    docs = docs.select("tenant_id", "kb_id", "document_id", F.col("active_generation_id").alias("generation_id"))
    ready = generations.where("status = 'READY'").select("tenant_id", "document_id", "revision_id", "generation_id")
    return rows.where("status = 'READY'").join(ready, ["tenant_id", "document_id", "revision_id", "generation_id"], "left_semi").join(docs, ["tenant_id", "document_id", "generation_id"]).select("projection_id", *SCOPE)


def seeds(entities: DataFrame, mentions: DataFrame, scope: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(normalized_name, uid, type) of entities that are asked for by name or uid (asked: name, uid, either may be null) and
    that evidence in scope mentions, in order, limit at most."""
    visible = mentions.join(scope.select(*SCOPE).distinct(), SCOPE, "left_semi").select("uid", "namespace", "tenant_id", "kb_id").distinct()
    by_name = entities.join(asked.select(F.col("name").alias("normalized_name")).where("normalized_name is not null").distinct(), "normalized_name", "left_semi")
    by_uid = entities.join(asked.select("uid").where("uid is not null").distinct(), "uid", "left_semi")
    hit = by_name.unionByName(by_uid).join(visible, ["uid", "namespace", "tenant_id", "kb_id"], "left_semi")
    return hit.select("normalized_name", "uid", "type").distinct().orderBy("normalized_name", "uid").limit(limit)


HOP = ("assertion_id", "predicate", "subject_uid", "object_uid", "object_type", "namespace", "kb_id", "document_id", "generation_id", "chunk_id")


#: Groups that ids which come more than once are told by; as many numbers are broadcast at most.
GROUPS = 1 << 18


def _by_id(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id comes once, and the others, beside which some of the former may be: ids are counted by their hashes, and
    what is broadcast are the groups of hashes that have one more than once."""
    number = F.xxhash64(column)
    again = rows.select(number.alias("_hash")).groupBy("_hash").count().where("count > 1").select(F.pmod("_hash", F.lit(GROUPS)).cast("int").alias("_group")).distinct()
    told = rows.withColumn("_group", F.pmod(number, F.lit(GROUPS)).cast("int"))
    once, more = (told.join(F.broadcast(again), "_group", how).drop("_group") for how in ("left_anti", "left_semi"))
    return once, more.distinct()


def two_hop_paths(first: DataFrame, second: DataFrame, bridged: DataFrame) -> DataFrame:
    """(path_id, kb_id, start_uid, middle_uid, end_uid, first_id, second_id, bridge_id, sources) of the two templates. The
    middle is one node of one document, or two that a bridge (source_uid, target_uid, source_document, target_document,
    identity_id, chunks) joins; both hops are of one base. Rows have HOP's columns; sources are the chunks that a path needs.

    A path is its facts and its bridge. Facts that come once make each path once, so only paths of other facts are compared."""
    template = lambda of: F.expr("CASE predicate " + " ".join(f"WHEN '{p}' THEN {i}" for p, i in of.items()) + " END")
    starts = {p: i for i, p in enumerate(TEMPLATES)}
    follows = {p: i for i, (ps, _) in enumerate(TEMPLATES.values()) for p in ps}
    place = ("assertion_id", "namespace", "kb_id", "document_id", "generation_id", "chunk_id")
    middle = F.when(F.col("predicate") == "HAS_FIELD", F.col("subject_uid")).otherwise(F.col("object_uid"))
    last = F.when(F.col("predicate") == "HAS_FIELD", F.col("object_uid")).otherwise(F.col("subject_uid"))
    x = first.where(F.col("predicate").isin(*starts) & (F.col("subject_uid") != F.col("object_uid"))).select(*[F.col(c).alias(f"x_{c}") for c in place], F.col("subject_uid").alias("start_uid"), F.col("object_uid").alias("middle"), template(starts).alias("template"))
    y = second.where(F.col("predicate").isin(*follows) & (middle != last)).select(*[F.col(c).alias(f"y_{c}") for c in place], middle.alias("other"), last.alias("end_uid"), template(follows).alias("template"))
    b = bridged.select(F.col("source_uid").alias("middle"), F.col("target_uid").alias("other"), F.col("source_document").alias("x_document_id"), F.col("target_document").alias("y_document_id"), F.col("identity_id").alias("bridge_id"), F.col("chunks").alias("between"), F.coalesce("identity_id", F.lit("")).alias("_bridge"))
    b = b.dropDuplicates(["middle", "other", "x_document_id", "y_document_id", "_bridge"])
    kept = ["x_kb_id", "start_uid", "middle", "end_uid", "x_assertion_id", "y_assertion_id", "bridge_id", "_bridge", "x_chunk_id", "y_chunk_id", "between"]

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        alike = [x[f"x_{c}"] == y[f"y_{c}"] for c in ("namespace", "kb_id", "document_id", "generation_id")]
        same = x.join(y, [x["middle"] == y["other"], x["template"] == y["template"], *alike]).withColumns({"bridge_id": F.lit(None).cast("string"), "_bridge": F.lit(""), "between": F.array().cast("array<bigint>")})
        ends = y.join(b, ["other", "y_document_id"], "left_semi")
        over = x.join(b, ["middle", "x_document_id"]).join(ends, ["other", "y_document_id", "template"]).where("x_kb_id = y_kb_id and not (middle = other and x_document_id = y_document_id and x_namespace = y_namespace and x_generation_id = y_generation_id)")
        return same.select(*kept).unionByName(over.select(*kept)).where("x_assertion_id <> y_assertion_id and start_uid <> end_uid")

    (x, xs), (y, ys) = _by_id(x, "x_assertion_id"), _by_id(y, "y_assertion_id")
    more = met(xs, ys).unionByName(met(xs, y)).unionByName(met(x, ys)).dropDuplicates(["x_assertion_id", "y_assertion_id", "_bridge"])
    sources = F.array_distinct(F.concat(F.array("x_chunk_id", "y_chunk_id"), "between"))
    key = F.sha2(F.to_json(F.array("x_assertion_id", "y_assertion_id", "_bridge")), 256)
    return met(x, y).unionByName(more).select(key.alias("path_id"), F.col("x_kb_id").alias("kb_id"), "start_uid", F.col("middle").alias("middle_uid"), "end_uid", F.col("x_assertion_id").alias("first_id"), F.col("y_assertion_id").alias("second_id"), "bridge_id", sources.alias("sources"))


def within_sources(paths: DataFrame, limit: int, most: int = MOST_PATHS) -> DataFrame:
    """Of each query's paths (query_id, path_id, first_id, second_id, sources, ...) in order those that keep the union of
    sources within the limit, `most` at most. Each choice depends on the ones before, so a query's paths (few, as relations have
    a budget) are folded in order over the sources and paths so far."""
    row = F.struct(*paths.columns)
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "second_id", "path_id", row.alias("row"))))
    each = paths.groupBy(F.col("query_id").alias("_query")).agg(F.transform(ordered, lambda p: p["row"]).alias("rows"))
    sources, rows = paths.schema["sources"].dataType.simpleString(), each.schema["rows"].dataType.simpleString()
    none = F.struct(F.array().cast(sources).alias("have"), F.array().cast(rows).alias("kept"))

    def add(so_far: Column, p: Column) -> Column:
        fits = (F.size(F.array_union(so_far["have"], p["sources"])) <= limit) & (F.size(so_far["kept"]) < most)
        return F.when(fits, F.struct(F.array_union(so_far["have"], p["sources"]).alias("have"), F.array_append(so_far["kept"], p).alias("kept"))).otherwise(so_far)

    return each.select(F.explode(F.aggregate("rows", none, add)["kept"]).alias("p")).select("p.*")


def complete_paths(paths: DataFrame, candidates: DataFrame) -> DataFrame:
    """Paths all of whose sources are candidates with the content that the path saw, in the path's base, and whose hops are
    connected. paths: (path_id, kb_id, hops array of (start_uid, end_uid, assertion_id, document_id), bridge_from, bridge_to,
    sources array of (chunk_id, kb_id, content_sha256)); candidates: (chunk_id, content_sha256). A path_id that stands for
    different paths is none."""
    a, b = F.col("hops")[0], F.col("hops")[1]
    joined = F.when(F.col("bridge_from").isNull(), (a["end_uid"] == b["start_uid"]) & (a["document_id"] == b["document_id"])).otherwise((F.col("bridge_from") == a["end_uid"]) & (F.col("bridge_to") == b["start_uid"]))
    connected = (F.size("hops") == 2) & joined & (a["start_uid"] != a["end_uid"]) & (b["start_uid"] != b["end_uid"]) & (a["start_uid"] != b["start_uid"]) & (a["start_uid"] != b["end_uid"]) & (a["assertion_id"] != b["assertion_id"])
    one = paths.groupBy("path_id").agg(F.countDistinct(F.to_json(F.struct(*[c for c in paths.columns if c != "path_id"]))).alias("_n")).where("_n = 1")
    some = paths.join(one.select("path_id"), "path_id", "left_semi").dropDuplicates(["path_id"]).where(F.coalesce(connected, F.lit(False)) & (F.size("sources") > 0))
    each = some.select("path_id", "kb_id", F.explode("sources").alias("s")).select("path_id", (F.col("s.kb_id") == F.col("kb_id")).alias("_in"), F.col("s.chunk_id").alias("chunk_id"), F.col("s.content_sha256").alias("content_sha256"))
    there = each.join(candidates.select("chunk_id", "content_sha256").distinct().withColumn("_there", F.lit(True)), ["chunk_id", "content_sha256"], "left")
    good = there.groupBy("path_id").agg(F.bool_and(F.col("_in") & F.coalesce("_there", F.lit(False))).alias("_ok")).where("_ok")
    return some.join(good.select("path_id"), "path_id", "left_semi")


def accepted(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(mode, case_id, path_found, documents, condition, fields, citations, accepted) for each case and mode: the wanted path is
    among the found ones, and the answer has all documents, the condition, all fields and citations that are all in its
    evidence. A case without a path to find passes if none was found. cases: (case_id, path_id, documents, condition, fields);
    answers: (mode, case_id, paths, documents, text, citations, evidence)."""
    a = answers.withColumnRenamed("documents", "_documents")
    j = cases.join(a, "case_id")
    path = F.when(F.col("path_id").isNull(), F.size("paths") == 0).otherwise(F.array_contains("paths", F.col("path_id")))
    checks = {
        "path_found": path,
        "documents_found": F.size(F.array_except("documents", "_documents")) == 0,
        "condition_found": F.coalesce(F.contains("text", "condition"), F.lit(True)),
        "fields_found": F.forall("fields", lambda f: F.contains(F.col("text"), f)),
        "citations_found": (F.size("citations") > 0) & (F.size(F.array_except("citations", "evidence")) == 0),
    }
    ok = F.lit(True)
    for c in checks.values():
        ok = ok & c
    return j.select("mode", "case_id", *[c.alias(k) for k, c in checks.items()], ok.alias("accepted"))

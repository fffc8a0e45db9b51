"""Queries of graph retrieval, publication, answers and JSON, registered beside those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json
from ..operators import answers, audit, graph, identity, paths, publication, relations
from . import adapters as x
from .adapters import NOW, R
from .queries import query


@query("SELECT doc_id, doc_id % 3 <> 1 AND doc_id % 5 <> 2 AND length(text) >= 8 AS holds FROM documents")
def quote_hash(spark, sf):
    """Some chunks have changed since, some offsets are one off."""
    d = x.table(spark, sf, "documents")
    digest = F.when(F.col("doc_id") % 3 == 1, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256))
    start = F.lit(2) + F.when(F.col("doc_id") % 5 == 2, 1).otherwise(0)
    quote = F.expr("substring(text, 3, 6)")
    return d.select("doc_id", (relations.quote_holds(F.col("text"), digest, quote, start, start + 6) & (F.char_length("text") >= 8)).alias("holds"))


def _records(spark, sf):
    """Relations as a store gives them; some are not well formed, out of scope or not from a seed."""
    li = x.table(spark, sf, "lineitem")
    uid = lambda c: F.sha2(c.cast("string"), 256)
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    quote = F.when(n == 2, F.call_function("repeat", F.lit("q"), F.lit(501))).when(n == 3, "").otherwise("quote with a condition")
    return li.select(
        k.alias("order"), n.alias("line"), F.when(n == 4, "ABC").otherwise(uid(F.concat(k, F.lit("-"), n, F.lit("-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey")))).alias("assertion_id"), uid(F.col("l_partkey") % 20).alias("seed_uid"), uid(F.col("l_partkey") % 20).alias("subject_uid"), uid(F.lit(1000) + F.col("l_suppkey")).alias("object_uid"),
        F.lit("REQUIRES_MATERIAL").alias("predicate"), F.when(n == 5, "Rule").otherwise("Step").alias("subject_type"), F.lit("Material").alias("object_type"), quote.alias("quote"), F.when(n == 6, "no such").otherwise("a condition").alias("condition_text"),
        F.lit(7).alias("quote_start"), (F.char_length(quote) + 7 + F.when(n == 7, 1).otherwise(0)).alias("quote_end"), F.lit("ns").alias("namespace"), F.lit(1).alias("tenant_id"), (k % 5).alias("kb_id"), k.alias("document_id"), k.alias("revision_id"), k.alias("generation_id"),
    )


@query("SELECT l_orderkey AS \"order\", l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 <> 0 AND l_partkey % 20 < 15 GROUP BY ALL")
def valid_relations(spark, sf):
    """G14."""
    rows = _records(spark, sf)
    scope = x.table(spark, sf, "orders").where("o_orderkey % 4 <> 0").select(F.lit("ns").alias("namespace"), F.lit(1).alias("tenant_id"), (F.col("o_orderkey") % 5).alias("kb_id"), *[F.col("o_orderkey").alias(c) for c in ("document_id", "revision_id", "generation_id")])
    seeds = spark.range(15).select(F.sha2(F.col("id").cast("string"), 256).alias("uid"))
    return relations.valid_relations(rows, scope, seeds, graph.endpoints(spark)).groupBy("order", "line").agg(F.count(F.lit(1)).alias("n"))


_MENTIONS = """men AS (SELECT p_partkey AS k, p_partkey % 5 AS kb, lower(p_name) AS n, CASE WHEN p_size % 4 <> 0 THEN 'c' || (p_size % 3) END AS c, p_partkey % 7 = 0 AS titled, p_partkey % 11 = 0 AS denied FROM part)"""


@query(f"WITH {_MENTIONS} SELECT a.k AS source_uid, b.k AS target_uid, CASE WHEN a.c = b.c THEN 'shared_context' ELSE 'explicit_document' END AS basis, a.n AS canonical_name FROM men a JOIN men b ON a.kb = b.kb AND a.n = b.n AND a.k <> b.k WHERE NOT a.denied AND NOT b.denied AND (a.c = b.c OR ((a.c IS NULL OR b.c IS NULL) AND (a.titled OR b.titled)))")
def identity_bridges(spark, sf):
    """Materials with one name."""
    k, name = F.col("p_partkey"), F.lower("p_name")
    rows = x.table(spark, sf, "part").select(
        F.lit(1).alias("tenant_id"), (k % 5).alias("kb_id"), k.alias("uid"), F.lit("Material").alias("type"), F.col("p_name").alias("name"), F.array(name).alias("names"),
        F.when(F.col("p_size") % 4 != 0, F.array(F.concat(F.lit("c"), F.col("p_size") % 3))).otherwise(F.array().cast("array<string>")).alias("contexts"), k.alias("document_id"),
        F.when(k % 11 == 0, F.concat(F.lit("first; "), name, F.lit("不是同一材料"))).otherwise(F.concat(name, F.lit(" 一般"))).alias("content"), F.when(k % 7 == 0, name).otherwise(F.concat(F.lit("doc "), k)).alias("document_title"), F.lit("file.pdf").alias("document_name"),
    )
    return identity.bridges(identity.mentions(rows)).select("source_uid", "target_uid", "basis", "canonical_name")


@query("WITH f AS (SELECT DISTINCT p_name AS name, p_partkey AS uid FROM part WHERE p_size % 10 = 0), m AS (SELECT name, min(uid) AS first, count(*) AS uids FROM f GROUP BY 1), a AS (SELECT DISTINCT p_name AS name FROM part), j AS (SELECT f.name, bool_and((uid - first) % 2 = 0) AS ok FROM f JOIN m USING (name) GROUP BY 1) SELECT a.name, coalesce(uids, 0) AS uids, coalesce(ok, false) AS ready FROM a LEFT JOIN m USING (name) LEFT JOIN j USING (name)")
def graph_readiness(spark, sf):
    """A bridge joins uids of one name that are both odd or both even."""
    p = x.table(spark, sf, "part")
    found = p.where("p_size % 10 = 0").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("uid"))
    first = found.groupBy("name").agg(F.min("uid").alias("target_uid"))
    bridged = found.join(first, "name").where("uid > target_uid and (uid - target_uid) % 2 = 0").select(F.col("uid").alias("source_uid"), "target_uid")
    return identity.readiness(p.select(F.col("p_name").alias("name")), found, bridged)


@query(f"WITH {R} SELECT document_id AS projection_id, kb_id, document_id, document_id * 10 AS revision_id FROM r WHERE file_type = 'en' AND document_id % 4 <> 0 AND document_id % 6 <> 1")
def graph_projections(spark, sf):
    """G10."""
    d = x.documents(spark, sf)
    i = F.col("document_id")
    same = [F.col("tenant_id"), i, (i * 10).alias("revision_id"), i.alias("generation_id")]
    rows = d.select(i.alias("projection_id"), *same, F.lit("ns").alias("namespace"), F.when(i % 4 == 0, "STALE").otherwise("READY").alias("status"))
    generations = d.select(*same, F.when(i % 6 == 1, "BUILDING").otherwise("READY").alias("status"))
    return paths.projections(rows, generations, x.readable(spark, sf), F.col("file_type") == "en").select("projection_id", "kb_id", "document_id", "revision_id")


@query("SELECT p_name AS normalized_name, p_partkey AS uid, 'Material' AS type FROM part WHERE (p_name = 'red widget' OR p_partkey IN (6, 7, 9, 12)) AND p_partkey % 3 = 0 ORDER BY 1, 2 LIMIT 41")
def graph_seeds(spark, sf):
    """Mentions of every third part are in scope."""
    k = F.col("p_partkey")
    p = x.table(spark, sf, "part")
    scope_of = [F.lit("ns").alias("namespace"), F.lit(1).alias("tenant_id"), (k % 5).alias("kb_id"), *[k.alias(c) for c in ("document_id", "revision_id", "generation_id")]]
    entities = p.select(k.alias("uid"), F.col("p_name").alias("normalized_name"), F.lit("Material").alias("type"), *scope_of[:3])
    asked = spark.createDataFrame([("red widget", None), (None, 6), (None, 7), (None, 9), (None, 12)], "name string, uid long")
    return paths.seeds(entities, p.select(k.alias("uid"), *scope_of), p.where("p_partkey % 3 = 0").select(*scope_of), asked, 41)


_HOPS = """fi AS (SELECT DISTINCT 'a' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS a, CASE WHEN l_linenumber % 2 = 1 THEN 'REQUIRES_MATERIAL' ELSE 'HAS_STEP' END AS p, 's' || l_orderkey AS s, 'm' || l_suppkey AS o, l_orderkey % 3 AS kb, l_orderkey % 50 AS d, l_orderkey * 10 + l_linenumber AS c FROM lineitem),
se AS (SELECT DISTINCT 'b' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS a, CASE WHEN l_linenumber % 3 = 0 THEN 'HAS_FIELD' ELSE 'REVIEWS' END AS p, 'm' || l_suppkey AS m, 'e' || l_partkey AS e, l_orderkey % 3 AS kb, l_orderkey % 50 AS d, l_orderkey * 10 + l_linenumber AS c FROM lineitem),
br AS (SELECT 'm' || s_suppkey AS m, s_suppkey % 50 AS d, (s_suppkey + 3) % 50 AS t, 'i' || s_suppkey AS i FROM supplier WHERE s_suppkey % 9 = 0),
jo AS (SELECT fi.a AS first_id, se.a AS second_id, NULL AS bridge_id, len(list_distinct([fi.c, se.c])) AS sources, fi.p AS fp, se.p AS sp FROM fi JOIN se ON se.m = fi.o AND se.kb = fi.kb AND se.d = fi.d
 UNION ALL SELECT fi.a, se.a, br.i, len(list_distinct([fi.c, se.c, -br.d])), fi.p, se.p FROM fi JOIN br ON br.m = fi.o AND br.d = fi.d JOIN se ON se.m = br.m AND se.d = br.t AND se.kb = fi.kb)"""


@query(f"WITH {_HOPS} SELECT first_id, second_id, bridge_id, sources FROM jo WHERE (fp = 'REQUIRES_MATERIAL' AND sp = 'HAS_FIELD') OR (fp = 'HAS_STEP' AND sp = 'REVIEWS')")
def two_hop_templates(spark, sf):
    """Both templates, in one document or over a bridge."""
    li = x.table(spark, sf, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    key = F.concat(k, F.lit("-"), n, F.lit("-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey"))
    rest = [F.lit("Material").alias("object_type"), F.lit("ns").alias("namespace"), (k % 3).alias("kb_id"), (k % 50).alias("document_id"), (k % 50).alias("generation_id"), (k * 10 + n).alias("chunk_id")]
    middle, end = F.concat(F.lit("m"), F.col("l_suppkey")), F.concat(F.lit("e"), F.col("l_partkey"))
    first = li.select(F.concat(F.lit("a"), key).alias("assertion_id"), F.when(n % 2 == 1, "REQUIRES_MATERIAL").otherwise("HAS_STEP").alias("predicate"), F.concat(F.lit("s"), k).alias("subject_uid"), middle.alias("object_uid"), *rest)
    field = n % 3 == 0
    second = li.select(F.concat(F.lit("b"), key).alias("assertion_id"), F.when(field, "HAS_FIELD").otherwise("REVIEWS").alias("predicate"), F.when(field, middle).otherwise(end).alias("subject_uid"), F.when(field, end).otherwise(middle).alias("object_uid"), *rest)
    i = F.col("s_suppkey")
    uid = F.concat(F.lit("m"), i)
    bridged = x.table(spark, sf, "supplier").where("s_suppkey % 9 = 0").select(uid.alias("source_uid"), uid.alias("target_uid"), (i % 50).alias("source_document"), ((i + 3) % 50).alias("target_document"), F.concat(F.lit("i"), i).alias("identity_id"), F.array(-(i % 50)).alias("chunks"))
    return paths.two_hop_paths(first, second, bridged).select("first_id", "second_id", "bridge_id", F.size("sources").cast("long").alias("sources"))


@query("SELECT o_orderkey AS path_id FROM orders WHERE o_orderkey % 8 IN (0, 1) OR (o_orderkey % 8 = 7 AND o_orderkey % 5 <> 0)")
def path_completeness(spark, sf):
    """Of each eight paths two are whole; the others have a loop, an end that does not meet, one fact twice, a source of another
    base, one with another text, and in four of five cases one that is there."""
    k = F.col("o_orderkey")
    r = k % 8
    hop = lambda a, b, f, d: F.struct(a.alias("start_uid"), b.alias("end_uid"), f.alias("assertion_id"), d.alias("document_id"))
    first = hop(F.lit(1), F.lit(2), k, F.lit(1))
    second = hop(F.when(r == 3, 9).when(r == 1, 5).otherwise(2), F.when(r == 2, 1).otherwise(3), F.when(r == 4, k).otherwise(k + 1), F.when(r == 1, 2).otherwise(1))
    source = lambda n, kb, digest: F.struct(n.alias("chunk_id"), kb.alias("kb_id"), digest.alias("content_sha256"))
    sources = F.array(source(k * 2, F.lit(1), F.lit("h")), source(k * 2 + 1, F.when(r == 5, 2).otherwise(1), F.when(r == 6, "old").otherwise("h")))
    o = x.table(spark, sf, "orders")
    p = o.select(k.alias("path_id"), F.lit(1).alias("kb_id"), F.array(first, second).alias("hops"), F.when(r == 1, 2).alias("bridge_from"), F.when(r == 1, 5).alias("bridge_to"), sources.alias("sources"))
    there = o.select(F.explode(F.array(k * 2, k * 2 + 1)).alias("chunk_id"), F.lit("h").alias("content_sha256"), (r == 7).alias("late"), (k % 5 == 0).alias("fifth")).where("not (late and fifth and chunk_id % 2 = 1)")
    return paths.complete_paths(p, there).select("path_id")


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'one_hop' ELSE 'two_hop' END AS mode, c_custkey AS case_id, c_custkey % 2 = 0 OR c_custkey % 3 = 2 AS path_found, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 2) AS accepted FROM customer")
def two_hop_acceptance(spark, sf):
    """A case has a path to find if it is odd, which two_hop finds; some answers lack a document, a field or a citation."""
    k = F.col("c_custkey")
    c = x.table(spark, sf, "customer")
    none = F.array().cast("array<bigint>")
    cases = c.select(k.alias("case_id"), F.when(k % 2 == 1, k).alias("path_id"), F.array(k, k + 1).alias("documents"), F.lit("if late").alias("condition"), F.array(F.lit("name"), F.lit("date")).alias("fields"))
    mode = F.when(k % 3 == 0, "hybrid").when(k % 3 == 1, "one_hop").otherwise("two_hop")
    got = F.when((k % 3 == 2) & (k % 2 == 1), F.array(k)).otherwise(none)
    given = c.select(mode.alias("mode"), k.alias("case_id"), got.alias("paths"), F.when(k % 5 == 0, F.array(k)).otherwise(F.array(k, k + 1, k + 2)).alias("documents"), F.when(k % 7 == 0, "if late, the name").otherwise("if late, the name and the date").alias("text"), F.when(k % 11 == 0, F.array(F.lit(9))).otherwise(F.array(F.lit(1))).alias("citations"), F.array(F.lit(1), F.lit(2)).alias("evidence"))
    return paths.accepted(cases, given).select("mode", "case_id", "path_found", "accepted")


_FAULTS = {
    "EVIDENCE_UNKNOWN_CHUNK": "k % 97 = 0",
    "EVIDENCE_SCOPE_MISMATCH": "k % 97 <> 0 AND k % 89 = 0",
    "EVIDENCE_CONTENT_HASH_MISMATCH": "k % 97 <> 0 AND k % 83 = 0",
    "EVIDENCE_QUOTE_OFFSET_INVALID": "k % 97 <> 0 AND k % 79 = 0",
    "EVIDENCE_SOURCE_REFS_MISMATCH": "k % 97 <> 0 AND k % 73 = 0",
    "EVIDENCE_KEY_MISMATCH": "k % 97 <> 0 AND k % 79 <> 0 AND k % 71 = 0",
    "ENTITY_NORMALIZATION_MISMATCH": "k % 67 = 0",
    "ENTITY_SCOPE_MISMATCH": "k % 61 = 0 AND k % 59 <> 0",
    "MENTION_WITHOUT_EVIDENCE": "k % 59 = 0",
    "ORPHAN_ENTITY_GLOBAL": "k % 53 = 0",
    "DUPLICATE_ENTITY_KEY_GLOBAL": "k % 47 = 0",
    "ENTITY_KEY_MISMATCH": "k % 43 = 0 AND k % 67 <> 0",
    "INVALID_RELATION_ENDPOINT": "k % 41 = 0 OR k % 37 = 0",
    "ORPHAN_OR_AMBIGUOUS_FACT_ENDPOINT": "k % 37 = 0",
    "FACT_ENTITY_SCOPE_MISMATCH": "k % 37 <> 0 AND k % 61 = 0",
    "FACT_EVIDENCE_CARDINALITY": "k % 29 = 0",
    "FACT_WITHOUT_EVIDENCE": "k % 29 <> 0 AND k % 23 = 0",
    "FACT_EVIDENCE_SCOPE_MISMATCH": "k % 29 <> 0 AND k % 23 <> 0 AND k % 89 = 0",
    "FACT_KEY_MISMATCH": "k % 29 <> 0 AND k % 19 = 0",
    "DUPLICATE_FACT": "k % 17 = 0",
    "ORPHAN_EVIDENCE": "k % 103 = 0 AND k % 97 <> 0 AND k % 101 <> 0",
    "OTHER_GENERATION_EVIDENCE": "k % 101 = 0 AND NOT (k % 89 = 0 AND k % 100 = 99)",
}
#: The same of projections, one for each hundredth of the orders.
_OF_PROJECTIONS = {"PROJECTION_NOT_READY": 13, "ACTIVE_REVISION_MISMATCH": 17, "NAMESPACE_MISMATCH": 19, "ENTITY_COUNT_MISMATCH": 23, "FACT_COUNT_MISMATCH": 29}
#: Rows for each order, where some are twice: entities of every 47th, facts of every 17th.
_TWICE = dict.fromkeys(("ENTITY_SCOPE_MISMATCH", "MENTION_WITHOUT_EVIDENCE"), "1 + CAST(k % 47 = 0 AS INTEGER)") | dict.fromkeys(("INVALID_RELATION_ENDPOINT", "ORPHAN_OR_AMBIGUOUS_FACT_ENDPOINT", "FACT_ENTITY_SCOPE_MISMATCH", "FACT_EVIDENCE_CARDINALITY", "FACT_WITHOUT_EVIDENCE", "FACT_EVIDENCE_SCOPE_MISMATCH", "FACT_KEY_MISMATCH"), "1 + CAST(k % 17 = 0 AS INTEGER)")
_AUDIT = " UNION ALL ".join(f"SELECT '{c}' AS code, CAST(sum({_TWICE.get(c, '1')}) AS BIGINT) AS issues FROM o WHERE {w} HAVING count(*) > 0" for c, w in _FAULTS.items())
_AUDIT += "".join(f" UNION ALL SELECT '{c}', count(*) FROM (SELECT DISTINCT k % 100 AS g FROM o) WHERE g % {n} = 0 HAVING count(*) > 0" for c, n in _OF_PROJECTIONS.items())


@query(f"WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders) {_AUDIT}")
def graph_audit_full(spark, sf):
    """A graph with a fact of two entities for each order, and each of the 27 faults at its own interval."""
    k = F.col("k")
    every = lambda n: k % n == 0
    o = x.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    place = [F.lit("ns").alias("namespace"), F.lit(1).alias("tenant_id"), (k % 3).alias("kb_id")]
    content = F.format_string("Step %d needs Form %d", k, k)
    generation = F.when(every(101), 1000).otherwise(k % 100)
    rest = [F.lit(1).alias("revision_id"), generation.alias("generation_id"), k.alias("chunk_index")]
    chunks = o.where("k % 97 <> 0").select(k.alias("chunk_id"), *place, (k % 100).alias("document_id"), *rest, content.alias("content"), F.sha2(content, 256).alias("content_sha256"), F.lit("r").alias("source_refs"))
    document = (k % 100 + F.when(every(89), 1).otherwise(0))
    key = F.when(every(71), F.concat(F.lit("bad"), k)).otherwise(audit.stable_key(F.lit("ns"), F.lit(1), generation, k, F.lit(0), content))
    evidence = o.select(key.alias("key"), k.alias("chunk_id"), *place, document.alias("document_id"), *rest, F.when(every(83), "x").otherwise(F.sha2(content, 256)).alias("content_sha256"), content.alias("quote"), F.lit(0).alias("quote_start"), (F.char_length(content) - F.when(every(79), 1).otherwise(0)).alias("quote_end"), F.when(every(73), "z").otherwise("r").alias("source_refs"))
    unused = o.where("k % 103 = 0 and k % 97 <> 0 and k % 101 <> 0").select(audit.stable_key(F.lit("ns"), F.lit(1), generation, k, F.lit(0), F.lit("Step")).alias("key"), k.alias("chunk_id"), *place, (k % 100).alias("document_id"), *rest, F.sha2(content, 256).alias("content_sha256"), F.lit("Step").alias("quote"), F.lit(0).alias("quote_start"), F.lit(4).alias("quote_end"), F.lit("r").alias("source_refs"))
    step, form = F.format_string("Step %d", k), F.format_string("Form %d", k)
    step_key = F.when(every(43), F.concat(F.lit("wrong"), k)).otherwise(audit.stable_key(F.lit("ns"), F.lit(1), k % 3, F.lit("Step"), F.lower(step), document))
    kb = k % 3 + F.when(every(61), 1).otherwise(0)
    form_key = audit.stable_key(F.lit("ns"), F.lit(1), kb, F.lit("Material"), F.lower(form), F.lit(None))
    a = o.select(step_key.alias("key"), *place, F.lit("Step").alias("type"), step.alias("name"), F.when(every(67), "STEP").otherwise(F.lower(step)).alias("normalized_name"))
    b = o.select(form_key.alias("key"), *place[:2], kb.alias("kb_id"), F.lit("Material").alias("type"), form.alias("name"), F.lower(form).alias("normalized_name"))
    twice = o.where("k % 47 = 0").select(form_key.alias("key"), *place[:2], kb.alias("kb_id"), F.lit("Material").alias("type"), form.alias("name"), F.lower(form).alias("normalized_name"))
    lost = o.where("k % 53 = 0").select(F.concat(F.lit("lost"), k).alias("key"), *place, F.lit("Material").alias("type"), F.lit("X").alias("name"), F.lit("x").alias("normalized_name"))
    mentions = o.select(step_key.alias("entity_key"), key.alias("evidence_key")).unionByName(o.select(form_key.alias("entity_key"), F.when(every(59), "none").otherwise(key).alias("evidence_key")))
    keys = F.when(every(29), F.array().cast("array<string>")).when(every(23), F.array(F.lit("none"))).otherwise(F.array(key))
    predicate = F.when(every(41), "HAS_FIELD").otherwise("REQUIRES_MATERIAL")
    target = F.when(every(37), "nobody").otherwise(form_key)
    own = audit.stable_key(F.get(keys, 0), step_key, predicate, target, F.lit(""))
    facts = o.select(F.when(every(19), F.concat(F.lit("f"), k)).otherwise(own).alias("key"), predicate.alias("predicate"), step_key.alias("subject_key"), target.alias("object_key"), F.lit("").alias("condition_text"), *place, (k % 100).alias("document_id"), generation.alias("generation_id"), keys.alias("evidence_keys"), k)
    facts, entities = facts.unionByName(facts.where("k % 17 = 0")), a.unionByName(b).unionByName(lost).unionByName(twice)
    evidence = evidence.unionByName(unused)
    g, plus = F.col("document_id"), lambda n: F.when(F.col("document_id") % n == 0, 1).otherwise(0)
    told = o.groupBy((k % 100).alias("document_id")).agg(F.count_if(~every(101)).alias("n"))
    projections = told.select(g.alias("projection_id"), g, (1 + plus(17)).alias("revision_id"), g.alias("generation_id"), F.when(g % 19 == 0, "other").otherwise("ns").alias("namespace"), F.when(g % 13 == 0, "STALE").otherwise("READY").alias("status"), (2 * F.col("n") + plus(23)).alias("entity_count"), (F.col("n") + plus(29)).alias("relation_count"))
    documents = told.select("document_id", F.lit(1).alias("active_revision_id"))
    entities_of = o.select(generation.alias("generation_id"), F.explode(F.array(step_key, form_key)).alias("entity_key"))
    found = [audit.evidence_problems(evidence, chunks, mentions, facts, projections, documents), audit.entity_problems(entities, mentions, evidence, facts), audit.fact_problems(facts, entities, evidence, graph.endpoints(spark)), audit.projection_problems(projections, documents, "ns", entities_of, facts)]
    return audit.counted(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]))


@query("WITH e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), c AS (SELECT 'RAW_PROJECTION_FACT_MISMATCH' AS code, count(*) AS issues FROM e WHERE k % 7 <> 0 AND k % 10 = 0 UNION ALL SELECT 'RAW_PROJECTION_ENTITY_MISMATCH', count(*) FROM e WHERE k % 11 = 0 UNION ALL SELECT 'FACT_EXCLUSION_KEY_INVALID', 2) SELECT * FROM c WHERE issues > 0")
def rebuild_check(spark, sf):
    """Every seventh fact is excluded, every tenth got lost, every eleventh entity is one too many; two exclusions name nothing."""
    k = x.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), F.col("key"))
    expected = kind(k, "fact").unionByName(kind(k.where("key % 11 <> 0"), "entity"))
    stored = kind(k.where("key % 7 <> 0 and key % 10 <> 0"), "fact").unionByName(kind(k, "entity"))
    return audit.counted(audit.rebuilt(expected, stored, k.where("key % 7 = 0").unionByName(spark.createDataFrame([(-1,), (-2,)], "key long"))))


# Cells of the column of duties, and actor, action and condition that they give.
DUTIES = (("由经办人登记", "经办人", "登记", None), ("主管与人事复核", "主管与人事", "复核", None), ("签收后由管理员归档", "管理员", "归档", "签收后"), ("财务付款", None, None, None), ("到货后盘点后由员工上架", "员工", "上架", "到货后盘点后"))
_DUTIES = ", ".join(f"({i}, '{a}', '{b}', {'NULL' if c is None else repr(c)})" for i, (_, a, b, c) in enumerate(DUTIES) if a)


@query(f"SELECT l_orderkey AS document_id, l_linenumber AS line_no, 'RESPONSIBLE_FOR' AS predicate, a AS subject, b AS object, c AS condition_text FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey % 5 AS n FROM lineitem WHERE l_orderkey % 3 = 0) JOIN (VALUES {_DUTIES}) v(n, a, b, c) USING (n) UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, 'GOVERNED_BY', 'M' || l_linenumber, 'keep', CAST(NULL AS VARCHAR) FROM lineitem WHERE l_orderkey % 3 = 1 AND l_linenumber <> 2")
def table_row_facts(spark, sf):
    """Tables of duties and of materials, some without a header, the header a chunk earlier; a row of another width does not count."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = x.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    duty = F.element_at(F.array(*[F.lit(d[0]) for d in DUTIES]), (k % len(DUTIES) + 1).cast("int"))
    material = F.when(n == 2, F.array(F.lit("a"))).otherwise(F.array(F.concat(F.lit("M"), n), F.lit("keep")))
    cells = F.when(k % 3 == 0, F.array(F.lit("x"), duty)).otherwise(material)
    body = rows.select(k.alias("document_id"), F.lit(1).alias("chunk_index"), n.alias("line_no"), cells.alias("cells"))
    head = rows.select(k.alias("document_id")).distinct().where("document_id % 3 <> 2").select("document_id", F.lit(0).alias("chunk_index"), F.lit(0).cast("long").alias("line_no"), F.when(F.col("document_id") % 3 == 0, F.array(F.lit(relations.TOPIC), F.lit(relations.DUTY))).otherwise(F.array(F.lit(relations.MATERIAL), F.lit(relations.CARE))).alias("cells"))
    rule = head.withColumn("line_no", F.lit(-1).cast("long")).withColumn("cells", F.array(F.lit("---"), F.lit(":-:")))
    return relations.table_facts(body.unionByName(head).unionByName(rule)).drop("chunk_index")


# --- publication


def _work(spark, sf):
    """(documents, tasks, projections, finished work): a document's new generation is indexed, its old one has a graph task."""
    i = F.col("doc_id")
    base = x.table(spark, sf, "documents").select("doc_id")
    docs = base.select(i.alias("document_id"), F.when(i % 10 == 0, "DRAFT").when(i % 13 == 0, "DELETED").otherwise("PUBLISHED").alias("status"), F.when(i % 13 == 0, x.now()).alias("deleted_at"), (i * 10 + F.when(i % 11 == 0, 1).otherwise(0)).alias("desired_revision_id"), F.when(i % 6 != 0, i * 100).alias("active_generation_id"))
    lease = F.when(i % 5 == 0, x.now() - F.expr("INTERVAL 1 DAY")).otherwise(x.now() + F.expr("INTERVAL 1 DAY"))
    both = [i.alias("document_id"), (i * 10).alias("revision_id"), F.lit("w").alias("owner"), F.lit(3).alias("epoch"), lease.alias("lease_until"), F.lit(None).cast("string").alias("error_code")]
    index = base.select((i * 2).alias("task_id"), F.lit("INDEX").alias("task_type"), F.when(i % 3 == 0, "FAILED").otherwise("RUNNING").alias("status"), (i * 100 + 1).alias("generation_id"), *both)
    chart = base.select((i * 2 + 1).alias("task_id"), F.lit("GRAPH").alias("task_type"), F.when(i % 2 == 0, "PENDING").otherwise("SUCCEEDED").alias("status"), (i * 100).alias("generation_id"), *both)
    projections = base.select(i.alias("document_id"), (i * 100).alias("generation_id"), F.lit("READY").alias("status"), F.lit("ns").alias("namespace"), F.lit(2).cast("int").alias("projection_version"))
    return docs, index.unionByName(chart), projections, index.select("task_id", "owner", F.when(F.col("document_id") % 7 == 0, 2).otherwise(3).alias("epoch"))


_PUBLISHED = "pu AS (SELECT doc_id AS d FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)"


def _published(spark, sf):
    docs, tasks, projections, done = _work(spark, sf)
    return docs, tasks, projections, publication.may_publish(done, tasks, docs, x.now())


@query(f"WITH {_PUBLISHED} SELECT doc_id AS document_id, CASE WHEN d IS NOT NULL THEN 'PUBLISHED' WHEN doc_id % 10 = 0 THEN 'DRAFT' WHEN doc_id % 13 = 0 THEN 'DELETED' ELSE 'PUBLISHED' END AS status, CASE WHEN d IS NOT NULL THEN d * 100 + 1 WHEN doc_id % 6 <> 0 THEN doc_id * 100 END AS active_generation_id FROM documents LEFT JOIN pu ON d = doc_id")
def publish_documents(spark, sf):
    """Q9."""
    docs, _, _, published = _published(spark, sf)
    return publication.published_documents(docs, published).select("document_id", "status", "active_generation_id")


@query(f"WITH {_PUBLISHED} SELECT doc_id * 2 AS task_id, CASE WHEN d IS NOT NULL THEN 'SUCCEEDED' WHEN doc_id % 3 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS status, NULL AS error_code, 3 AS epoch, d IS NULL AS held FROM documents LEFT JOIN pu ON d = doc_id UNION ALL SELECT doc_id * 2 + 1, CASE WHEN d IS NOT NULL AND doc_id % 2 = 0 THEN 'CANCELLED' WHEN doc_id % 2 = 0 THEN 'PENDING' ELSE 'SUCCEEDED' END, CASE WHEN d IS NOT NULL AND doc_id % 2 = 0 THEN 'GENERATION_SUPERSEDED' END, CASE WHEN d IS NOT NULL AND doc_id % 2 = 0 THEN 4 ELSE 3 END, NOT (d IS NOT NULL AND doc_id % 2 = 0) FROM documents LEFT JOIN pu ON d = doc_id AND doc_id % 6 <> 0")
def publish_tasks(spark, sf):
    """Q9."""
    docs, tasks, _, published = _published(spark, sf)
    after = publication.tasks_after(tasks, docs, published)
    return after.select("task_id", "status", "error_code", "epoch", F.col("owner").isNotNull().alias("held"))


@query(f"WITH {_PUBLISHED} SELECT 'graph:purge:' || (d * 100) || ':v2' AS deduplication_key, d AS document_id FROM pu WHERE d % 6 <> 0 AND d % 4 <> 0")
def publish_purges(spark, sf):
    """Q9: every fourth purge is in the outbox already."""
    docs, _, projections, published = _published(spark, sf)
    known = docs.where("document_id % 4 = 0").select(F.format_string("graph:purge:%d:v2", F.col("document_id") * 100).alias("deduplication_key"))
    return publication.purge_events(projections, docs, published, known).select("deduplication_key", "document_id")


@query(f"WITH {_PUBLISHED} SELECT doc_id AS document_id, CASE WHEN d IS NOT NULL AND d % 6 <> 0 THEN 'STALE' ELSE 'READY' END AS status FROM documents LEFT JOIN pu ON d = doc_id")
def publish_projections(spark, sf):
    """Q9."""
    docs, _, projections, published = _published(spark, sf)
    return publication.projections_after(projections, docs, published).select("document_id", "status")


@query("WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS key, min(l_orderkey) AS c FROM lineitem GROUP BY 1) SELECT key, CASE WHEN c % 5 = 0 AND c % 4 <> 0 THEN 'new' ELSE 'old' END AS version FROM o WHERE NOT (c % 5 = 0 AND c % 4 <> 0 AND key % 10 = 3) UNION ALL SELECT DISTINCT o_orderkey * 10 + 9, 'new' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0")
def chunk_upsert(spark, sf):
    """Every fifth chunk is written again, with one fact less and one more; generations of every fourth are retired."""
    li = x.table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    place = lambda c: [F.lit("ns").alias("namespace"), F.lit(1).alias("tenant_id"), c.alias("generation_id"), c.alias("chunk_id")]
    old = li.select((k * 10 + F.col("l_linenumber")).alias("key"), *place(k), F.lit("old").alias("version")).dropDuplicates(["key"])
    orders = x.table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(*place(F.col("o_orderkey")))
    more = orders.select((F.col("chunk_id") * 10 + 9).alias("key"), *orders.columns, F.lit("new").alias("version"))
    new = old.where("chunk_id % 5 = 0 and key % 10 <> 3").withColumn("version", F.lit("new")).unionByName(more).unionByName(more)
    retired = x.table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.lit("ns").alias("namespace"), F.lit(1).alias("tenant_id"), F.col("o_orderkey").alias("generation_id"))
    return publication.upserted_chunks(old, new, orders, retired, "key").select("key", "version")


@query("SELECT l_orderkey % 50 AS document_id, l_suppkey % 4 AS generation_id, count(*) AS n FROM lineitem WHERE l_orderkey % 50 NOT IN (3, 7) AND NOT (l_orderkey % 50 = 5 AND l_suppkey % 4 = 1) GROUP BY ALL")
def graph_purge(spark, sf):
    """G9."""
    li = x.table(spark, sf, "lineitem").select(F.lit("ns").alias("namespace"), F.lit(1).alias("tenant_id"), (F.col("l_orderkey") % 50).alias("document_id"), (F.col("l_suppkey") % 4).alias("generation_id"))
    documents = spark.createDataFrame([("ns", 1, 3), ("ns", 1, 7), ("ns", 2, 9), ("other", 1, 9)], "namespace string, tenant_id int, document_id long")
    generations = spark.createDataFrame([("ns", 1, 5, 1), ("other", 1, 6, 1)], "namespace string, tenant_id int, document_id long, generation_id long")
    return publication.purged(li, documents, generations).groupBy("document_id", "generation_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 9 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 7 END AS version FROM customer")
def optimistic_update(spark, sf):
    """M1: changes to every sixth row expect another version."""
    c = x.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit(7).alias("version"))
    k = F.col("c_custkey")
    changes = c.where("c_custkey % 3 = 0 or c_custkey % 4 = 0").select("c_custkey", F.when(k % 3 == 0, 7).otherwise(6).alias("version"), F.concat(F.lit("new "), k).alias("c_name"), F.when(k % 9 == 0, 99).cast("long").alias("c_nationkey"))
    return publication.updated(c, changes, "c_custkey", "version", ["c_name", "c_nationkey"])[0]


@query("WITH w AS (SELECT DISTINCT o_custkey AS d FROM orders WHERE o_custkey % 4 = 0 UNION SELECT -1), s AS (SELECT o_orderkey % 3000 AS k FROM orders GROUP BY 1 HAVING min(o_custkey) <> max(o_custkey)) SELECT d AS document_id, CASE WHEN d NOT IN (SELECT c_custkey FROM customer) THEN 'DOCUMENT_NOT_FOUND' WHEN d IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3000 IN (FROM s)) THEN 'OBJECT_SHARED' ELSE 'OK' END AS code FROM w")
def delete_checks(spark, sf):
    """M3, J6."""
    o = x.table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.lit("b").alias("bucket"), (F.col("o_orderkey") % 3000).alias("object_key"))
    wanted = o.where("document_id % 4 = 0").select("document_id").unionByName(spark.createDataFrame([(-1,)], "document_id long"))
    return publication.deletable(x.table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id")), o, wanted)


@query("SELECT event_type, event_id, CASE event_id % 6 WHEN 0 THEN 'OWN' WHEN 1 THEN 'INVALID_EMBEDDING' WHEN 2 THEN 'MODEL_CONFIGURATION_ERROR' WHEN 3 THEN 'OBJECT_NOT_FOUND' WHEN 4 THEN 'PROCESSING_TIMEOUT' ELSE 'PROCESSING_UNAVAILABLE' END AS code, event_id % 6 >= 4 AS retryable FROM events")
def failure_class(spark, sf):
    """Q12."""
    kinds = F.array(*[F.lit(k) for k in (*publication.FAILURES, "other")])
    e = x.table(spark, sf, "events").withColumn("f", publication.failure(F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")), F.lit("OWN")))
    return e.select("event_type", "event_id", "f.code", "f.retryable")


# --- answers

@query("SELECT item_id, sha256('文档标题：T' || item_id || chr(10) || '文件名：f.pdf' || chr(10) || '章节：' || CASE WHEN item_id % 2 = 0 THEN 'S' ELSE '' END || chr(10) || '原文：' || chr(10) || text) AS digest FROM benchmark")
def rerank_texts(spark, sf):
    """R5."""
    b = x.table(spark, sf, "benchmark")
    text = answers.rerank_text(F.concat(F.lit("T"), F.col("item_id")), F.lit("f.pdf"), F.when(F.col("item_id") % 2 == 0, "S"), F.col("text"))
    return b.select("item_id", F.sha2(text, 256).alias("digest"))


@query("SELECT count(DISTINCT (o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_shippriority END)) AS requests FROM (SELECT o_custkey, o_orderkey % 3 AS o_shippriority FROM orders)")
def request_digests(spark, sf):
    """Of even customers all requests mean the same, however their ids are ordered."""
    o = x.table(spark, sf, "orders")
    k, n = F.col("o_custkey"), F.col("o_orderkey") % 3
    ids = F.when(n == 0, F.array(k, k + 1)).when(n == 1, F.array(k + 1, k)).otherwise(F.array(k, k + 1))
    docs = F.when(n == 2, F.array().cast("array<bigint>"))
    item = lambda f, v: F.struct(F.lit(f).alias("field"), F.lit("eq").alias("operator"), v.cast("string").alias("value"))
    filters = F.when(n == 0, F.array(item("a", k), item("b", k))).otherwise(F.array(item("b", k), item("a", k)))
    digest = answers.request_digest(F.when(k % 2 == 0, "q").otherwise(F.concat(F.lit("q"), n)), F.lit("c"), ids, docs, filters, F.lit(0), F.lit(20))
    return o.select(k, digest.alias("d")).agg(F.countDistinct("o_custkey", "d").alias("requests"))


@query("SELECT conv_id, CAST(sum(greatest(length(text), 0)) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END) AS BIGINT) AS output_tokens, CASE WHEN bool_or(turn = 7) THEN NULL ELSE round(sum((length(text) * CASE WHEN role = 'user' THEN 1 ELSE 2 END + CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END * 4) / 1e6), 6) END AS cost FROM conversations GROUP BY 1")
def token_costs(spark, sf):
    """A19."""
    t = F.col("turn")
    rows = x.table(spark, sf, "conversations").select("conv_id", F.when(t == 7, "unknown").when(F.col("role") == "user", "small").otherwise("large").alias("model"), F.char_length("text").alias("input_tokens"), F.when(t % 3 != 0, t).alias("output_tokens"))
    return answers.usage(rows, "conv_id", {"small": (1.0, 4.0), "large": (2.0, 4.0)})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'QUERY_SCOPE_FORBIDDEN' WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'empty' WHEN o_orderkey % 3 = 0 THEN 'structured' ELSE 'retrieval' END AS executor FROM orders")
def plan_dispatch(spark, sf):
    """L5."""
    k = F.col("o_orderkey")
    rows = x.table(spark, sf, "orders").select(k, F.when(k % 3 == 0, "structured").otherwise("hybrid").alias("route"), F.when(k % 4 == 0, "empty").otherwise("planned").alias("status"), (k % 10 != 0).alias("same_identity"))
    return answers.executor_of(rows).select("o_orderkey", "executor")


@query("SELECT l_orderkey AS answer_id, bool_or(l_linenumber > 1 AND l_partkey % 3 = 1) AS incomplete FROM lineitem GROUP BY 1")
def table_contexts(spark, sf):
    """Fragments know their header, show one, or lack it."""
    r = F.col("l_partkey") % 3
    rows = x.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.lit("table").alias("kind"), F.col("l_linenumber").alias("row_start"), F.when(r == 0, 1).alias("header_row"), F.when(r == 2, "| a | b |\n| --- | --- |\n| 1 | 2 |").otherwise("| 1 | 2 |").alias("content"))
    return answers.lacks_header(rows)


@query("SELECT o_orderkey AS id, 'SCOPES_MIXED' AS issue FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def scope_mixing(spark, sf):
    """D18."""
    k = F.col("o_orderkey")
    scope_of = lambda d, s: F.struct(F.lit(d).alias("document_id"), F.lit(s).alias("scope"))
    rows = x.table(spark, sf, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("documents"), F.when(k % 3 == 0, "In plant A and plant B it holds").otherwise("It holds").alias("statement"), F.array(scope_of(1, "plant A"), scope_of(2, "plant B")).alias("scopes"))
    return answers.scope_conflicts(rows)


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'empty' WHEN 2 THEN 'degraded' ELSE 'ok' END AS status FROM orders")
def degradation_status(spark, sf):
    """R6."""
    k = F.col("o_orderkey") % 5
    codes = F.when(k.isin(0, 2), F.array(F.lit("RERANKER_UNAVAILABLE"), F.lit("RERANKER_UNAVAILABLE"))).otherwise(F.array().cast("array<string>"))
    return x.table(spark, sf, "orders").select("o_orderkey", answers.status_of(codes, F.when(k == 1, 0).otherwise(3), F.when(k == 0, "unsupported").otherwise("planned")).alias("status"))


# --- JSON


@query("""WITH j AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"k": null, "n": {"x": 5}}' WHEN 1 THEN '[1, 2, 3]' WHEN 2 THEN '"s"' WHEN 3 THEN '7.5' WHEN 4 THEN 'true' ELSE '{bad' END AS j, event_id % 6 AS m FROM events)
SELECT event_id, CASE m WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'number' WHEN 4 THEN 'boolean' END AS type, CASE WHEN m = 1 THEN 3 END AS items, CASE WHEN m = 0 THEN '5' END AS x, m = 0 AS has_k, CAST(1 + CASE WHEN m = 0 THEN 0 ELSE 1 END AS INTEGER) AS set_, event_id % 4 BETWEEN 1 AND 2 AS mid, CASE WHEN m = 2 THEN '1,2,9' ELSE '1,2' END AS list, '{"a":' || m || '}' AS built, CASE WHEN m = 3 THEN 'b:9' ELSE 'b:2' END AS b FROM j""")
def json_functions(spark, sf):
    """F9, F20, F24, F26-F29, F31, F32."""
    m = F.col("event_id") % 6
    texts = ['{"k": null, "n": {"x": 5}}', "[1, 2, 3]", '"s"', "7.5", "true", "{bad"]
    e = x.table(spark, sf, "events").select("event_id", m.alias("m"), F.element_at(F.array(*[F.lit(t) for t in texts]), (m + 1).cast("int")).alias("j"))
    ok = F.when(F.try_parse_json("j").isNotNull(), F.col("j"))
    both = json.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.when(F.col("m") == 3, F.create_map(F.lit("b"), F.lit(9))).otherwise(F.create_map(F.lit("c"), F.lit(3))))
    return e.select(
        "event_id", json.type_of("j").alias("type"), json.array_length("j").alias("items"), json.field(ok, "n.x").alias("x"), json.has_key(ok, "k").alias("has_k"), json.nonnulls(F.lit(1), F.when(F.col("m") != 0, 1)).alias("set_"), json.in_range(F.col("event_id") % 4, F.lit(1), F.lit(2)).alias("mid"),
        F.array_join(json.append_if_absent(F.array(F.lit(1), F.lit(2)), F.when(F.col("m") == 2, 9).otherwise(2)), ",").alias("list"), json.build_object(a=F.col("m"), z=F.lit(None).cast("int")).alias("built"), F.concat(F.lit("b:"), F.element_at(both, "b")).alias("b"),
    )

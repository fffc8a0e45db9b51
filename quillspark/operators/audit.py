"""Audits of a stored graph against the chunks it was made from (G22, G23, S13). Each join runs once and
gives every code that it can tell as (code, key) rows; nothing meets but by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import piece

SCOPE = ("tenant_id", "kb_id", "document_id", "revision_id", "generation_id", "chunk_index")
#: Entities of these types are keyed by their place too.
CONTEXT_TYPES = ("Step", "State", "Field", "Rule")


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the JSON array of the parts as strings."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def _rows(df: DataFrame, code: str, bad: Column, key: str = "key") -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))


def _coded(df: DataFrame, codes: dict[str, Column], key: str = "key") -> DataFrame:
    """(code, key) for each code whose condition holds, so many times if it is a number: one pass over df, however many codes
    there are. A condition that is null holds."""

    def times(code: str, c: Column) -> Column:
        n = c if dict(df.select(c.alias("n")).dtypes)["n"] != "boolean" else F.coalesce(c, F.lit(True)).cast("int")
        return F.array_repeat(F.lit(code), n.cast("int"))

    found = F.concat(*[times(code, c) for code, c in codes.items()])
    return df.select(F.explode(found).alias("code"), F.col(key).cast("string").alias("key"))


def _apart(columns, prefix: str) -> Column:
    other = F.lit(False)
    for n in columns:
        other = other | ~F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return other


def token(key: Column) -> Column:
    """The first 128 bits of a key's SHA-256. Keys meet by it, so that no exchange carries them; those that a result names go beside it."""
    return F.unhex(F.substring(F.sha2(key.cast("string"), 256), 1, 32))


def evidence_problems(evidence: DataFrame, chunks: DataFrame, mentions: DataFrame | None = None, facts: DataFrame | None = None, projections: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Evidence (key, chunk_id, SCOPE, namespace, content_sha256, quote, quote_start, quote_end, source_refs) against chunks (chunk_id,
    SCOPE, content, content_sha256, source_refs); with mentions and facts, whether any of these uses it; with projections and
    documents, whether it is of an audited document but of none of the audited generations."""
    c = chunks.select("chunk_id", *[F.col(n).alias(f"c_{n}") for n in (*SCOPE, "content", "source_refs")], token(F.col("content_sha256")).alias("c_hash"), F.lit(True).alias("_c"))
    own = stable_key(*[F.col(n) for n in ("namespace", "tenant_id", "generation_id", "chunk_id", "quote_start", "quote")])
    told = evidence.select("key", "chunk_id", *SCOPE, "quote", "quote_start", "quote_end", "source_refs", token(F.col("content_sha256")).alias("hash"), F.coalesce(F.col("key") != own, F.lit(True)).alias("_differs"))
    known = F.coalesce("_c", F.lit(False))
    there = F.coalesce(piece(F.col("c_content"), F.col("quote_start"), F.col("quote_end")) == F.col("quote"), F.lit(False)) & (F.char_length("quote") > 0)
    found = _coded(told.join(c, "chunk_id", "left"), {
        "EVIDENCE_UNKNOWN_CHUNK": ~known,
        "EVIDENCE_SCOPE_MISMATCH": known & _apart(SCOPE, "c_"),
        "EVIDENCE_CONTENT_HASH_MISMATCH": known & F.coalesce(F.col("hash") != F.col("c_hash"), F.lit(True)),
        "EVIDENCE_QUOTE_OFFSET_INVALID": known & ~there,
        "EVIDENCE_KEY_MISMATCH": known & there & F.col("_differs"),
        "EVIDENCE_SOURCE_REFS_MISMATCH": known & ~F.col("source_refs").eqNullSafe(F.col("c_source_refs")),
    })
    if mentions is not None and facts is not None:
        used = mentions.select(token(F.col("evidence_key")).alias("_t")).unionByName(facts.select(F.explode("evidence_keys").alias("_k")).select(token(F.col("_k")).alias("_t")))
        unused = evidence.select("key", token(F.col("key")).alias("_t")).join(used, "_t", "left_anti")
        found = found.unionByName(_rows(unused, "ORPHAN_EVIDENCE", F.lit(True)))
    if projections is not None and documents is not None:
        other = evidence.select("key", "generation_id", "document_id").join(projections.select("generation_id"), "generation_id", "left_anti")
        found = found.unionByName(_rows(other.join(documents.select("document_id"), "document_id", "left_semi"), "OTHER_GENERATION_EVIDENCE", F.lit(True)))
    return found


def entity_problems(entities: DataFrame, mentions: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities (key, namespace, tenant_id, kb_id, type, name, normalized_name) and mentions (entity_key, evidence_key): a pass over
    the mentions, and one over the entities' keys and their uses together."""
    place = ("namespace", "tenant_id", "kb_id")
    name = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    keyed = lambda t, n, d: stable_key(*[F.col(c) for c in place], t, n, d)
    context = F.coalesce(F.col("type").isin(*CONTEXT_TYPES), F.lit(False))
    # what follows from the entity alone is told before it meets its mentions; only a context's key needs their document
    own = F.when(~context, F.coalesce(F.col("key") != keyed(F.col("type"), name, F.lit(None)), F.lit(True)))
    ent = entities.select(token(F.col("key")).alias("_t"), *place, F.when(context, F.col("type")).alias("_type"), F.when(context, name).alias("_name"), F.coalesce(F.col("normalized_name") == name, F.lit(False)).alias("_normal"), own.alias("_differs"))
    e = evidence.select(token(F.col("key")).alias("_v"), *[F.col(n).alias(f"e_{n}") for n in (*place, "document_id")], F.lit(True).alias("_e"))
    j = mentions.select("entity_key", token(F.col("entity_key")).alias("_t"), token(F.col("evidence_key")).alias("_v")).join(e, "_v", "left").drop("_v").join(ent, "_t")
    known = F.coalesce("_e", F.lit(False))
    differs = F.coalesce("_differs", F.col("_t") != token(keyed(F.col("_type"), F.col("_name"), F.col("e_document_id"))))
    mentioned = _coded(j, {
        "MENTION_WITHOUT_EVIDENCE": ~known,
        "ENTITY_SCOPE_MISMATCH": known & _apart(place, "e_"),
        "ENTITY_KEY_MISMATCH": known & F.col("_normal") & differs,
    }, "entity_key")
    bad = F.coalesce((name == "") | (F.col("normalized_name") != name), F.lit(True))
    use = lambda df, c: df.select(F.col(c).alias("key"), token(F.col(c)).alias("_t"), F.lit(0).alias("_n"), F.lit(1).alias("_used"))
    uses = use(mentions, "entity_key").unionByName(use(facts, "subject_key")).unionByName(use(facts, "object_key"))
    both = entities.select("key", token(F.col("key")).alias("_t"), F.lit(1).alias("_n"), F.lit(0).alias("_used")).unionByName(uses)
    keys = both.groupBy("_t").agg(F.first("key").alias("key"), F.sum("_n").alias("_n"), F.max("_used").alias("_used"))
    return mentioned.unionByName(_rows(entities, "ENTITY_NORMALIZATION_MISMATCH", bad)).unionByName(_coded(keys.where("_n > 0"), {
        "DUPLICATE_ENTITY_KEY_GLOBAL": F.col("_n") > 1,
        "ORPHAN_ENTITY_GLOBAL": F.when(F.col("_used") == 0, F.col("_n")).otherwise(0),
    }))


def fact_problems(facts: DataFrame, entities: DataFrame, evidence: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Facts (key, predicate, subject_key, object_key, condition_text, namespace, tenant_id, kb_id, document_id, generation_id,
    evidence_keys), each with one piece of evidence, two ends of allowed types in its scope, and the key that follows from them:
    a pass with their ends, one with their evidence, one by what they say."""
    place = ("namespace", "tenant_id", "kb_id")
    tokens = [token(F.col(f"{end}_key")).alias(end) for end in ("subject", "object")]
    ends = facts.select("key", "predicate", *place, *tokens)
    known = entities.select(token(F.col("key")).alias("_t"), "type", *place).dropDuplicates(["_t"])
    for end in ("subject", "object"):
        apart = F.lit(False)
        for n in place:
            apart = apart | (F.col(f"_{n}") != F.col(n))
        ends = ends.join(known.toDF(end, f"{end}_type", *[f"_{n}" for n in place]), end, "left").withColumn(f"{end}_apart", apart).drop(end, *[f"_{n}" for n in place])
    typed = ends.join(whitelist.withColumn("_w", F.lit(True)), ["predicate", "subject_type", "object_type"], "left")
    two = F.col("subject_type").isNotNull() & F.col("object_type").isNotNull()
    each = facts.select("key", "namespace", "document_id", "generation_id", F.explode("evidence_keys").alias("_k")).withColumn("_v", token(F.col("_k"))).drop("_k")
    e = evidence.select(token(F.col("key")).alias("_v"), *[F.col(n).alias(f"e_{n}") for n in ("namespace", "document_id", "generation_id")], F.lit(True).alias("_e"))
    held = each.join(e, "_v", "left")
    other = (F.col("namespace") != F.col("e_namespace")) | (F.col("document_id") != F.col("e_document_id")) | (F.col("generation_id") != F.col("e_generation_id"))
    own = stable_key(F.get("evidence_keys", 0), *[F.col(n) for n in ("subject_key", "predicate", "object_key", "condition_text")])
    alike = facts.select("key", "generation_id", "predicate", "condition_text", *tokens).groupBy("generation_id", "subject", "predicate", "object", "condition_text").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("_n"))
    of_ends = _coded(typed, {
        "INVALID_RELATION_ENDPOINT": F.col("_w").isNull(),
        "FACT_ENTITY_SCOPE_MISMATCH": two & F.coalesce(F.col("subject_apart") | F.col("object_apart"), F.lit(True)),
        "ORPHAN_OR_AMBIGUOUS_FACT_ENDPOINT": ~two,
    })
    alone = _coded(facts, {
        "FACT_EVIDENCE_CARDINALITY": F.size("evidence_keys") != 1,
        "FACT_KEY_MISMATCH": (F.size("evidence_keys") == 1) & F.coalesce(F.col("key") != own, F.lit(True)),
    })
    of_evidence = _coded(held, {"FACT_WITHOUT_EVIDENCE": F.col("_e").isNull(), "FACT_EVIDENCE_SCOPE_MISMATCH": F.col("_e").isNotNull() & F.coalesce(other, F.lit(True))})
    return of_ends.unionByName(alone).unionByName(of_evidence).unionByName(_coded(alike, {"DUPLICATE_FACT": F.col("_n") > 1}))


def projection_problems(projections: DataFrame, documents: DataFrame, namespace: str, entities_of: DataFrame, facts: DataFrame) -> DataFrame:
    """Projections (projection_id, document_id, revision_id, generation_id, namespace, status, entity_count, relation_count) against
    documents (document_id, active_revision_id) and what is stored: entities_of (generation_id, entity_key), facts."""
    of = lambda df, c, n: df.select("generation_id", token(F.col(c)).alias("_t")).groupBy("generation_id").agg(F.countDistinct("_t").alias(n))
    j = projections.join(documents.select("document_id", "active_revision_id"), "document_id", "left")
    j = j.join(of(entities_of, "entity_key", "_e"), "generation_id", "left").join(of(facts, "key", "_f"), "generation_id", "left")
    return _coded(j, {
        "PROJECTION_NOT_READY": F.col("status") != "READY",
        "ACTIVE_REVISION_MISMATCH": ~F.col("revision_id").eqNullSafe(F.col("active_revision_id")),
        "NAMESPACE_MISMATCH": F.col("namespace") != namespace,
        "ENTITY_COUNT_MISMATCH": F.col("entity_count") != F.coalesce("_e", F.lit(0)),
        "FACT_COUNT_MISMATCH": F.col("relation_count") != F.coalesce("_f", F.lit(0)),
    }, "projection_id")


def rebuilt(expected: DataFrame, stored: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(code, key) of what a rebuild (kind, key) lacks or has besides what the cached extractions give without the excluded
    facts, each of which must be one of theirs."""
    kept = expected.join(exclusions.select(F.lit("fact").alias("kind"), "key"), ["kind", "key"], "left_anti")
    name = F.concat(F.lit("RAW_PROJECTION_"), F.upper("kind"), F.lit("_MISMATCH"))
    apart = kept.select("kind", "key").exceptAll(stored.select("kind", "key")).unionByName(stored.select("kind", "key").exceptAll(kept.select("kind", "key")))
    unknown = exclusions.select("key").distinct().join(expected.where("kind = 'fact'").select("key"), "key", "left_anti")
    return apart.select(name.alias("code"), F.col("key").cast("string").alias("key")).unionByName(_rows(unknown, "FACT_EXCLUSION_KEY_INVALID", F.lit(True)))


def counted(problems: DataFrame) -> DataFrame:
    """(code, issues)."""
    return problems.groupBy("code").agg(F.count(F.lit(1)).alias("issues"))

"""Extracted relations against their evidence (G5, G6, G14-G16). All checks are columns over rows that carry the quote, the text
of the chunk it comes from, and the names and types of both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import allowed

# Signs that end a clause; how a condition in front begins, or where in it a word stands that makes it one; verbs
# that tell a field's owner; relations whose subject acts; relations that may state what is forbidden, and words that forbid.
CLAUSE_END = r"[。！？!?；;\n]"
CONDITION_HEAD = r"^(?:如果|必要时|尚缺少)|若(?!干)|如(?:有|改变|无法|不能|发现)|(?:时|后)$|(?<![临同及工小计])时(?![间长点限效段钟差区刻])|(?<!最)后(?![续台端勤备缀果])"
FIELD_VERB = r"包含|包括|含有|字段|填写|填入|写出|记录|保留|记载|列出|表头|栏[目位]|[|\t]"
ACTOR_RELATIONS = ("RESPONSIBLE_FOR", "REVIEWS", "CONFIRMS")
MAY_FORBID = ("GOVERNED_BY", "APPLIES_TO")
FORBIDDEN = r"而不是|不得|不能|不要|不应|禁止"
# A negated action between the ends of a path's relation, a condition in front of it, and the verb it needs.
NEGATED_BETWEEN = r"(?:不得|不能|不要|不应|不可|禁止|无需|无须|不必|不需要|不用|尚未|并未|未曾|不曾|没有|不再|未|不)[ \t]*(?:(?:直接|另行|重复|擅自|自行|再次)[ \t]*){0,3}(?:(?:提交|提供|填写|填入|填报|使用|需要|需|包含|包括|含有|负责|执行|办理|审核|复核|审查|确认|核实)|$)"
CONDITION_PIECE = r"^(?:如果|若(?!干)|如(?:有|改变|无法|不能|发现)|只有|只要|仅在|除非|必要时|尚缺少)|(?:时|后)$"
TRIGGERS = {
    "REQUIRES_MATERIAL": r"需要|需|提交|提供|填写|使用|填报|必须",
    "HAS_FIELD": r"包含|包括|含有|字段|填写|填入|表头|栏[目位]|[|\t]",
    "HAS_STEP": r"包含|包括|步骤|进行|办理|先|首先|然后|：|:",
    "RESPONSIBLE_FOR": r"负责|执行|办理",
    "REVIEWS": r"审核|复核|审查",
    "CONFIRMS": r"确认|核实",
}
LONGEST = 500


def at(text: Column, part: Column) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.call_function("instr", text, part) - 1


def piece(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))


def _last_clause(text: Column) -> Column:
    """What stands behind the last sign that ends a clause."""
    return F.element_at(F.split(text, CLAUSE_END), -1)


def evidence_issues() -> Column:
    """An array of what is wrong with a relation (predicate, subject_name, object_name, subject_type, object_type, quote,
    condition_text, content); empty if the quote supports it."""
    q, content, s, o = F.col("quote"), F.col("content"), F.col("subject_name"), F.col("object_name")
    condition = F.coalesce("condition_text", F.lit(""))
    begin = at(content, q)
    clause = F.trim(F.concat(_last_clause(piece(content, F.lit(0), begin)), q))
    head = F.split(clause, r"[，,。；;\n]")[0]
    actor, action = at(q, s), at(q, o)
    actor_inside = (action >= 0) & (action < actor) & (actor < action + F.char_length(o)) & ~F.contains(F.regexp_replace(q, r"由\s+", "由"), F.concat(F.lit("由"), s))
    acts = F.when(F.col("subject_type") == "Step", s).otherwise(o)
    up_to_action = F.concat(F.element_at(F.split(piece(content, F.lit(0), begin + at(q, acts)), r"[，,。！？!?；;\n]"), -1), acts)
    found = F.array(
        F.when(~F.contains(content, q), "QUOTE_NOT_IN_CHUNK"),
        F.when(~(F.contains(q, s) & F.contains(q, o)), "NAME_NOT_IN_QUOTE"),
        F.when(~F.contains(q, condition), "CONDITION_NOT_IN_QUOTE"),
        F.when((condition == "") & head.rlike(CONDITION_HEAD), "CONDITION_LEFT_OUT"),
        F.when((F.col("predicate") == "HAS_FIELD") & ~q.rlike(FIELD_VERB), "FIELD_WITHOUT_EVIDENCE"),
        F.when(F.col("predicate").isin(*ACTOR_RELATIONS) & actor_inside, "ACTOR_IS_OBJECT"),
        F.when(~F.col("predicate").isin(*MAY_FORBID) & up_to_action.rlike(FORBIDDEN), "NEGATED_ACTION"),
    )
    return F.array_compact(found)


def quote_holds(content: Column, digest: Column, quote: Column, start: Column, end: Column) -> Column:
    """The chunk is the one that was read (its hash), and the quote is exactly what stands at its offsets."""
    return F.coalesce((F.sha2(content, 256) == digest) & (piece(content, start, end) == quote), F.lit(False))


def held_evidence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence (chunk_id, content_sha256, quote, quote_start, quote_end, ...) that still stands in its chunk (chunk_id, content):
    the chunk is the one that was read and the quote is exactly at its offsets. Only such evidence goes into graph.one_hop()."""
    j = evidence.join(chunks.select("chunk_id", F.col("content").alias("_content")), "chunk_id")
    return j.where(quote_holds(F.col("_content"), F.col("content_sha256"), F.col("quote"), F.col("quote_start"), F.col("quote_end"))).drop("_content")


def well_formed() -> Column:
    """Keys are 64 hexadecimal digits, the seed is one of the ends, quotes and conditions have a length, a condition stands in
    the quote and offsets are as long as the quote. Types and scope are joins: see valid_relations()."""
    condition = F.coalesce("condition_text", F.lit(""))
    keys = [F.col(c).rlike("^[0-9a-f]{64}$") for c in ("assertion_id", "seed_uid", "subject_uid", "object_uid")]
    quote = F.char_length("quote").between(1, LONGEST) & (F.char_length(condition) <= LONGEST) & F.contains("quote", condition)
    offsets = (F.col("quote_start") >= 0) & (F.col("quote_end") == F.col("quote_start") + F.char_length("quote"))
    ok = F.col("seed_uid").isin(F.col("subject_uid"), F.col("object_uid")) & quote & offsets
    for k in keys:
        ok = ok & k
    return F.coalesce(ok, F.lit(False))


SCOPE = ["namespace", "tenant_id", "kb_id", "document_id", "revision_id", "generation_id"]


def valid_relations(relations: DataFrame, projections: DataFrame, seeds: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Relations in the scope of an authorised projection, from a seed (uid), with types that the predicate joins."""
    known = relations.where(well_formed()).join(projections.select(*SCOPE).distinct(), SCOPE, "left_semi")
    return allowed(known.join(seeds.select(F.col("uid").alias("seed_uid")).distinct(), "seed_uid", "left_semi"), whitelist)


def leading_condition(preceding: Column) -> Column:
    """The conditions in front of a relation, from the first to the last one, with what stands between; empty if there is none."""
    pieces = F.split(preceding, "[，,]")
    ends = F.transform(pieces, lambda p, i: F.struct(F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.char_length(x) + 1).alias("end"), F.char_length(p).alias("size"), F.trim(p).rlike(CONDITION_PIECE).alias("is")))
    hits = F.filter(ends, lambda e: e["is"])
    begin, end = hits[0]["end"] - 1 - hits[0]["size"], F.element_at(hits, -1)["end"] - 1
    return F.when(F.size(hits) > 0, F.trim(piece(preceding, begin, end))).otherwise("")


def strict_path_relation() -> Column:
    """Whether a relation may be a hop of a path: its evidence supports it, the subject stands before the object, no negated
    action between them, a condition in front is kept whole, and the verb (or, for reviews and confirmations, the object's
    beginning) fits the predicate. Needs G5's columns and quote_start."""
    q, s, o = F.col("quote"), F.col("subject_name"), F.col("object_name")
    start, end = at(q, s), at(q, o)
    between = piece(q, start + F.char_length(s), end)
    preceding = F.trim(_last_clause(piece(F.col("content"), F.lit(0), F.col("quote_start") + start)))
    condition = leading_condition(preceding)
    verb = F.lit(False)
    for predicate, pattern in TRIGGERS.items():
        fits = between.rlike(pattern)
        if predicate in ("REVIEWS", "CONFIRMS"):
            fits = fits | o.rlike(f"^(?:{pattern})")
        verb = verb | ((F.col("predicate") == predicate) & fits)
    ok = (F.size(evidence_issues()) == 0) & (start >= 0) & (end > start) & ~between.rlike(NEGATED_BETWEEN) & ((condition == "") | (condition == F.coalesce("condition_text", F.lit("")))) & verb
    return F.coalesce(ok, F.lit(False))


def salvaged_relations(relations: DataFrame, entities: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Relations (extraction_id, subject_id, object_id, predicate ...) both of whose ends are among the entities (extraction_id,
    local_id, type) that were kept, with types that the predicate joins."""
    e = entities.select("extraction_id", "local_id", "type")
    ends = relations
    for end in ("subject", "object"):
        ends = ends.join(e.toDF("extraction_id", f"{end}_id", f"{end}_type"), ["extraction_id", f"{end}_id"])
    return allowed(ends, whitelist)


# Roles that a cell may open with, and the columns of the two kinds of tables.
ROLES = "用人部门|接收人|管理员|经办人|主管|行政|人事|员工"
DUTY, TOPIC, MATERIAL, CARE = "办理岗位应做", "事项", "资料类型", "保管关注点"


def role_action(cell: Column) -> Column:
    """struct(actor, action, condition) of a cell "[... 后]由 roles action"; null if it does not open with a role. The last
    "后由" parts the condition."""
    conditional = cell.rlike("后由")
    condition = F.when(conditional, F.regexp_extract(cell, "(?s)^(.*后)由", 1))
    rest = F.when(conditional, F.regexp_extract(cell, "(?s)^.*后由(.*)$", 1)).otherwise(F.regexp_replace(cell, "^由", ""))
    pattern = rf"^((?:{ROLES})(?:与(?:{ROLES}))*)(.+)$"
    return F.when(rest.rlike(pattern), F.struct(F.regexp_extract(rest, pattern, 1).alias("actor"), F.regexp_extract(rest, pattern, 2).alias("action"), condition.alias("condition")))


def table_facts(rows: DataFrame) -> DataFrame:
    """(document_id, chunk_index, line_no, predicate, subject, object, condition_text) by rule from table rows (document_id,
    chunk_index, line_no, cells). A header holds for the rows behind it, over chunks too, that have as many cells."""
    w = Window.partitionBy("document_id").orderBy("chunk_index", "line_no")
    place, cells = ["document_id", "chunk_index", "line_no"], F.col("cells")
    is_header = (F.array_contains(cells, DUTY) & F.array_contains(cells, TOPIC)) | (F.array_contains(cells, MATERIAL) & F.array_contains(cells, CARE))
    # rows are sorted once, a header as the places of its columns; it has two cells at least, so rows of fewer give nothing
    columns = F.struct(F.size(cells).alias("size"), *[F.array_position(cells, name).cast("int").alias(c) for c, name in (("duty", DUTY), ("material", MATERIAL), ("care", CARE))])
    known = rows.where(F.exists(cells, lambda c: ~c.rlike("^[-:]+$")) & is_header.isNotNull() & (F.size(cells) > 1))
    r = known.select(*place, F.when(~is_header, cells).alias("cells"), F.when(is_header, columns).alias("_columns")).withColumn("_header", F.last("_columns", ignorenulls=True).over(w))
    r = r.where(F.col("_columns").isNull() & (F.col("_header.size") == F.size(cells)))
    cell = lambda c: F.get(cells, F.col(f"_header.{c}") - 1)
    r = r.select(*place, F.when(F.col("_header.duty") > 0, role_action(cell("duty"))).alias("_f"), F.when(F.col("_header.material") > 0, cell("material")).alias("_m"), cell("care").alias("_c"))
    fact = lambda predicate, subject, object_, condition: F.struct(F.lit(predicate).alias("predicate"), subject.alias("subject"), object_.alias("object"), condition.cast("string").alias("condition_text"))
    duty = F.when(F.col("_f").isNotNull(), fact("RESPONSIBLE_FOR", F.col("_f.actor"), F.col("_f.action"), F.col("_f.condition")))
    kept = F.when((F.length("_m") > 0) & (F.length("_c") > 0), fact("GOVERNED_BY", F.col("_m"), F.col("_c"), F.lit(None)))
    return r.select(*place, F.explode(F.array_compact(F.array(duty, kept))).alias("_t")).select(*place, "_t.*")
